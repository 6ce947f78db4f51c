"""Bounded iterations: UMI collapse, decontamination, barcode correction."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import combinations, groupby
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import seq, special
from .graph import components
from .lineage import settle
from .ranks import running_counts
from .stats import benjamini_hochberg, overdispersion


def collapse_umis(counts: DataFrame, key: str, umi: str, count: str, length: int, ratio: int = 10, most: int = 3) -> DataFrame:
    """UMIs attach to the nearest more frequent one, and counts go to the roots (ITER-01).

    A parent has at least ``ratio`` times the count and at most ``most`` mismatches; the nearest wins, then the most
    frequent, then the first by name. Parents are sought through shared seeds and the magnitudes above the child's, so a
    key with very many UMIs is dealt over both, and UMIs of one magnitude never meet. Each step multiplies the count by ``ratio``, so the chain has at most log(largest count) steps and the
    jumps to the root are unrolled. Rows without a key or a UMI are no one's neighbours and stay as they are, summed like any.
    """
    summed = settle(counts.groupBy(key, umi).agg(F.sum(count).alias(count)))
    named = F.col(key).isNotNull() & F.col(umi).isNotNull()
    rows, unnamed = summed.where(named), summed.where(~named)
    largest = rows.agg(F.max(count)).first()[0] or 1
    level = lambda c: F.floor(F.log(float(ratio), c) + 1e-9).cast("int")  # noqa: E731  a parent is a level higher at least
    top = int(math.log(max(largest, 1), ratio) + 1e-9)
    seeds = rows.withColumns({"_s": F.explode(seq.seed_chunks(F.col(umi), length, most)), "_l": level(F.col(count)), "_bits": seq.packed(F.col(umi))})
    child = seeds.where(F.col("_l") < top).select(key, "_s", F.col(umi).alias("child"), F.col(count).alias("_c"), F.col("_bits").alias("_cb"), F.explode(F.sequence(F.col("_l") + 1, F.lit(top))).alias("_l"))
    parent = seeds.select(key, "_s", "_l", F.col(umi).alias("parent"), F.col(count).alias("_p"), F.col("_bits").alias("_pb"))
    met = child.join(parent, [key, "_s", "_l"]).where(F.col("_p") >= ratio * F.col("_c")).where("child != parent").withColumn("_d", seq.distance(F.col("child"), F.col("parent"), F.col("_cb"), F.col("_pb")))
    best = met.where(F.col("_d") <= most).groupBy(key, "child").agg(F.min(F.struct("_d", (-F.col("_p")).alias("p"), "parent")).alias("_b"))
    links = rows.join(best.select(key, F.col("child").alias(umi), F.col("_b.parent").alias("up")), [key, umi], "left")
    links = settle(links.withColumn("root", F.coalesce("up", umi)))
    steps = max(1, math.ceil(math.log(max(largest, 2), ratio)))
    for _ in range(max(1, math.ceil(math.log2(steps + 1)))):  # pointer jumping doubles the reach
        up = links.select(F.col(key), F.col(umi).alias("root"), F.col("root").alias("_next"))
        links = links.join(up, [key, "root"]).withColumn("root", F.col("_next")).drop("_next")
        links = links.select(key, umi, count, "root")
    return settle(links.unionByName(unnamed.select(key, umi, count, F.col(umi).alias("root"))))


def collapsed_counts(links: DataFrame, key: str, count: str) -> DataFrame:
    """Counts by root."""
    return links.groupBy(key, F.col("root").alias("umi")).agg(F.sum(count).alias(count), F.count("*").alias("members"))


@dataclass(frozen=True)
class DecontaminationSettings:
    """Fixed values that results depend on."""

    pseudocount: float = 0.5
    min_recipient_count: int = 100
    min_enrichment: float = 5.0
    min_excess: float = 100.0
    fdr: float = 0.01
    min_barcode_total: int = 10
    min_donor_ids: int = 10
    rounds: int = 10
    rho_cap: float = 0.2
    hard_cutoff: int | None = 2000


def decontamination_input(donor: DataFrame, recipient: DataFrame, settings: DecontaminationSettings = DecontaminationSettings()) -> DataFrame:
    """Recipient pairs (barcode, cell_id, count) with the donor's counts and supports, before the first round."""
    mine = donor.groupBy("barcode", "cell_id").agg(F.sum("count").alias("donor_count"))
    totals = donor.groupBy("barcode").agg(F.sum("count").alias("donor_total"), F.count_distinct("cell_id").alias("donor_n_ids"))
    rows = recipient.withColumnRenamed("count", "recipient_count").join(mine, ["barcode", "cell_id"], "left").join(totals, "barcode", "left")
    rows = rows.na.fill(0, ["donor_count", "donor_total", "donor_n_ids"])
    alone = F.sum((F.col("donor_count") == 0).cast("long")).over(Window.partitionBy("barcode"))
    rows = rows.withColumn("support_n_ids", F.col("donor_n_ids") + alone)
    share = (F.col("donor_count") + settings.pseudocount) / (F.col("donor_total") + settings.pseudocount * F.col("support_n_ids"))
    hard = F.lit(False) if settings.hard_cutoff is None else F.col("recipient_count") > settings.hard_cutoff
    return rows.withColumns({"p": share, "hard": hard}).withColumn("clean_count", F.when(F.col("hard"), 0).otherwise(F.col("recipient_count")))


def decontamination_candidates(rows: DataFrame, settings: DecontaminationSettings = DecontaminationSettings()) -> DataFrame:
    """One round's expectation, enrichment and candidates; no p-values yet (ITER-02)."""
    total = F.sum("clean_count").over(Window.partitionBy("barcode"))
    rows = rows.withColumn("barcode_total", total).withColumn("expected", F.col("barcode_total") * F.col("p"))
    rows = rows.withColumn("enrichment", (F.col("clean_count") + settings.pseudocount) / (F.col("expected") + settings.pseudocount))
    tested = (
        ~F.col("hard") & (F.col("barcode_total") >= settings.min_barcode_total) & (F.col("donor_n_ids") >= settings.min_donor_ids) & (F.col("donor_total") > 0)
        & (F.col("clean_count") >= settings.min_recipient_count) & (F.col("clean_count") - F.col("expected") >= settings.min_excess) & (F.col("enrichment") >= settings.min_enrichment)
    )
    return rows.withColumn("candidate", tested)


def decontaminate(donor: DataFrame, recipient: DataFrame, settings: DecontaminationSettings = DecontaminationSettings()) -> tuple[DataFrame, float, int]:
    """(rows with clean_count, flagged and the last round's statistics; rho; rounds) (ITER-02, Q-43)."""
    tail = special.betabinomial_udf()
    rows = settle(decontamination_input(donor, recipient, settings).withColumns({"stat_flagged": F.lit(False), "last_flag_round": F.lit(0)}))

    def rho_of(df: DataFrame) -> float:
        with_totals = df.withColumn("_n", F.sum("clean_count").over(Window.partitionBy("barcode")) if "barcode_total" not in df.columns else F.col("barcode_total"))
        eligible = (F.col("donor_n_ids") >= settings.min_donor_ids) & ~F.col("hard") & ~F.col("stat_flagged")
        return overdispersion(with_totals, "clean_count", "_n", "p", eligible, cap=settings.rho_cap).first()[0]

    rho, done = rho_of(rows), 0
    for done in range(1, settings.rounds + 1):
        state = decontamination_candidates(rows.drop("barcode_total", "expected", "enrichment", "candidate", "p_value", "q_value"), settings)
        tested = state.withColumn("p_value", F.when(F.col("candidate"), tail(F.when(F.col("candidate"), F.col("clean_count")), F.when(F.col("candidate"), F.col("barcode_total")), F.col("p"), F.lit(rho))))
        adjusted = benjamini_hochberg(tested, "p_value", "q_value")
        now = F.col("candidate") & (F.coalesce("q_value", F.lit(1.0)) <= settings.fdr)
        rows = settle(
            adjusted.withColumn("_now", now).withColumns(
                {
                    "_changed": F.col("_now") & (F.col("clean_count") != 0),
                    "stat_flagged": F.col("stat_flagged") | F.col("_now"),
                    "last_flag_round": F.when(F.col("_now"), done).otherwise(F.col("last_flag_round")),
                    "clean_count": F.when(F.col("_now"), 0).otherwise(F.col("clean_count")),
                    "p_value": F.coalesce("p_value", F.lit(1.0)),
                    "q_value": F.coalesce("q_value", F.lit(1.0)),
                }
            )
        )
        rho = rho_of(rows)
        if not rows.where("_changed").limit(1).count():
            break
    flagged = rows.drop("_now", "_changed").withColumn("flagged", F.col("hard") | F.col("stat_flagged"))
    return flagged.withColumn("removed_count", F.col("recipient_count") - F.col("clean_count")), rho, done


def merge_barcodes(cell: str, rows: pd.DataFrame, most: int = 2, least_reads: int = 10) -> tuple[list[tuple], list[tuple]]:
    """One cell's barcodes merged, least supported first, into the best supported barcode alike (ITER-03).

    rows: barcode, umi, reads, feature, identity. Alike is within ``most`` mismatches and of the same identity. After
    each merge the order is taken anew. Returns the kept (barcode, feature, umis, reads) and the events.
    """
    return _merged(rows[["barcode", "umi", "reads", "feature", "identity"]].itertuples(index=False, name=None), most, least_reads)


def _merged(rows: Iterable[tuple], most: int, least_reads: int) -> tuple[list[tuple], list[tuple]]:
    umis, reads, identity = {}, {}, {}
    by_feature: dict[str, dict] = {}
    for b, u, n, f, i in rows:
        umis.setdefault(b, set()).add(u)
        reads[b] = reads.get(b, 0) + int(n)
        identity[b] = i if isinstance(i, str) and i else None
        held = by_feature.setdefault(b, {}).setdefault(f, [set(), 0])
        held[0].add(u)
        held[1] += int(n)
    support = lambda b: (len(umis[b]), reads[b], b)
    apart = lambda a, b: sum(x != y for x, y in zip(a, b))
    events: list[tuple] = []
    # barcodes alike share a mask, so a barcode's neighbours are found without comparing it with all others
    masks = lambda b: ["".join("*" if i in hidden else x for i, x in enumerate(b)) for hidden in combinations(range(len(b)), min(most, len(b)))]
    filed: dict[tuple, set] = {}
    for b in umis:
        if identity[b] is not None:
            for m in masks(b):
                filed.setdefault((identity[b], m), set()).add(b)

    def neighbours(b: str) -> set:
        return set().union(*[filed[identity[b], m] for m in masks(b)]) - {b}

    # neighbours only ever go, so a barcode without any is done with; a stale entry of the heap is skipped
    waiting = [support(b) for b in umis if identity[b] is not None and neighbours(b)]
    heapq.heapify(waiting)
    while waiting:
        entry = heapq.heappop(waiting)
        low = entry[2]
        if low not in umis or support(low) != entry or not (near := neighbours(low)):
            continue
        high = max(near, key=support)
        shared = len(umis[low] & umis[high])
        before = (len(umis[low]), len(umis[high]), reads[low], reads[high])
        umis[high] |= umis.pop(low)
        reads[high] += reads.pop(low)
        for m in masks(low):
            filed[identity[low], m].discard(low)
        for f, (u, n) in by_feature.pop(low).items():
            held = by_feature[high].setdefault(f, [set(), 0])
            held[0] |= u
            held[1] += n
        events.append((len(events) + 1, low, high, apart(low, high), *before, shared, len(umis[high]), reads[high]))
        heapq.heappush(waiting, support(high))
    kept = []
    for b in sorted(umis):
        if reads[b] > least_reads:
            feature = max(by_feature[b].items(), key=lambda x: (len(x[1][0]), x[1][1], x[0]))[0]
            kept.append((b, feature, len(umis[b]), reads[b]))
    return kept, events


def barcode_components(rows: DataFrame, length: int, most: int = 2) -> DataFrame:
    """cell, barcode and component (its first barcode) of the barcodes that have one of their identity alike in their cell (ITER-03)."""
    named = rows.where("cell is not null and barcode is not null and identity is not null and identity != ''")
    masks = named.select("cell", "barcode", "identity").distinct().withColumn("_k", F.explode(seq.mask_keys(F.col("barcode"), length, most)))
    # a mask's barcodes differ in its hidden places alone, so there are few of them
    hub = F.min("barcode").over(Window.partitionBy("cell", "identity", "_k"))
    node = lambda c: F.struct("cell", F.col(c).alias("barcode"))
    edges = masks.withColumn("_hub", hub).where("barcode != _hub").select(node("barcode").alias("a"), node("_hub").alias("b"))
    return components(edges).select("node.cell", "node.barcode", F.col("component.barcode").alias("component"))


def correct_barcodes(rows: DataFrame, length: int, most: int = 2, least_reads: int = 10) -> tuple[DataFrame, DataFrame]:
    """(corrected counts, merge events) of all cells (ITER-03, Q-15). rows: cell, barcode, umi, reads, feature, identity.

    A merge never leaves a connected component of barcodes alike, so components are what enters Python, each by itself, however many
    barcodes a cell has; all other barcodes are aggregated as they are. Within a component candidates are merged by rising support, which only grows, and
    so a cell's events stand in the order of their candidates' support, as if the cell had been merged as one.
    """
    busy = settle(barcode_components(rows, length, most))
    kind = "kind string, cell string, barcode string, other string, feature string, umis long, reads long, distance long, low_umis long, low_reads long"

    def merge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Components one after the other as they are sorted, of which only the one at hand is held."""
        names = [x.split()[0] for x in kind.split(", ")]
        told = (row for pdf in frames for row in pdf.itertuples(index=False, name=None))
        out: list[tuple] = []
        for (cell, _), group in groupby(told, itemgetter(0, 1)):
            kept, events = _merged((row[2:] for row in group), most, least_reads)
            out += [("kept", cell, b, None, f, u, n, None, None, None) for b, f, u, n in kept]
            out += [("event", cell, e[1], e[2], None, e[9], e[10], e[3], e[4], e[6]) for e in events]
            if len(out) >= 10_000:
                yield pd.DataFrame(out, columns=names).astype({c: "Int64" for c in names[5:]})
                out = []
        yield pd.DataFrame(out, columns=names).astype({c: "Int64" for c in names[5:]})

    # a component is some rows, too few for a call of its own
    near = rows.join(busy, ["cell", "barcode"]).select("cell", "component", "barcode", "umi", F.col("reads").cast("long"), "feature", "identity")
    merged = settle(near.repartition("cell", "component").sortWithinPartitions("cell", "component").mapInPandas(merge, kind))
    quiet = rows.join(busy, ["cell", "barcode"], "left_anti")
    per = quiet.groupBy("cell", "barcode", "feature").agg(F.count_distinct("umi").alias("u"), F.sum("reads").alias("r"))
    label = per.groupBy("cell", "barcode").agg(F.max(F.struct("u", "r", "feature")).alias("_b"))
    whole = quiet.groupBy("cell", "barcode").agg(F.count_distinct("umi").alias("umis"), F.sum("reads").alias("reads")).where(F.col("reads") > least_reads)
    plain = whole.join(label, ["cell", "barcode"]).select("cell", "barcode", F.col("_b.feature").alias("feature"), "umis", "reads")
    kept = merged.where("kind = 'kept'").select("cell", "barcode", "feature", "umis", "reads")
    support = F.struct("low_umis", "low_reads", "barcode")
    events = running_counts(settle(merged.where("kind = 'event'").withColumns({"_o": support, "n": F.lit(1)})), ["cell"], "_o")
    events = events.select("cell", (F.col("below") + 1).alias("seq"), F.col("barcode").alias("candidate"), F.col("other").alias("seed"), "distance", "umis", "reads")
    return kept.unionByName(plain), events
