"""Joins between reads and references: exact, masked, nearest and approximate.

Reference tables are dimensions of known size; ``small`` counts them and marks them for broadcast only within
``DIMENSION_ROWS`` and ``DIMENSION_BYTES``, and larger ones meet the reads in shuffled joins on the same keys.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import seq
from .lineage import settle, stored

DIMENSION_ROWS = 500_000
DIMENSION_BYTES = 64 << 20
#: Distinct spans of a bin that one group looks up.
BIN_SPANS = 1_000_000


def small(df: DataFrame, rows: int = DIMENSION_ROWS, size: int = DIMENSION_BYTES) -> DataFrame:
    n, held = df.limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and held <= size else df


def expand_degenerate(patterns: DataFrame, pattern: str, out: str) -> DataFrame:
    """Every n of a pattern as each of a, c, g and t, one place at a time (SEQ-02). All places are expanded, as many as the longest pattern has."""
    df = patterns.withColumn(out, F.col(pattern))
    bases = F.array(*[F.lit(b) for b in "acgt"])
    most = patterns.agg(F.max(F.length(F.regexp_replace(pattern, "[^n]", "")))).first()[0] or 0
    for _ in range(most):
        first = F.instr(out, "n")
        parts = F.transform(bases, lambda b: F.concat(F.substring(F.col(out), F.lit(1), first - 1), b, F.substring(F.col(out), first + 1, F.length(out))))
        df = df.withColumn(out, F.explode(F.when(first > 0, parts).otherwise(F.array(F.col(out)))))
    return df


def unambiguous(df: DataFrame, key: str, label: str) -> DataFrame:
    """Keys with exactly one distinct label (MAT-02)."""
    return df.groupBy(key).agg(F.count_distinct(label).alias("_n"), F.min(label).alias(label)).where("_n = 1").drop("_n")


def scan_kmers(reads: DataFrame, library: DataFrame, sequence: str, barcode: str, k: int, read: str, keep: list[str] | None = None) -> DataFrame:
    """Every occurrence of a barcode (as its reverse complement) in the reads: one row a hit (MAT-01)."""
    keyed = library.withColumn("_k", seq.reverse_complement(F.col(barcode)))
    windows = reads.select(read, *(keep or []), F.explode(seq.kmers(F.col(sequence), k)).alias("_k"))
    return windows.join(small(keyed), "_k").drop("_k")


def dictionary_hits(segments: DataFrame, words: DataFrame, segment: str, word: str, keys: list[str]) -> DataFrame:
    """``keys``, the columns of ``words`` and _p, the 0-based place, of every occurrence of a word in the segments: one pass over them, whatever lengths words have.

    Words are filed under their beginnings, as long as the shortest word. At each place of a segment that many letters fetch the
    words that may begin there, and the rest of the word is compared in place.
    """
    first = words.agg(F.min(F.length(word))).first()[0] or 1
    filed = small(words.where(F.length(word) > 0).withColumn("_begin", F.substring(word, 1, first)))
    windows = segments.select(*keys, F.col(segment).alias("_segment"), F.posexplode(seq.kmers(F.col(segment), first)).alias("_p", "_at"))
    met = windows.join(filed, F.col("_at") == F.col("_begin"))
    return met.where(F.substring(F.col("_segment"), F.col("_p") + 1, F.length(word)) == F.col(word)).drop("_segment", "_at", "_begin")


def best_substring(segments: DataFrame, candidates: DataFrame, segment: str, candidate: str, label: str, keys: list[str]) -> DataFrame:
    """The longest candidate a segment contains, then the leftmost, then the first by name; its end (MAT-03)."""
    listed = candidates.select(F.col(candidate).alias("_k"), label).distinct()
    hits = dictionary_hits(segments, listed, segment, "_k", keys)
    best = F.min(F.struct((-F.length("_k")).alias("len"), F.col("_p").alias("pos"), F.col(label).alias("label")))
    return hits.groupBy(*keys).agg(best.alias("_b")).select(*keys, F.col("_b.label").alias(label), (F.col("_b.pos") - F.col("_b.len")).alias("end"))


def two_ended(reads: DataFrame, fronts: DataFrame, backs: DataFrame, read: str, sequence: str, barcode: str, label: str, span: int = 50) -> DataFrame:
    """Front barcode in the first and back barcode in the last ``span`` letters, forwards or else reversed (MAT-04)."""
    both = reads.select(read, F.explode(F.array(F.struct(F.lit(0).alias("turned"), F.col(sequence).alias("oriented")), F.struct(F.lit(1).alias("turned"), seq.reverse_complement(F.col(sequence)).alias("oriented")))).alias("_o"))
    both = both.select(read, "_o.turned", "_o.oriented").withColumns({"_head": seq.head(F.col("oriented"), span), "_tail": seq.tail(F.col("oriented"), span)})
    keys = [read, "turned", "oriented"]
    front = best_substring(both, fronts, "_head", barcode, label, keys).withColumnsRenamed({label: "front", "end": "front_end"})
    back = best_substring(both, backs, "_tail", barcode, label, keys).select(*keys, F.col(label).alias("back"))
    met = front.join(back, keys)
    return met.groupBy(read).agg(F.min(F.struct("turned", "oriented", "front", "front_end", "back")).alias("_b")).select(read, "_b.*")


def longest_in_window(windows: DataFrame, dictionary: DataFrame, window: str, key: str, label: str, keys: list[str]) -> DataFrame:
    """Of the longest keys found in a window the label if they agree, else NULL; leftmost place (MAT-05)."""
    words = dictionary.select(F.col(key).alias("_k"), F.col(label).alias("_l"))
    hits = dictionary_hits(windows, words, window, "_k", keys).withColumn("_n", F.length("_k"))
    top = hits.withColumn("_m", F.max("_n").over(Window.partitionBy(*keys))).where("_n = _m")
    found = top.groupBy(*keys).agg(F.count_distinct("_l").alias("_d"), F.min("_l").alias(label), F.min("_p").alias("pos"), F.max("_n").alias("key_length"))
    return found.withColumn(label, F.when(F.col("_d") == 1, F.col(label))).drop("_d")


def conjunctive(df: DataFrame, features: list[str], umi: str) -> DataFrame:
    """Rows that have all features and then a UMI (MAT-06)."""
    both = F.col(umi).isNotNull()
    for f in features:
        both &= F.col(f).isNotNull()
    return df.where(both)


def conjunctive_funnel(df: DataFrame, features: list[str], umi: str) -> DataFrame:
    """How many rows have each feature, all of them, and a UMI on top: one pass (MAT-06, Q-05)."""
    every = F.lit(True)
    for f in features:
        every &= F.col(f).isNotNull()
    return df.agg(F.count("*").alias("reads"), *[F.count(f).alias(f"with_{f}") for f in features], F.count_if(every).alias("all_features"), F.count_if(every & F.col(umi).isNotNull()).alias("recorded"))


def orientation(rows: DataFrame, columns: dict[str, DataFrame]) -> DataFrame:
    """One row: matches of each column's dictionary read directly and reversed, of both columns together, and the choice (SEQ-21).

    ``columns`` names two columns and their dictionaries (one column each). Reversed is chosen only if more pairs match so.
    """
    names = list(columns)
    for c, words in columns.items():
        w = words.select(F.col(words.columns[0]).alias("_w")).distinct()
        for turned, key in (("direct", F.col("_w")), ("reversed", seq.reverse_complement(F.col("_w")))):
            side = w.select(key.alias(f"_{c}_{turned}_key")).withColumn(f"_{c}_{turned}", F.lit(True))
            rows = rows.join(small(side), F.col(c) == F.col(f"_{c}_{turned}_key"), "left").drop(f"_{c}_{turned}_key")
    hit = lambda c, turned: F.coalesce(F.col(f"_{c}_{turned}"), F.lit(False))
    single = [F.count_if(hit(c, t)).alias(f"{c}_{t}") for c in names for t in ("direct", "reversed")]
    both = [F.count_if(hit(names[0], t) & hit(names[1], t)).alias(f"both_{t}") for t in ("direct", "reversed")]
    out = rows.agg(F.count("*").alias("pairs"), *single, *both)
    return out.withColumn("selected", F.when(F.col("both_reversed") > F.col("both_direct"), "reversed").otherwise("direct"))


def masked_match(reads: DataFrame, library: list[tuple[str, str]], sequence: str, most: int = 3) -> DataFrame:
    """Library rows a read fits at position 0: upper-case places exactly, lower-case ones up to ``most`` mismatches (MAT-07).

    One pass over the reads for any number of patterns: a read gives one key for each distinct mask, its letters in the exact places,
    and meets the patterns of that mask by it. The other places are compared by bits where both are bases.
    """
    masks: dict[tuple, int] = {}
    rows = []
    for name, pattern in library:
        must, free = seq.case_pattern(pattern)
        mask = masks.setdefault((tuple(must), tuple(free)), len(masks))
        letters = lambda places: "".join(pattern[p].upper() for p in places)
        rows.append((mask, name, pattern, letters(must), letters(free)))
    pick = lambda c, places: F.concat(*[F.substring(c, F.lit(p + 1), F.lit(1)) for p in places]) if places else F.lit("")
    dim = reads.sparkSession.createDataFrame(rows, "_mask int, name string, pattern string, _key string, _free string").withColumn("_packed", seq.packed(F.col("_free")))
    upper = F.upper(F.col(sequence))
    long_enough = lambda places: F.length(sequence) >= max(places, default=-1) + 1
    keys = [F.when(long_enough([*must, *free]), F.struct(F.lit(i).alias("_mask"), pick(upper, must).alias("_key"), pick(upper, free).alias("_own"))) for (must, free), i in masks.items()]
    own = reads.withColumn("_m", F.explode(F.array_compact(F.array(*keys)))).select(*reads.columns, "_m.*").withColumn("_bits", seq.packed(F.col("_own")))
    met = own.join(small(dim), ["_mask", "_key"]).withColumn("mismatches", seq.distance(F.col("_own"), F.col("_free"), F.col("_bits"), F.col("_packed")))
    return met.where(F.col("mismatches") <= most).select(*reads.columns, "name", "pattern", "mismatches")


def nearest(queries: DataFrame, references: DataFrame, sequence: str, reference: str, label: str, length: int, most: int = 2) -> DataFrame:
    """Each distinct query's one nearest reference within ``most`` mismatches; ties and odd letters give no row (MAT-08)."""
    clean = queries.select(F.col(sequence).alias("query")).distinct().where((F.length("query") == length) & F.col("query").rlike("^[ACGT]*$"))
    seeds = lambda df, c: df.withColumns({"_s": F.explode(seq.seed_chunks(F.col(c), length, most)), f"_{c}": seq.packed(F.col(c))})
    refs = seeds(references.select(F.col(reference).alias("reference"), label).where(F.length("reference") == length), "reference")
    met = seeds(clean, "query").join(small(refs), "_s").drop("_s").distinct()
    near = met.withColumn("distance", seq.distance(F.col("query"), F.col("reference"), F.col("_query"), F.col("_reference"))).where(F.col("distance") <= most)
    best = near.withColumn("_m", F.min("distance").over(Window.partitionBy("query"))).where("distance = _m")
    found = best.groupBy("query").agg(F.count("*").alias("_n"), F.min(label).alias(label), F.min("distance").alias("distance"))
    return found.where("_n = 1").drop("_n")


def _covering(features: pd.DataFrame, spans: pd.DataFrame, kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which spans overlap a feature, and the least and the greatest code of the features they overlap).

    Features' ends cut the axis into segments. A feature is noted at two runs of segments, as long as a power of two, that cover it; notes are handed
    down to the halves of their runs until each segment has its own. Least codes of a span are then read off two runs again.
    """
    cuts = np.unique(np.concatenate([features["_s"], features["_e"]]))
    first, last = (np.searchsorted(cuts, features[c]) for c in ("_s", "_e"))
    begin = np.maximum(np.searchsorted(cuts, spans["_s"], "right") - 1, 0)
    end = np.minimum(np.searchsorted(cuts, spans["_e"], "left"), len(cuts) - 1)
    met = np.flatnonzero(begin < end)
    begin, end = begin[met], end[met]
    power = lambda n: np.frexp(n)[1] - 1  # noqa: E731  of the greatest power of two that is no longer
    none = np.iinfo(kind).max

    def least(codes: np.ndarray) -> np.ndarray:
        table = np.full((int(power(len(cuts) - 1)) + 1, len(cuts) - 1), none, kind)
        k = power(last - first)
        for at in (first, last - (1 << k)):
            np.minimum.at(table, (k, at), codes)
        for j in range(len(table) - 1, 0, -1):
            half = 1 << (j - 1)
            np.minimum(table[j - 1], table[j], out=table[j - 1])
            np.minimum(table[j - 1, half:], table[j, :-half], out=table[j - 1, half:])
        for j in range(1, len(table)):
            half = 1 << (j - 1)
            table[j] = table[j - 1]
            table[j, :-half] = np.minimum(table[j - 1, :-half], table[j - 1, half:])
        k = power(end - begin)
        return np.minimum(table[k, begin], table[k, end - (1 << k)])

    low, high = least(features["_low"].to_numpy(kind)), -least(-features["_high"].to_numpy(kind))
    some = low != none
    return met[some], low[some], high[some]


def overlaps(blocks: DataFrame, features: DataFrame, keys: list[str], feature: str, chrom: str = "chrom", bin_size: int = 16384, spans: int = BIN_SPANS) -> DataFrame:
    """For each read what its blocks overlap (half-open): status counted, no_feature or ambiguous, and the feature if it is alone (MAT-11).

    Whether a read has one feature is told by the least and the greatest that its blocks overlap, so pairs of reads and features are never made. Distinct spans
    of blocks meet the features of their bins, and a bin of more than ``spans`` of them is dealt over several groups; a bin's least and greatest
    feature under any span are looked up in a table of its segments. Blocks fetch what their span has found.
    """

    def bins(start, end):
        return F.explode(F.sequence(F.floor(start / bin_size), F.floor((end - 1) / bin_size)))

    kinds, named = dict(blocks.dtypes), dict(features.dtypes)[feature]
    wide = blocks.where((F.col("end") > F.col("start")) & F.col(chrom).isNotNull())
    distinct = wide.select(F.col(chrom).alias("_c"), F.col("start").alias("_s"), F.col("end").alias("_e")).distinct()
    asked = stored(distinct.withColumn("_b", bins(F.col("_s"), F.col("_e"))))
    parts = small(settle(asked.groupBy("_c", "_b").agg(F.ceil(F.count("*") / spans).cast("int").alias("_n"))))
    f = features.where("end > start").where(F.col(feature).isNotNull()).groupBy(F.col(chrom).cast(kinds[chrom]).alias("_c"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    f = f.agg(F.min(feature).alias("_low"), F.max(feature).alias("_high")).withColumn("_b", bins(F.col("_s"), F.col("_e")))
    held = f.join(parts, ["_c", "_b"]).withColumn("_p", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).drop("_n")
    dealt = asked.join(parts, ["_c", "_b"]).withColumn("_p", F.pmod(F.xxhash64("_s", "_e"), F.col("_n")).cast("int")).drop("_n")
    group = ["_c", "_b", "_p"]

    def look(key, own: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        columns = ["_c", "_s", "_e", "_low", "_high"]
        if not len(own) or not len(there):
            return pd.DataFrame(columns=columns)
        codes, values = pd.factorize(pd.concat([own["_low"], own["_high"]], ignore_index=True), sort=True)
        # what lies beyond the bin is another bin's
        low, high = key[1] * bin_size, (key[1] + 1) * bin_size
        clipped = own.assign(_s=own["_s"].clip(lower=low), _e=own["_e"].clip(upper=high), _low=codes[: len(own)], _high=codes[len(own) :])
        at, least, most = _covering(clipped, pd.DataFrame({"_s": there["_s"].clip(lower=low), "_e": there["_e"].clip(upper=high)}), np.int32)
        return there.iloc[at][["_c", "_s", "_e"]].assign(_low=values[least], _high=values[most])

    schema = f"_c {kinds[chrom]}, _s {kinds['start']}, _e {kinds['end']}, _low {named}, _high {named}"
    met = held.groupBy(group).cogroup(dealt.groupBy(group)).applyInPandas(look, schema)
    best = met.groupBy("_c", "_s", "_e").agg(F.min("_low").alias("_low"), F.max("_high").alias("_high"))
    own = (F.col(chrom) == F.col("_c")) & (F.col("start") == F.col("_s")) & (F.col("end") == F.col("_e"))
    found = blocks.join(best, own, "left").groupBy(*keys).agg(F.min("_low").alias("_low"), F.max("_high").alias("_high"))
    status = F.when(F.col("_low").isNull(), "no_feature").when(F.col("_low") == F.col("_high"), "counted").otherwise("ambiguous")
    return found.select(*keys, status.alias("status"), F.when(F.col("_low") == F.col("_high"), F.col("_low")).alias(feature))


def outlined(features: DataFrame, feature: str, chrom: str = "chrom", bin_size: int = 16384) -> DataFrame:
    """Stretches of each chromosome that have a feature, apart from one another: _c, _s, _e and the least and greatest feature (_low, _high) all along it. Bins are outlined by themselves."""
    f = features.where("end > start").where(F.col(feature).isNotNull() & F.col(chrom).isNotNull()).groupBy(F.col(chrom).alias("_c"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    f = f.agg(F.min(feature).alias("_low"), F.max(feature).alias("_high")).withColumn("_b", F.explode(F.sequence(F.floor(F.col("_s") / bin_size), F.floor((F.col("_e") - 1) / bin_size))))
    kinds = dict(f.dtypes)

    def outline(key, own: pd.DataFrame) -> pd.DataFrame:
        low, high = key[1] * bin_size, (key[1] + 1) * bin_size
        codes, values = pd.factorize(pd.concat([own["_low"], own["_high"]], ignore_index=True), sort=True)
        clipped = pd.DataFrame({"_s": own["_s"].clip(lower=low), "_e": own["_e"].clip(upper=high), "_low": codes[: len(own)], "_high": codes[len(own) :]})
        cuts = np.unique(np.concatenate([clipped["_s"], clipped["_e"]]))
        at, least, most = _covering(clipped, pd.DataFrame({"_s": cuts[:-1], "_e": cuts[1:]}), np.int32)
        new = np.ones(len(at), bool)  # neighbours alike are one stretch
        new[1:] = (np.diff(at) != 1) | (np.diff(least) != 0) | (np.diff(most) != 0)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(at)) - 1
        return pd.DataFrame({"_c": key[0], "_s": cuts[at[first]], "_e": cuts[at[last] + 1], "_low": values[least[first]], "_high": values[most[first]]})

    return f.groupBy("_c", "_b").applyInPandas(outline, f"_c {kinds['_c']}, _s {kinds['_s']}, _e {kinds['_e']}, _low {kinds['_low']}, _high {kinds['_high']}")


class Outline:
    """Collected rows of ``outlined``: what spans meet, by two runs of stretches as long as a power of two. Longer runs are made when a span needs them."""

    def __init__(self, rows: pd.DataFrame):
        self.chroms = {c: i for i, c in enumerate(rows["_c"].unique())}
        rows = rows.assign(_c=rows["_c"].map(self.chroms)).sort_values(["_c", "_s"], ignore_index=True)
        codes, self.features = pd.factorize(pd.concat([rows["_low"], rows["_high"]], ignore_index=True), sort=True)
        self.begins, self.ends = (self.place(rows["_c"].to_numpy(np.int64), rows[c].to_numpy(np.int64)) for c in ("_s", "_e"))
        self.none = len(self.features)
        self.least, self.most = [codes[: len(rows)].astype(np.int32)], [codes[len(rows) :].astype(np.int32)]

    @staticmethod
    def place(chrom: np.ndarray, at: np.ndarray) -> np.ndarray:
        return (chrom << 33) + at

    def meet(self, chrom: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and the greatest code of ``features`` under each span; ``none`` and -1 without any. A chromosome that the outline lacks is -1."""
        low, high = np.full(len(start), self.none, np.int32), np.full(len(start), -1, np.int32)
        first = np.searchsorted(self.ends, self.place(chrom, start), "right")
        last = np.searchsorted(self.begins, self.place(chrom, end), "left")
        met = np.flatnonzero((last > first) & (end > start) & (chrom >= 0))
        first, last = first[met], last[met]
        power = np.frexp(last - first)[1] - 1
        while len(met) and len(self.least) <= power.max():
            half = 1 << (len(self.least) - 1)
            for table, of in ((self.least, np.minimum), (self.most, np.maximum)):
                longer = table[-1].copy()
                longer[:-half] = of(table[-1][:-half], table[-1][half:])
                table.append(longer)
        for k in np.unique(power):
            own = power == k
            a, b = first[own], last[own] - (1 << int(k))
            low[met[own]] = np.minimum(self.least[k][a], self.least[k][b])
            high[met[own]] = np.maximum(self.most[k][a], self.most[k][b])
        return low, high


def outline_of(features: DataFrame, feature: str, chrom: str = "chrom", bin_size: int = 16384, rows: int = DIMENSION_ROWS, size: int = DIMENSION_BYTES) -> Outline | None:
    """The features' outline if it is a small dimension, as ``small`` has it; else None."""
    out = settle(outlined(features, feature, chrom, bin_size))
    n, held = out.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0))).first()
    return Outline(out.toPandas()) if n <= rows and held <= size else None


def context_pattern(barcodes: Iterable[str], left: str, right: str, edits: int = 1) -> str:
    """Alternation of the barcodes in their context and of the reverse complements, with an edit budget (MAT-09)."""
    comp = str.maketrans("ACGTN", "TGCAN")
    forms = [f"{left}{b}{right}" for b in barcodes]
    forms += [f.translate(comp)[::-1] for f in forms]
    return "(?:" + "|".join(forms) + f"){{e<={edits}}}"


def best_context(reads: Column, groups: dict[str, list[str]], left: str = "GGAGT", right: str = "TCGGC", edits: int = 1) -> Column:
    """The group whose context matches a read best (fewest edits, then the first group); NULL without a match (MAT-09)."""
    patterns = {name: context_pattern(barcodes, left, right, edits) for name, barcodes in groups.items()}

    @F.pandas_udf("string")
    def find(texts: pd.Series) -> pd.Series:
        import regex

        compiled = [(name, regex.compile(p, regex.BESTMATCH)) for name, p in patterns.items()]

        def one(text):
            found = [(sum(m.fuzzy_counts), i, name) for i, (name, r) in enumerate(compiled) if (m := r.search(text or ""))]
            return min(found)[2] if found else None

        return texts.map(one)

    return find(reads)


def approximate_count(reads: Column, barcode: str, edits: int = 1) -> Column:
    """Occurrences without overlap of a barcode within ``edits`` (MAT-10)."""

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        import regex

        r = regex.compile(f"(?:{regex.escape(barcode)}){{e<={edits}}}")
        return texts.map(lambda t: sum(1 for _ in r.finditer(t or "")))

    return count(reads)
