"""Removing near-duplicates: one document of each group of texts alike stays.

Two texts are alike if their sets of five-word shingles have a Jaccard similarity of 0.8 or more. Candidates come
from two sources. The SimHash of the shingle set is met by its Golay-code keys (``simhash.golay_links``): texts whose
fingerprints differ in three bits or fewer. At 0.8 some ten of 64 bits differ, so those keys alone would lose
most pairs near the bound; MinHash of the same shingles finds them, and as only the similarity counts there, it does
not matter where or how a text was edited: ``BANDS`` bands of ``ROWS`` values each are keys, and two texts that share
one are linked if ``MATCHES`` of the four-bit ends of ``SKETCH`` values agree. A pair at 0.8 shares no band with
probability 8e-11 and fails the second test with less than 1e-10 (Chernoff), a closer pair more rarely. With
``exact`` no pair is left to chance: texts alike share one of the first fifth of their shingles in order of the hash
(prefix filter), and those are keys as well. Groups of candidates are then compared by their shingle sets, exactly.

Equal texts (by 128 bits of their words' hash) are one node from the start. A group's sets are read together; from a
group of m fewer than m links are kept, found by searching from each text among those not reached. In a group above
``GROUP`` texts or ``GROUP_BYTES`` of sets each text is compared with one of its candidates first. What they join is
one class for certain, so only the texts outside a group's largest class have to meet others: the largest is dealt once in
blocks, and the rest, a few in groups of near copies, meets each block. The document with the least id of each class
stays.

Defined results: null and empty texts have no words and are equal; a text of fewer than five words is one shingle;
a null id sorts first; of repeated rows one stays; an empty table stays empty; all columns are kept, whatever they
are called; ids may be of any type that can be compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .runtime import cut, fresh, small_batches, tidy, utf8
from .simhash import golay_links, in_runs, joining_links, majority, of_counts

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 44, 4
#: Of so many MinHash values four bits each are kept; candidates agree in MATCHES of them or more.
SKETCH, MATCHES = 128, 70
#: A band's key that more texts share is dealt in pairs of blocks.
BLOCK = 8192
GROUP = 256
GROUP_BYTES = 16 << 20
#: Up to this many keys (some 16 bytes each) are broadcast; beyond it joins are shuffled.
BROADCAST_KEYS = 1_000_000


@cache
def draws() -> list[np.ndarray]:
    """What the hash functions (x ^ a) * b and the bands' keys are made of: fixed random 64-bit numbers, factors odd."""
    rng = np.random.default_rng(5)
    a, b, c, e = (rng.integers(0, 1 << 64, n, np.uint64) for n in (BANDS * ROWS, BANDS * ROWS, ROWS, BANDS))
    return [a, b | np.uint64(1), c | np.uint64(1), e]


def min_hashes(shingles: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a set of shingles."""
    a, b, *_ = draws()
    out = np.full(len(a), np.iinfo(np.uint64).max)
    for low in range(0, len(shingles), 64):
        part = shingles[low : low + 64].view(np.uint64)[:, None] ^ a
        part *= b
        np.minimum(out, part.min(axis=0), out=out)
    return out


def sketch(shingles: np.ndarray) -> bytes:
    """The keys of all bands, then the four-bit ends; nothing for a text without words."""
    if not len(shingles):
        return b""
    *_, c, e = draws()
    least = min_hashes(shingles)
    keys = (least.reshape(BANDS, ROWS) * c).sum(axis=1, dtype=np.uint64) + e
    ends = (least[:SKETCH] >> np.uint64(24) & np.uint64(15)).reshape(-1, 16) << np.arange(0, 64, 4, dtype=np.uint64)
    return np.concatenate([keys, ends.sum(axis=1, dtype=np.uint64)]).astype("<u8").tobytes()


def matches(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many of the four-bit ends the rows of two arrays agree."""
    apart = a ^ b
    apart |= apart >> np.uint64(2)
    apart |= apart >> np.uint64(1)
    return SKETCH - np.bitwise_count(apart & np.uint64(0x1111111111111111)).sum(axis=-1, dtype=np.int64)


def words_hash(words: list[bytes]) -> bytes:
    """128 bits that stand for a text."""
    import xxhash

    return xxhash.xxh3_128_digest(b" ".join(words), 3)


def shingle_set(words: list[bytes]) -> np.ndarray:
    """Sorted distinct hashes of the five-word shingles."""
    import xxhash

    if not words:
        return np.zeros(0, np.int64)
    grams = map(b" ".join, zip(*[words[i:] for i in range(min(SHINGLE, len(words)))]))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(g) for g in grams), np.uint64).view(np.int64))


def prefix(shingles: np.ndarray) -> np.ndarray:
    """Shingles of which texts alike share one: the first of each set in one order, some fifth of it."""
    return shingles[: len(shingles) - math.ceil(SIMILARITY * len(shingles) - 1e-9) + 1]


def sketches(docs: DataFrame, exact: bool = False) -> DataFrame:
    """(doc_id, th, word_hash, sketch, n, f0, heads) of every document; th is the text's own hash, n counts shingles, f0 is their SimHash."""
    small_batches(docs.sparkSession)
    names = ["doc_id", "th", "word_hash", "sketch", "n", "f0", "heads"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidy(batches):
            rows = []
            for text in batch.column(2):  # one at a time: a batch's words take many times its bytes
                words = (text.as_py() or b"").lower().split()
                own = shingle_set(words)
                counts = sum((majority(own[i : i + 65536].view(np.uint64)) for i in range(0, len(own), 65536)), np.zeros(64, np.int64))
                fp = int(np.array(of_counts(counts, len(own)), np.uint64).view(np.int64))
                rows.append((words_hash(words), sketch(own), len(own), fp, prefix(own).astype("<i8").tobytes() if exact and len(own) else b""))
            made = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, (pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names)

    chosen = docs.select("doc_id", text_hash().alias("th"), utf8(F.col("text")).alias("whole_bytes"))
    return chosen.mapInArrow(run, f"doc_id {chosen.schema[0].dataType.simpleString()}, th long, word_hash binary, sketch binary, n long, f0 long, heads binary")


def prefix_links(nodes: DataFrame) -> DataFrame:
    """(a, b): links that join all nodes that share a prefix shingle."""

    def key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidy(batches):
            for node, heads in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys = np.frombuffer(heads, "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.full(len(keys), node))], ["key", "node"])

    keyed = nodes.select("node", "heads").mapInArrow(key_rows, "key long, node long")
    # every node is linked to the least that shares its key: sums a key at a time, no list of a group
    least = keyed.groupBy("key").agg(F.min("node").alias("b"), F.count("*").alias("n")).where("n > 1").select("key", "b")
    return keyed.join(least, "key").select(F.col("node").alias("a"), "b").where("a != b")


def band_links(nodes: DataFrame) -> DataFrame:
    """(a, b): links that join all nodes (node, sketch) that share a band's key and agree in MATCHES ends or more.

    Only keys that two nodes or more share are met, and only then are the ends fetched.
    """

    def key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidy(batches):
            node, made = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            good = np.array([bool(x) for x in made], bool)
            keys = np.frombuffer(b"".join(x[: 8 * BANDS] for x in made), "<i8")
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(node[good], BANDS))], ["key", "node"])

    keyed = nodes.select("node", "sketch").mapInArrow(key_rows, "key long, node long")
    shared = cut(keyed.groupBy("key").count().where("count > 1"))
    blocks = F.when(F.col("count") > BLOCK, F.ceil(F.col("count") / (BLOCK // 2))).otherwise(1)
    dealt = _dealt(keyed.join(shared.select("key", blocks.alias("blocks")), "key")).select("key", "part", "node")
    ends = nodes.select("node", F.substring("sketch", 8 * BANDS + 1, SKETCH // 2).alias("ends"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, parts, node, made in in_runs(tidy(batches), 2, 50_000):
            ends = np.frombuffer(b"".join(made), "<u8").reshape(len(node), -1)
            edge = np.flatnonzero((keys[1:] != keys[:-1]) | (parts[1:] != parts[:-1])) + 1
            low, high = np.concatenate([[0], edge]), np.concatenate([edge, [len(node)]])
            two = low[high - low == 2]
            two = two[matches(ends[two], ends[two + 1]) >= MATCHES]
            links = [np.stack([two, two + 1], axis=1)]
            for x, y in zip(low[high - low > 2], high[high - low > 2]):
                own = ends[x:y]
                links.append(x + np.array(joining_links(own, lambda i, rest: matches(own[i], own[rest]) >= MATCHES), np.int64).reshape(-1, 2))
            at = np.concatenate(links)
            yield pa.RecordBatch.from_arrays([pa.array(node[at[:, 0]]), pa.array(node[at[:, 1]])], ["a", "b"])

    met = dealt.join(ends, "node").select("key", "part", "node", "ends").repartition("key", "part").sortWithinPartitions("key", "part")
    return met.mapInArrow(meet, "a long, b long")


def _dealt(rows: DataFrame) -> DataFrame:
    """``rows`` (node, blocks) once for every pair of blocks that a row's own block is in, named by ``part``."""
    own = F.pmod(F.xxhash64("node"), F.col("blocks"))
    dealt = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)))
    return dealt.withColumn("part", F.least("own", "other") * F.col("blocks") + F.greatest("own", "other"))


def text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _small(df: DataFrame) -> DataFrame:
    """``df`` marked for broadcast if it is counted to be small."""
    return F.broadcast(df) if df.count() <= BROADCAST_KEYS else df


def set_rows(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, shingles) of the wanted nodes: the set of each as packed hashes. wanted: node, word_hash, doc_id, th."""
    id_, hash_ = fresh(docs.columns, "wanted_id", "wanted_hash")
    keys = _small(wanted.select(F.col("doc_id").alias(id_), F.col("th").alias(hash_)).distinct())
    texts = docs.select("doc_id", text_hash().alias("th"), "text").join(keys, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col("th") == F.col(hash_)), "left_semi")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidy(batches):
            hashes, made = [], []
            for text in batch.column(0):
                words = (text.as_py() or b"").lower().split()
                hashes.append(words_hash(words))
                made.append(shingle_set(words).astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.binary()), pa.array(made, pa.binary())], ["word_hash", "shingles"])

    found = texts.select(utf8(F.col("text"))).mapInArrow(sets, "word_hash binary, shingles binary").dropDuplicates(["word_hash"])
    return wanted.select("node", "word_hash").join(found, "word_hash").select("node", "shingles")


def alike_links(links: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the links (a, b) whose own two texts are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidy(batches):
            good = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, "<i8"), np.frombuffer(y, "<i8")
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(both + 1e-9 >= SIMILARITY * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    ends = [sets.select(F.col("node").alias(c), F.col("shingles").alias(f"s{c}")) for c in "ab"]
    return links.join(ends[0], "a").join(ends[1], "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _crowds(docs: DataFrame, wanted: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of large groups: rows (root, part, node, label) to meet, and the links that are certain. wanted: as in ``set_rows``, with root and n."""
    # one link a text, to the least it is a candidate with: as many rows as texts, however many keys they share
    links = candidates.groupBy(F.greatest("a", "b").alias("b")).agg(F.min(F.least("a", "b")).alias("a")).join(wanted.select(F.col("node").alias("b")), "b")
    sure = cut(alike_links(links, set_rows(docs, wanted)))
    named = cut(wanted.join(components(sure).withColumnRenamed("root", "label"), "node", "left").select("root", "node", "n", F.coalesce("label", "node").alias("label")))
    classes = named.groupBy("root", "label").agg(F.count("*").alias("rows"), (8 * F.sum("n")).alias("bytes"))
    blocks = F.ceil(F.greatest(F.col("rows") / (GROUP / 2), F.col("bytes") / (GROUP_BYTES / 2)))
    largest = classes.groupBy("root").agg(F.max(F.struct("rows", "bytes", "label")).alias("m")).select("root", "m.*")
    rest = classes.join(largest.select("root", F.col("label").alias("top")), "root").where("label != top").groupBy("root").agg(F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"))
    plan = largest.select("root", F.col("label").alias("top"), F.least(blocks, "rows").alias("g")).join(rest.select("root", F.least(blocks, "rows").alias("o")), "root")
    rows = named.join(plan, "root").withColumns({"i": F.pmod(F.xxhash64("node"), F.col("g")), "j": F.pmod(F.xxhash64("node"), F.col("o"))})
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    # a block of the largest class with each block of the rest; a block of the rest with each of the largest class, and with the other blocks of the rest
    main = F.transform(upto("o"), lambda j: F.col("i") * F.col("o") + j)
    against = F.transform(upto("g"), lambda i: i * F.col("o") + F.col("j"))
    among = F.transform(upto("o"), lambda j: (F.col("g") + F.least("j", j)) * F.col("o") + F.greatest("j", j))
    parts = F.when(F.col("label") == F.col("top"), main).when(F.col("o") > 1, F.concat(against, among)).otherwise(against)
    return cut(rows.select("root", F.explode(parts).alias("part"), "node", "label")), sure


def alike(docs: DataFrame, nodes: DataFrame, exact: bool = False) -> DataFrame:
    """(a, b): links that join all nodes whose texts are alike. nodes: node, word_hash, doc_id, th (a row it stands for), sketch, n, f0, heads."""
    candidates = golay_links(nodes, ["f0"]).unionByName(band_links(nodes))
    if exact:
        candidates = candidates.unionByName(prefix_links(nodes))
    candidates = cut(candidates)
    grouped = components(candidates)
    wanted = cut(nodes.join(grouped, "node").select("node", "word_hash", "root", "doc_id", "th", "n"))
    sizes = wanted.groupBy("root").agg(F.count("*").alias("rows"), (8 * F.sum("n")).alias("bytes"))
    crowd = cut(sizes.where((F.col("rows") > GROUP) | ((F.col("bytes") > GROUP_BYTES) & (F.col("rows") > 2))).select("root"))
    dealt = wanted.join(crowd, "root", "left_anti").select("root", F.lit(0).cast("long").alias("part"), "node", F.col("node").alias("label"))
    sure = None
    if crowd.limit(1).count():
        rows, sure = _crowds(docs, cut(wanted.join(crowd, "root", "left_semi")), candidates)
        dealt = dealt.unionByName(rows)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in in_runs(tidy(batches), 2, 1):
            edge = np.flatnonzero((rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])) + 1
            links = []
            for low, high in zip([0, *edge], [*edge, len(rows[0])]):
                own = [np.frombuffer(x, "<i8") for x in rows[4][low:high]]
                links += [(low + a, low + b) for a, b in similar(own, rows[3][low:high])]
            if links:
                at = np.array(links)
                yield pa.RecordBatch.from_arrays([pa.array(rows[2][at[:, 0]]), pa.array(rows[2][at[:, 1]])], ["a", "b"])

    met = dealt.join(set_rows(docs, wanted), "node").select("root", "part", "node", "label", "shingles").repartition("root", "part").sortWithinPartitions("root", "part", "node")
    links = met.mapInArrow(verify, "a long, b long")
    return links if sure is None else links.unionByName(sure)


def similar(sets: list[np.ndarray], labels: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that join all sets connected by a Jaccard similarity of SIMILARITY or more; those of one label are joined already."""
    if len(sets) < 2:
        return []
    sizes = np.array([len(s) for s in sets])
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    marks = np.zeros(int(flat.max()) + 1 if len(flat) else 1, bool)

    def close(x: int, rest: np.ndarray) -> np.ndarray:
        near = np.zeros(len(rest), bool)
        own = flat[ends[x] - sizes[x] : ends[x]]
        marks[own] = True
        for k, y in enumerate(rest):
            small, large = sorted((sizes[x], sizes[y]))
            if small + 1e-9 < SIMILARITY * large:
                continue
            both = int(marks[flat[ends[y] - sizes[y] : ends[y]]].sum())
            near[k] = both + 1e-9 >= SIMILARITY * (sizes[x] + sizes[y] - both)
        marks[own] = False
        return near

    return joining_links(np.zeros(len(sets)), close, labels)


def near_dedup(docs: DataFrame, exact: bool = False) -> DataFrame:
    """``docs`` with one row of each class of texts alike; with ``exact`` candidates are not left to any chance."""
    sketched = cut(sketches(docs, exact))
    first = F.min(F.struct("doc_id", "th"))
    # numbered once and kept, so that a node's number never changes
    nodes = sketched.groupBy("word_hash").agg(first.alias("m"), *[F.min(c).alias(c) for c in ("sketch", "n", "f0", "heads")])
    nodes = cut(nodes.select(F.monotonically_increasing_id().alias("node"), "word_hash", "m.doc_id", "m.th", "sketch", "n", "f0", "heads"))
    linked = components(alike(docs, nodes, exact))
    classed = nodes.select("node", "doc_id", "th").join(linked, "node", "left").withColumn("root", F.coalesce("root", "node"))
    stays = classed.groupBy("root").agg(first.alias("m")).select(F.col("m.doc_id").alias("stay_id"), F.col("m.th").alias("stay_hash"))
    rows = sketched.groupBy("doc_id", "th").count()
    same = F.col("doc_id").eqNullSafe(F.col("stay_id")) & (F.col("th") == F.col("stay_hash"))
    marked = cut(rows.join(stays, same, "left").select("doc_id", "th", "count", F.col("stay_hash").isNotNull().alias("stay")))
    own, id_, hash_ = fresh(docs.columns, "own_hash", "other_id", "other_hash")
    named = [F.col("doc_id").alias(id_), F.col("th").alias(hash_)]
    out = docs.withColumn(own, text_hash())
    here = F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(own) == F.col(hash_))
    out = out.join(_small(marked.where("not stay").select(*named)), here, "left_anti")
    repeated = marked.where("stay and count > 1").select(*named)
    if repeated.limit(1).count():
        repeated = _small(repeated)
        once = out.join(repeated, here, "left_semi").dropDuplicates(["doc_id", own])
        out = out.join(repeated, here, "left_anti").unionByName(once)
    return out.drop(own)
