"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is four 16-bit segments, each set into a word of the perfect binary Golay code (23 bits,
radius 3, 4096 codewords). Every 16-bit word has the codeword index it decodes to, and those its one-bit neighbours
decode to: between one and a few keys. Of three errors or fewer at least one segment has none (pigeonhole), so
either two segments are free of errors, or one is and each other has exactly one. The first case is met by the six
pairs of whole segments (32 bits). The second by a whole segment and two others under their keys: one row holds
x's keys of the first and the index of the second, the other y's index and keys; as each has one error, x's keys
hold y's index and the reverse, so both meet in one row of 16 + 12 + 12 bits. No link is lost, and every candidate
is verified by its exact distance.

Rows of a key are handled where they meet, in order. Small groups compare all their pairs; from larger ones only
links that join what is not joined yet are kept, found by searching from each fingerprint among those not yet
reached, so a group of m gives fewer than m links and needs no list of pairs. Groups above ``BLOCK`` are
dealt in pairs of blocks over many tasks. Distinct fingerprints are linked; documents only join at the end.

Defined results: a null or empty text has no words and fingerprint zero, linked like any other; repeated rows are
kept, in one component; a null doc_id is no candidate for a component's name (null where all are null); an
empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .runtime import buffers, cut, documents, fresh, small_batches, tidy, utf8

SEED = 42
RADIUS = 3
#: A group of a key above this size is compared in pairs of blocks.
BLOCK = 8192
NODES_A_TASK = 8192
#: Groups up to this size compare all their pairs at once.
SMALL = 8
#: Generator polynomial of the binary Golay code: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GOLAY = 0b101011100011


@cache
def golay_syndromes() -> np.ndarray:
    """The error (23 bits, weight 3 at most) of each of the 2048 syndromes."""
    errors = np.zeros(2048, np.int64)
    bits = [1 << i for i in range(23)]
    patterns = [0, *bits]
    patterns += [a | b for i, a in enumerate(bits) for b in bits[:i]]
    patterns += [a | b | c for i, a in enumerate(bits) for j, b in enumerate(bits[:i]) for c in bits[:j]]
    errors[golay_remainder(np.array(patterns))] = patterns
    return errors


def golay_remainder(words: np.ndarray) -> np.ndarray:
    out = words.astype(np.int64).copy()
    for i in range(22, 10, -1):
        out ^= np.where(out >> i & 1, GOLAY << (i - 11), 0)
    return out


def golay_index(words: np.ndarray) -> np.ndarray:
    """Index (12 bits) of the one codeword within distance 3 of each 23-bit word."""
    return (words ^ golay_syndromes()[golay_remainder(words)]) >> 11


@cache
def segment_keys() -> np.ndarray:
    """For each 16-bit segment the index of itself and of its 16 neighbours: row 0 its own, repeats of it as -1."""
    words = np.arange(1 << 16, dtype=np.int64)
    spread = words << 7  # the segment in the high bits, so that its bits count in the index
    own = golay_index(spread)
    near = np.stack([own, *[golay_index(spread ^ (1 << (7 + i))) for i in range(16)]])
    near.sort(axis=0)
    near[1:][near[1:] == near[:-1]] = -1
    near = np.where(near == own, -1, near)
    near = -np.sort(-near, axis=0)
    width = int((near >= 0).sum(0).max())
    return np.concatenate([own[None], near[:width]]).astype(np.int64)


def keys_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, position in ``fps``) of every key of every fingerprint (uint64)."""
    table = segment_keys()
    segs = [(fps >> np.uint64(16 * i) & np.uint64(0xFFFF)).astype(np.int64) for i in range(4)]
    at = np.arange(len(fps))
    keys, places = [], []
    for t, (i, j) in enumerate([(i, j) for i in range(4) for j in range(i + 1, 4)]):
        keys.append(t << 40 | segs[i] << 16 | segs[j])
        places.append(at)
    for i in range(4):
        j, k = (i + 1) % 4, (i + 2) % 4
        head = (6 + i) << 40 | segs[i] << 24
        own_j, own_k = table[0][segs[j]], table[0][segs[k]]
        keys.append(head | own_j << 12 | own_k)
        places.append(at)
        for near in table[1:]:
            for near_j, near_k in ((near[segs[j]], own_k), (own_j, near[segs[k]])):
                good = (near_j >= 0) & (near_k >= 0)
                keys.append((head | near_j << 12 | near_k)[good])
                places.append(at[good])
    return np.concatenate(keys), np.concatenate(places)


def majority(hashes: np.ndarray) -> np.ndarray:
    """How many of the unsigned 64-bit hashes have each bit set."""
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)


def of_counts(counts: np.ndarray, n: int) -> int:
    """The fingerprint whose bits are set in over half of ``n`` hashes."""
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """The unsigned 64-bit SimHash of a text's word shingles, repeats included; zero without words."""
    import xxhash

    words = text.lower().split()  # ASCII only, as the input is bytes
    if not words:
        return 0
    digest, n, counts = xxhash.xxh64_intdigest, max(1, len(words) - shingle + 1), np.zeros(64, np.int64)
    for low in range(0, n, 1 << 16):
        part = words[low : low + (1 << 16) + shingle - 1]
        grams = map(b" ".join, zip(*[part[i:] for i in range(min(shingle, len(words)))]))
        counts += majority(np.fromiter((digest(g, SEED) for g in grams), np.uint64))
    return of_counts(counts, n)


def fingerprints(docs: DataFrame, keep: list[str], shingle: int = 3) -> DataFrame:
    """``keep`` and fp (the fingerprint's bits as a signed long)."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidy(batches):
            fps = np.array([fingerprint(t, shingle) for t in buffers(batch.column(batch.num_columns - 1))], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fps.view(np.int64))], [*keep, "fp"])

    chosen = docs.select(*keep, utf8(F.col("text")).alias(*fresh(keep, "bytes")))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema[:-1])
    return chosen.mapInArrow(run, f"{schema}, fp long")


def joining_links(fps: np.ndarray, close, labels: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Positions of links that join all that ``close(i, positions) -> mask`` connects, fewer than there are fingerprints.

    Those of one label count as joined already: they are neither compared nor linked with one another.
    """
    left, links = np.arange(len(fps)), []

    def reach(near: np.ndarray) -> np.ndarray:
        """What is reached with ``near`` (a mask of ``left``), taken from ``left``."""
        nonlocal left
        if labels is not None and near.any():
            near = np.isin(labels[left], labels[left[near]])
        got, left = left[near], left[~near]
        return got

    while len(left):
        front = reach(np.arange(len(left)) == 0).tolist()
        while front and len(left):
            x = front.pop()
            near = close(x, left)
            links += [(x, y) for y in left[near]]
            front += reach(near).tolist()
    return links


def _within(columns: list[np.ndarray], first: np.ndarray, second: np.ndarray, both: int | None) -> np.ndarray:
    """Pairs with the key's fingerprint (column 0) within RADIUS, and it and its companion together within ``both``."""
    apart = np.bitwise_count(columns[0][first] ^ columns[0][second])
    near = apart <= RADIUS
    if both is not None:
        near &= apart.astype(np.int64) + np.bitwise_count(columns[1][first] ^ columns[1][second]) <= both
    return near


def _group_links(columns: list[np.ndarray], starts: np.ndarray, ends: np.ndarray, both: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Links within each run [start, end) of rows that share a key."""
    a, b = [], []
    sizes = ends - starts
    small = (sizes > 1) & (sizes <= SMALL)
    s, e = starts[small], ends[small]
    lag = 1
    while len(s):  # all pairs at distance ``lag`` within their runs, at once
        lengths = e - s - lag
        s, e, lengths = s[lengths > 0], e[lengths > 0], lengths[lengths > 0]
        if not len(s):
            break
        first = np.repeat(s - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
        near = _within(columns, first, first + lag, both)
        a.append(first[near])
        b.append(first[near] + lag)
        lag += 1
    for low, high in zip(starts[sizes > SMALL], ends[sizes > SMALL]):
        own = [c[low:high] for c in columns]
        found = np.array(joining_links(own[0], lambda x, rest: _within(own, np.full(len(rest), x), rest, both)), np.int64).reshape(-1, 2)
        a.append(found[:, 0] + low)
        b.append(found[:, 1] + low)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def golay_links(nodes: DataFrame, columns: list[str], both: int | None = None) -> DataFrame:
    """(a, b): links between nodes (node: long, and one or more fingerprint columns) that share a key and lie close.

    Close is within RADIUS in the fingerprint of the key and, if ``both`` is given, within it together with the next.
    """
    width = len(columns)
    held = ["f"] if both is None else ["f", "g"]

    def key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidy(batches):
            node, fps = batch.column(0).to_numpy(), [batch.column(1 + i).to_numpy() for i in range(width)]
            for low in range(0, len(node), 4096):
                part = slice(low, low + 4096)
                for c in range(width):
                    keys, at = keys_of(fps[c][part].view(np.uint64))
                    carried = [fps[(c + i) % width][part][at] for i in range(len(held))]
                    yield pa.RecordBatch.from_arrays([pa.array(keys | c << 44), pa.array(node[part][at]), *map(pa.array, carried)], ["key", "node", *held])

    fields = ", ".join(f"{c} long" for c in held)
    n = nodes.count()
    # a node gives some 40 rows a column: tasks are cut by what they make, not by what they read
    tasks = max(1, -(-n * width // NODES_A_TASK))
    keyed = nodes.select("node", *columns).repartition(tasks, "node").mapInArrow(key_rows, f"key long, node long, {fields}").withColumn("part", F.lit(0))
    crowd = cut(keyed.groupBy("key").count().where(F.col("count") > BLOCK).select("key", F.ceil(F.col("count") / (BLOCK // 2)).alias("blocks"))) if n > BLOCK else None
    if crowd is not None and crowd.limit(1).count():
        # crowded keys are few by their size: at most the rows divided by BLOCK
        listed = F.broadcast(crowd)
        own = F.pmod(F.xxhash64("node"), F.col("blocks"))
        other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
        dealt = keyed.join(listed, "key").withColumn("own", own).withColumn("other", other)
        dealt = dealt.withColumn("part", (1 + F.least("own", "other") * F.col("blocks") + F.greatest("own", "other")).cast("int"))
        keyed = keyed.join(listed, "key", "left_anti").unionByName(dealt.select("key", "node", *held, "part"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in in_runs(tidy(batches), 2, 200_000):
            change = np.flatnonzero((group[0][1:] != group[0][:-1]) | (group[1][1:] != group[1][:-1])) + 1
            starts, ends = np.concatenate([[0], change]), np.concatenate([change, [len(group[0])]])
            a, b = _group_links([c.view(np.uint64) for c in group[3:]], starts, ends, both)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(group[2][a]), pa.array(group[2][b])], ["a", "b"])

    met = keyed.select("key", "part", "node", *held).repartition("key", "part").sortWithinPartitions("key", "part")
    return met.mapInArrow(meet, "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a != b")


def in_runs(batches: Iterator[pa.RecordBatch], keys: int, rows: int) -> Iterator[list[np.ndarray]]:
    """Column arrays of some ``rows`` rows at a time, cut only where one of the first ``keys`` columns changes."""
    held: list[np.ndarray] | None = None
    for batch in _and_end(batches):
        if batch is not None:
            got = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            held = got if held is None else [np.concatenate(x) for x in zip(held, got)]
            if len(held[0]) < rows:
                continue
        if held is None or not len(held[0]):
            continue
        rest = len(held[0])
        if batch is not None:  # the last run may go on
            same = np.logical_and.reduce([c == c[-1] for c in held[:keys]])
            rest = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
        if rest:
            yield [c[:rest] for c in held]
        held = [c[rest:] for c in held]


def _and_end(batches):
    yield from batches
    yield None


def classes(docs: DataFrame, fp: str = "fp") -> DataFrame:
    """(fp, component_id): for each distinct fingerprint the least doc_id reachable."""
    groups = cut(docs.groupBy(fp).agg(F.min("doc_id").alias("least")))
    linked = components(golay_links(groups.select(F.col(fp).alias("node"), F.col(fp).alias("f0")), ["f0"]))
    rooted = groups.join(linked, groups[fp] == linked["node"], "left").select(fp, "least", F.coalesce("root", fp).alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(named, "root").select(fp, "component_id")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and component."""
    docs = cut(fingerprints(documents(spark, sf_dir), ["doc_id"]))
    return docs.join(classes(docs), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
