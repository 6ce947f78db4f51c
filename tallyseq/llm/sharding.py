"""Sharding by histogram sort: splitters are found by exact byte counts, then rows are exchanged once.

Rows are ordered by (hash of the text, hash of the id, row number), so equal texts stand together and the order
is a shuffle. The driver proposes keys; every partition counts, exactly, the bytes and rows below each; the
proposals are refined between the two nearest counted keys until each boundary is within tolerance of its goal.
Where one text, or one repeated row, holds more than the tolerance, the search goes on inside it by the next
component of the key, down to single rows. Only counts reach the driver: a few for each boundary and partition.
Shards are divided further by the same search, so that a shard is not one task; the counts of rows below the
boundaries give every slot its base. Then each row moves once to its part, is sorted and numbered.

Defined results: a null text has no bytes and counts 1; a null id is hashed as null; repeated rows are told apart
by their row number; an empty table gives an empty result; of extra columns only those asked for are carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .runtime import cut, documents, tidy, utf8

LOW, HIGH = -(1 << 63), (1 << 63) - 1
Key = tuple[int, int, int]
#: Keys proposed for each open boundary and round.
PROBES = 8
#: And pairs of keys around the expected place, at the width shifted by so many bits.
CLOSING = (6, 9, 12, 16)


def counts_below(keyed: DataFrame, keys: list[Key]) -> list[tuple[int, int]]:
    """Exact (bytes, rows) below each of the ascending keys."""
    a, b, c = (np.array([k[i] for k in keys], np.int64) for i in range(3))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, rows = np.zeros(len(a) + 1, np.int64), np.zeros(len(a) + 1, np.int64)
        for batch in tidy(batches):
            x, y, z, n = (batch.column(i).to_numpy() for i in range(4))
            at = place(x, y, z, a, b, c)
            np.add.at(size, at, n)
            rows += np.bincount(at, minlength=len(rows))
        yield pa.RecordBatch.from_pydict({"at": np.arange(len(size)), "bytes": size, "n": rows})

    found = keyed.select("_k1", "_k2", "_k3", "size").mapInArrow(count, "at long, bytes long, n long").groupBy("at").agg(F.sum("bytes"), F.sum("n")).collect()
    size, rows = np.zeros(len(a) + 1, np.int64), np.zeros(len(a) + 1, np.int64)
    for at, s, n in found:
        size[at], rows[at] = s, n
    return list(zip(np.cumsum(size)[:-1].tolist(), np.cumsum(rows)[:-1].tolist()))


def place(x, y, z, a, b, c) -> np.ndarray:
    """How many of the ascending keys (a, b, c) are at or below each row's key (x, y, z)."""
    return _place((x, y, z), (a, b, c))


def _place(own: tuple[np.ndarray, ...], keys: tuple[np.ndarray, ...]) -> np.ndarray:
    """One component at a time: rows that equal keys in the first are placed among those keys by the next, all rows of a run of keys at once."""
    at = np.searchsorted(keys[0], own[0], "right")
    if len(keys) == 1 or not len(keys[0]):
        return at
    first = np.searchsorted(keys[0], own[0], "left")
    tied = np.flatnonzero(at > first)
    for low in np.unique(first[tied]):  # runs of equal keys, few as keys are
        rows = tied[first[tied] == low]
        high = at[rows[0]]
        at[rows] = low + _place(tuple(o[rows] for o in own[1:]), tuple(k[low:high] for k in keys[1:]))
    return at


class Boundary:
    """The search for one key with ``goal`` of ``total`` bytes below it."""

    def __init__(self, goal: int, slack: int, total: int):
        self.goal, self.slack = goal, slack
        self.prefix: tuple[int, ...] = ()
        self.low, self.high = LOW, HIGH
        self.low_size, self.high_size = 0, total
        self.best: tuple[int, Key, int, int] | None = None

    def key(self, v: int) -> Key:
        return (*self.prefix, v, LOW, LOW)[:3]

    def done(self) -> bool:
        return self.best is not None and (self.best[0] <= self.slack or (len(self.prefix) == 2 and self.high - self.low <= 1))

    def proposals(self) -> set[int]:
        """The ends, points at even distances, and points closing in on where the goal lies if bytes are spread evenly, as hashes spread them."""
        low, width, spread = self.low, self.high - self.low, max(1, self.high_size - self.low_size)
        even = {low + width * i // (PROBES + 1) for i in range(1, PROBES + 1)}
        middle = low + width * min(max(self.goal - self.low_size, 0), spread) // spread
        near = {min(max(middle + sign * (width >> shift), low), self.high) for shift in CLOSING for sign in (-1, 1)}
        return even | near | {low, self.high}

    def take(self, below: dict[Key, tuple[int, int]]) -> None:
        low, high, low_size, high_size = self.low, self.high, self.low_size, self.high_size
        for v in sorted(self.proposals()):
            size, rows = below[self.key(v)]
            off = abs(size - self.goal)
            if self.best is None or off < self.best[0]:
                self.best = (off, self.key(v), size, rows)
            if size <= self.goal:
                low, low_size = v, size
            else:
                high, high_size = v, size
                break
        self.low, self.high, self.low_size, self.high_size = low, high, low_size, high_size
        if not self.done() and high - low <= 1 and len(self.prefix) < 2:  # one value holds the goal: go on inside it
            self.prefix = (*self.prefix, low)
            self.low, self.high = LOW, HIGH


def find_boundaries(keyed: DataFrame, goals: list[tuple[int, int]], total: int) -> list[tuple[Key, int, int]]:
    """(key, bytes below, rows below) for each (goal, slack) of ``total`` bytes."""
    open_ = [Boundary(*g, total) for g in goals]
    while todo := [x for x in open_ if not x.done()]:
        keys = sorted({x.key(v) for x in todo for v in x.proposals()})
        below = dict(zip(keys, counts_below(keyed, keys)))
        for x in todo:
            x.take(below)
    return [x.best[1:] for x in open_]


def histogram_shards(rows: DataFrame, shards: int, tolerance: float = 0.001, part_bytes: int = 32 << 20, parts_most: int = 1024) -> DataFrame:
    """``rows`` (with size, _k1 and _k2) with shard and slot; shards near equal in the sum of size.

    Boundaries lie within ``tolerance`` of a shard's bytes, or a single row, of their goals. A shard is sorted by some
    ``part_bytes`` a task, by ``parts_most`` tasks at most, as the driver searches for each task's boundary.
    """
    spark = rows.sparkSession
    keyed = cut(rows.withColumn("_k3", F.monotonically_increasing_id()))
    total, n = keyed.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    if not n:
        return rows.drop("_k1", "_k2").withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")})
    fine = min(parts_most, max(1, -(-total // (shards * part_bytes))))
    goals = []
    for i in range(1, shards * fine):
        share = total / shards / (1 if i % fine == 0 else fine)
        goals.append((total * i // (shards * fine), int(share * (tolerance if i % fine == 0 else 0.2))))
    found = find_boundaries(keyed, goals, total)
    keys = [f[0] for f in found]
    for i in range(1, len(keys)):  # two boundaries may have met in one row
        keys[i] = max(keys[i], keys[i - 1])
    rows_below = [0, *[f[2] for f in found]]
    for i in range(1, len(rows_below)):
        rows_below[i] = max(rows_below[i], rows_below[i - 1])
    a, b, c = (np.array([k[i] for k in keys], np.int64) for i in range(3))
    base = [rows_below[p] - rows_below[p // fine * fine] for p in range(shards * fine)]

    names = keyed.columns

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidy(batches):
            x, y, z = (batch.column(names.index(k)).to_numpy() for k in ("_k1", "_k2", "_k3"))
            part = place(x, y, z, a, b, c) if len(a) else np.zeros(len(x), np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part.astype(np.int32))], [*names, "_part"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.schema) + ", _part int"
    dealt = keyed.mapInArrow(deal, schema)
    bases = F.broadcast(spark.createDataFrame([(p, p // fine, x) for p, x in enumerate(base)], "_part int, shard int, _base long"))
    order = Window.partitionBy("_part").orderBy("_k1", "_k2", "_k3")
    numbered = dealt.withColumn("_n", F.row_number().over(order)).join(bases, "_part")
    return numbered.withColumn("slot", F.col("_base") + F.col("_n") - 1).drop("_k1", "_k2", "_k3", "_part", "_base", "_n")


def shard_keys(docs: DataFrame) -> DataFrame:
    """``docs`` with what the operator orders and measures by: size, _k1 (equal for equal texts) and _k2."""
    return docs.withColumns(
        {"size": F.octet_length(F.coalesce("text", F.lit(""))).cast("long") + 1, "_k1": F.xxhash64(F.coalesce("text", F.lit(""))), "_k2": F.xxhash64("doc_id")}
    )


def op6_histogram_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of near equal bytes."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    rows = shard_keys(docs).withColumn("text_crc32", F.crc32(utf8(F.col("text")))).drop("text")
    out = histogram_shards(rows, 16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int"), "slot", F.lit(None).cast("int").alias("grown_shard"))
