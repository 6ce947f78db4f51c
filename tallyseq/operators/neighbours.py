"""Exact nearest neighbours in which only blocks of points meet that can hold one.

Points are dealt to the nearest of some pivots and, within a pivot, to bands by their distance to it, so that a block is a shell around a pivot
of some ``BLOCK`` points, however many a pivot draws. A point first looks at its own block; what it finds there bounds how far its neighbours
can be. By the triangle inequality no point of a shell is nearer to it than its own distance to the pivot is to the shell's, so it goes
on only to blocks that this leaves, the likeliest first, and the best of all its finds stay.

Blocks are files of a table in the shared folder. A task has the points of one block and reads the others that they go to one after the other,
so that no point moves or is kept once for each block it visits: what is written grows with the points, what is read and compared with the pairs of blocks left.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from urllib.parse import unquote

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.fastq import filesystem
from .lineage import settle, shared_folder
from .ranks import running_counts

#: Points of a block, and pivots at most.
BLOCK, PIVOTS = 2000, 256

#: Pairs of points that are measured exactly at once.
PAIRS = 50_000


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(float)


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * x @ y.T, 0))


def _nearest(x: np.ndarray, own: np.ndarray, y: np.ndarray, ids: np.ndarray, k: int, bound: np.ndarray) -> Iterator[tuple]:
    """(rows of x, rows of y, distances) of the points of y that are not a row itself and no farther than its ``bound``; where that is infinite, of the k nearest and those as far as the k-th at least."""
    # one matrix product around x's mean, short of x's own squares, finds who may be near; those few are measured exactly
    mean = x.mean(0)
    left, right = x - mean, y - mean
    xx, yy = (left * left).sum(1), (right * right).sum(1)
    most = xx.max() + 2 * yy.max()
    left, right = np.column_stack([-2 * left, np.ones(len(x))]), np.column_stack([right, yy]).T
    # in single precision where what it may be wrong by is small beside the bounds
    slack = 2.4e-7 * (x.shape[1] + 8) * most
    if 1e-20 < most < 1e30 and slack < 1e-3 * np.median(bound) ** 2:
        left, right = left.astype(np.float32), right.astype(np.float32)
    else:
        slack = 1e-9 * (1 + most)
    nth = min(k, len(y)) - 1
    for low in range(0, len(x), 256):
        part = slice(low, low + 256)
        rough = left[part] @ right
        far = bound[part] ** 2 - xx[part]
        free = np.flatnonzero(np.isinf(far))
        if len(free):
            others = np.where(own[part][free, None] == ids, np.inf, rough[free])
            far[free] = np.partition(others, nth, axis=1)[:, nth]
        # rounded up in single precision
        i, j = np.divmod(np.flatnonzero(rough <= np.nextafter((far + slack).astype(rough.dtype), rough.dtype.type(np.inf))[:, None]), len(y))
        for at in range(0, len(i), PAIRS):
            a, b = i[at : at + PAIRS] + low, j[at : at + PAIRS]
            other = own[a] != ids[b]
            a, b = a[other], b[other]
            d = np.sqrt(((x[a] - y[b]) ** 2).sum(1))
            within = d <= bound[a]
            yield a[within], b[within], d[within]


def _search(x: np.ndarray, own: np.ndarray, blocks: Iterable[tuple[np.ndarray | float, Callable[[], tuple]]], k: int) -> tuple[tuple, np.ndarray]:
    """((rows of x, distances, ids, labels) of the k nearest of each row, ties by id; how far the k-th is, infinite without).

    blocks: how near a row a point of the block can be, and what gives the block's points, ids and labels.
    """
    bound, best, waiting, wait = np.full(len(x), np.inf), None, [], 0

    def sort_in() -> None:
        nonlocal best, wait
        row, d, ids, names = (np.concatenate(c) for c in zip(*([best] if best else []), *waiting))
        order = np.lexsort((ids, d, row))
        order = order[np.arange(len(order)) - np.searchsorted(row[order], row[order]) < k]
        best = row[order], d[order], ids[order], names[order]
        full = np.flatnonzero(np.bincount(best[0], minlength=len(x)) == k)
        bound[full] = best[1][np.searchsorted(best[0], full, "right") - 1]
        waiting.clear()
        wait = 0

    for least, load in blocks:
        goes = np.flatnonzero(least <= bound)  # the likeliest blocks first leave later ones fewer
        if not len(goes):
            continue
        y, ids, names = load()
        waiting.append((goes[:0], np.zeros(0), ids[:0], names[:0]))
        for i, j, d in _nearest(x[goes], own[goes], y, ids, k, bound[goes]):
            waiting.append((goes[i], d, ids[j], names[j]))
            wait += len(i)
            if wait > len(best[0]) // 2 if best else wait > PAIRS:
                sort_in()
        if best is None or np.isinf(bound).any():
            sort_in()
    if waiting:
        sort_in()
    return best, bound


def dealt(points: DataFrame, block: int = BLOCK, pivots: int = PIVOTS) -> tuple[DataFrame, np.ndarray]:
    """(a table of the points with their pivot, distance to it and band, where a block has files of its own; the pivots). points: key, v, label."""
    n = points.count()
    wanted = min(pivots, max(1, -(-n // block)))
    # chosen by hash; as many as a driver can hold
    centres = np.array([r.v for r in points.orderBy(F.xxhash64("key"), "key").limit(wanted).select("v").collect()], float)

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if len(pdf):
                d = _distances(_matrix(pdf.v), centres)
                pivot = d.argmin(1)
                away = np.sqrt(((_matrix(pdf.v) - centres[pivot]) ** 2).sum(1))
                yield pdf.assign(pivot=pivot.astype(np.int32), away=away)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.schema)
    near = points.mapInPandas(deal, f"{kinds}, pivot int, away double")
    order = F.struct("away", "key")
    placed = running_counts(settle(near.withColumns({"_o": order, "n": F.lit(1)})), ["pivot"], "_o")
    band = F.floor(F.col("below") / block).cast("int")
    placed = placed.select(*points.columns, "away", "pivot", band.alias("band"))
    where = f"{shared_folder(points.sparkSession)}/blocks-{uuid.uuid4().hex}"
    placed.repartition("pivot", "band").write.partitionBy("pivot", "band").parquet(where)
    return points.sparkSession.read.schema(placed.schema).parquet(where), centres


def _asking(pdf: pd.DataFrame) -> np.ndarray:
    return pdf.asks.to_numpy(bool) if "asks" in pdf else np.ones(len(pdf), bool)


def own_blocks(placed: DataFrame, k: int) -> DataFrame:
    """Of the points that ask: key, v, pivot, band and bound: how far the k-th nearest in its own block is, infinite without."""
    kinds = dict(placed.dtypes)

    def own(pdf: pd.DataFrame) -> pd.DataFrame:
        x, ids, asks = _matrix(pdf.v), pdf.key.to_numpy(), _asking(pdf)
        bound = _search(x[asks], ids[asks], [(0.0, lambda: (x, ids, ids))], k)[1] if asks.any() else np.zeros(0)
        return pdf[asks][["key", "v", "pivot", "band"]].assign(bound=bound)

    return placed.groupBy("pivot", "band").applyInPandas(own, f"key {kinds['key']}, v {kinds['v']}, pivot int, band int, bound double")


def _least(x: np.ndarray, shells: pd.DataFrame, centres: np.ndarray) -> np.ndarray:
    """How near a row of x a point of each shell can be at least."""
    away = _distances(x, centres)[:, shells["pivot"].to_numpy()]
    return np.maximum(away - shells.high.to_numpy(), shells.low.to_numpy() - away) - 1e-6 * (1 + away.max())


def visits(found: DataFrame, shells: pd.DataFrame, centres: np.ndarray) -> DataFrame:
    """A block (pivot, band), another (to_pivot, to_band) that may hold a nearer point for some of its points, and how near that can be (least). shells: pivot, band, low, high."""
    shells = shells[["pivot", "band", "low", "high"]]
    rows = max(1, 4_000_000 // len(shells))  # points whose distances to all shells are held at once

    def visit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in frames:
            for start in range(0, len(whole), rows):
                for (pivot, band), pdf in whole.iloc[start : start + rows].groupby(["pivot", "band"]):
                    least = _least(_matrix(pdf.v), shells, centres)
                    goes = (least <= pdf.bound.to_numpy()[:, None]).any(0) & ~((shells["pivot"] == pivot) & (shells.band == band)).to_numpy()
                    to = shells[goes]
                    yield pd.DataFrame({"pivot": pivot, "band": band, "to_pivot": to["pivot"], "to_band": to.band, "least": least.min(0)[goes]})

    pairs = found.select("v", "bound", "pivot", "band").mapInPandas(visit, "pivot int, band int, to_pivot int, to_band int, least double")
    return pairs.groupBy("pivot", "band", "to_pivot", "to_band").agg(F.min("least").alias("least"))


def _block(files: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Points, ids and labels of a block's files."""
    parts = []
    for file in files:
        fs, path = filesystem(file)
        with fs.open_input_file(path) as f:
            parts.append(pq.ParquetFile(f).read(["key", "v", "label"]))
    block = pa.concat_tables(parts)
    v = block["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float)
    return v.reshape(len(block), -1), block["key"].to_pandas().to_numpy(), block["label"].to_pandas().to_numpy()


def knn(points: DataFrame, key: str, vector: str, label: str, k: int, block: int = BLOCK, pivots: int = PIVOTS, asks: Column | None = None) -> DataFrame:
    """(key, neighbour, label, distance): the k nearest other points of each point, exactly, ties by key (MAT-14). Points for which ``asks`` is not true are neighbours only."""
    asking = F.lit(True) if asks is None else F.coalesce(asks, F.lit(False))
    own = points.select(F.col(key).alias("key"), F.col(vector).alias("v"), F.col(label).alias("label"), asking.alias("asks"))
    placed, centres = dealt(own, block, pivots)
    # a row for each block
    shells = placed.withColumn("file", F.input_file_name()).groupBy("pivot", "band").agg(F.min("away").alias("low"), F.max("away").alias("high"), F.collect_set("file").alias("files")).toPandas()
    files = {(p, b): [unquote(f) for f in all_] for p, b, all_ in zip(shells["pivot"], shells.band, shells.files)}
    kinds = dict(placed.dtypes)

    def search(pdf: pd.DataFrame, trips: pd.DataFrame | None = None) -> pd.DataFrame:
        asks = _asking(pdf)
        if not asks.any():
            return pd.DataFrame({"key": [], "neighbour": [], "label": [], "distance": []})
        x, ids, names = _matrix(pdf.v), pdf.key.to_numpy(), pdf.label.to_numpy()

        def blocks() -> Iterator[tuple]:
            yield 0.0, lambda: (x, ids, names)
            if trips is not None and len(trips):
                to = trips.sort_values("least").merge(shells, "left", left_on=["to_pivot", "to_band"], right_on=["pivot", "band"], suffixes=("_own", ""))
                least = _least(x[asks], to, centres)
                for n, at in enumerate(zip(to["pivot"], to.band)):
                    yield least[:, n], lambda at=at: _block(files[at])

        (row, d, near, label), _ = _search(x[asks], ids[asks], blocks(), k)
        return pd.DataFrame({"key": ids[asks][row], "neighbour": near, "label": label, "distance": d})

    out = f"key {kinds['key']}, neighbour {kinds['key']}, label {kinds['label']}, distance double"
    if len(shells) > 1:
        pairs = visits(own_blocks(placed, k), shells, centres)
        shells = shells[["pivot", "band", "low", "high"]]
        dealt_blocks = placed.repartition(len(shells), "pivot", "band")  # a block is much work on few bytes
        near = dealt_blocks.groupBy("pivot", "band").cogroup(pairs.groupBy("pivot", "band")).applyInPandas(search, out)
    else:
        near = placed.groupBy("pivot", "band").applyInPandas(lambda pdf: search(pdf), out)
    return near.select(F.col("key").alias(key), "neighbour", "label", "distance")
