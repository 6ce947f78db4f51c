"""Grouped-map steps for small groups: resampled intervals, leaf orders, density curves, simulated doublets."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bootstrap_median_difference(df: DataFrame, keys: list[str], value: str, inside: str, draws: int = 300, seed: int = 475, most: int = 20_000) -> DataFrame:
    """Median difference inside - outside and its 95 % interval over resamples (ST-22).

    A group is an experiment's cells. Each has a generator of its own, seeded by its keys, so the result does not
    depend on the order of groups. Values are binned by count first; above ``most`` distinct values a group is an error.
    """
    binned = df.groupBy(*keys, value, F.col(inside).cast("int").alias("_in")).agg(F.count("*").alias("_n"))
    types = dict(df.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", diff double, low double, high double"

    def one(key, pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > most:
            raise ValueError(f"{key}: {len(pdf)} distinct values")
        rng = np.random.default_rng([seed, *np.frombuffer(repr(key).encode(), np.uint8)])
        sides = []
        for s in (1, 0):
            part = pdf[pdf["_in"] == s].sort_values(value)
            sides.append(np.repeat(part[value].to_numpy(float), part["_n"].to_numpy()))
        if not len(sides[0]) or not len(sides[1]):
            return pd.DataFrame([(*key, None, None, None)], columns=[*keys, "diff", "low", "high"])
        a, b = sides
        seen = [np.median(rng.choice(a, len(a))) - np.median(rng.choice(b, len(b))) for _ in range(draws)]
        low, high = np.quantile(seen, [0.025, 0.975])
        return pd.DataFrame([(*key, float(np.median(a) - np.median(b)), float(low), float(high))], columns=[*keys, "diff", "low", "high"])

    return binned.groupBy(*keys).applyInPandas(one, schema)


def leaf_order(rows: np.ndarray) -> list[int]:
    """Leaves of average-linkage clustering by Euclidean distance, left branch first (ST-25). For some hundred rows."""
    n = len(rows)
    clusters = {i: [i] for i in range(n)}
    d = np.sqrt(((rows[:, None] - rows[None]) ** 2).sum(-1)).astype(float)
    np.fill_diagonal(d, np.inf)
    alive = list(range(n))
    while len(alive) > 1:
        part = d[np.ix_(alive, alive)]
        i, j = divmod(int(part.argmin()), len(alive))
        a, b = alive[min(i, j)], alive[max(i, j)]
        na, nb = len(clusters[a]), len(clusters[b])
        d[a] = (na * d[a] + nb * d[b]) / (na + nb)
        d[:, a] = d[a]
        d[a, a] = np.inf
        clusters[a] += clusters.pop(b)
        alive.remove(b)
    return clusters[alive[0]] if alive else []


def clustered(df: DataFrame, name: str, features: list[str], most: int = 2000) -> DataFrame:
    """Rows of a figure's heatmap with their place in leaf order. A heatmap of more than ``most`` rows is an error: all distances are held at once."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows to cluster")
    kind = dict(df.dtypes)[name]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(name).reset_index(drop=True)
        order = leaf_order(pdf[features].to_numpy(float))
        return pd.DataFrame({name: pdf[name].iloc[order].to_numpy(), "place": range(len(order))})

    return df.select(name, *features, F.lit(0).alias("_g")).groupBy("_g").applyInPandas(lambda pdf: one(pdf), f"`{name}` {kind}, place int")


def density(df: DataFrame, value: str, grid: list[float]) -> DataFrame:
    """Gaussian kernel density on a fixed grid, Scott's bandwidth; zero where all values are equal (ST-26)."""
    n, sd = F.count(value), F.stddev_samp(value)
    width = F.broadcast(df.agg((sd * F.pow(n, F.lit(-0.2))).alias("_h")))
    points = df.select(value).crossJoin(width).withColumn("x", F.explode(F.array(*[F.lit(float(g)) for g in grid])))
    z = (F.col("x") - F.col(value)) / F.nullif("_h", F.lit(0.0))
    return points.groupBy("x").agg(F.coalesce(F.avg(F.exp(-z * z / 2) / (F.col("_h") * float(np.sqrt(2 * np.pi)))), F.lit(0.0)).alias("density"))


def simulated_doublets(points: DataFrame, key: str, vector: str, share: float = 1.0, seed: int = 475) -> DataFrame:
    """(key < 0, vector): means of hash-drawn pairs of cells, about ``share`` times as many as there are cells (RND-05).

    Each cell is matched with the one beside it in a hashed order of its bucket, so no list of cells is needed.
    """
    n = points.count()
    parts = max(1, n // 1000)
    from pyspark.sql import Window

    mixed = points.withColumns({"_p": F.pmod(F.xxhash64(F.lit(seed), key), F.lit(parts)), "_o": F.xxhash64(F.lit(seed + 1), key)})
    w = Window.partitionBy("_p").orderBy("_o", key)
    paired = mixed.withColumns({"_v": F.lead(vector).over(w), "_k": F.lead(key).over(w)}).where("_v is not null")
    if share < 1:
        paired = paired.where(F.pmod(F.xxhash64(F.lit(seed + 2), key), F.lit(10_000)) < int(share * 10_000))
    return paired.select((-F.col(key) - 1).alias(key), F.zip_with(vector, "_v", lambda a, b: ((a + b) / 2).cast("float")).alias(vector))
