"""Ranks and exact quantiles of groups, however large one group is.

Equal values meet first, with their counts. Distinct values are then dealt by range of group and value, so that a range holds some
``RANK_ROWS`` of them whatever their groups, and each range is summed by itself; what stands before a range in its group comes from one row for each
group and range. No task orders a group. Where all distinct values fit one range there is one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import dealt, settle
from .match import small

#: Distinct values that one task orders.
RANK_ROWS = 500_000


def met(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Join on keys that may be NULL; b's are dropped. A small b travels to a, so that no group is brought together."""
    b = small(b.withColumnsRenamed({k: f"{k}_" for k in keys}))
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"{k}_"))
    return a.join(b, same).drop(*[f"{k}_" for k in keys])


def value_counts(df: DataFrame, keys: list[str], value: str, **sums: Column) -> DataFrame:
    """A settled row for each key and value: n, and the given aggregates. Rows are counted first and dealt, so that no task's map grows with the input."""
    df = dealt(df, df.count(), *keys, value)
    return settle(df.groupBy(*keys, value).agg(F.count("*").alias("n"), *[c.alias(name) for name, c in sums.items()]))


def running_counts(values: DataFrame, keys: list[str], value: str, count: str = "n", out: str = "below", most: int | None = None) -> DataFrame:
    """``values``, a settled row for each key and value, with the sum of ``count`` over the group's smaller values. NULL comes first and NaN last, as in Spark's order."""
    most = RANK_ROWS if most is None else most
    parts = max(1, -(-values.count() // most))
    if parts == 1:
        before = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
        return values.withColumn(out, F.coalesce(F.sum(count).over(before), F.lit(0)))
    # settled, as the ranges' borders are drawn from a sample and must be the same wherever the rows are used
    ranged = settle(values.repartitionByRange(parts, *[F.col(k) for k in keys], F.col(value)).withColumn("_part", F.spark_partition_id()))
    within = Window.partitionBy(*keys, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    own = ranged.withColumn("_own", F.coalesce(F.sum(count).over(within), F.lit(0)))
    across = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    bases = settle(ranged.groupBy(*keys, "_part").agg(F.sum(count).alias("_s")).select(*keys, "_part", F.coalesce(F.sum("_s").over(across), F.lit(0)).alias("_base")))
    return met(own, bases, [*keys, "_part"]).withColumn(out, F.col("_own") + F.col("_base")).drop("_own", "_base", "_part")


def mean_ranks(values: DataFrame, keys: list[str], value: str, count: str = "n", out: str = "rank", most: int | None = None) -> DataFrame:
    """``values`` with the rank that the rows of each value share."""
    below = running_counts(values, keys, value, count, "_below", most)
    return below.withColumn(out, F.col("_below") + (F.col(count) + 1) / 2).drop("_below")


def average_rank(df: DataFrame, value: str, keys: list[str], out: str = "rank", most: int | None = None) -> DataFrame:
    """Ranks within the group, ties sharing their mean (ST-17, ST-19)."""
    ranks = mean_ranks(value_counts(df, keys, value), keys, value, out=out, most=most).drop("n")
    return df.join(ranks, [*keys, value])


def quantiles_of_counts(counts: DataFrame, keys: list[str], value: str, points: dict[str, float], count: str = "n", most: int | None = None) -> DataFrame:
    """Exact quantiles (linear between neighbours) by name, of settled counts of values without NULL: a row for each group."""
    most = RANK_ROWS if most is None else most
    if counts.count() <= most:
        return counts.where(F.col(count) > 0).groupBy(*keys).agg(*[F.expr(f"percentile(`{value}`, {p}D, `{count}`)").alias(name) for name, p in points.items()])
    counts = counts.where(F.col(count) > 0)
    placed = running_counts(counts, keys, value, count, "_below", most)
    whole = settle(counts.groupBy(*keys).agg(F.sum(count).alias("_n")))
    rows = met(placed, whole, keys)
    found = []
    for name, p in points.items():
        at = F.lit(p) * (F.col("_n") - 1)
        nth = lambda k: F.max(F.when((F.col("_below") <= k) & (k < F.col("_below") + F.col(count)), F.col(value)))
        low, high, share = nth(F.floor(at)), nth(F.ceil(at)), F.max(at - F.floor(at))
        found.append((low + F.when(share > 0, share * (high - low)).otherwise(0.0)).alias(name))
    return settle(rows.groupBy(*keys).agg(*found))  # a row a group, that whoever joins it counts


def group_quantiles(df: DataFrame, value: str, keys: list[str], points: dict[str, float], most: int | None = None) -> DataFrame:
    """Exact quantiles of each group's values, NULL left out (AGG-04, ST-27); a group without values gives no row."""
    return quantiles_of_counts(value_counts(df.where(F.col(value).isNotNull()), keys, value), keys, value, points, most=most)


def group_summary(df: DataFrame, value: str, keys: list[str], name: str, most: int | None = None) -> DataFrame:
    """Rows with a value and how many have one over 0, mean, median, sample deviation, extremes and quartiles of each group (AGG-04)."""
    counts = value_counts(df.where(F.col(value).isNotNull()), keys, value)
    v, n = F.col(value), F.col("n")
    size = F.sum("n").alias("n_values")
    flat = counts.groupBy(*keys).agg(size, (F.sum(v * n) / F.sum("n")).alias(f"{name}_mean"), F.min(v).alias(f"{name}_min"), F.max(v).alias(f"{name}_max"))
    squares = met(counts, flat.select(*keys, F.col(f"{name}_mean").alias("_m")), keys).groupBy(*keys).agg(F.sum((v - F.col("_m")) * (v - F.col("_m")) * n).alias("_ss"))
    quantiles = quantiles_of_counts(counts, keys, value, {f"{name}_median": 0.5, f"{name}_q25": 0.25, f"{name}_q75": 0.75}, most=most)
    out = met(met(flat, squares, keys), quantiles, keys)
    return out.withColumn(f"{name}_sd", F.sqrt(F.try_divide("_ss", F.col("n_values") - 1))).drop("_ss")


def mad_sigma(df: DataFrame, value: str, keys: list[str], most: int | None = None) -> DataFrame:
    """median and 1.4826 times the median absolute deviation of each group (AGG-19)."""
    counts = value_counts(df.where(F.col(value).isNotNull()), keys, value)
    mid = quantiles_of_counts(counts, keys, value, {"median": 0.5}, most=most)
    off = met(counts, mid, keys).select(*keys, F.abs(F.col(value) - F.col("median")).alias("_off"), "n")
    off = settle(dealt(off, counts.count(), *keys, "_off").groupBy(*keys, "_off").agg(F.sum("n").alias("n")))
    sigma = quantiles_of_counts(off, keys, "_off", {"_mad": 0.5}, most=most)
    return met(mid, sigma, keys).select(*keys, "median", (1.4826 * F.col("_mad")).alias("sigma"))
