"""Aggregates, windows and reshaping with explicit tie-breaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import finite


def geometric_mean(c: Column) -> Column:
    """Of the positive values; 0 where there are none (AGG-06)."""
    return F.coalesce(F.exp(F.avg(F.when(c > 0, F.ln(c)))), F.lit(0.0))


def dominant(df: DataFrame, keys: list[str], label: list[str], weights: list[str], fraction: float, strict: bool = False) -> DataFrame:
    """Each key's label with the greatest weights and its share of the first weight; ``assigned`` from ``fraction`` on (AGG-07, Q-14).

    Ties go to the greatest label, so the result is the same on every run.
    """
    per = df.groupBy(*keys, *label).agg(*[F.sum(w).alias(w) for w in weights])
    best = per.groupBy(*keys).agg(F.max(F.struct(*weights, *label)).alias("_b"), F.sum(weights[0]).alias("total"), F.count("*").alias("components"))
    share = F.try_divide(F.col(f"_b.{weights[0]}").cast("double"), F.col("total"))
    out = best.select(*keys, *[F.col(f"_b.{x}").alias(x) for x in label], F.col(f"_b.{weights[0]}").alias("dominant"), "total", "components", share.alias("fraction"))
    return out.withColumn("assigned", F.col("fraction") > fraction if strict else F.col("fraction") >= fraction)


def unique_mode(df: DataFrame, keys: list[str], label: list[str]) -> DataFrame:
    """The most frequent label of each key; keys with a tie are dropped (AGG-10)."""
    per = df.groupBy(*keys, *label).count()
    top = Window.partitionBy(*keys)
    best = per.withColumn("_m", F.max("count").over(top)).where("count = _m").withColumn("_n", F.count("*").over(top))
    return best.where("_n = 1").drop("_m", "_n")


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row of each key, the first in an explicit order (PRJ-03, WIN-04)."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """WIN-08."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= k).drop("_n")


def zscore(c: Column, keys: list[str], population: bool = True, otherwise: float = 0.0) -> Column:
    """Score within the group; ``otherwise`` where the deviation is 0 or missing (WIN-02, ST-24)."""
    w = Window.partitionBy(*keys)
    sd = (F.stddev_pop if population else F.stddev_samp)(c).over(w)
    return F.coalesce((c - F.avg(c).over(w)) / F.nullif(sd, F.lit(0.0)), F.lit(otherwise))


def grid(df: DataFrame, dims: dict[str, list], zeros: list[str]) -> DataFrame:
    """Every combination of the dimensions' values, given as lists; missing measures are 0 (PRJ-18)."""
    out = df.sparkSession.range(1).drop("id")
    for name, values in dims.items():
        out = out.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    return out.join(df, list(dims), "left").na.fill(0, zeros)


def merged_intervals(df: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Islands of overlapping or touching intervals (WIN-07). Those without ends come last and join the island before them, or are alone without one."""
    order = Window.partitionBy(*keys).orderBy(F.asc_nulls_last(start), F.asc_nulls_last(end))
    before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("_new", F.when(before.isNull() | (F.col(start) > before), 1).otherwise(0))
    island = marked.withColumn("_i", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*keys, "_i").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n")).drop("_i")


def block_positions(df: DataFrame, group: str, order: Column, gap: float) -> DataFrame:
    """Each group's block of ``n`` places on an axis, half a place of margin on either side, and a gap to the next (WIN-06)."""
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum(F.col("n") + gap).over(w), F.lit(0.0))
    return df.withColumn("_f", first).withColumns({"start": F.col("_f") - 0.5, "end": F.col("_f") + F.col("n") - 0.5, "center": F.col("_f") + (F.col("n") - 1) / 2}).drop("_f")


def histogram(c: Column, edges: list[float]) -> Column:
    """0-based bin of right-open bins, the last one closed; NULL outside (AGG-21)."""
    out = F.lit(None).cast("int")
    for i in reversed(range(len(edges) - 1)):
        last = i == len(edges) - 2
        out = F.when((c >= edges[i]) & ((c <= edges[i + 1]) if last else (c < edges[i + 1])), i).otherwise(out)
    return out


def drawn(seed: int, ident: list[str]) -> Column:
    """A number between 0 and 1 that depends on the seed and the row's ``ident`` alone."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ident])
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long") + 1) / float((1 << 52) + 1)


def weighted_sample(df: DataFrame, keys: list[str], weight: Column, n: int, seed: int, ident: list[str]) -> DataFrame:
    """n rows of each key without replacement, with chances by weight; the draw depends on the seed and the row's ``ident`` alone (RND-01, RND-02)."""
    return top_per_group(df.withColumn("_d", -F.ln(drawn(seed, ident)) / weight), keys, [F.col("_d"), *map(F.col, ident)], n).drop("_d")


def density_bins(df: DataFrame, x: str, y: str, bins: int) -> DataFrame:
    """``df`` with x_bin, y_bin of ``bins`` even bins on each axis from least to greatest value, the last one closed, and density, the points of the bin (AGG-21).

    Points without two finite coordinates have neither. An axis of one value has one bin.
    """
    there = finite(F.col(x)) & finite(F.col(y))
    ends = F.broadcast(df.where(there).agg(F.min(x).alias("_x0"), F.max(x).alias("_x1"), F.min(y).alias("_y0"), F.max(y).alias("_y1")))  # one row
    place = lambda c, a, b: F.when(there, F.least(F.coalesce(F.floor(F.try_divide(F.col(c) - F.col(a), (F.col(b) - F.col(a)) / bins)), F.lit(0)), F.lit(bins - 1))).cast("int")
    placed = df.crossJoin(ends).withColumns({"x_bin": place(x, "_x0", "_x1"), "y_bin": place(y, "_y0", "_y1")}).drop("_x0", "_x1", "_y0", "_y1")
    counts = placed.where("x_bin is not null").groupBy("x_bin", "y_bin").agg(F.count("*").alias("density"))
    return placed.join(F.broadcast(counts), ["x_bin", "y_bin"], "left").select(*df.columns, "x_bin", "y_bin", "density")  # at most bins * bins rows


def thinned(df: DataFrame, label: str, limits: dict, x: str, y: str, ident: list[str], bins: int = 180, seed: int = 475) -> DataFrame:
    """Points of each label, up to its limit, those of dense bins less likely; labels without a limit are left out (RND-01, RND-03, Q-21).

    A point's weight is one over the root of its bin's count. The draw is without replacement and depends on the seed and the point's ``ident`` alone.
    """
    listed = F.create_map(*[F.lit(v) for kv in limits.items() for v in kv])
    chosen = density_bins(df, x, y, bins).where(F.col(label).isin(*limits))
    weight = 1 / F.sqrt(F.greatest(F.coalesce("density", F.lit(1)), F.lit(1)))
    ranked = chosen.withColumn("_d", -F.ln(drawn(seed, ident)) / weight)
    # a bound that all labels share is taken before rows move; each label's own bound after it
    first = ranked.withColumn("_n", F.row_number().over(Window.partitionBy(label).orderBy("_d", *ident))).where(F.col("_n") <= max(limits.values()))
    return first.where(F.col("_n") <= listed[F.col(label)]).drop("_d", "_n")


def top_names(df: DataFrame, keys: list[str], name: str, order: list[Column], k: int = 12, sep: str = ";") -> DataFrame:
    """The first k names of each key in an explicit order, as one text (AGG-13). Only k rows of a key are gathered."""
    first = df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= k)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("_n", name))), lambda x: x[name])
    return first.groupBy(*keys).agg(F.array_join(listed, sep).alias("names"))
