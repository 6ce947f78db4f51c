"""Sparse gene x cell matrices as (gene, cell, count) triples; zeros are not stored, so means divide by all cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .match import small


def library_sizes(triples: DataFrame) -> DataFrame:
    """Counts and genes of each cell (MTX-01)."""
    return triples.groupBy("cell").agg(F.sum("count").alias("n_counts"), F.count_if(F.col("count") != 0).alias("n_genes"))


def log_normalised(triples: DataFrame, scale: float = 1e4) -> DataFrame:
    """ln(1 + count / library * scale) (MTX-02)."""
    sized = triples.join(library_sizes(triples).select("cell", "n_counts"), "cell")
    return sized.withColumn("expr", F.log1p(F.col("count") / F.greatest("n_counts", F.lit(1)) * scale)).drop("n_counts")


def panel_normalised(cells: DataFrame, words: str, genes: list[str], scale: float = 1e4) -> DataFrame:
    """``log_normalised`` triples of the listed genes alone, of cells given by rows with an array of their genes, one entry for each count.

    A row's size is the length of its array, so counts of other genes never leave it. A cell's rows are summed.
    """
    own = cells.where("cell is not null").select("cell", F.when(F.col(words).isNotNull(), F.size(words)).cast("long").alias("_n"), F.filter(words, lambda w: w.isin(genes)).alias("_w"))
    hits = own.select("cell", "_n", F.posexplode_outer("_w").alias("_p", "gene"))
    per = hits.groupBy("cell", "gene").agg(F.count("gene").alias("count"), F.sum(F.when(F.coalesce("_p", F.lit(0)) == 0, F.col("_n"))).alias("_n"))
    sized = per.withColumn("_n", F.sum("_n").over(Window.partitionBy("cell"))).where("gene is not null")
    return sized.withColumn("expr", F.log1p(F.col("count") / F.greatest("_n", F.lit(1)) * scale)).drop("_n")


def unique_genes(triples: DataFrame, names: DataFrame) -> DataFrame:
    """Of genes with one symbol the row with the largest total, then the first (MTX-03). names: gene, symbol."""
    totals = names.join(triples.groupBy("gene").agg(F.sum("count").alias("_t")), "gene", "left").na.fill(0, ["_t"])
    return totals.groupBy("symbol").agg(F.max(F.struct("_t", (-F.col("gene")).alias("n"))).alias("_b")).select("symbol", (-F.col("_b.n")).alias("gene"))


def group_means(expr: DataFrame, groups: DataFrame, genes: DataFrame) -> DataFrame:
    """Mean over all cells of a group and over those that express the gene (MTX-05). groups: cell, group; genes: gene."""
    sizes = groups.groupBy("group").agg(F.count("*").alias("n_cells"))
    sums = expr.join(groups, "cell").join(genes, "gene", "left_semi").groupBy("gene", "group").agg(F.sum("expr").alias("s"), F.sum(F.col("expr") * F.col("expr")).alias("ss"), F.count("*").alias("n_expressing"))
    full = genes.select("gene").crossJoin(sizes)  # a panel of genes times a handful of groups
    out = full.join(sums, ["gene", "group"], "left").na.fill(0, ["s", "ss", "n_expressing"])
    return out.withColumns({"mean": F.col("s") / F.col("n_cells"), "mean_expressing": F.try_divide("s", "n_expressing"), "detected": F.col("n_expressing") / F.col("n_cells")})


def marker_score(expr: DataFrame, markers: DataFrame, genes: DataFrame) -> DataFrame:
    """Mean over the markers that the matrix has of the normalised expression (ST-30). markers, genes: gene.

    ``genes`` names the matrix's rows, whether any cell expresses them or not. Markers that it lacks don't count in the
    divisor; without any there are no scores.
    """
    wanted = small(markers.select("gene").distinct())
    n = genes.join(wanted, "gene", "left_semi").agg(F.count_distinct("gene").alias("_n"))  # one row
    hits = expr.join(wanted, "gene", "left_semi").join(genes.select("gene").distinct(), "gene", "left_semi")
    return hits.groupBy("cell").agg(F.sum("expr").alias("_s")).crossJoin(F.broadcast(n)).select("cell", (F.col("_s") / F.col("_n")).alias("score"))


def gene_index(features: DataFrame, order: str, symbol: str = "symbol", kind: str = "feature_type", wanted: str = "Gene Expression") -> DataFrame:
    """The first row of each symbol among the features of one kind (MTX-04)."""
    return features.where(F.col(kind) == wanted).groupBy(symbol).agg(F.min(order).alias(order))


def nonzero_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that have any value other than 0 or missing in the columns (MTX-06)."""
    return df.where(F.exists(F.array(*columns), lambda x: F.coalesce(x != 0, F.lit(False))))


def standardised(df: DataFrame, columns: list[str], floor: float = 1e-6) -> DataFrame:
    """Columns less their means over their population deviations, which are ``floor`` at least (MTX-07)."""
    moments = df.agg(*[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns])  # one row
    wide = df.crossJoin(F.broadcast(moments))
    scaled = {c: (F.col(c) - F.col(f"_m_{c}")) / F.greatest(f"_s_{c}", F.lit(floor)) for c in columns}
    return wide.withColumns(scaled).select(*df.columns)


def cell_class(a: Column, b: Column, least: float = 0.05, margin: float = 0.05) -> Column:
    """dc or t where that score is large enough and ahead of the other, else unknown (Q-16)."""
    return F.when((a >= least) & (a > b + margin), "dc").when((b >= least) & (b > a + margin), "t").otherwise("unknown")
