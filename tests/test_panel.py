"""Expression of a panel of genes equals the panel's part of the whole matrix's, and moves no other gene."""

from pyspark.sql import functions as F

from tallyseq.operators import matrix
from tallyseq.plans import cells


def test_panel_is_part_of_the_whole(spark):
    rows = [(1, ["a", "b", "a", "x"]), (1, ["a"]), (2, ["x", "y"]), (3, []), (4, None), (5, ["b"] * 300), (None, ["a", "x"])]
    words = spark.createDataFrame(rows, "cell long, words array<string>")
    triples = words.select("cell", F.explode("words").alias("gene")).groupBy("cell", "gene").agg(F.count("*").alias("count"))
    key = lambda df: sorted(((r.cell, r.gene, r["count"], round(r.expr, 9)) for r in df.where("gene in ('a', 'b') and cell is not null").collect()), key=repr)
    got = matrix.panel_normalised(words, "words", ["a", "b"])
    assert key(got) == key(matrix.log_normalised(triples))
    assert len(key(got)) == 3


def test_queries_of_a_panel_keep_no_whole_matrix(spark, monkeypatch):
    kept = []
    real = cells.settle
    monkeypatch.setattr(cells, "settle", lambda df: kept.append(real(df)) or kept[-1])
    for query, genes in ((cells.sparse_group_means, cells.PANEL), (cells.signature_score, cells.PANEL), (cells.marker_cell_class, cells.DC_MARKERS + cells.T_MARKERS)):
        kept.clear()
        query(spark, "/root/testdata/sf0.001").collect()
        assert all(df.where(~F.col("gene").isin(genes)).count() == 0 for df in kept)
