"""Tasks' rows are bounded where they are sorted or hashed, and exact quantiles take few passes."""

import random

import pytest
from pyspark.sql import functions as F

from tallyseq.operators import lineage, ranks, stats


def test_dealt_rows_of_a_task(spark):
    df = spark.range(10_000).withColumn("k", F.col("id") % 997)
    assert lineage.dealt(df, 10_000, "k", most=100).rdd.getNumPartitions() == 100
    sizes = lineage.dealt(df, 10_000, "k", most=100).groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert sizes < 400
    assert lineage.dealt(df, 300, "k", most=100) is df


@pytest.mark.parametrize("n", [1000, 1001])
def test_quantiles_take_one_run_of_passes(spark, monkeypatch, n):
    rng = random.Random(n)
    values = [rng.choice([rng.gauss(0, 1), rng.randint(-3, 3), 1e6]) for _ in range(n)]
    rows = spark.createDataFrame([(float(v),) for v in values], "v double")
    for q in (0.0, 0.05, 0.3333, 0.5, 0.95, 0.999, 1.0):
        for most in (1, 7, 100):
            want = rows.agg(F.percentile("v", F.lit(q))).first()[0]
            assert stats.quantile(rows, F.col("v"), q, n, most=most) == pytest.approx(want, abs=1e-12)
    real, asked = type(rows).agg, []
    monkeypatch.setattr(type(rows), "agg", lambda df, *c: asked.append(1) or real(df, *c))
    stats.quantile(rows, F.col("v"), 0.5, n, most=100)
    assert len(asked) == 2  # the ends, and both neighbours at once


def test_values_of_a_group_are_dealt_and_groups_are_not_brought_together(spark, monkeypatch):
    rows = spark.range(6000).select((F.col("id") % 2).alias("g"), ((F.col("id") * 7919 % 5003) / 8).alias("v"))
    want = {g: (m, 1.4826 * s) for g, m, s in rows.groupBy("g").agg(F.median("v").alias("m")).join(rows, "g").groupBy("g", "m").agg(F.median(F.abs(F.col("v") - F.col("m")))).collect()}
    counted = []
    monkeypatch.setattr(ranks, "dealt", lambda df, n, *keys: counted.append((n, keys)) or lineage.dealt(df, n, *keys, most=100))
    real, parts = ranks.settle, []
    monkeypatch.setattr(ranks, "settle", lambda df: (parts.append(df.rdd.getNumPartitions()), real(df))[1])
    found = ranks.mad_sigma(rows, "v", ["g"], most=300)
    assert {r.g: (r.median, pytest.approx(r.sigma)) for r in found.collect()} == want
    assert [n for n, _ in counted][0] == 6000 and len(counted) == 2 and parts[0] == 60
    assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
