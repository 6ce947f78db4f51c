"""Ranks and quantiles by ranges against plain versions, with ranges forced small."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyseq.operators import ranks, stats


def rows(n=4000, seed=1):
    """Groups of very different sizes, one of them holding most rows; ties, and values next to each other."""
    rng = random.Random(seed)
    for _ in range(n):
        g = rng.choice(["hot"] * 6 + ["a", "b", None, "rare" if rng.random() < 0.02 else "c"])
        yield g, rng.choice([float(rng.randint(-20, 20)), rng.gauss(0, 1e6), 1 + rng.randint(0, 3) * 2**-52]), rng.random() < 0.4


def by_group(data):
    out = {}
    for g, v, inside in data:
        out.setdefault(g, []).append((v, inside))
    return out


@pytest.mark.parametrize("most", [40, None])
def test_running_counts_in_any_ranges(spark, most):
    data = list(rows())
    df = spark.createDataFrame(data, "g string, v double, i boolean")
    got = ranks.mean_ranks(ranks.value_counts(df, ["g"], "v"), ["g"], "v", most=most).collect()
    plain = {}
    for g, own in by_group(data).items():
        values = sorted(v for v, _ in own)
        for v in set(values):
            plain[g, v] = (values.index(v) + 1 + values.index(v) + values.count(v)) / 2
    assert {(r.g, r.v): r["rank"] for r in got} == plain and len(got) == len(plain)


def test_no_range_is_large(spark):
    """A group of nearly all distinct values is ordered by many tasks."""
    values = spark.range(20_000).select(F.when(F.col("id") % 50 == 0, "small").otherwise("hot").alias("g"), (F.col("id") * 7919 % 20_011).cast("double").alias("v"), F.lit(1).cast("long").alias("n"))
    settled = ranks.settle(values)
    dealt = settled.repartitionByRange(20, "g", "v").withColumn("part", F.spark_partition_id())
    assert dealt.groupBy("g", "part").count().agg(F.max("count")).first()[0] < 3000
    got = ranks.running_counts(settled, ["g"], "v", most=1000)
    plan = got._jdf.queryExecution().toString()
    assert "_part" in plan.split("Window [")[1]
    assert got.where("g = 'hot'").agg(F.max("below"), F.count_distinct("below")).first() == (19_599, 19_600)


@pytest.mark.parametrize("most", [30, None])
def test_quantiles_summary_and_mad(spark, most):
    data = list(rows(2500, 2)) + [("one", 5.0, True), ("nulls", None, True)]
    df = spark.createDataFrame(data, "g string, v double, i boolean")
    points = {"p0": 0.0, "p05": 0.05, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    got = {r.g: r for r in ranks.group_quantiles(df, "v", ["g"], points, most).collect()}
    summary = {r.g: r for r in ranks.group_summary(df, "v", ["g"], "x", most).collect()}
    mad = {r.g: r for r in ranks.mad_sigma(df, "v", ["g"], most).collect()}
    plain = {g: np.array([v for v, _ in own if v is not None]) for g, own in by_group(data).items()}
    assert set(got) == set(summary) == set(mad) == {g for g, v in plain.items() if len(v)}
    for g, r in got.items():
        v = plain[g]
        assert [r[p] for p in points] == pytest.approx(np.quantile(v, list(points.values())), rel=1e-12)
        s = summary[g]
        assert (s.n_values, s.x_min, s.x_max) == (len(v), v.min(), v.max()) and s.x_mean == pytest.approx(v.mean(), rel=1e-9, abs=1e-6)
        assert s.x_sd is None if len(v) == 1 else s.x_sd == pytest.approx(v.std(ddof=1), rel=1e-9)
        assert [s.x_q25, s.x_median, s.x_q75] == pytest.approx(np.quantile(v, [0.25, 0.5, 0.75]), rel=1e-12)
        assert (mad[g].median, mad[g].sigma) == pytest.approx((np.median(v), 1.4826 * np.median(abs(v - np.median(v)))), rel=1e-12)


def test_rank_tests_by_ranges_equal_those_in_one(spark):
    data = [r for r in rows(1500, 3) if r[0]]
    df = spark.createDataFrame(data, "g string, v double, i boolean")
    same = lambda f: (sorted(map(tuple, f(30).collect())), sorted(map(tuple, f(None).collect())))
    for a, b in (same(lambda m: stats.mann_whitney(df, "v", "i", ["g"], m)), same(lambda m: stats.pairwise_against(df, "g", "v", "a", most=m))):
        assert len(a) == len(b) > 2
        for x, y in zip(a, b):
            assert x[0] == y[0] and all(i == j or i == pytest.approx(j, rel=1e-12) for i, j in zip(x[1:], y[1:]))
    own = by_group(data)["a"]
    u = sum((x > y) + (x == y) / 2 for x, i in own if i for y, j in own if not j)
    assert {r.g: r.u for r in stats.mann_whitney(df, "v", "i", ["g"], 30).collect()}["a"] == u


def test_correlations_and_their_p_values(spark):
    rng = random.Random(4)
    data = [("a", x := rng.gauss(0, 1), x + rng.gauss(0, 2)) for _ in range(40)] + [("line", float(i), 3.0 * i) for i in range(5)] + [("flat", 1.0, float(i)) for i in range(6)] + [("two", 1.0, 2.0), ("two", 2.0, 1.0), ("a", None, 1.0), ("a", 1.0, None)]
    got = {r.g: r for r in stats.correlations(spark.createDataFrame(data, "g string, x double, y double"), "x", "y", ["g"], 10).collect()}
    x, y = (np.array([r[i] for r in data if r[0] == "a" and None not in r]) for i in (1, 2))
    place = lambda v: np.argsort(np.argsort(v))
    for name, a, b in (("pearson", x, y), ("spearman", place(x), place(y))):
        c = np.corrcoef(a, b)[0, 1]
        t = abs(c) * math.sqrt(38 / (1 - c * c))
        grid = np.linspace(0, t, 200_001)
        density = np.exp(math.lgamma(19.5) - math.lgamma(19)) / math.sqrt(38 * math.pi) * (1 + grid**2 / 38) ** -19.5
        tail = 1 - 2 * np.trapezoid(density, grid)
        assert got["a"][name] == pytest.approx(c, rel=1e-9) and got["a"][f"{name}_p"] == pytest.approx(tail, rel=1e-6) and got["a"].n == 40
    assert got["line"].spearman == pytest.approx(1) and got["line"].spearman_p == pytest.approx(0, abs=1e-9) and got["line"].pearson_p == pytest.approx(0, abs=1e-9)
    assert got["flat"].pearson is None and got["flat"].pearson_p is None and got["two"].pearson_p is None
