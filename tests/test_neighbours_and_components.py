"""Pruned neighbours, connected components and the barcode merge by components, against brute force."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyseq.operators import graph, iterate, neighbours

POINTS = "id long, v array<double>, label int"


def plain(data, k):
    ids = np.array([r[0] for r in data])
    x = np.array([r[1] for r in data])
    for i in range(len(data)):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        order = [j for j in np.lexsort((ids, d)) if j != i][:k]
        for j in order:
            yield ids[i], ids[j], data[j][2], round(float(d[j]), 9)


def clustered(n, dims=3, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 50, (12, dims))
    return [(i, (centres[i % 12] + rng.normal(0, 1, dims)).tolist(), i % 4) for i in range(n)]


def grid(n):
    rng = random.Random(2)
    return [(i * 3, [float(rng.randint(0, 5)), float(rng.randint(0, 5))], i % 2) for i in range(n)]


@pytest.mark.parametrize("data,k,block", [(clustered(600), 5, 30), (grid(300), 7, 25), (grid(40), 50, 7), (clustered(50), 4, 1000), (clustered(1), 3, 10)])
def test_neighbours_equal_brute_force(spark, data, k, block):
    df = spark.createDataFrame(data, POINTS).repartition(3)
    got = sorted((r.id, r.neighbour, r.label, round(r.distance, 9)) for r in neighbours.knn(df, "id", "v", "label", k, block, 16).collect())
    assert got == sorted(plain(data, k))


def test_clusters_far_apart_do_not_meet(spark):
    df = spark.createDataFrame(clustered(1200), POINTS).select(F.col("id").alias("key"), "v", "label")
    placed, centres = neighbours.dealt(df, 25, 48)
    assert placed.groupBy("pivot", "band").count().agg(F.max("count")).first()[0] <= 25
    shells = placed.groupBy("pivot", "band").agg(F.min("away").alias("low"), F.max("away").alias("high")).toPandas()
    met = neighbours.visits(neighbours.own_blocks(placed, 5), shells, centres).select("pivot", "band", "to_pivot", "to_band").distinct().count()
    assert met < 0.4 * len(shells) * (len(shells) - 1)


def test_one_pivot_with_all_points_is_cut_into_bands(spark):
    """Points that are all alike lie in blocks of bounded size all the same."""
    data = [(i, [1.0, 1.0], 0) for i in range(90)] + [(100, [9.0, 9.0], 1)]
    df = spark.createDataFrame(data, POINTS)
    placed, _ = neighbours.dealt(df.select(F.col("id").alias("key"), "v", "label"), 10, 4)
    assert placed.groupBy("pivot", "band").count().agg(F.max("count")).first()[0] <= 10
    got = sorted((r.id, r.neighbour) for r in neighbours.knn(df, "id", "v", "label", 2, 10, 4).collect())
    assert got == sorted((i, j) for i, j, _, _ in plain(data, 2))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components_equal_a_walk(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(400, 480)] + [(7, 7), (500, 501), (501, 500)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(up)}


def test_no_edges(spark):
    assert graph.components(spark.createDataFrame([(1, 1)], "a long, b long")).collect() == []


BARCODES = "cell string, barcode string, umi string, reads long, feature string, identity string"


def cells(seed, n_cells=6, n=70):
    rng = random.Random(seed)
    for c in range(n_cells):
        identity = {}
        for _ in range(n):
            b = "".join(rng.choice("ACG") for _ in range(6)) if rng.random() < 0.6 else rng.choice(["AAAAAA", "AAAAAC", "GGGGGG"])
            yield f"c{c}", b, f"u{rng.randint(0, 40)}", rng.randint(1, 9), rng.choice("fgh"), identity.setdefault(b, rng.choice(["x", "y", None, ""]))


@pytest.mark.parametrize("seed", [1, 2])
def test_components_merge_as_whole_cells(spark, seed):
    rows = list(cells(seed))
    kept, events = iterate.correct_barcodes(spark.createDataFrame(rows, BARCODES).repartition(5), 6)
    want_kept, want_events = [], []
    for cell in sorted({r[0] for r in rows}):
        own = pd.DataFrame([r[1:] for r in rows if r[0] == cell], columns=["barcode", "umi", "reads", "feature", "identity"])
        k, e = iterate.merge_barcodes(cell, own)
        want_kept += [(cell, b, f, u, n) for b, f, u, n in k]
        want_events += [(cell, x[0], x[1], x[2], x[3], x[9], x[10]) for x in e]
    assert sorted(map(tuple, kept.collect())) == sorted(want_kept)
    assert sorted(map(tuple, events.collect())) == sorted(want_events) and len(want_events) > 20


def test_a_cell_of_many_barcodes_is_many_components(spark):
    """100 000 barcodes of one cell, in pairs that are alike: no component has more than its pair."""
    base = spark.range(50_000).select(F.concat(*[F.element_at(F.array(*map(F.lit, "ACGT")), (F.shiftright("id", 2 * (i // 3)).bitwiseAND(F.lit(3)) + 1).cast("int")) for i in range(24)]).alias("b"))
    twin = base.withColumn("barcode", F.explode(F.array("b", F.concat(F.expr("substring(b, 1, 23)"), F.translate(F.substring("b", 24, 1), "ACGT", "CGTA")))))
    rows = twin.select(F.lit("c").alias("cell"), "barcode", F.lit("u").alias("umi"), F.lit(7).cast("long").alias("reads"), F.lit("f").alias("feature"), F.lit("i").alias("identity"))
    found = iterate.barcode_components(rows, 24, 1)
    sizes = found.groupBy("component").count().agg(F.max("count"), F.count("*")).first()
    assert sizes == (2, 50_000)


def test_many_small_components_take_no_call_each(spark, monkeypatch):
    """6000 cells of one component each: a call for each of them took most of the time."""
    rows = spark.range(18_000).selectExpr("cast(id % 6000 as string) as cell", "case when id < 12000 then 'ACGTAC' else 'ACGTAA' end as barcode", "concat('u', id) as umi", "7L as reads", "'f' as feature", "'i' as identity")
    monkeypatch.setattr(type(rows.groupBy("cell")), "applyInPandas", lambda *_: pytest.fail("a call for each component"))
    kept, events = iterate.correct_barcodes(rows, 6)
    assert {tuple(r)[1:] for r in kept.collect()} == {("ACGTAC", "f", 3, 21)} and kept.count() == 6000
    assert {tuple(r)[1:] for r in events.collect()} == {(1, "ACGTAA", "ACGTAC", 1, 3, 21)} and events.count() == 6000
    assert iterate.merge_barcodes("0", rows.where("cell = '0'").toPandas())[0] == [("ACGTAC", "f", 3, 21)]
