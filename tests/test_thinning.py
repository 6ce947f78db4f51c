"""Density bins and thinned points."""

import numpy as np
import pytest

from tallyseq.operators import aggregate

POINTS = "id long, label string, x double, y double"


def points(n=900, seed=1):
    rng = np.random.default_rng(seed)
    dense = rng.normal(0, 0.05, (n, 2))
    spread = rng.uniform(-3, 3, (n // 3, 2))
    for i, (x, y) in enumerate(np.concatenate([dense, spread])):
        yield i, "abc"[i % 3], float(x), float(y)


@pytest.mark.parametrize("bins", [1, 7, 40])
def test_bins_are_those_of_a_histogram(spark, bins):
    data = list(points())
    x, y = np.array([r[2] for r in data]), np.array([r[3] for r in data])
    hist, x_edges, y_edges = np.histogram2d(x, y, bins=bins)
    place = lambda v, e: np.clip(np.searchsorted(e, v, side="right") - 1, 0, bins - 1)
    want = hist[place(x, x_edges), place(y, y_edges)]
    got = {r.id: r.density for r in aggregate.density_bins(spark.createDataFrame(data, POINTS), "x", "y", bins).collect()}
    assert [got[r[0]] for r in data] == want.tolist()


def test_missing_coordinates_and_flat_axes(spark):
    rows = [(1, "a", 2.0, 5.0), (2, "a", 2.0, 6.0), (3, "a", None, 1.0), (4, "a", float("nan"), 1.0), (5, "a", float("inf"), 1.0)]
    got = {r.id: (r.x_bin, r.y_bin, r.density) for r in aggregate.density_bins(spark.createDataFrame(rows, POINTS), "x", "y", 4).collect()}
    assert got == {1: (0, 0, 1), 2: (0, 3, 1), 3: (None, None, None), 4: (None, None, None), 5: (None, None, None)}


def test_thinning_keeps_limits_whole_labels_and_sparse_points(spark):
    data = list(points())
    df = spark.createDataFrame(data, POINTS)
    got = aggregate.thinned(df, "label", {"a": 100, "b": 10_000}, "x", "y", ["id"], 20).collect()
    label = {i: kind for i, kind, *_ in data}
    mine = {k: [r.id for r in got if r.label == k] for k in "abc"}
    assert len(mine["a"]) == len(set(mine["a"])) == 100 and set(mine["b"]) == {i for i, k in label.items() if k == "b"} and not mine["c"]
    again = aggregate.thinned(df.repartition(5), "label", {"a": 100, "b": 10_000}, "x", "y", ["id"], 20)
    assert sorted(r.id for r in again.collect()) == sorted(r.id for r in got)
    sparse = sum(i >= 900 for i in mine["a"]) / 100
    assert sparse > 0.4  # a quarter of the points, but those in thin bins
    other = aggregate.thinned(df, "label", {"a": 100}, "x", "y", ["id"], 20, seed=3)
    assert {r.id for r in other.collect()} != set(mine["a"])
