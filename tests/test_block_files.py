"""Points do not move once for each block they visit, and single precision loses no neighbour."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyseq.operators import neighbours

from .test_neighbours_and_components import POINTS, plain


def test_visits_are_pairs_of_blocks_and_not_rows_of_points(spark):
    rng = np.random.default_rng(3)
    data = [(i, v.tolist(), 0) for i, v in enumerate(rng.normal(0, 1, (800, 32)))]  # nothing to leave out
    df = spark.createDataFrame(data, POINTS).select(F.col("id").alias("key"), "v", "label")
    placed, centres = neighbours.dealt(df, 40, 10)
    shells = placed.groupBy("pivot", "band").agg(F.min("away").alias("low"), F.max("away").alias("high")).toPandas()
    met = neighbours.visits(neighbours.own_blocks(placed, 5), shells, centres)
    assert "v" not in met.columns
    assert met.count() == met.select("pivot", "band", "to_pivot", "to_band").distinct().count() <= len(shells) * (len(shells) - 1)


@pytest.mark.parametrize("offset,scale", [(0, 1), (1e4, 1), (0, 1e-12), (0, 1e18), (1e-3, 1e-3)])
def test_points_of_any_size_and_copies(spark, offset, scale):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (300, 8))
    x[200:] = x[rng.integers(0, 12, 100)]  # copies, in no order
    data = [(int(i), (offset + v * scale).tolist(), int(i) % 3) for i, v in zip(rng.permutation(300), x)]
    df = spark.createDataFrame(data, POINTS).repartition(3)
    got = sorted((r.id, r.neighbour) for r in neighbours.knn(df, "id", "v", "label", 6, 20, 8).collect())
    assert got == sorted((i, j) for i, j, _, _ in plain(data, 6))


def test_names_as_keys_and_points_without_a_label(spark):
    rng = np.random.default_rng(5)
    data = [(f"p{i:03}", v.tolist(), i % 2 or None) for i, v in enumerate(rng.normal(0, 1, (90, 3)))]
    near = neighbours.knn(spark.createDataFrame(data, "id string, v array<float>, label int"), "id", "v", "label", 4, 10, 5).collect()
    label = {i: l for i, _, l in data}
    want = sorted((data[i][0], data[j][0], label[data[j][0]]) for i, j, _, _ in plain([(n, np.float32(v).tolist(), 0) for n, (_, v, _) in enumerate(data)], 4))
    assert sorted(((r.id, r.neighbour, r.label) for r in near), key=repr) == sorted(want, key=repr)
