"""Points that do not ask are found as neighbours, and cost no search."""

import random

import pytest

from tallyseq.operators import neighbours


@pytest.mark.parametrize("block", [2000, 20])
def test_only_those_that_ask_have_neighbours(spark, monkeypatch, block):
    rng = random.Random(block)
    rows = [(i - 40, [rng.gauss(0, 1) for _ in range(4)], i % 3) for i in range(160)]
    points = spark.createDataFrame(rows, "id long, v array<double>, label int")
    whole = neighbours.knn(points, "id", "v", "label", 5, block=block, pivots=4)
    real, seen = neighbours.visits, []
    monkeypatch.setattr(neighbours, "visits", lambda found, *a: seen.append(found) or real(found, *a))
    some = neighbours.knn(points, "id", "v", "label", 5, block=block, pivots=4, asks=points.id >= 0)
    key = lambda df: sorted((r.id, r.neighbour, r.label, round(r.distance, 9)) for r in df.collect())
    assert key(some) == [x for x in key(whole) if x[0] >= 0]
    assert {x[0] for x in key(some)} == set(range(120))
    assert all(f.where("key < 0").count() == 0 for f in seen)
    none = neighbours.knn(points, "id", "v", "label", 5, block=block, pivots=4, asks=points.id > 1000)
    assert none.count() == 0
