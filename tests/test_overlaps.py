"""Overlaps against brute force, and of stacks of features that would make too many pairs."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tallyseq.operators import match


@pytest.mark.parametrize("size,spans", [(4, 1_000_000), (64, 7), (16384, 50)])
@pytest.mark.parametrize("kind", ["string", "long"])
def test_overlaps_as_brute_force(spark, size, spans, kind):
    rng = random.Random(size)
    name = (lambda i: f"g{i}") if kind == "string" else (lambda i: i)
    features = [(rng.choice("ab"), s, s + rng.randint(-1, 30), name(rng.randint(0, 9))) for s in (rng.randint(-40, 300) for _ in range(60))] + [("a", 5, 9, None)]
    blocks = [(i, rng.choice(["a", "b", "c", None]), s, s + rng.randint(-1, 60)) for i in range(300) for s in (rng.randint(-60, 330) for _ in range(rng.randint(1, 3)))]
    want = {}
    for i, c, s, e in blocks:
        want.setdefault(i, set()).update(g for fc, fs, fe, g in features if fc == c and g is not None and e > s and fe > fs and fs < e and fe > s)
    want = {i: ("no_feature", None) if not g else ("counted", *g) if len(g) == 1 else ("ambiguous", None) for i, g in want.items()}
    b = spark.createDataFrame(blocks, "id int, chrom string, start int, end int")
    f = spark.createDataFrame(features, f"chrom string, start int, end int, gene {kind}")
    got = match.overlaps(b, f, ["id"], "gene", bin_size=size, spans=spans)
    assert got.schema["gene"].dataType.simpleString() == {"string": "string", "long": "bigint"}[kind]
    assert {r.id: (r.status, r.gene) for r in got.collect()} == want


def test_stacked_features_make_no_pairs(spark):
    """200 000 reads over 200 000 features in one place are 4e10 pairs."""
    begun = time.time()
    f = spark.range(200_000).select(F.lit("a").alias("chrom"), (F.col("id") % 700).cast("int").alias("start"), (F.col("id") % 700 + 300).cast("int").alias("end"), F.col("id").alias("gene"))
    b = spark.range(200_000).select("id", F.lit("a").alias("chrom"), (F.col("id") % 999 - 1).cast("int").alias("start"), (F.col("id") % 999 + 200).cast("int").alias("end"))
    assert {r.status: r.n for r in match.overlaps(b, f, ["id"], "gene", bin_size=1024).groupBy("status").agg(F.count("*").alias("n")).collect()} == {"ambiguous": 200_000}
    assert time.time() - begun < 120
