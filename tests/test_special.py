"""Tails of whole columns against those of single values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyseq.functions import special


def test_normal_tails():
    z = np.concatenate([np.linspace(-38, 38, 4001), [0.0, -0.0, 3.5355, 3.5356, 60.0]])
    want = np.array([special.normal_tail(v) for v in z])
    got = special.normal_tails(z)
    assert np.allclose(got, want, rtol=1e-11, atol=1e-300) and np.isnan(special.normal_tails(np.array([math.nan]))[0])


def test_student_tails():
    rng = np.random.default_rng(1)
    t, df = rng.normal(0, 8, 3000), rng.choice([0.5, 1, 2, 3, 7.3, 30, 400, 1e5], 3000)
    want = [special.student_two_sided(a, b) for a, b in zip(t, df)]
    assert special.students_two_sided(t, df) == pytest.approx(want, rel=1e-9, abs=1e-300)
    odd = [(math.inf, 3.0), (1.0, -1.0), (math.nan, 2.0), (0.0, 5.0), (1.0, math.inf)]
    assert special.students_two_sided(*np.array(odd).T).tolist() == [special.student_two_sided(*o) for o in odd]


def test_columns_with_missing_values(spark):
    df = spark.createDataFrame([(1.0, 3.0), (None, 3.0), (2.0, None), (0.0, 9.0)], "t double, df double").repartition(1)
    got = df.select(special.student_udf()(F.col("t"), F.col("df")).alias("p"), special.normal_udf()(F.col("t")).alias("n")).collect()
    assert sorted((r.p is None, r.n is None) for r in got) == [(False, False), (False, False), (True, False), (True, True)]
    assert df.limit(0).select(special.normal_udf()(F.col("t"))).count() == 0
