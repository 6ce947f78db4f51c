"""What the suffix tree exchanges, and its frequent contexts."""

import random

import pytest
from pyspark.sql import functions as F

from tallyseq.llm import suffix_tree


def _shuffled(spark):
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def _scores(spark, texts, **kwargs):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).withColumn("trains", F.col("doc_id") % 5 != 2)
    return {r.doc_id: r for r in suffix_tree.scores(docs, ["doc_id"], "trains", **kwargs).collect()}


def test_exchange_grows_as_the_input_does(spark, monkeypatch):
    """Runs of words that become candidates only in the larger corpus travelled in the smaller one, too."""
    monkeypatch.setattr(suffix_tree, "BLOCK", 20_000)
    rng = random.Random(3)
    made = [" ".join(f"v{rng.randint(0, 3000)}" for _ in range(100)) for _ in range(1000)]
    sent = [_shuffled(spark)]
    for texts in (made, made + made):
        _scores(spark, texts)
        sent.append(_shuffled(spark))
    assert sent[2] - sent[1] < 2.3 * (sent[1] - sent[0])


@pytest.mark.parametrize("depth", [1, 2, 3, 4])
def test_frequent_contexts_score_as_others(spark, monkeypatch, depth):
    """Contexts of any length that go to several parts, parts that are settled in slices."""
    rng = random.Random(5)
    texts = [" ".join(rng.choice("aaaaabbcdefgh") for _ in range(rng.randint(0, 60))) for _ in range(200)] + ["a " * 300, "", None]
    want = _scores(spark, texts, depth=depth)
    monkeypatch.setattr(suffix_tree, "BLOCK", 900)
    for most, size in ((20, 500_000), (400, 50)):
        monkeypatch.setattr(suffix_tree, "undealt", lambda tokens, parts, most=most: most)
        monkeypatch.setattr(suffix_tree, "SLICE", size)
        got = _scores(spark, texts, depth=depth)
        assert {i: r.score for i, r in got.items()} == {i: pytest.approx(r.score, rel=1e-6) for i, r in want.items()}
        assert {i: r[:-1] for i, r in got.items()} == {i: r[:-1] for i, r in want.items()}
