"""The quality classifier: its features against plain Python, and held-out accuracy."""

import os
import random
import zlib

import numpy as np
import pytest

from pyspark.sql import functions as F

from tallyseq.llm import labelled, quality, toxicity

from .helpers import LONG, save

SF = "/root/testdata/sf0.1"


def plain_features(text):
    """(words, pairs, n-grams) that a text has."""
    words = [w for w in text.replace("\t", " ").replace("\n", " ").split(" ") if w]
    grams = [(" " + w + " ")[i : i + n] for w in words for n in quality.GRAMS for i in range(len(w) + 3 - n)]
    pairs = ["twice" if a == b else (a, b) for a, b in zip(words, words[1:])]
    return words, pairs, grams


@pytest.mark.parametrize("texts", [["one two two  three", "", " \n\t", "x", "ÉÀ 漢字🎉 a-b!! |", "a" * 300], ["one two two three"]])
def test_features_are_words_pairs_and_grams(texts):
    owner, bucket, _ = quality.features(texts, [None] * len(texts), 1 << 40)
    for i, text in enumerate(texts):
        words, pairs, grams = plain_features(text)
        mine = bucket[owner == i]
        assert len(mine) == len(words) + len(pairs) + len(grams)
        assert len(set(mine.tolist())) == len(set(words)) + len(set(pairs)) + len(set(grams))


def test_texts_by_parts_and_in_any_batch_score_alike():
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["good", "bad", "words", "!!", "|"]) for _ in range(rng.randint(0, 400))) for _ in range(30)] + [LONG, "", " "]
    model = quality.Model(np.random.default_rng(1).normal(size=quality.BUCKETS).astype(np.float32), 0.1)
    whole = quality.scores(texts, model)
    for part in (50, 1000):
        assert np.allclose(quality.scores(texts, model, part), whole, atol=1e-9)
    assert np.array_equal(np.concatenate([quality.scores([t], model) for t in texts]), whole)
    assert whole[-1] == whole[-2] == pytest.approx(1 / (1 + np.exp(-0.1)))


def test_learns_symbols_and_repeats():
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    clean = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(800)]
    junk = [" ".join(w + "!!" for w in rng.choice(clean).upper().split()) for _ in range(150)] + [" ".join([rng.choice(words)] * 60) for _ in range(150)]
    model = quality.train([t.encode() for t in clean[:600] + junk[::2]], [1] * 600 + [0] * 150, 0.8)
    got = quality.scores(clean[600:] + junk[1::2], model)
    assert (got[:200] >= 0.3).mean() > 0.99 and (got[200:] < 0.3).mean() > 0.95


def test_one_class_in_the_sample_gives_the_share(spark):
    """Labels of a class are all of texts too long for the sample."""
    rows = [(i, ("long " * 4000 if i < 20 else f"short text {i}")) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 20), int(i >= 20)) for i in range(100)], "doc_id long, toxic int, quality int")
    for module, column, share in ((toxicity, "toxic", 0.2), (quality, "quality", 0.8)):
        model = module.fit(docs, labels, F.col("doc_id").isNotNull())
        got = [r.score for r in module.score_documents(docs, model, ["doc_id"]).collect()]
        assert got == pytest.approx([share] * 100), column


def test_sample_takes_the_least_hashes_and_both_classes(spark):
    docs = spark.range(4000).selectExpr("id as doc_id", "concat('text ', id) as text")
    labels = spark.range(4000).selectExpr("id as doc_id", "cast(id % 4 = 0 as int) as quality")
    got = labelled.sample(docs, labels, "quality", F.col("doc_id") >= 0, 50, 100)
    assert got.whole and got.prior == 0.25 and got.labels.count(0) == got.labels.count(1) == 50
    again = labelled.sample(docs.repartition(7), labels.repartition(5), "quality", F.col("doc_id") >= 0, 50, 100)
    assert again.texts == got.texts


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_held_out_labels(spark):
    rows = {r.doc_id: r for r in quality.op12_quality(spark, SF).collect()}
    labels = [r for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if rows[r.doc_id].held_out]
    assert all(rows[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in labels)
    low = [rows[r.doc_id].predicted for r in labels if r.quality == 0]
    high = [rows[r.doc_id].predicted for r in labels if r.quality == 1]
    assert len(low) > 100 and np.mean(low) < 0.02 and np.mean(high) > 0.99


def test_scores_are_kept_with_columns_of_any_name(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a text", 5), (None, None, None)], "doc_id long, text string, bytes long")
    save(docs, tmp_path)
    got = quality.score_documents(docs, quality.prior_model(0.5), ["doc_id", "bytes"], "_score").collect()
    assert sorted((r.doc_id is None, r.bytes, r._score) for r in got) == [(False, 5, 0.5), (True, None, 0.5)]
