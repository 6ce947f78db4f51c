"""Quality by supervised subword embeddings: hashed word and character n-gram vectors, averaged per document, under a softmax.

A text's features are its words and pairs of neighbouring words, as spelt (a word that follows itself is one feature, whichever word it is),
and the n-grams of two to four characters of each word with its ends; each is hashed into a bucket that holds a vector. A text's vector
is the mean of its features' vectors. Vectors and softmax are trained together by stochastic gradient descent in numpy on the driver, over
a bounded sample of labelled rows (``labelled``), a text at a time at a falling rate. After training a bucket is one number (its vector
times the difference of the softmax's rows), so a text's score is a mean of numbers. Features are computed by whole arrays of characters, never word by word.

All documents are scored over their whole texts; a long one is read by parts of some ``PART`` characters, cut between words, with the sum and the last word carried on.

Defined results: a null or empty text, or one of white space, has the bias's score; rows without a label are scored too; without
labels of both classes among the sampled rows every score is the training rows' share of label 1 (1e-6 without rows); a table's
repeated rows are kept; an empty table gives an empty result; extra columns are kept by ``score_documents`` if asked for.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import labelled
from .runtime import buffers, doc_bucket, documents, fresh, give_back, small_batches, tidy, utf8

BUCKETS = 1 << 20
GRAMS = (2, 3, 4)
THRESHOLD = 0.3
#: The sample's bounds: rows of each class, and bytes of each.
PER_CLASS = 1000
SAMPLE_BYTES = 16_000
#: Texts of the sample that must hold a feature for it to be learnt.
LEAST = 3
#: Texts that training looks at, however many there are to go round.
STEPS = 24_000
#: Characters of texts that are read at a time.
PART = 1 << 20
#: Bytes of texts in a batch between the JVM and Python.
BATCH = 2 << 20
#: Means of many features are small numbers; the softmax sees them enlarged.
SCALE = 20.0

_MIX, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x100000001B3)
#: What a word that follows itself counts as, before it is mixed.
_TWICE = np.uint64(0x7477696365)
_WHITE = np.zeros(33, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True


def _mixed(h: np.ndarray, size: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _MIX
    return ((h ^ (h >> np.uint64(32))) % np.uint64(size)).astype(np.int64)


def features(parts: list[str], before: list[int | None], size: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, list[int | None]]:
    """(the part and the bucket of each feature, each part's last word): ``before`` is the hash of the word before each part."""
    c = np.frombuffer("".join([f" {p} " for p in parts]).encode("utf-32-le", "surrogatepass"), "<u4")
    part = np.repeat(np.arange(len(parts)), [len(p) + 2 for p in parts])
    white = c <= 32
    white[white] = _WHITE[c[white]]
    starts = np.ones(len(c), bool)
    starts[1:] = part[1:] != part[:-1]
    keep = ~white | starts
    keep[1:] |= ~white[:-1]  # one space of each run
    d, part, space = np.where(white, 0, c)[keep].astype(np.uint64), part[keep], white[keep]
    owner, bucket = [], []
    with np.errstate(over="ignore"):
        for n in GRAMS:
            if len(d) < n:
                continue
            h = np.full(len(d) - n + 1, n, np.uint64)
            inner = np.ones(len(h), bool)
            for k in range(n):
                h = h * _STEP + d[k : k + len(h)]
                if 0 < k < n - 1:
                    inner &= ~space[k : k + len(h)]
            if n == 2:
                inner = ~(space[:-1] & space[1:])
            owner.append(part[: len(h)][inner] if n == 2 else part[1 : 1 + len(h)][inner])
            bucket.append(_mixed(h[inner], size))
        at = np.flatnonzero(~space)
        first = np.ones(len(at), bool)
        first[1:] = np.diff(at) > 1
        begins = np.flatnonzero(first)
        last = list(before)
        if len(begins):
            place = np.arange(len(at)) - np.repeat(begins, np.diff(np.append(begins, len(at))))
            powers = np.cumprod(np.full(int(place.max()) + 1, _STEP), dtype=np.uint64)
            word = np.add.reduceat(d[at] * powers[place], begins) * _MIX
            of = part[at[begins]]
            owner.append(of)
            bucket.append(_mixed(word + np.uint64(1), size))
            previous = np.roll(word, 1)
            paired = np.ones(len(word), bool)
            head = np.flatnonzero(np.diff(of, prepend=-1))
            for i in head:
                known = before[of[i]]
                paired[i] = known is not None
                previous[i] = known or 0
            tail = np.append(head[1:], len(of)) - 1
            for i in tail:
                last[of[i]] = int(word[i])
            pair = np.where(previous == word, _TWICE, previous * _STEP + word)[paired]
            owner.append(of[paired])
            bucket.append(_mixed(pair, size))
    if not owner:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), last
    return np.concatenate(owner), np.concatenate(bucket), last


@dataclass(frozen=True)
class Model:
    """Each bucket's weight, and the bias."""

    weights: np.ndarray
    bias: float


def prior_model(prior: float) -> Model:
    return Model(np.zeros(BUCKETS, np.float32), float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))))


def train(texts: list[bytes], labels: list[int], prior: float, size: int = BUCKETS, width: int = 8, steps: int = STEPS, rate: float = 0.1, seed: int = 7) -> Model:
    """Fit on whole texts of both classes; ``prior`` is the share of label 1 to restore."""
    rng = np.random.default_rng(seed)
    y = np.array(labels, np.int64)
    counts = np.bincount(y, minlength=2)
    rows, items, times = [], [], []
    for i, text in enumerate(texts):
        _, own, _ = features([text.decode("utf-8", "replace")], [None], size)
        found, n = np.unique(own, return_counts=True)
        rows.append(np.full(len(found), i))
        items.append(found)
        times.append(n / max(len(own), 1))
    row, item, share = np.concatenate(rows), np.concatenate(items), np.concatenate(times).astype(np.float32)
    kept = np.bincount(item, minlength=size)[item] >= LEAST
    used, item = np.unique(item[kept], return_inverse=True)
    row, share = row[kept], share[kept]
    bounds = np.searchsorted(row, np.arange(len(texts) + 1)).tolist()
    table = rng.uniform(-1 / width, 1 / width, (len(used), width)).astype(np.float32)
    soft, bias = np.zeros((width, 2), np.float32), np.zeros(2, np.float32)
    weight = len(y) / (2 * np.maximum(counts, 1))
    rounds, step = -(-steps // len(texts)), 0
    steps = rounds * len(texts)
    for _ in range(rounds):
        for i in rng.permutation(len(texts)):
            own, part = item[bounds[i] : bounds[i + 1]], share[bounds[i] : bounds[i + 1]] * SCALE
            mean = part @ table[own]
            logits = mean @ soft + bias
            p = np.exp(logits - logits.max())
            grad = p / p.sum()
            grad[y[i]] -= 1
            grad *= np.float32(rate * weight[y[i]] * (1 - step / steps))
            step += 1
            table[own] -= part[:, None] * (soft @ grad)
            soft -= np.outer(mean, grad)
            bias -= grad
    weights = np.zeros(size, np.float32)
    weights[used] = SCALE * (table @ (soft[:, 1] - soft[:, 0]))
    return Model(weights, float(bias[1] - bias[0]) + float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))))


def _parts(text: str, length: int = PART) -> Iterator[str]:
    """A text cut before white space, so that each part but the last has ``length`` characters at least."""
    low = 0
    while len(text) - low > length:
        high = low + length
        while high < len(text) and text[high] not in "\t\n\v\f\r ":
            high += 1
        yield text[low:high]
        low = high
    yield text[low:]


def scores(texts: list[str], model: Model, part: int = PART) -> np.ndarray:
    """The probability of label 1 for each text."""
    sums, counts = np.zeros(len(texts)), np.zeros(len(texts))
    size = len(model.weights)
    group, length = [], 0
    for i, text in enumerate(texts):
        if len(text) > part:
            carried: list[int | None] = [None]
            for piece in _parts(text, part):
                _, bucket, carried = features([piece], carried, size)
                sums[i] += np.add.accumulate(model.weights[bucket], dtype=np.float64)[-1] if len(bucket) else 0.0
                counts[i] += len(bucket)
        else:
            group.append(i)
            length += len(text)
        if group and (length >= part or i == len(texts) - 1):
            owner, bucket, _ = features([texts[j] for j in group], [None] * len(group), size)
            sums[group] = np.bincount(owner, model.weights[bucket], len(group))
            counts[group] = np.bincount(owner, minlength=len(group))
            group, length = [], 0
    means = np.divide(sums, counts, out=np.zeros(len(texts)), where=counts > 0)
    return 1 / (1 + np.exp(-np.clip(means + model.bias, -60, 60)))


def fit(docs: DataFrame, labels: DataFrame, trains, per_class: int = PER_CLASS, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """A model from the labelled rows of ``docs`` for which the condition ``trains`` holds."""
    got = labelled.sample(docs, labels, "quality", trains, per_class, sample_bytes)
    model = train(got.texts, got.labels, got.prior) if got.whole else prior_model(got.prior)
    give_back()
    return model


def score_documents(docs: DataFrame, model: Model, keep: list[str], out: str = "score") -> DataFrame:
    """``keep`` and the score, under the name ``out``."""
    spark = docs.sparkSession
    small_batches(spark, size=BATCH)
    shared = spark.sparkContext.broadcast(model)  # four megabytes, whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidy(batches):
            texts = [t.decode("utf-8", "replace") for t in buffers(batch.column(batch.num_columns - 1))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores(texts, shared.value), pa.float64())], [*keep, out])

    chosen = docs.select(*keep, utf8(F.col("text")).alias(*fresh(docs.columns, "bytes")))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in chosen.schema[:-1])
    return chosen.mapInArrow(run, f"{schema}`{out}` double")


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score, by a model that has not seen the held-out fold's labels."""
    docs = documents(spark, sf_dir)
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), doc_bucket(F.col("doc_id"), 5) != 0)
    scored = score_documents(docs, model, ["doc_id"])
    return scored.select("doc_id", (doc_bucket(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
