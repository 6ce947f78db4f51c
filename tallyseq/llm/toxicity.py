"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word is the bag of its character n-grams (with word ends) and itself, hashed into buckets; its vector is the
mean of theirs and a text's vector the mean of its words'. Embeddings and softmax are trained jointly, in numpy on
the driver, with Adam over the whole sample, so a misspelling that was never seen lies near what it is spelt
like. A text of several passages is read by passages as well, and its score is that of the whole or of its most
toxic passage, as few words in many thousands vanish in a mean. After training a bucket is one number
(embedding times softmax difference), so scoring is a lookup a word.

The sample of labelled rows is bounded (``labelled``): ``per_class`` rows of each class of the training folds, of at most ``sample_bytes``
each. The classes' true frequencies, counted over all labelled training rows, are put back into the bias. All documents are
scored over their whole texts.

Defined results: a null or empty text, or one of marks alone, has the bias's score; rows without a label are scored too; several labels of
one id count as their greatest; without labels of both classes among the sampled rows every score is the
training rows' toxic fraction (1e-6 without rows); repeated rows are kept; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import labelled
from .runtime import buffers, doc_bucket, documents, fresh, give_back, small_batches, tidy, utf8

BUCKETS = 1 << 20
GRAMS = (3, 4, 5)
THRESHOLD = 0.3
#: Words a passage has; passages overlap by half.
PASSAGE = 400
PER_CLASS = 1000
SAMPLE_BYTES = 16_000
#: Means of many words are small numbers; the softmax sees them enlarged.
SCALE = 100.0
#: Standard errors by which a bucket's frequencies must differ, and what is added to its counts.
SURE, SMOOTH = 3.0, 5.0


#: What a word has one of at least; runs of marks, such as the bars of a table, are no words.
_LETTER = re.compile(rb"[0-9a-z\x80-\xff]").search


def tokens(text: bytes) -> list[bytes]:
    """Words in lower case (A-Z), marks at their ends taken off."""
    return [w.strip(b".,;:!?\"'()[]") or w for w in text.lower().split() if _LETTER(w)]


def buckets(word: bytes, size: int = BUCKETS) -> list[int]:
    """The buckets of a word and its character n-grams."""
    spelt = "<" + word.decode("utf-8", "replace") + ">"
    out = [zlib.crc32(word) % size]
    for n in GRAMS:
        out += [zlib.crc32(spelt[i : i + n].encode()) % size for i in range(len(spelt) - n + 1)]
    return out


@dataclass(frozen=True)
class Model:
    """Each bucket's weight, the bias, and the passage length in words."""

    weights: np.ndarray
    bias: float
    passage: int = PASSAGE


class _Sums:
    """Sums of the rows of a table by group, forwards and (for gradients) transposed."""

    def __init__(self, group: np.ndarray, item: np.ndarray, weight: np.ndarray, groups: int, items: int):
        order = np.argsort(group, kind="stable")
        self.g, self.i, self.w, self.n = group[order], item[order], weight[order].astype(np.float32), groups
        back = np.argsort(item, kind="stable")
        self.bg, self.bi, self.bw, self.m = group[back], item[back], weight[back].astype(np.float32), items

    @staticmethod
    def _sum(values: np.ndarray, keys: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros((n, values.shape[1]), np.float32)
        if len(keys):
            first = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1])
            out[keys[first]] = np.add.reduceat(values, first, axis=0)
        return out

    def forward(self, table: np.ndarray) -> np.ndarray:
        return self._sum(table[self.i] * self.w[:, None], self.g, self.n)

    def backward(self, grad: np.ndarray) -> np.ndarray:
        return self._sum(grad[self.bg] * self.bw[:, None], self.bi, self.m)


def train(texts: list[bytes], labels: list[int], prior: float, size: int = BUCKETS, width: int = 4, rounds: int = 80, rate: float = 0.02, seed: int = 7) -> Model:
    """Fit on whole texts of both classes; ``prior`` is the toxic fraction to restore.

    Buckets whose document frequencies do not differ between the classes by ``SURE`` standard errors keep weight
    zero: they are noise that a small sample would be learnt by heart from. The others start at their log odds.
    """
    y = np.array(labels, np.float32)
    vocabulary: dict[bytes, int] = {}
    text_of, word_of, share = [], [], []
    for d, text in enumerate(texts):
        words = tokens(text)
        for w, n in Counter(words).items():
            text_of.append(d)
            word_of.append(vocabulary.setdefault(w, len(vocabulary)))
            share.append(n / len(words))
    bags = [np.array(buckets(w, size), np.int64) for w in vocabulary]
    lengths = np.array([len(b) for b in bags], np.int64)
    flat = np.concatenate(bags) if bags else np.zeros(0, np.int64)
    text_of, word_of, share = np.array(text_of, np.int64), np.array(word_of, np.int64), np.array(share)
    counts = np.array([(y == 0).sum(), (y == 1).sum()])
    seen = np.zeros((2, size))
    bounds = np.searchsorted(text_of, np.arange(len(texts) + 1))
    for d in range(len(texts)):
        own = word_of[bounds[d] : bounds[d + 1]]
        if len(own):
            seen[int(y[d]), np.unique(np.concatenate([bags[w] for w in own]))] += 1
    rates = seen / np.maximum(counts, 1)[:, None]
    pooled = seen.sum(0) / max(len(y), 1)
    error = np.sqrt(np.maximum(pooled * (1 - pooled), 1e-9) * (1 / counts).sum())
    telling = np.abs(rates[1] - rates[0]) >= SURE * error
    start = np.log(((seen[1] + SMOOTH) / (counts[1] + 2 * SMOOTH)) / ((seen[0] + SMOOTH) / (counts[0] + 2 * SMOOTH)))
    keep = telling[flat] if len(flat) else np.zeros(0, bool)
    used, item = np.unique(flat[keep], return_inverse=True)
    owner = np.repeat(np.arange(len(bags)), lengths)
    subwords = _Sums(owner[keep], item, (1 / np.maximum(lengths, 1))[owner[keep]], len(bags), len(used))
    mixes = _Sums(text_of, word_of, share, len(texts), len(bags))
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.01, (len(used), width)).astype(np.float32)
    table[:, 0] = start[used]
    soft = rng.normal(0, 0.1, (width, 2)).astype(np.float32)
    soft[0] = (-0.5, 0.5)
    bias = np.zeros(2, np.float32)
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (table, soft, bias)]
    weight = np.where(y == 1, 1 / counts[1], 1 / counts[0]).astype(np.float32)[:, None]
    for step in range(1, rounds + 1):
        averages = mixes.forward(subwords.forward(table)) * SCALE
        logits = averages @ soft + bias
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        grad = (p - np.stack([1 - y, y], 1)) * weight
        gradients = (subwords.backward(mixes.backward(grad @ soft.T)) * SCALE, averages.T @ grad, grad.sum(0))
        for value, g, m in zip((table, soft, bias), gradients, moments):
            m[0] = 0.9 * m[0] + 0.1 * g
            m[1] = 0.99 * m[1] + 0.01 * g * g
            value -= rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-8)
    weights = np.zeros(size, np.float32)
    weights[used] = SCALE * (table @ (soft[:, 1] - soft[:, 0]))
    odds = np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))
    return Model(weights, float(bias[1] - bias[0] + odds))


def scores(texts: list[bytes], model: Model, known: dict[bytes, float] | None = None) -> list[float]:
    """The probability of each text's being toxic."""
    known = {} if known is None else known
    size = len(model.weights)
    out = []
    for text in texts:
        words = tokens(text)
        new = [w for w in set(words) if w not in known]
        if len(known) > 200_000:
            known.clear()
            new = list(set(words))
        if new:
            bags = [buckets(w, size) for w in new]
            ends = np.cumsum([len(b) for b in bags])
            sums = np.add.reduceat(model.weights[np.concatenate([np.array(b) for b in bags])], np.concatenate([[0], ends[:-1]]))
            known.update(zip(new, (sums / np.diff(np.concatenate([[0], ends]))).tolist()))
        v = np.fromiter(map(known.__getitem__, words), np.float64, len(words))
        best = float(v.mean()) if len(v) else 0.0
        if len(v) >= 2 * model.passage:
            run = np.concatenate([[0.0], np.cumsum(v)])
            half = model.passage // 2
            at = np.arange(0, len(v) - half, half)
            end = np.minimum(at + model.passage, len(v))
            best = max(best, float(((run[end] - run[at]) / (end - at)).max()))
        out.append(float(1 / (1 + np.exp(-np.clip(best + model.bias, -60, 60)))))
    return out


def fit(docs: DataFrame, labels: DataFrame, trains, per_class: int = PER_CLASS, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """A model from the labelled rows of ``docs`` for which the condition ``trains`` holds."""
    got = labelled.sample(docs, labels, "toxic", trains, per_class, sample_bytes)
    if got.whole:
        model = train(got.texts, got.labels, got.prior)
    else:
        model = Model(np.zeros(BUCKETS, np.float32), float(np.log(max(got.prior, 1e-6) / max(1 - got.prior, 1e-6))))
    del got
    give_back()
    return model


def score_documents(docs: DataFrame, model: Model, keep: list[str], out: str = "score") -> DataFrame:
    """``keep`` and the score, under the name ``out``."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # four megabytes, whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, float] = {}
        for batch in tidy(batches):
            got = scores(buffers(batch.column(batch.num_columns - 1)), shared.value, known)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(got, pa.float64())], [*keep, out])

    chosen = docs.select(*keep, utf8(F.col("text")).alias(*fresh(docs.columns, "bytes")))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema[:-1])
    return chosen.mapInArrow(run, f"{schema}, `{out}` double")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score, by a model that has not seen the held-out fold's labels."""
    docs = documents(spark, sf_dir)
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), doc_bucket(F.col("doc_id"), 4) != 2)
    held_out = doc_bucket(F.col("doc_id"), 4) == 2
    scored = score_documents(docs, model, ["doc_id"])
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
