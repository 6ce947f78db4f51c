"""A bounded sample of labelled documents to fit a classifier on.

``per_class`` rows of each class of the training folds, those with the least hash of their id, of at most ``sample_bytes`` each, whole. The share
of label 1 is counted over all labelled training rows. Several labels of one id count as their greatest; rows with a null id or label
are none; repeated rows of one id may all be drawn.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import utf8

#: The range of an id's hash; rows below a share of it are looked at. Large enough for any number of labels.
SPAN = 1 << 62


@dataclass
class Sample:
    """Texts with their labels, and the share of label 1 among all labelled training rows (0 without any)."""

    texts: list[bytes]
    labels: list[int]
    prior: float

    @property
    def whole(self) -> bool:
        """If both classes are there."""
        return len(set(self.labels)) == 2


def sample(docs: DataFrame, labels: DataFrame, column: str, trains: Column, per_class: int, sample_bytes: int) -> Sample:
    """A sample of the rows of ``docs`` for which the condition ``trains`` (on doc_id) holds."""
    marks = labels.select("doc_id", (F.col(column).cast("int") > 0).cast("int").alias("mark")).where("doc_id is not null and mark is not null")
    marks = marks.groupBy("doc_id").agg(F.max("mark").alias("mark")).where(trains)
    found = {r.mark: r.n for r in marks.groupBy("mark").agg(F.count("*").alias("n")).collect()}
    prior = found.get(1, 0) / sum(found.values()) if found else 0.0
    if len(found) < 2:
        return Sample([], [], prior)
    # only about as many rows as asked for meet the texts; which ones is decided by the id alone
    chosen = None
    for mark, n in sorted(found.items()):
        bound = SPAN if n <= 3 * per_class else SPAN // n * 3 * per_class
        part = marks.where((F.col("mark") == mark) & (F.pmod(F.xxhash64("doc_id"), F.lit(SPAN)) < F.lit(bound)))
        chosen = part if chosen is None else chosen.unionByName(part)
    # broadcast: the hash leaves some three times ``per_class`` ids of each class, however many there are; ids meet as text, whatever their types
    chosen = chosen.select(F.col("doc_id").cast("string").alias("id"), F.xxhash64("doc_id").alias("order"), "mark")
    joined = docs.select(F.col("doc_id").cast("string").alias("id"), "text").where(F.octet_length("text") <= sample_bytes).join(F.broadcast(chosen), "id")
    order = Window.partitionBy("mark").orderBy("order", "id", F.xxhash64("text"))
    rows = joined.withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_class).select(utf8(F.col("text")).alias("text"), "mark", "place").collect()
    rows.sort(key=lambda r: (r.mark, r.place))
    return Sample([bytes(r.text) for r in rows], [r.mark for r in rows], prior)
