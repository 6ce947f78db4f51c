"""The corpus pipeline: documents, filtered and tokenised stage by stage.

Defined results, for every stage: a null text is an empty one and is kept unless an equal one stands for it; a null
id is compared as null and sorts first; repeated rows of one id and text are judged alike, and one stays after the
near duplicates; an empty table stays empty; without labels of both classes nothing is toxic unless the labelled
training rows are by 0.3 or more; an empty benchmark leaves all documents. Extra columns are kept by the filtering
stages under any name, as the stages' own columns take names that the documents don't have; ids may be of any type
that can be compared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyseq.llm import bpe, decontaminate, near_dedup, toxicity
from tallyseq.llm.runtime import cut, doc_bucket, documents, fresh, remove_folder, shared_folder

#: Up to this many keys of rejected documents are broadcast; beyond it the join is shuffled.
BROADCAST_KEYS = 1_000_000


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject. It is fitted on the labelled documents outside fold 2 of 4."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), doc_bucket(F.col("doc_id"), 4) != 2)
    (score,) = fresh(docs.columns, "toxicity")
    scored = toxicity.score_documents(docs, model, docs.columns, score)
    return scored.where(F.col(score) < toxicity.THRESHOLD).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts alike, the one with the least id."""
    return near_dedup.near_dedup(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words stand in benchmark windows."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    own, id_, hash_ = fresh(docs.columns, "own_hash", "bad_id", "bad_hash")
    text_hash = F.xxhash64(F.coalesce("text", F.lit("")))
    rows = docs.select("doc_id", "text", text_hash.alias(own))
    found = decontaminate.find_hits(rows, items, ["doc_id", own], with_items=False)
    bad = cut(found.where(decontaminate.contaminated(F.col("n_hit"), F.col("n_words"))).select(F.col("doc_id").alias(id_), F.col(own).alias(hash_)).distinct())
    bad = F.broadcast(bad) if bad.count() <= BROADCAST_KEYS else bad
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col(id_)) & (text_hash == F.col(hash_)), "left_anti")


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of each document's token ids and of the bytes they decode to."""
    import public_tokenizers as p

    found = bpe.encode_decode(docs, p.path("byte_bpe_multi_50k.tiktoken"), p.PATTERN, ids=False, keep=["doc_id", "lang", "source"])
    return found.select("doc_id", "lang", "source", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("byte_bpe", tokenise),
]
#: The classifier, the fingerprints and the tokenizer cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to the documents; each stage's result is written to the shared folder and read again.

    A stage's folder goes when the next stage's result is written; the last one stays, as the result reads it.
    """
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        folder = shared_folder(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
        if before:
            remove_folder(before)
        before = folder
    return STAGES[-1][1](spark, docs, sf_dir)
