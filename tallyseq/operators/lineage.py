"""Ending a plan's lineage on reliable checkpoints."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder the session names, which all executors share; a folder of our own only on a local master."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        where = sc.getConf().get("spark.checkpoint.dir")
        if not where:
            if sc.master != "local" and not sc.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            import tempfile

            where = tempfile.mkdtemp(prefix="tallyseq-")
        sc.setCheckpointDir(where)
    return sc._jsc.sc().getCheckpointDir().get()


def settle(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of a task that sorts them or holds them in a hash map.
TASK_ROWS = 250_000


def dealt(df: DataFrame, rows: int, *keys: str, most: int = TASK_ROWS) -> DataFrame:
    """``df``, of some ``rows`` rows, by its keys over as many tasks as hold ``most`` rows each; few rows are left to the session.

    Shuffles merge small parts by their packed bytes, so that a task's memory would grow with the input where rows pack well.
    """
    return df.repartition(-(-rows // most), *keys) if rows > 4 * most else df


def stored(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept as a table in the shared checkpoint folder, whose columns are packed and read as they are asked for."""
    where = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)
