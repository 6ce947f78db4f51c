"""Session factory with the settings the engine's plans are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(app: str = "tallyseq", master: str | None = None, **conf: str) -> SparkSession:
    """A session with AQE, UTC and Arrow on. ``conf`` (dots as ``__``) wins over the defaults."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    return builder.config(map=settings).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str):
    """One of the driver's parquet tables; only Spark opens the path, so any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
