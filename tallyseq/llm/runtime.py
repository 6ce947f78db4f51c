"""What the operators share: reliable checkpoints, the shared folder, and small Arrow batches."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Batches between the JVM and Python hold this many bytes or rows at most, so that a few very long
#: texts in one batch do not decide a worker's memory.
BATCH_BYTES = 8 << 20
BATCH_ROWS = 4000

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a folder of our own only where none is set, as in tests."""
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if not where and current.isDefined():
        where = current.get()
    if not where:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = tempfile.mkdtemp(prefix="tallyseq-checkpoints-")
    if current.isEmpty():
        sc.setCheckpointDir(where)
    return where


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept as a table in the shared folder: its lineage ends there.

    A table and no checkpoint, as a checkpoint's frame holds on to the plan it came from, and so to that plan's exchanges
    on the executors' disks and its broadcasts in the driver's memory.
    """
    where = shared_folder(df.sparkSession, "cut")
    df.write.parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)


def shared_folder(spark: SparkSession, name: str) -> str:
    """URI of a new folder below the shared checkpoint folder."""
    base = checkpoint_dir(spark).rstrip("/")
    if "://" not in base and not base.startswith("file:"):
        base = "file://" + os.path.abspath(base)
    return f"{base}/{name}-{uuid.uuid4().hex}"


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a URI (file:, hdfs:, s3:, gs:)."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[len("file:") :].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


class WholeFile:
    """A file that appears whole under its name or not at all: a retried or speculative task replaces it with the same bytes."""

    def __init__(self, uri: str):
        self.fs, self.path = filesystem(uri)
        self.fs.create_dir(os.path.dirname(self.path), recursive=True)
        self.part, self.size = f"{self.path}.{uuid.uuid4().hex}.tmp", 0
        self.out = self.fs.open_output_stream(self.part, compression=None)

    def write(self, chunk: bytes) -> None:
        self.out.write(chunk)
        self.size += len(chunk)

    def done(self) -> int:
        self.out.close()
        self.fs.move(self.part, self.path)
        return self.size


def write_file(uri: str, chunks: Iterator[bytes]) -> int:
    """Write a file whole; returns its size."""
    out = WholeFile(uri)
    for chunk in chunks:
        out.write(chunk)
    return out.done()


def remove_folder(uri: str) -> None:
    """Delete a folder of intermediate files that no result reads any more."""
    fs, path = filesystem(uri)
    if fs.get_file_info(path).type != pafs.FileType.NotFound:
        fs.delete_dir(path)


def fresh(columns: list[str], *names: str) -> list[str]:
    """``names``, with underscores before those that a table has already (in any case)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


@cache
def steady() -> None:
    """From now on this process takes large pieces of memory from the machine and gives each back as it is freed, instead of keeping them."""
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        ctypes.CDLL(None).mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD
    except (OSError, AttributeError):  # not glibc
        pass


def give_back() -> None:
    """Memory that this process has freed goes back to the machine, as the process goes on to do other work."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``batches``; at their end the worker gives freed memory back, as it goes on to serve other stages."""
    steady()
    yield from batches
    give_back()


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, all else as it is; the fast built-in where a text is pure ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def utf8(text: Column) -> Column:
    """The text's bytes; none for null."""
    return F.coalesce(text, F.lit("")).cast("binary")


def doc_bucket(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def buffers(column: pa.Array) -> list[bytes]:
    """The values of a binary Arrow column as bytes, nulls as empty."""
    return [b"" if x is None else x for x in column.to_pylist()]
