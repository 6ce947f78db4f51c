"""FASTQ readers as Spark data sources: one partition a file, as gzip cannot be split."""

from __future__ import annotations

import fnmatch
import gzip
import io
import os
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SUFFIXES = (".fastq.gz", ".fq.gz", ".fastq", ".fq")
BATCH = 20_000


class _File(InputPartition):
    def __init__(self, *paths: str):
        self.paths = paths


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI or local path, and the path on it."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[len("file:") :].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), os.path.abspath(path))


def _matching(fs: pafs.FileSystem, where: str, parts: list[str]) -> Iterator[str]:
    """Files below a folder that fit a pattern part by part: ``*`` never crosses a folder's border, and ``**`` is any number of folders."""
    if not parts:
        return
    if parts[0] == "**":
        yield from _matching(fs, where, parts[1:])
    for info in fs.get_file_info(pafs.FileSelector(where, allow_not_found=True)):
        if info.type == pafs.FileType.Directory and parts[0] == "**":
            yield from _matching(fs, info.path, parts)
        elif fnmatch.fnmatchcase(info.base_name, parts[0]):
            if info.type == pafs.FileType.Directory:
                yield from _matching(fs, info.path, parts[1:])
            elif len(parts) == 1:
                yield info.path


def listed(path: str, suffixes: tuple[str, ...] = SUFFIXES) -> list[str]:
    """Files of a folder or pattern, by name (SRC-07). Same-named files of several folders stay apart by their path."""
    fs, where = filesystem(path)
    head = path[: len(path) - len(where)] if path.endswith(where) else ""
    if fs.get_file_info(where).type == pafs.FileType.Directory:
        found = set(_matching(fs, where, ["*"]))
    else:
        fixed = os.path.dirname(where[: min((where.find(c) for c in "*?[" if c in where), default=len(where))])
        found = set(_matching(fs, fixed, where[len(fixed) :].strip("/").split("/")))
    return [head + f for f in sorted((f for f in found if f.lower().endswith(suffixes)), key=lambda f: (os.path.basename(f), f))]


def opened(path: str) -> io.BufferedReader:
    """A file of any file system as a stream of its bytes."""
    fs, where = filesystem(path)
    return io.BufferedReader(fs.open_input_stream(where, compression=None), 1 << 20)


def random_access(path: str):
    """A file of any file system, to be read at any place."""
    fs, where = filesystem(path)
    return fs.open_input_file(where)


def _open(path: str):
    return gzip.open(opened(path), "rb") if path.endswith(".gz") else opened(path)


def batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches."""
    while part := list(islice(rows, BATCH)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), schema)], schema=schema)


def records(path: str, strict: bool, require_at: bool, upper: bool, quality: bool = False) -> Iterator[tuple[str, str]]:
    """(read id, sequence). strict: a record that is cut short is an error; quality: one without its quality line is; require_at: odd headers are skipped."""
    with _open(path) as lines:
        while head := lines.readline():
            seq, plus, qual = lines.readline(), lines.readline(), lines.readline()
            if strict and not (seq and plus and qual):
                raise ValueError(f"{path}: incomplete FASTQ record")
            if quality and not qual:
                raise ValueError(f"{path}: FASTQ record without a quality line")
            if not seq:
                return
            name = head.decode("utf-8", "ignore").strip()
            if require_at and not name.startswith("@"):
                continue
            text = seq.decode("utf-8", "ignore").strip()
            yield (name[1:].split() or [""])[0] if name.startswith("@") else (name.split() or [""])[0], text.upper() if upper else text


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        flag = lambda k, d: str(options.get(k, d)).lower() == "true"
        self.strict, self.require_at, self.upper, self.quality = flag("strict", "true"), flag("requireat", "false"), flag("upper", "true"), flag("quality", "false")
        self.suffixes = tuple(options.get("suffixes", ",".join(SUFFIXES)).split(","))

    def partitions(self):
        return [_File(p) for p in listed(self.path, self.suffixes)] or [_File()]

    def read(self, partition):
        schema = pa.schema([("file", pa.string()), ("path", pa.string()), ("read_idx", pa.int64()), ("read_id", pa.string()), ("seq", pa.string()), ("seq_len", pa.int32())])
        for path in partition.paths:
            name = os.path.basename(path)
            found = records(path, self.strict, self.require_at, self.upper, self.quality)
            yield from batches(((name, path, i, read, text, len(text)) for i, (read, text) in enumerate(found)), schema)


class FastqSource(DataSource):
    """Options: path, strict, requireAt, quality, upper, suffixes (SRC-01 to SRC-05). ``file`` names the sample, also over several folders; ``path`` tells its files apart (SRC-08)."""

    @classmethod
    def name(cls):
        return "fastq"

    def schema(self):
        return "file string, path string, read_idx long, read_id string, seq string, seq_len int"

    def reader(self, schema):
        return _Reader(self.options)


class _PairReader(DataSourceReader):
    def __init__(self, options):
        self.first, self.second = options["first"], options["second"]

    def partitions(self):
        a, b = listed(self.first), listed(self.second)
        if len(a) != len(b):
            raise ValueError(f"{len(a)} first and {len(b)} second files")
        return [_File(*p) for p in zip(a, b)] or [_File()]

    def read(self, partition):
        schema = pa.schema([("file", pa.string()), ("read_idx", pa.int64()), ("seq1", pa.string()), ("seq2", pa.string())])
        if partition.paths:
            yield from batches(self._pairs(partition.paths), schema)

    def _pairs(self, paths):
        one, two = (records(p, True, False, True) for p in paths)
        i, end = 0, object()
        while True:
            a, b = next(one, end), next(two, end)
            if a is end and b is end:
                return
            if a is end or b is end:
                raise ValueError(f"{paths}: files of unequal length")
            yield os.path.basename(paths[0]), i, a[1], b[1]
            i += 1


class FastqPairSource(DataSource):
    """Options: first, second (SRC-06)."""

    @classmethod
    def name(cls):
        return "fastq_pair"

    def schema(self):
        return "file string, read_idx long, seq1 string, seq2 string"

    def reader(self, schema):
        return _PairReader(self.options)


def read_fastq(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.dataSource.register(FastqSource)
    return spark.read.format("fastq").options(path=path, **options).load()


def read_pairs(spark: SparkSession, first: str, second: str) -> DataFrame:
    spark.dataSource.register(FastqPairSource)
    return spark.read.format("fastq_pair").options(first=first, second=second).load()


def probe(reads: DataFrame, anchor: str, n: int = 1000) -> DataFrame:
    """Of the first n reads of each file: how often the anchor opens a read or stands in it, by length (SRC-09)."""
    from pyspark.sql import functions as F

    first = reads.where(F.col("read_idx") < n)
    return first.groupBy("file", "seq_len").agg(F.count("*").alias("reads"), F.count_if(F.col("seq").startswith(anchor)).alias("anchor_first"), F.count_if(F.col("seq").contains(anchor)).alias("anchor_any"))
