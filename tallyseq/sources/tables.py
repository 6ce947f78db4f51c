"""Tables of many shapes: checked, ragged, sniffed, archived, wide, logged."""

from __future__ import annotations

import csv
import gzip
import io
import os
import re
import tarfile
import zipfile
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

from . import fastq


def expect_columns(df: DataFrame, *names: str) -> DataFrame:
    """``df``, or an error that lists the columns it lacks."""
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def assert_unique(df: DataFrame, *keys: str) -> DataFrame:
    """``df``, or an error that shows keys with more than one row (JOIN-05)."""
    if twice := df.groupBy(*keys).count().where("count > 1").limit(5).collect():
        raise ValueError(f"keys with more than one row: {[tuple(r) for r in twice]}")
    return df


def validated_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left", validate: str = "many_to_one") -> DataFrame:
    """A join whose cardinality is checked first: many_to_one, one_to_many or one_to_one (JOIN-05)."""
    sides = {"many_to_one": [right], "one_to_many": [left], "one_to_one": [left, right]}
    if validate not in sides:
        raise ValueError(f"validate is one of {', '.join(sides)}")
    for side in sides[validate]:
        assert_unique(side, *keys)
    return left.join(right, keys, how)


def assert_same_keys(have: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """``have``, or an error that shows keys which only one of the two has (SRC-25)."""
    a, b = have.select(key).distinct(), wanted.select(key).distinct()
    lacks, extra = ([r[0] for r in x.join(y, key, "left_anti").orderBy(key).limit(10).collect()] for x, y in ((b, a), (a, b)))
    if lacks or extra:
        raise ValueError(f"keys that differ: missing {lacks}, extra {extra}")
    return have


def read_snapshot(spark: SparkSession, path: str, wanted: DataFrame, key: str = "gene", field: str = "genes") -> DataFrame:
    """(key, value as JSON text) of the object ``field`` of a JSON document, whose keys must be those of ``wanted`` (SRC-25)."""
    text = spark.read.text(path, wholetext=True).select(F.from_json(F.get_json_object("value", f"$.{field}"), "map<string,string>").alias("m"))
    return assert_same_keys(text.select(F.explode("m").alias(key, "value")), wanted, key)


def read_strings(spark: SparkSession, path: str, required: list[str], sep: str = ",") -> DataFrame:
    """All columns as text, missing ones as '' (SRC-15)."""
    return expect_columns(spark.read.csv(path, header=True, sep=sep, inferSchema=False), *required).na.fill("")


def read_sniffed(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """Delimiter from the first line, byte-order mark and blanks around names dropped (SRC-16)."""
    first = spark.read.text(path).first()[0].lstrip("﻿")
    sep = max(",\t;|", key=first.count)
    df = spark.read.csv(path, header=True, sep=sep)
    return expect_columns(df.toDF(*[c.lstrip("﻿").strip() for c in df.columns]), *required)


def ragged_reference(lines: DataFrame) -> DataFrame:
    """id, gene, sequence of lines without a header: by tab, else comma, else blanks; three fields at most (SRC-17)."""
    v = F.trim("value")
    parts = F.when(v.contains("\t"), F.split(v, "\t", 3)).when(F.length(F.regexp_replace(v, "[^,]", "")) >= 2, F.split(v, ",", 3)).otherwise(F.split(v, r"\s+", 3))
    rows = lines.where(v != "").select(parts.alias("p")).where(F.size("p") == 3)
    return rows.select(F.trim(F.col("p")[0]).alias("id"), F.trim(F.col("p")[1]).alias("gene"), F.upper(F.trim(F.col("p")[2])).alias("sequence"))


def selected(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """A subset under new names; odd names such as neg|fdr are quoted (SRC-18)."""
    expect_columns(df, *names)
    return df.select(*[F.col(f"`{k}`").alias(v) for k, v in names.items()])


def first_present(df: DataFrame, *candidates: str) -> str:
    """The first candidate that is a column, whatever its case (SRC-19)."""
    have = {c.lower(): c for c in df.columns}
    for c in candidates:
        if c.lower() in have:
            return have[c.lower()]
    raise KeyError(f"none of {candidates} in {df.columns}")


def read_gene_info(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated gene records; the header may start with #Format:, and - is missing (SRC-20)."""
    df = spark.read.csv(path, header=True, sep="\t", nullValue="-")
    return df.toDF(*[re.sub(r"^#(Format:\s*)?", "", c).split(" ")[0] if i == 0 else c for i, c in enumerate(df.columns)])


def wide_row(df: DataFrame, key: str, value: str, label: str = "label") -> DataFrame:
    """One row of a wide table as (symbol, id, score), names read as SYM (ID) (SRC-21, SET-09)."""
    row = df.where(F.col(f"`{key}`") == value)
    names = [c for c in df.columns if c != key]
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias(label), F.col(f"`{c}`").cast("double").alias("score")) for c in names]))
    long = row.select(pairs.alias("x")).select("x.*")
    return long.withColumns({"symbol": F.regexp_extract(label, r"^([^ (]+)", 1), "gene_id": F.nullif(F.regexp_extract(label, r"\((\d+)\)", 1), F.lit("")).cast("long")})


def archive_member(path: str, suffix: str) -> bytes:
    """The member of a tar.gz whose name ends with ``suffix``, unpacked if it is gzip too (SRC-14)."""
    with tarfile.open(fileobj=fastq.opened(path), mode="r|gz") as tar:
        for m in tar:
            if m.name.endswith(suffix):
                data = tar.extractfile(m).read()
                return gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
    raise FileNotFoundError(f"{path}: no member {suffix}")


class _MatrixReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]

    def partitions(self):
        return [fastq._File(self.path)]

    def read(self, partition):
        schema = pa.schema([("gene", pa.int32()), ("cell", pa.int32()), ("count", pa.float64())])
        yield from fastq.batches(self._entries(partition.paths[0]), schema)

    def _entries(self, path):
        with tarfile.open(fileobj=fastq.opened(path), mode="r|gz") as tar:
            for m in tar:
                if m.name.endswith("matrix.mtx.gz"):
                    lines = (x for x in gzip.open(tar.extractfile(m), "rt") if not x.startswith("%"))
                    next(lines, None)  # the sizes
                    for line in lines:
                        gene, cell, count = line.split()
                        yield int(gene) - 1, int(cell) - 1, float(count)
                    return
        raise FileNotFoundError(f"{path}: no matrix")


class MatrixSource(DataSource):
    """Option: path of a tar.gz with matrix.mtx.gz; its entries are streamed by one task, in Arrow batches (SRC-13)."""

    @classmethod
    def name(cls):
        return "mtx_tar"

    def schema(self):
        return "gene int, cell int, count double"

    def reader(self, schema):
        return _MatrixReader(self.options)


def read_matrix_archive(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(triples, features, cells) of a gene x cell archive (SRC-13). Indices are 0-based. Names of genes and cells are read by the driver, the matrix by a task."""
    lines = lambda suffix: archive_member(path, suffix).decode().splitlines()
    features = [(i, *(x.split("\t") + ["", ""])[:3]) for i, x in enumerate(lines("features.tsv.gz"))]
    cells = [(i, x.strip()) for i, x in enumerate(lines("barcodes.tsv.gz"))]
    spark.dataSource.register(MatrixSource)
    triples = spark.read.format("mtx_tar").options(path=path).load()
    return triples, spark.createDataFrame(features, "gene int, gene_id string, symbol string, feature_type string"), spark.createDataFrame(cells, "cell int, barcode string")


def xlsx_rows(path: str, sheet: int = 1) -> list[list[str | None]]:
    """A sheet's rows, from shared and inline strings and cell references (SRC-22)."""
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    with zipfile.ZipFile(path) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{{{ns['m']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        root = ElementTree.fromstring(z.read(f"xl/worksheets/sheet{sheet}.xml"))
    out = []
    for row in root.iterfind(".//m:row", ns):
        cells: dict[int, str | None] = {}
        for c in row.iterfind("m:c", ns):
            letters = re.match(r"[A-Z]+", c.get("r", "A"))[0]
            at = 0
            for x in letters:
                at = at * 26 + ord(x) - 64
            v = c.find("m:v", ns)
            if c.get("t") == "inlineStr":
                cells[at - 1] = "".join(t.text or "" for t in c.iter(f"{{{ns['m']}}}t"))
            elif v is not None:
                cells[at - 1] = shared[int(v.text)] if c.get("t") == "s" else v.text
        out.append([cells.get(i) for i in range(max(cells, default=-1) + 1)])
    return out


def read_xlsx(spark: SparkSession, path: str, sheet: int = 1) -> DataFrame:
    rows = [r for r in xlsx_rows(path, sheet) if any(x is not None for x in r)]
    head, body = rows[0], rows[1:]
    return spark.createDataFrame([tuple((r + [None] * len(head))[: len(head)]) for r in body], ", ".join(f"`{h}` string" for h in head))


def logged_commands(spark: SparkSession, path: str, executable: str = "mageck") -> DataFrame:
    """(file, command): each log's first Parameters line, the executable's folder dropped (SRC-27)."""
    lines = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("file"), "value")
    found = F.regexp_extract("value", r"Parameters:\s*([^\r\n]*)", 1)
    return lines.where(found != "").select("file", F.regexp_replace(found, rf"^\S*/({executable}\S*)", "$1").alias("command"))


def file_manifest(spark: SparkSession, path: str, hash_up_to: int = 1 << 30) -> DataFrame:
    """path, role by suffix, size, time, sha256 of the files below a folder; larger ones are not hashed (SRC-28)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.lower("path")
    role = F.when(name.rlike(r"\.(fastq|fq)(\.gz)?$"), "reads").when(name.rlike(r"\.bam$"), "alignments").when(name.rlike(r"\.(csv|tsv|txt)(\.gz)?$"), "table").otherwise("other")
    small = files.where(F.col("length") <= hash_up_to).select("path", role.alias("role"), "length", "modificationTime", F.sha2("content", 256).alias("sha256"))
    large = files.where(F.col("length") > hash_up_to).select("path", role.alias("role"), "length", "modificationTime", F.lit(None).cast("string").alias("sha256"))
    return small.unionByName(large)


def write_table(df: DataFrame, path: str, sep: str = ",", gz: bool = False) -> None:
    """One delimited file with a header: for the small tables that figures are drawn from (SNK-01, SNK-02)."""
    df.coalesce(1).write.mode("overwrite").option("sep", sep).option("compression", "gzip" if gz else "none").csv(path, header=True)


def add_counts(old: DataFrame, new: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """Counts of both, added by key (SNK-03)."""
    return old.unionByName(new).groupBy(*keys).agg(*[F.sum(m).alias(m) for m in measures])


def csv_text(rows: list[dict]) -> str:
    """Small driver-side tables as text (SNK-05)."""
    out = io.StringIO()
    if rows:
        w = csv.DictWriter(out, list(rows[0]), lineterminator="\n")
        w.writeheader()
        w.writerows(rows)
    return out.getvalue()


def shell_script(commands: list[str], folder: str) -> str:
    """A script that runs recorded commands in a folder (SNK-06)."""
    return "\n".join(["#!/usr/bin/env bash", "set -euo pipefail", f"cd {os.path.abspath(folder)!r}", *commands]) + "\n"
