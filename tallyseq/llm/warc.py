"""WARC archives with a Merkle fixity audit.

Pages are written as WARC 1.1 resource records, one gzip member each, into a file a task, beside an index of 64-bit
offsets. A fixity tree has the SHA-256 of every record's stored bytes as leaves; a node hashes its ``FAN``
children in order, each with the offset range it covers, up to a root a file and on up to one root of the archive.
Replicas are compared from the root: only children of nodes that differ are looked at on the next level, so an
archive with few damaged records reads few nodes, and the leaves that differ locate the damage by file and range.
Levels are kept in order in files, and within files only those that hold a wrong node are read. Records are written
as they are made; a task holds one record and the offsets.

Files are read by the offsets of the index, in blocks, so a damaged record does not hide those after it. A
record that is missing from a replica, or only in it, differs too.

Defined results: null html is an empty block and null urls have an empty target; repeated pages are records of
their own; an empty table gives an archive without files, whose root is the hash of nothing; extra columns are not
read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .binary_tokens import map_file
from .runtime import WholeFile, cut, filesystem, remove_folder, shared_folder, small_batches, tidy, write_file

FAN = 16
#: Written into every record: an archive of the same pages has the same bytes.
DATE = "2024-01-01T00:00:00Z"


def record(page_id: int | None, url: str | None, html: bytes) -> bytes:
    """One resource record, uncompressed."""
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id}\n{target}")
    head = [
        "WARC/1.1",
        "WARC-Type: resource",
        f"WARC-Record-ID: <urn:uuid:{name}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(html).hexdigest()}",
        "Content-Type: text/html",
        *([] if page_id is None else [f"X-Page-Id: {page_id}"]),
        f"Content-Length: {len(html)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + html + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers by lower-case name, block) of a record."""
    head, found, rest = data.partition(b"\r\n\r\n")
    if not found or not head.startswith(b"WARC/"):
        raise ValueError("no WARC record")
    headers = dict((k.lower(), v.strip()) for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:]))
    return headers, rest[: int(headers["content-length"])]


def compress(data: bytes) -> bytes:
    """A gzip member without a time stamp."""
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def write_archive(pages: DataFrame, folders: list[str], damage: Callable[[int | None], bool] | None = None) -> list[tuple[int, int]]:
    """Write the pages to each folder, as (part, records) for each file.

    ``damage`` is for drills: in the last folder one byte is changed in records of the pages it names.
    """
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, files, offsets = TaskContext.get().partitionId(), [], [0]
        for batch in tidy(batches):
            if not files:
                files = [WholeFile(f"{folder}/part-{part:06d}.warc.gz") for folder in folders]
            for page_id, url, html in zip(*[c.to_pylist() for c in batch.columns]):
                member = compress(record(page_id, url, html))
                offsets.append(offsets[-1] + len(member))
                for k, file in enumerate(files):
                    file.write(_flip(member) if damage and k == len(files) - 1 and damage(page_id) else member)
        for folder, file in zip(folders, files):
            file.done()
            write_file(f"{folder}/part-{part:06d}.idx", iter([np.array(offsets, "<i8").tobytes()]))
        if files:
            yield pa.RecordBatch.from_pydict({"part": [part], "records": [len(offsets) - 1]})

    chosen = pages.select(F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).cast("binary").alias("html"))
    return sorted((r.part, r.records) for r in chosen.mapInArrow(run, "part long, records long").collect())


def _flip(data: bytes) -> bytes:
    middle = len(data) // 2
    return data[:middle] + bytes([data[middle] ^ 1]) + data[middle + 1 :]


def read_records(spark: SparkSession, folder: str, files: list[tuple[int, int]], contents: bool = False) -> DataFrame:
    """(file, seq, offset, size, hash) of every record by the folder's own index; with ``contents`` page_id, url and payload_sha256."""
    more = ", page_id long, url string, payload_sha256 string" if contents else ""
    names = ["file", "seq", "offset", "size", "hash", *(["page_id", "url", "payload_sha256"] if contents else [])]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()][: len(names)]

    def one(part: int, seq: int, offset: int, data: bytes) -> tuple:
        row = (part, seq, offset, len(data), hashlib.sha256(data).hexdigest())
        if not contents:
            return row
        try:
            headers, block = parse_record(zlib.decompress(data, 31))
            page = headers.get("x-page-id")
            return (*row, None if page is None else int(page), headers["warc-target-uri"], hashlib.sha256(block).hexdigest())
        except (ValueError, KeyError, zlib.error):
            return (*row, None, None, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                part = files[k][0]
                at = map_file(f"{folder}/part-{part:06d}.idx", "<i8")
                fs, path = filesystem(f"{folder}/part-{part:06d}.warc.gz")
                with fs.open_input_stream(path, compression=None, buffer_size=1 << 20) as stream:
                    for low in range(0, len(at) - 1, 1000):
                        rows = [one(part, i, int(at[i]), stream.read(int(at[i + 1] - at[i]))) for i in range(low, min(low + 1000, len(at) - 1))]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    if not files:
        return spark.createDataFrame([], f"file long, seq long, offset long, size long, hash string{more}")
    return spark.range(0, len(files), 1, len(files)).mapInArrow(run, f"file long, seq long, offset long, size long, hash string{more}")


class FixityTree:
    """The levels of one replica's tree: level 0 the records, the last the root of the archive.

    Levels are Parquet files in the shared folder, each task's rows in order, so that the nodes of few files are read
    without the rest.
    """

    def __init__(self, leaves: DataFrame):
        self.spark, self.folder = leaves.sparkSession, shared_folder(leaves.sparkSession, "fixity")
        self.levels, self.parents, self.inner = [], [], 0
        self._keep(leaves.select("file", F.col("seq").alias("pos"), "offset", "size", "hash"))

    def _keep(self, nodes: DataFrame) -> None:
        where = f"{self.folder}/level={len(self.levels)}"
        nodes.select("file", "pos", "offset", "size", "hash").sortWithinPartitions("file", "pos").write.parquet(where)
        self.levels.append(self.spark.read.schema("file long, pos long, offset long, size long, hash string").parquet(where))

    def within_files(self) -> bool:
        """If some file has more than one node yet."""
        return bool(self.levels[-1].where("pos > 0").limit(1).count())

    def files_most(self) -> int:
        """The highest file number, -1 at the root."""
        top = self.levels[-1].agg(F.max("file")).first()[0]
        return -1 if top is None else top

    def in_files(self, level: int) -> bool:
        """If a level's nodes have the file number of their parents."""
        return level < self.inner

    def up_within(self) -> None:
        self.inner += 1
        self._up(F.col("file"), F.floor(F.col("pos") / FAN).cast("long"), F.col("pos"))

    def up_files(self, last: bool) -> None:
        """Files above files: their numbers are folded, and the one node left is numbered -1."""
        self._up(F.lit(-1).cast("long") if last else F.floor(F.col("file") / FAN).cast("long"), F.lit(0).cast("long"), F.col("file"))

    def _up(self, file, pos, order) -> None:
        below = self.levels[-1].select(file.alias("file"), pos.alias("pos"), order.alias("n"), "offset", "size", "hash")
        text = F.transform(F.array_sort(F.collect_list(F.struct("n", "offset", "size", "hash"))), lambda x: F.concat_ws(":", x["offset"], x["size"], x["hash"]))
        nodes = below.groupBy("file", "pos").agg(F.sha2(F.array_join(text, "\n").cast("binary"), 256).alias("hash"), F.min("offset").alias("offset"), F.sum("size").alias("size"))
        self.parents.append((file, pos))
        self._keep(nodes)

    @property
    def root(self) -> str:
        row = self.levels[-1].first()
        return row["hash"] if row else hashlib.sha256(b"").hexdigest()


def fixity_trees(*leaves: DataFrame) -> list[FixityTree]:
    """A tree for each replica, all of one height: the lower ones get levels of single children."""
    trees = [FixityTree(x) for x in leaves]
    while any([t.within_files() for t in trees]):
        for t in trees:
            t.up_within()
    while (most := max(t.files_most() for t in trees)) >= 0:
        for t in trees:
            t.up_files(most < FAN)
    return trees


#: Up to so many files with a wrong node are named in the scan's filter.
FILES_NAMED = 1000


def differing(a: FixityTree, b: FixityTree) -> DataFrame:
    """(file, seq) of the records in which the replicas differ, found by descent from the roots of two trees of one height."""
    if a.root == b.root:
        return a.spark.createDataFrame([], "file long, seq long")
    wrong = _unequal(a.levels[-1], b.levels[-1])
    for level in range(len(a.levels) - 2, -1, -1):
        file, pos = a.parents[level]
        suspects, named = [], None
        if a.in_files(level):
            found = [r.file for r in wrong.select("file").distinct().limit(FILES_NAMED + 1).collect()]
            named = found if len(found) <= FILES_NAMED else None
        for tree in (a, b):
            nodes = tree.levels[level] if named is None else tree.levels[level].where(F.col("file").isin(named))
            nodes = nodes.withColumns({"_file": file, "_pos": pos})
            up = wrong.select(F.col("file").alias("_file"), F.col("pos").alias("_pos"))
            suspects.append(nodes.join(up, ["_file", "_pos"], "left_semi").drop("_file", "_pos"))
        wrong = cut(_unequal(*suspects))
    return wrong.select("file", F.col("pos").alias("seq"))


def _unequal(a: DataFrame, b: DataFrame) -> DataFrame:
    x = a.select("file", "pos", F.struct("offset", "size", "hash").alias("_a"))
    y = b.select("file", "pos", F.struct("offset", "size", "hash").alias("_b"))
    return x.join(y, ["file", "pos"], "full").where(~F.col("_a").eqNullSafe(F.col("_b"))).select("file", "pos")


#: The drill of the query: these pages' records are damaged in the second replica.
DRILL = (101, 7)


def op8_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages archived twice, one byte damaged in some records of the second replica, and the audit's finding for each record."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    first, second = shared_folder(spark, "warc-a"), shared_folder(spark, "warc-b")
    every, rest = DRILL
    files = write_archive(pages, [first, second], lambda page_id: page_id is not None and page_id % every == rest)
    records = cut(read_records(spark, first, files, contents=True))
    trees = fixity_trees(records, read_records(spark, second, files))
    bad = differing(*trees)
    for folder in (first, second, *[t.folder for t in trees]):
        remove_folder(folder)  # the drill's findings are kept
    found = records.join(bad.withColumn("status", F.lit("corrupt")), ["file", "seq"], "left")
    return found.select("page_id", "url", "payload_sha256", F.coalesce("status", F.lit("intact")).alias("status"))


OP8_SQL = "SELECT page_id, coalesce(url, '') AS url, sha256(coalesce(html, '')) AS payload_sha256, CASE WHEN page_id % 101 = 7 THEN 'corrupt' ELSE 'intact' END AS status FROM pages"
