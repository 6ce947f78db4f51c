"""BAM records and gene annotation."""

from __future__ import annotations

import gzip
import os
import struct
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.aggregate import merged_intervals
from . import bgzf, fastq

#: Flags of reads that are not counted: unmapped, secondary, supplementary, failed quality; and duplicates.
SKIP, DUPLICATE = 0x4 | 0x100 | 0x800 | 0x200, 0x400
_OPS = "MIDNSHP=X"
#: Bytes of a file in one partition.
SPLIT_BYTES = 64 << 20
#: Sizes of the fixed-length tag types.
_SIZES = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
_FORMATS = {"c": "<b", "C": "<B", "s": "<h", "S": "<H", "i": "<i", "I": "<I"}


def hit_count(tags: bytes) -> int | None:
    """The NH tag, None if absent or behind a tag of unknown type (SRC-11)."""
    at = 0
    while at + 3 <= len(tags):
        name, kind = tags[at : at + 2], chr(tags[at + 2])
        at += 3
        if kind in _SIZES:
            if name == b"NH" and kind in _FORMATS:
                return struct.unpack_from(_FORMATS[kind], tags, at)[0]
            at += _SIZES[kind]
        elif kind in "ZH":
            at = tags.index(b"\0", at) + 1
        elif kind == "B":
            at += 5 + _SIZES[chr(tags[at])] * struct.unpack_from("<I", tags, at + 1)[0]
        else:
            return None
    return None


_SCHEMA = pa.schema(
    [("file", pa.string()), ("read_idx", pa.int64()), ("ref", pa.string()), ("pos", pa.int32()), ("flag", pa.int32()), ("cigar", pa.list_(pa.struct([("op", pa.string()), ("len", pa.int32())]))), ("nh", pa.int32())]
)


class _Bam(InputPartition):
    """A range of a file's bytes; without a header the file is gzip of no blocks, and read as one stream."""

    def __init__(self, path: str, low: int = 0, high: int = 0, header: bgzf.Header | None = None):
        self.path, self.low, self.high, self.header = path, low, high, header


class _BamReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.split = options["path"], int(options.get("split_bytes", SPLIT_BYTES))

    def partitions(self):
        out = []
        for path in fastq.listed(self.path, (".bam",)):
            with fastq.random_access(path) as file:
                window = bgzf.Window(file)
                if bgzf.block_size(window.at(0, bgzf.MOST)) is None:
                    out.append(_Bam(path))
                    continue
                header = bgzf.read_header(window, path)
                out += [_Bam(path, low, min(low + self.split, window.size), header) for low in range(0, window.size, self.split)]
        return out

    def read(self, partition):
        name = os.path.basename(partition.path)
        if partition.header is None:
            yield from fastq.batches(self._streamed(partition.path, name), _SCHEMA)
            return
        with fastq.random_access(partition.path) as file:
            for data, starts, sizes, places in bgzf.stretches(file, partition.header, partition.low, partition.high):
                for at in range(0, len(starts), fastq.BATCH):
                    part = slice(at, at + fastq.BATCH)
                    yield _columns(name, partition.header.names, data, starts[part], sizes[part], places[part])

    @staticmethod
    def _streamed(path, name):
        with gzip.open(fastq.opened(path), "rb") as data:
            if data.read(4) != b"BAM\1":
                raise ValueError(f"{path}: no BAM file")
            data.read(struct.unpack("<i", data.read(4))[0])
            names = []
            for _ in range(struct.unpack("<i", data.read(4))[0]):
                names.append(data.read(struct.unpack("<i", data.read(4))[0])[:-1].decode())
                data.read(4)
            i = 0
            while len(head := data.read(4)) == 4:
                yield name, i, *_fields(data.read(struct.unpack("<i", head)[0]), names)
                i += 1


def _fields(record: bytes, names) -> tuple:
    """(ref, pos, flag, cigar, nh) of a record."""
    ref, pos, name_len, _, _, n_ops, flag, seq_len = struct.unpack_from("<iiBBHHHi", record, 0)
    at = 32 + name_len
    cigar = [{"op": _OPS[x & 15], "len": x >> 4} for x in struct.unpack_from(f"<{n_ops}I", record, at)]
    at += 4 * n_ops + (seq_len + 1) // 2 + seq_len
    return names[ref] if ref >= 0 else None, pos, flag, cigar, hit_count(record[at:])


def _columns(file: str, names: tuple[str, ...], data: bytes, starts: np.ndarray, sizes: np.ndarray, places: np.ndarray) -> pa.RecordBatch:
    """What ``_fields`` tells, of many records at once."""
    raw, n = np.frombuffer(data, np.uint8), len(starts)
    taken = lambda at, width: raw[at[:, None] + np.arange(width)]
    fixed = taken(starts - 4, 36).reshape(-1).view(bgzf._FIXED)
    ref, ops, bases = fixed["ref"].astype(np.int64), fixed["ops"].astype(np.int64), fixed["bases"].astype(np.int64)
    at = starts + 32 + fixed["name"]
    tags, ends = at + 4 * ops + (bases + 1) // 2 + bases, starts + sizes
    if (ref >= len(names)).any() or (bases < 0).any() or (tags > ends).any():
        raise ValueError(f"{file}: a record's fields don't fit it or the header")
    packed = raw[bgzf.spread(4 * ops, at)].view("<u4")
    steps = pa.StructArray.from_arrays([pa.array(list(_OPS)).take(pa.array(packed & 15)), pa.array((packed >> 4).astype(np.int32))], ["op", "len"])
    cigar = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(ops)).astype(np.int32)), steps)
    hits, known = np.zeros(n, np.int64), tags == ends
    first = np.flatnonzero(ends - tags >= 4)  # mostly NH is the first tag
    head = taken(tags[first], 3)
    head = head[:, 0].astype(np.int64) << 16 | head[:, 1].astype(np.int64) << 8 | head[:, 2]
    none = known.copy()
    for kind, form in _FORMATS.items():
        own = first[head == int.from_bytes(b"NH" + kind.encode(), "big")]
        own = own[ends[own] - tags[own] >= 3 + _SIZES[kind]]
        hits[own] = taken(tags[own] + 3, _SIZES[kind]).reshape(-1).view(np.dtype(form))
        known[own] = True
    for i in np.flatnonzero(~known):
        found = hit_count(data[tags[i] : ends[i]])
        hits[i], none[i] = found or 0, found is None
    return pa.RecordBatch.from_arrays(
        [pa.repeat(file, n), pa.array(places), pa.array([*names, None], pa.string()).take(pa.array(np.where(ref < 0, len(names), ref))), pa.array(fixed["pos"].copy()),
         pa.array(fixed["flag"].astype(np.int32)), cigar, pa.array(hits, mask=none).cast(pa.int32())], schema=_SCHEMA)


class BamSource(DataSource):
    """Options: path, split_bytes (SRC-10). Ranges of a file's bytes are partitions; read_idx is a record's virtual offset, which orders a file's rows and is the same for any split.

    A file that is gzip but has no blocks is read in one partition, its read_idx a running number. Rows come as Arrow batches.
    """

    @classmethod
    def name(cls):
        return "bam"

    def schema(self):
        return "file string, read_idx long, ref string, pos int, flag int, cigar array<struct<op:string,len:int>>, nh int"

    def reader(self, schema):
        return _BamReader(self.options)


def read_bam(spark: SparkSession, path: str, split_bytes: int = 0) -> DataFrame:
    spark.dataSource.register(BamSource)
    return spark.read.format("bam").options(path=path, split_bytes=split_bytes or SPLIT_BYTES).load()


def _records(batch: pa.RecordBatch, numbers: dict[str, int]) -> bytes:
    """The rows of ``write_bam`` as BAM records."""
    if any(batch.column(c).null_count for c in ("name", "pos", "flag")):
        raise ValueError("a record needs name, pos and flag")
    whole = lambda c: c.to_numpy(zero_copy_only=False).astype(np.int64)
    names = batch.column("name").cast(pa.binary())
    refs = batch.column("ref").dictionary_encode()
    own = np.array([*[numbers.get(r, -1) for r in refs.dictionary.to_pylist()], -1], np.int64)
    cigars, hits = batch.column("cigar"), batch.column("nh")
    steps = cigars.flatten()  # a missing list has none
    ops = pc.index_in(steps.field("op"), pa.array(list(_OPS)))
    if steps.null_count or ops.null_count or steps.field("len").null_count:
        raise ValueError(f"a cigar's operations are one of {_OPS} with a length")
    lengths = whole(steps.field("len"))
    if len(lengths) and not (0 <= lengths.min() and lengths.max() < 1 << 28):
        raise ValueError("a cigar's lengths are from 0 to 2**28 - 1")
    return bgzf.bam_records(
        np.frombuffer(b"".join(names.to_pylist()), np.uint8), whole(pc.binary_length(names)), own[whole(refs.indices.fill_null(len(own) - 1))], whole(batch.column("pos")), whole(batch.column("flag")),
        lengths << 4 | whole(ops), whole(pc.list_value_length(cigars).fill_null(0)), whole(hits.fill_null(0)), hits.is_valid().to_numpy(zero_copy_only=False))


def write_bam(records: DataFrame, folder: str, references: list[tuple[str, int]], payload: int = bgzf.PAYLOAD) -> None:
    """Records (sample, name, ref, pos, flag, cigar as in ``read_bam``, nh) as files ``<sample>.<partition>.bam``, one for each sample of a partition.

    A file appears whole under its name, so a task that runs again replaces it with the same bytes. Rows keep the order they have.
    """
    numbers = {name: i for i, (name, _) in enumerate(references)}
    columns = ["sample", "name", "ref", "pos", "flag", "cigar", "nh"]

    def write(batches):
        part, open_files = TaskContext.get().partitionId(), {}
        for batch in batches:
            samples = batch.column(0).dictionary_encode()
            codes = samples.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            for code in dict.fromkeys(codes.tolist()):
                sample = samples.dictionary[code].as_py() if code >= 0 else None
                if sample not in open_files:
                    fs, where = fastq.filesystem(f"{folder}/{sample}.{part:05d}.bam")
                    fs.create_dir(os.path.dirname(where), recursive=True)
                    temporary = f"{where}.{uuid.uuid4().hex}.tmp"
                    open_files[sample] = (fs, where, temporary, fs.open_output_stream(temporary, compression=None), bgzf.Writer(payload=payload))
                    open_files[sample][3].write(open_files[sample][4].write(bgzf.bam_header(references)))
                _, _, _, out, packer = open_files[sample]
                out.write(packer.write(_records(batch.take(pa.array(np.flatnonzero(codes == code))), numbers)))
        for fs, where, temporary, out, packer in open_files.values():
            out.write(packer.close())
            out.close()
            fs.move(temporary, where)
        yield pa.RecordBatch.from_pydict({"files": [len(open_files)]}, schema=pa.schema([("files", pa.int64())]))

    records.select(columns).mapInArrow(write, "files long").agg(F.sum("files")).collect()


def usable(df: DataFrame, duplicates: bool = False, multimappers: bool = False) -> DataFrame:
    """Records that are counted (PRJ-07)."""
    mask = SKIP | (0 if duplicates else DUPLICATE)
    out = df.where((F.col("flag").bitwiseAND(F.lit(mask)) == 0) & F.col("ref").isNotNull())
    return out if multimappers else out.where(F.coalesce("nh", F.lit(1)) <= 1)


def read_gtf(spark: SparkSession, path: str) -> DataFrame:
    """Exons, 0-based and half-open, overlapping ones of a gene merged (SRC-12)."""
    part = F.split("value", "\t")
    lines = spark.read.text(path).where(~F.col("value").startswith("#")).where(F.size(part) >= 9).where(part[2] == "exon")
    attribute = lambda k: F.nullif(F.regexp_extract(part[8], rf'(?:^|;)\s*{k} "([^"]*)"', 1), F.lit(""))
    exons = lines.select(
        part[0].alias("chrom"), (part[3].cast("int") - 1).alias("start"), part[4].cast("int").alias("end"), part[6].alias("strand"),
        attribute("gene_id").alias("gene_id"), attribute("gene_name").alias("gene_name"), F.coalesce(attribute("gene_biotype"), attribute("gene_type")).alias("gene_biotype"),
    )
    return merged_intervals(exons.where("gene_id is not null"), ["chrom", "strand", "gene_id", "gene_name", "gene_biotype"]).drop("n")
