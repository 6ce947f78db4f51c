"""Split BAM files and counts by gene."""

import os
import random
import struct

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyseq.operators import genecounts
from tallyseq.sources import alignments, bgzf, fastq

REFERENCES = [("chr1", 200_000), ("chr2", 90_000)]
RECORDS = "sample string, name string, ref string, pos int, flag int, cigar array<struct<op:string,len:int>>, nh int"


def made(n, seed=1):
    rng = random.Random(seed)
    for i in range(n):
        ref = rng.choice(["chr1", "chr2", None])
        cigar = [(rng.choice("MIDNSHP=X"), rng.randint(1, 300)) for _ in range(rng.choice([0, 1, 3, 40]))]
        yield "s", "r" * rng.choice([1, 9, 200]) + str(i), ref, rng.randrange(80_000) if ref else -1, rng.choice([0, 4, 16, 256, 1024]), cigar, rng.choice([None, 1, 7])


@pytest.mark.parametrize("payload", [777, bgzf.PAYLOAD])
def test_any_number_of_splits_gives_the_same_rows(spark, tmp_path, payload):
    rows = list(made(3000))
    alignments.write_bam(spark.createDataFrame(rows, RECORDS).coalesce(1), str(tmp_path), REFERENCES, payload)
    (path,) = fastq.listed(str(tmp_path), (".bam",))
    size = os.path.getsize(path)
    one = alignments.read_bam(spark, str(tmp_path)).orderBy("read_idx").collect()
    assert [(r.ref, r.pos, r.flag, [tuple(c) for c in r.cigar], r.nh) for r in one] == [(ref, pos, flag, cigar, nh) for _, _, ref, pos, flag, cigar, nh in rows]
    for splits in (2, 7, 50, 400):
        df = alignments.read_bam(spark, str(tmp_path), -(-size // splits))
        assert df.rdd.getNumPartitions() > splits * 0.9
        assert df.orderBy("read_idx").collect() == one


def test_header_longer_than_a_split_and_records_longer_than_a_block(spark, tmp_path):
    references = [(f"contig_{i}_{'x' * 40}", 1000 + i) for i in range(3000)]
    cigar = [("M", 1), ("N", 2)] * 20_000
    rows = [("s", f"r{i}", references[i][0], i, 0, cigar if i % 3 == 0 else [("M", 5)], None) for i in range(12)]
    alignments.write_bam(spark.createDataFrame(rows, RECORDS).coalesce(1), str(tmp_path), references, 5000)
    one = alignments.read_bam(spark, str(tmp_path)).orderBy("read_idx").collect()
    assert [(r.ref, len(r.cigar)) for r in one] == [(r[2], len(r[5])) for r in rows]
    for split in (2000, 9000):
        assert alignments.read_bam(spark, str(tmp_path), split).orderBy("read_idx").collect() == one


def test_empty_and_broken_files(spark, tmp_path):
    writer = bgzf.Writer()
    (tmp_path / "none.bam").write_bytes(writer.write(bgzf.bam_header(REFERENCES)) + writer.close())
    assert alignments.read_bam(spark, str(tmp_path), 10).count() == 0
    writer = bgzf.Writer()
    whole = writer.write(bgzf.bam_header(REFERENCES) + bgzf.bam_record("a", 0, 1, 0, [])[:-1]) + writer.close()
    (tmp_path / "none.bam").write_bytes(whole)
    with pytest.raises(Exception, match="within a record"):
        alignments.read_bam(spark, str(tmp_path)).count()
    (tmp_path / "none.bam").write_bytes(b"no gzip at all")
    with pytest.raises(Exception):
        alignments.read_bam(spark, str(tmp_path)).count()


def test_blocks_are_gzip_members(tmp_path):
    import gzip

    writer = bgzf.Writer(payload=100)
    data = os.urandom(1000)
    raw = writer.write(data) + writer.close()
    assert gzip.decompress(raw) == data and bgzf.block_size(raw[:18]) is not None and raw.endswith(bgzf.END)
    assert struct.unpack("<H", raw[16:18])[0] + 1 == bgzf.block_size(raw)


EXONS = "chrom string, start int, end int, strand string, gene_id string, gene_name string, gene_biotype string"


def _exons(spark):
    return spark.createDataFrame([("chr1", 100, 200, "+", "A", "Alpha", "coding"), ("chr1", 190, 300, "-", "B", None, None), ("chr1", 400, 500, "+", "A", "Alpha", "coding"), ("chr2", 0, 10, "+", "C", "Gamma", None)], EXONS)


def _bam(spark, folder, rows):
    alignments.write_bam(spark.createDataFrame([(s, f"{s}{i}", *r) for i, (s, *r) in enumerate(rows)], RECORDS).coalesce(1), str(folder), REFERENCES)


M = lambda n: [("M", n)]
ROWS = [
    ("one", "chr1", 120, 0, M(10), None), ("one", "chr1", 195, 0, M(3), 1), ("one", "chr1", 150, 16, [("M", 5), ("N", 245), ("M", 20)], 1), ("one", "chr1", 120, 1024, M(10), 1), ("one", "chr1", 120, 1028, M(10), 1),
    ("one", "chr1", 120, 0, M(10), 4), ("one", None, -1, 4, [], None), ("one", "chr1", 0, 0, M(100), None), ("one", "chr2", 9, 0, M(1), None), ("two", "chr1", 250, 0, M(9), None), ("two", "chr1", 120, 0, [], None),
]


def test_outcomes_summary_and_matrix_by_hand(spark, tmp_path):
    _bam(spark, tmp_path, ROWS)
    counts = genecounts.sample_counts(genecounts.read_outcomes(alignments.read_bam(spark, str(tmp_path), 50), _exons(spark)))
    summary = {r.sample: r.asDict() for r in genecounts.count_summary(counts).collect()}
    assert summary["one"] == {"sample": "one", "records": 9, "skipped_flag_or_unmapped": 3, "skipped_multimapper": 1, "counted": 3, "no_feature": 1, "ambiguous": 1, "skipped_duplicate": 1}
    assert (summary["two"]["counted"], summary["two"]["no_feature"], summary["two"]["records"]) == (1, 1, 2)
    matrix = genecounts.gene_matrix(counts, genecounts.gene_index(_exons(spark)), ["one", "two", "three"])
    assert {r.gene_id: (r.gene_name, r.gene_biotype, r.chrom, r.one, r.two, r.three) for r in matrix.collect()} == {"A": ("Alpha", "coding", "chr1", 2, 0, 0), "B": ("B", "", "chr1", 0, 1, 0), "C": ("Gamma", "", "chr2", 1, 0, 0)}
    every = genecounts.CountSettings(duplicates=True, multimappers=True)
    counts = genecounts.sample_counts(genecounts.read_outcomes(alignments.read_bam(spark, str(tmp_path)), _exons(spark), every))
    assert genecounts.count_summary(counts).where("sample = 'one'").select("counted", "skipped_multimapper", "skipped_duplicate").first() == (5, 0, 0)


def test_cached_samples_are_not_read_again(spark, tmp_path, monkeypatch):
    _bam(spark, tmp_path / "bam", ROWS)
    read = []
    own = alignments.read_bam
    monkeypatch.setattr(alignments, "read_bam", lambda s, path, *a: read.append(os.path.basename(path).split(".")[0]) or own(s, path, *a))
    cache = genecounts.CountCache(spark, str(tmp_path / "cache"), "annotation 1")
    first = sorted(cache.counts(str(tmp_path / "bam"), _exons(spark)).collect(), key=repr)
    assert sorted(read) == ["one", "two"] and len({r.sample for r in first}) == 2
    read.clear()
    assert sorted(cache.counts(str(tmp_path / "bam"), _exons(spark)).collect(), key=repr) == first and read == []
    _bam(spark, tmp_path / "bam", [("two", "chr2", 1, 0, M(3), None)])  # the same file name, other records
    changed = cache.counts(str(tmp_path / "bam"), _exons(spark)).collect()
    assert read == ["two"] and {(r.gene_id, r.n) for r in changed if r.sample == "two"} == {("C", 1)}
    assert sorted((r for r in changed if r.sample == "one"), key=repr) == [r for r in first if r.sample == "one"]
    assert cache.prune(str(tmp_path / "bam")) == 1 and cache.prune(str(tmp_path / "bam")) == 0
    read.clear()
    other = genecounts.CountCache(spark, str(tmp_path / "cache"), "annotation 1", genecounts.CountSettings(duplicates=True))
    assert other.counts(str(tmp_path / "bam"), _exons(spark)).agg(F.sum("duplicates")).first()[0] == 0 and sorted(read) == ["one", "two"]


def test_records_of_many_shapes_are_read_and_written_in_columns():
    numbers = {name: i for i, (name, _) in enumerate(REFERENCES)}
    rows = [*made(500), ("s", "é", "elsewhere", 3, 65535, [("M", (1 << 28) - 1)], -5)]
    steps = lambda cigar: [{"op": op, "len": n} for op, n in cigar]
    types = [("sample", pa.string()), ("name", pa.string()), ("ref", pa.string()), ("pos", pa.int32()), ("flag", pa.int32()), ("cigar", pa.list_(pa.struct([("op", pa.string()), ("len", pa.int32())]))), ("nh", pa.int32())]
    batch = pa.RecordBatch.from_pylist([dict(zip([t[0] for t in types], (*r[:5], steps(r[5]) or None, r[6]))) for r in rows], schema=pa.schema(types))
    got, at = alignments._records(batch.slice(1), numbers), 0
    for _, name, ref, pos, flag, cigar, nh in rows[1:]:
        tags = b"" if nh is None else b"NHi" + struct.pack("<i", nh)
        want = bgzf.bam_record(name.encode().decode("latin-1"), numbers.get(ref, -1), pos, flag, [("MIDNSHP=X".index(op), n) for op, n in cigar], tags) if name.isascii() else None
        size = 4 + struct.unpack_from("<i", got, at)[0]
        assert want is None or got[at : at + size] == want
        at += size
    assert at == len(got)
    for column, value in (("flag", 1 << 16), ("name", "n" * 255), ("cigar", [{"op": "Q", "len": 1}]), ("pos", None)):
        wrong = batch.slice(0, 1).to_pylist()[0] | {column: value}
        with pytest.raises(ValueError):
            alignments._records(pa.RecordBatch.from_pylist([wrong], schema=batch.schema), numbers)


def test_tags_in_any_order(spark, tmp_path):
    tags = [b"", b"NHC\x05", b"NHi" + struct.pack("<i", 9), b"XSA+NHc\x03", b"XZZabc\0NHS\x01\x01", b"XBBi" + struct.pack("<Iii", 2, 1, 2) + b"NHI" + struct.pack("<I", 77), b"XQ?ab", b"NHZab\0", b"NHs\xff\xff"]
    writer = bgzf.Writer(payload=300)
    data = bgzf.bam_header(REFERENCES) + b"".join(bgzf.bam_record(f"q{i}", i % 3 - 1, i, 0, [(0, 5), (3, 7)][: i % 3], t) for i, t in enumerate(tags * 20))
    (tmp_path / "t.bam").write_bytes(writer.write(data) + writer.close())
    for split in (0, 100):
        got = alignments.read_bam(spark, str(tmp_path), split).orderBy("read_idx").collect()
        assert [r.nh for r in got] == [None, 5, 9, 3, 257, 77, None, None, -1] * 20
        assert [(r.ref, r.pos, len(r.cigar)) for r in got] == [([None, "chr1", "chr2"][i % 3], i, i % 3) for i in range(180)]


def test_outlines_that_travel_and_joined_blocks_give_the_same_rows(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    rows = [("s", rng.choice(["chr1", "chr2", None]), rng.randrange(2000), rng.choice([0, 0, 1024]), [(rng.choice("MNDM"), rng.randint(0, 60)) for _ in range(rng.randint(0, 6))], rng.choice([None, 1, 2])) for _ in range(2000)]
    _bam(spark, tmp_path, rows)
    exons = spark.createDataFrame([(rng.choice(["chr1", "chr3"]), s, s + rng.randint(-1, 80), "+", f"g{rng.randrange(40)}", None, None) for s in (rng.randrange(2000) for _ in range(60))] + [("chr1", 1, 9, "+", None, None, None)], EXONS)
    bam = alignments.read_bam(spark, str(tmp_path))
    joined = sorted(map(repr, genecounts.read_outcomes(bam, exons, genecounts.CountSettings(bin_size=64, outline_rows=0)).collect()))
    assert len(joined) == 2000 and len({r.split("status=")[1].split(",")[0] for r in joined}) == 5
    monkeypatch.setattr(genecounts, "overlaps", None)  # nothing is joined
    for size in (64, 16384):
        assert sorted(map(repr, genecounts.read_outcomes(bam, exons, genecounts.CountSettings(bin_size=size)).collect())) == joined
    none = genecounts.read_outcomes(bam, exons.limit(0)).groupBy("status").count().collect()
    assert {r.status for r in none} == {"skipped_flag_or_unmapped", "skipped_multimapper", "no_feature"}
