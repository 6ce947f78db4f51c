"""Gene counts of alignment files: what becomes of each record, counts by gene and sample, and a cache of samples already counted."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import seq
from ..sources import alignments, fastq
from .lineage import stored
from .match import DIMENSION_ROWS, Outline, outline_of, overlaps

STATUSES = ["skipped_flag_or_unmapped", "skipped_multimapper", "counted", "no_feature", "ambiguous"]


@dataclass(frozen=True)
class CountSettings:
    """What is counted: duplicates, records of several hits; the bin of the overlap join, and up to how many stretches an annotation's outline travels to the records."""

    duplicates: bool = False
    multimappers: bool = False
    bin_size: int = 16384
    outline_rows: int = DIMENSION_ROWS


def sample_of(file: Column) -> Column:
    """The sample of a file: its name up to the first dot."""
    return F.regexp_extract(file, r"^([^.]*)", 1)


def read_outcomes(records: DataFrame, exons: DataFrame, settings: CountSettings = CountSettings()) -> DataFrame:
    """file, read_idx, status, gene_id (of counted records) and duplicate (skipped for that flag alone) of ``read_bam``'s records (Q-57).

    exons: chrom, start, end, gene_id. A record's flag is looked at first, then its number of hits; only what is left meets the exons. Records look their
    blocks up in the exons' outline where that is small, and nothing is shuffled; else blocks are joined to them (``overlaps``), with the same rows.
    """
    flagged = (F.col("flag").bitwiseAND(F.lit(alignments.SKIP)) != 0) | F.col("ref").isNull()
    duplicate = (F.col("flag").bitwiseAND(F.lit(alignments.DUPLICATE)) != 0) & F.lit(not settings.duplicates)
    several = (F.coalesce("nh", F.lit(1)) > 1) & F.lit(not settings.multimappers)
    told = records.withColumns({"why": F.when(flagged | duplicate, STATUSES[0]).when(several, STATUSES[1]), "duplicate": duplicate & ~flagged})
    # a record whose alignment has no block overlaps nothing
    aligned = F.when(F.col("why").isNull(), seq.aligned_blocks(F.col("pos"), F.col("cigar")))
    told = told.select("file", "read_idx", F.col("ref").alias("chrom"), aligned.alias("blocks"), "why", "duplicate")
    features = exons.select("chrom", "start", "end", F.col("gene_id").cast("string").alias("gene_id"))
    outline = outline_of(features, "gene_id", bin_size=settings.bin_size, rows=settings.outline_rows)
    if outline is not None:
        return _looked(told, outline)
    told = stored(told.withColumn("block", F.explode_outer("blocks")).select("file", "read_idx", "chrom", "block.start", "block.end", "why", "duplicate"))  # files are read once
    skipped = told.where("why is not null").select("file", "read_idx", F.col("why").alias("status"), F.lit(None).cast("string").alias("gene_id"), "duplicate")
    blocks = told.where("why is null").select("file", "read_idx", "chrom", F.coalesce("start", F.lit(0)).alias("start"), F.coalesce("end", F.lit(0)).alias("end"))
    met = overlaps(blocks, features, ["file", "read_idx"], "gene_id", bin_size=settings.bin_size)
    return skipped.unionByName(met.select("file", "read_idx", "status", "gene_id", F.lit(False).alias("duplicate")))


def _looked(told: DataFrame, outline: Outline) -> DataFrame:
    """Outcomes of records (file, read_idx, chrom, blocks, why, duplicate) where they are: the annotation's outline travels to them."""
    sent = told.sparkSession.sparkContext.broadcast(outline)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        names = pa.array([*map(str, own.features)], pa.string())
        known = pa.array([*own.chroms], pa.string())
        codes = np.array([*own.chroms.values(), -1], np.int64)
        for batch in batches:
            file, place, chrom, blocks, why, duplicate = batch.columns
            counts = pc.fill_null(pc.list_value_length(blocks), 0).to_numpy(zero_copy_only=False)
            on = codes[pc.fill_null(pc.index_in(chrom, known, skip_nulls=True), len(codes) - 1).to_numpy(zero_copy_only=False)]
            spans = blocks.flatten()
            start, end = (spans.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("start", "end"))
            low, high = own.meet(np.repeat(on, counts), start, end)
            some = np.flatnonzero(counts)
            first = (np.cumsum(counts) - counts)[some]
            least, most = np.full(len(counts), own.none, np.int32), np.full(len(counts), -1, np.int32)
            if len(some):
                least[some], most[some] = np.minimum.reduceat(low, first), np.maximum.reduceat(high, first)
            found = pa.array(STATUSES[2:], pa.string()).take(pa.array(np.where(most < 0, 1, np.where(least == most, 0, 2))))
            counted = (most >= 0) & (least == most)
            gene = names.take(pa.array(np.where(counted, least, 0), mask=~counted))
            yield pa.RecordBatch.from_arrays([file, place, pc.coalesce(why, found), gene, duplicate], ["file", "read_idx", "status", "gene_id", "duplicate"])

    return told.mapInArrow(run, "file string, read_idx long, status string, gene_id string, duplicate boolean")


def sample_counts(outcomes: DataFrame) -> DataFrame:
    """sample, status, gene_id (null but for counted) and n, duplicates: all that later tables need, one row for each of them."""
    return outcomes.groupBy(sample_of(F.col("file")).alias("sample"), "status", "gene_id").agg(F.count("*").alias("n"), F.count_if("duplicate").alias("duplicates"))


def count_summary(counts: DataFrame) -> DataFrame:
    """sample, records, one column for each status, and how many were duplicates only."""
    per = [F.coalesce(F.sum(F.when(F.col("status") == s, F.col("n"))), F.lit(0)).alias(s) for s in STATUSES]
    return counts.groupBy("sample").agg(F.sum("n").alias("records"), *per, F.sum("duplicates").alias("skipped_duplicate"))


def gene_matrix(counts: DataFrame, genes: DataFrame, samples: list[str]) -> DataFrame:
    """``genes`` (gene_id and more, a row each) with a column of counts for each sample, 0 without any."""
    wide = counts.where("status = 'counted' and gene_id is not null").groupBy("gene_id").pivot("sample", samples).agg(F.sum("n"))
    return genes.join(wide, "gene_id", "left").na.fill(0, samples)


def gene_index(exons: DataFrame) -> DataFrame:
    """A row for each gene of an annotation: gene_id, gene_name (its id without one), gene_biotype, chrom and strand of its last exon."""
    last = F.max_by(F.struct("gene_name", "gene_biotype", "chrom", "strand"), F.struct("chrom", "start", "end"))
    one = exons.groupBy("gene_id").agg(last.alias("g"))
    return one.select("gene_id", F.coalesce("g.gene_name", "gene_id").alias("gene_name"), F.coalesce("g.gene_biotype", F.lit("")).alias("gene_biotype"), "g.chrom", "g.strand")


class CountCache:
    """Counts of samples by what they were counted from: a sample whose files and settings are the same is not read again.

    A sample's key is a digest of its files' names, sizes and times of change, of the annotation's identity and of the settings. Counts are Parquet
    below ``folder``, a folder for each key, and count once their writing has ended. A changed sample gets another key, so
    that only its rows are made anew; ``prune`` deletes what no present sample names.
    """

    def __init__(self, spark: SparkSession, folder: str, annotation: str, settings: CountSettings = CountSettings()):
        self.spark, self.folder, self.annotation, self.settings = spark, folder.rstrip("/"), annotation, settings

    def keys(self, path: str) -> dict[str, tuple[str, list[str]]]:
        """Each sample's key and files; no file is opened."""
        files: dict[str, list[str]] = {}
        for file in fastq.listed(path, (".bam",)):
            files.setdefault(os.path.basename(file).split(".")[0], []).append(file)
        out = {}
        for sample, own in files.items():
            seen = []
            for file in own:
                fs, where = fastq.filesystem(file)
                info = fs.get_file_info(where)
                seen.append([file, info.size, info.mtime_ns])
            told = json.dumps([sample, seen, self.annotation, asdict(self.settings)], sort_keys=True)
            out[sample] = (hashlib.sha256(told.encode()).hexdigest()[:32], own)
        return out

    def _done(self, key: str) -> bool:
        fs, where = fastq.filesystem(f"{self.folder}/key={key}/_SUCCESS")
        return fs.get_file_info(where).is_file

    def counts(self, path: str, exons: DataFrame) -> DataFrame:
        """``sample_counts`` of all samples below a path; only those without a key are read."""
        keys = self.keys(path)
        for key, files in keys.values():
            if not self._done(key):
                records = None
                for file in files:
                    own = alignments.read_bam(self.spark, file)
                    records = own if records is None else records.unionByName(own)
                sample_counts(read_outcomes(records, exons, self.settings)).write.mode("overwrite").parquet(f"{self.folder}/key={key}")
        schema = "sample string, status string, gene_id string, n long, duplicates long"
        if not keys:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.folder}/key={key}" for key, _ in keys.values()])

    def prune(self, path: str) -> int:
        """Delete counts that no sample below the path has any more; how many there were."""
        fs, where = fastq.filesystem(self.folder)
        present = {f"key={key}" for key, _ in self.keys(path).values()}
        old = [i for i in fs.get_file_info(fastq.pafs.FileSelector(where, allow_not_found=True)) if i.base_name.startswith("key=") and i.base_name not in present]
        for info in old:
            fs.delete_dir(info.path)
        return len(old)
