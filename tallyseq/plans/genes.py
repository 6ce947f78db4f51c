"""Alignment files: records written from a table as BAM, read back in splits, and counted by gene."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import genecounts
from ..operators.lineage import settle, shared_folder
from ..session import table
from ..sources import alignments, fastq
from .catalog import query

#: Reference sequences of the derived files, and the bytes of a split.
REFERENCES, SPLIT = [(f"c{i}", 100_000) for i in range(5)], 1 << 20

_BAM = """l AS MATERIALIZED (SELECT row_number() OVER () AS rid, lower(l_returnflag || l_linestatus) AS sample, CAST(l_quantity AS INT) AS q, CASE WHEN l_orderkey % 41 = 0 THEN NULL ELSE 'c' || CAST(l_suppkey % 5 AS VARCHAR) END AS chrom, CAST(l_partkey * 37 % 60000 AS INT) AS pos,
  CASE WHEN l_orderkey % 17 = 0 THEN 256 WHEN l_orderkey % 19 = 0 THEN 1024 WHEN l_orderkey % 23 = 0 THEN 1028 ELSE 16 END AS flag, CASE WHEN l_partkey % 7 = 0 THEN 1 + l_linenumber % 3 END AS nh FROM lineitem),
 b AS (SELECT *, pos AS s, pos + 20 + q AS e FROM l UNION ALL SELECT *, pos + 20 + q + 300, pos + 20 + q + 330 FROM l WHERE q % 2 = 0),
 x AS (SELECT 'c' || CAST(p_partkey % 5 AS VARCHAR) AS chrom, CAST(p_partkey * 101 % 60000 AS INT) AS s, CAST(p_partkey * 101 % 60000 + 40 + p_size AS INT) AS e, 'g' || CAST(p_partkey % 97 AS VARCHAR) AS gene_id FROM part),
 w AS (SELECT *, CASE WHEN flag IN (256, 1028, 1024) OR chrom IS NULL THEN 'skipped_flag_or_unmapped' WHEN coalesce(nh, 1) > 1 THEN 'skipped_multimapper' END AS why FROM l),
 h AS (SELECT b.rid, count(DISTINCT x.gene_id) AS n, min(x.gene_id) AS gene_id FROM b JOIN x ON x.chrom = b.chrom AND x.s < b.e AND x.e > b.s GROUP BY 1),
 r AS (SELECT w.sample, w.flag = 1024 AND w.chrom IS NOT NULL AS dup, coalesce(why, CASE WHEN h.n IS NULL THEN 'no_feature' WHEN h.n = 1 THEN 'counted' ELSE 'ambiguous' END) AS status, h.gene_id FROM w LEFT JOIN h ON h.rid = w.rid AND w.why IS NULL)"""


def _counts(spark, d):
    """Counts of files that are written from ``lineitem`` and deleted when they have been counted."""
    order, part = F.col("l_orderkey"), F.col("l_partkey")
    op = lambda o, n: F.struct(F.lit(o).alias("op"), n.cast("int").alias("len"))
    q = F.col("l_quantity").cast("int")
    spliced = F.array(op("M", q + 20), op("N", F.lit(300)), op("S", F.lit(4)), op("M", F.lit(30)))
    records = table(spark, d, "lineitem").select(
        F.lower(F.concat("l_returnflag", "l_linestatus")).alias("sample"), F.concat_ws("-", order, "l_linenumber").alias("name"), F.when(order % 41 != 0, F.concat(F.lit("c"), F.col("l_suppkey") % 5)).alias("ref"), (part * 37 % 60000).cast("int").alias("pos"),
        F.when(order % 17 == 0, 256).when(order % 19 == 0, 1024).when(order % 23 == 0, 1028).otherwise(16).alias("flag"), F.when(q % 2 == 0, spliced).otherwise(F.array(op("M", q + 20))).alias("cigar"), F.when(part % 7 == 0, 1 + F.col("l_linenumber") % 3).cast("int").alias("nh"),
    )
    folder = f"{shared_folder(spark)}/bam-{uuid.uuid4().hex}"
    alignments.write_bam(records, folder, REFERENCES)
    counts = settle(genecounts.sample_counts(genecounts.read_outcomes(alignments.read_bam(spark, folder, SPLIT), _exons(spark, d))))
    fs, where = fastq.filesystem(folder)
    if fs.get_file_info(where).type == fastq.pafs.FileType.Directory:
        fs.delete_dir(where)
    return counts


def _exons(spark, d):
    p = F.col("p_partkey")
    start = (p * 101 % 60000).cast("int")
    return table(spark, d, "part").select(
        F.concat(F.lit("c"), p % 5).alias("chrom"), start.alias("start"), (start + 40 + F.col("p_size")).cast("int").alias("end"), F.lit("+").alias("strand"),
        F.concat(F.lit("g"), p % 97).alias("gene_id"), F.lit(None).cast("string").alias("gene_name"), F.lit(None).cast("string").alias("gene_biotype"),
    )


@query("bam_count_summary", f"WITH {_BAM} SELECT sample, count(*) AS records, {', '.join(f'''count(*) FILTER (status = '{s}') AS {s}''' for s in genecounts.STATUSES)}, count(*) FILTER (dup) AS skipped_duplicate FROM r GROUP BY 1")
def bam_count_summary(spark, d):
    """What became of the records of each sample's files (SRC-10, Q-57)."""
    return genecounts.count_summary(_counts(spark, d))


SAMPLES = ["af", "nf", "no", "rf"]


@query("bam_gene_matrix", f"WITH {_BAM}, g AS (SELECT DISTINCT gene_id FROM x) SELECT g.gene_id, g.gene_id AS gene_name, {', '.join(f'''count(*) FILTER (sample = '{s}') AS {s}''' for s in SAMPLES)} FROM g LEFT JOIN r ON r.gene_id = g.gene_id AND status = 'counted' GROUP BY 1")
def bam_gene_matrix(spark, d):
    """Counts of every gene in four samples' files, zeros included (Q-57)."""
    found = genecounts.gene_matrix(_counts(spark, d), genecounts.gene_index(_exons(spark, d)), SAMPLES)
    return found.select("gene_id", "gene_name", *SAMPLES)
