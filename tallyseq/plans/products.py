"""Products of whole workflows: funnels, orientation, pairwise tests, program cards, comparisons, files read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import seq, special
from ..operators import aggregate as agg
from ..operators import annotate, match, stats
from ..operators.lineage import shared_folder
from ..session import table
from ..sources import fastq, tables
from .catalog import query
from .counts import _simpson, r
from .reads import _DNA, _RC, _READS, _library, _reads, dna
from .screens import _SCREEN, _screen

_FEATURES = f"""{_READS}, bc AS (SELECT substring({_DNA.format('i')}, 1, 6) AS k FROM range(0, 20) AS t(i)), g1 AS (SELECT substring({_DNA.format('i')}, 13, 6) AS k FROM range(0, 30) AS t(i)), g2 AS (SELECT substring({_DNA.format('i * 31')}, 1, 5) AS k FROM range(0, 400) AS t(i)),
 x AS (SELECT id, seq[33:38] IN (SELECT k FROM bc) AS a, seq[45:50] IN (SELECT k FROM g1) AS b, seq[1:5] IN (SELECT k FROM g2) AS c, regexp_matches(seq[17:32], 'G[ACGT]{{8}}T') AS u FROM r)"""


@query("conjunctive_features", f"WITH {_FEATURES} SELECT count(*) AS reads, count(*) FILTER (a) AS with_bc, count(*) FILTER (b) AS with_g1, count(*) FILTER (c) AS with_g2, count(*) FILTER (a AND b AND c) AS all_features, count(*) FILTER (a AND b AND c AND u) AS recorded FROM x")
def conjunctive_features(spark, d):
    """Reads with a barcode, both guides and then a UMI, as a funnel (MAT-06, Q-05)."""
    words = {"bc": (20, 1, 1, 6, 33), "g1": (30, 1, 13, 6, 45), "g2": (400, 31, 1, 5, 1)}
    rows = _reads(spark, d).withColumn("umi", F.nullif(F.regexp_extract(F.substring("seq", 17, 16), "G([ACGT]{8})T", 1), F.lit("")))
    for name, (n, step, start, size, at) in words.items():
        listed = spark.range(n).select(F.substring(dna(F.col("id") * step), start, size).alias("_k")).distinct()
        rows = rows.withColumn("_k", F.substring("seq", at, size)).join(match.small(listed.withColumn(name, F.col("_k"))), "_k", "left").drop("_k")
    return match.conjunctive_funnel(rows, list(words), "umi")


_SEEN = f"""s AS (SELECT substring({_DNA.format('event_id % 7')}, 1, 6) AS t, substring({_DNA.format('event_id % 9')}, 9, 6) AS p, user_id % 3 = 0 AS turned FROM events), o AS (SELECT CASE WHEN turned THEN t ELSE {_RC.format('t')} END AS t, CASE WHEN turned THEN p ELSE {_RC.format('p')} END AS p FROM s),
 td AS (SELECT DISTINCT substring({_DNA.format('i')}, 1, 6) AS k FROM range(0, 5) AS x(i)), pd AS (SELECT DISTINCT substring({_DNA.format('i')}, 9, 6) AS k FROM range(0, 6) AS x(i)),
 m AS (SELECT t IN (SELECT k FROM td) AS a, t IN (SELECT {_RC.format('k')} FROM td) AS b, p IN (SELECT k FROM pd) AS c, p IN (SELECT {_RC.format('k')} FROM pd) AS e FROM o)"""


@query("orientation_preflight", f"""WITH {_SEEN} SELECT count(*) AS pairs, count(*) FILTER (a) AS treatment_direct, count(*) FILTER (b) AS treatment_reversed, count(*) FILTER (c) AS peptide_direct, count(*) FILTER (e) AS peptide_reversed,
 count(*) FILTER (a AND c) AS both_direct, count(*) FILTER (b AND e) AS both_reversed, CASE WHEN count(*) FILTER (b AND e) > count(*) FILTER (a AND c) THEN 'reversed' ELSE 'direct' END AS selected FROM m""")
def orientation_preflight(spark, d):
    """Which way barcodes are read, by the pairs that match (SEQ-21, Q-13)."""
    e, turned = table(spark, d, "events"), F.col("user_id") % 3 == 0
    t, p = F.substring(dna(F.col("event_id") % 7), 1, 6), F.substring(dna(F.col("event_id") % 9), 9, 6)
    rows = e.select(F.when(turned, t).otherwise(seq.reverse_complement(t)).alias("treatment"), F.when(turned, p).otherwise(seq.reverse_complement(p)).alias("peptide"))
    words = lambda n, at: spark.range(n).select(F.substring(dna(F.col("id")), at, 6).alias("k"))
    return match.orientation(rows, {"treatment": words(5, 1), "peptide": words(6, 9)})


@query("top_names", """SELECT p_brand, string_agg(p_name, ';' ORDER BY n) AS names FROM (SELECT p_brand, p_name, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_size DESC, p_partkey) AS n FROM part) WHERE n <= 12 GROUP BY 1""")
def top_names(spark, d):
    """The twelve first names of each group as one text (AGG-13)."""
    return agg.top_names(table(spark, d, "part"), ["p_brand"], "p_name", [F.col("p_retailprice"), F.col("p_size").desc(), F.col("p_partkey")])


@query("casefold_labels", """SELECT n_name, count(r_name) AS regions FROM nation LEFT JOIN region ON lower(trim(' ' || upper(n_name[1:4]) || ' ')) = lower(trim(r_name[1:4])) GROUP BY 1""")
def casefold_labels(spark, d):
    """Labels compared without regard to case and outer blanks (SEQ-18)."""
    n = table(spark, d, "nation").select("n_name", F.concat(F.lit(" "), F.upper(F.substring("n_name", 1, 4)), F.lit(" ")).alias("a"))
    g = table(spark, d, "region").select("r_name", F.lower(F.substring("r_name", 1, 4)).alias("b"))
    return n.join(F.broadcast(g), seq.same_label(F.col("a"), F.col("b")), "left").groupBy("n_name").agg(F.count("r_name").alias("regions"))  # five regions


_PAIRWISE = f"""v AS (SELECT c_mktsegment AS grp, c_acctbal AS x FROM customer), gs AS (SELECT DISTINCT grp FROM v WHERE grp <> 'BUILDING'),
 s AS (SELECT grp, x, 1 AS own FROM v WHERE grp <> 'BUILDING' UNION ALL SELECT gs.grp, x, 0 FROM v, gs WHERE v.grp = 'BUILDING'), k AS (SELECT grp, x, count(*) AS t, sum(own) AS t1 FROM s GROUP BY 1, 2),
 rk AS (SELECT *, coalesce(sum(t) OVER (PARTITION BY grp ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (t + 1) / 2.0 AS rank FROM k),
 m AS (SELECT grp, CAST(sum(t1) AS DOUBLE) AS n1, CAST(sum(t - t1) AS DOUBLE) AS n2, CAST(sum(rank * t1) AS DOUBLE) AS r1, sum(CAST(t AS DOUBLE) * t * t - t) AS ties FROM rk GROUP BY 1),
 q AS (SELECT grp, quantile_cont(x, 0.5) FILTER (own = 1) AS md1, quantile_cont(x, 0.5) FILTER (own = 0) AS md2 FROM s GROUP BY 1),
 u AS (SELECT *, r1 - n1 * (n1 + 1) / 2 AS u, n1 + n2 AS n FROM m JOIN q USING (grp)),
 z AS (SELECT *, (u - n1 * n2 / 2 - 0.5 * sign(u - n1 * n2 / 2)) / sqrt(n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1)))) AS z FROM u),
 pv AS (SELECT *, greatest(1 - 2 * {_simpson('exp(-{x} * {x} / 2) / sqrt(2 * pi())', 'least(abs(z), 40)')}, 0) AS p FROM z), raw AS (SELECT *, p * (count(*) OVER ()) / row_number() OVER (ORDER BY p, grp) AS raw FROM pv)"""


@query("pairwise_vs_reference", f"""WITH {_PAIRWISE} SELECT grp, CAST(n1 AS BIGINT) AS n_group, CAST(n2 AS BIGINT) AS n_reference, round(md1, 6) AS median_group, round(md2, 6) AS median_reference, round(md1 - md2, 6) AS median_diff, round(2 * u / (n1 * n2) - 1, 6) AS rank_biserial,
 round(p, 6) + 0 AS p_value, round(least(min(raw) OVER (ORDER BY p DESC, grp DESC ROWS UNBOUNDED PRECEDING), 1), 6) + 0 AS q_value FROM raw""")
def pairwise_vs_reference(spark, d):
    """Each segment's balances against one segment's, with adjusted p-values (Q-33, Q-35)."""
    rows = table(spark, d, "customer").select(F.col("c_mktsegment").alias("grp"), F.col("c_acctbal").alias("x"))
    out = stats.pairwise_against(rows, "grp", "x", "BUILDING").withColumn("p", F.least(2 * special.normal_udf()(F.abs("z")), F.lit(1.0)))
    out = stats.benjamini_hochberg(out, "p", "q")
    return out.select("grp", "n_group", "n_reference", *[r(F.col(c), c) for c in ("median_group", "median_reference", "median_diff", "rank_biserial")], r(F.col("p"), "p_value"), r(F.col("q"), "q_value"))


_CARD_TEXTS = ["COPII-coated vesicle budding", "ubiquitin ligase complex", "mRNA splicing, via spliceosome", "regulation of transcription", "ion channel activity", "unknown"]
_CARD_SQL = "CASE " + " ".join(f"WHEN n % 6 = {i} THEN '{p}'" for i, p in enumerate(["ER-Golgi / COPII vesicular transport", "Ubiquitin–proteasome / protein degradation", "Spliceosome / RNA processing (likely general)", "Transcription / chromatin (likely general)", "Transport — ion channels & solute carriers", annotate.UNCLEAR])) + " END"


@query("program_cards", f"""WITH {_SCREEN}, x AS (SELECT *, greatest(CASE WHEN b_lfc > 0 THEN b_pos ELSE b_neg END, CASE WHEN c_lfc > 0 THEN c_pos ELSE c_neg END) AS f FROM s), h AS (SELECT gene, length(gene) + ascii(right(gene, 1)) AS n FROM x WHERE f <= 0.05), c AS (SELECT gene, {_CARD_SQL} AS program FROM h),
 k AS (SELECT program, count(*) AS gene_cards, row_number() OVER (ORDER BY min(gene)) AS place FROM c GROUP BY 1) SELECT c.gene, c.program, k.gene_cards, CAST(k.place AS INT) AS place FROM c JOIN k USING (program)""")
def program_cards(spark, d):
    """Genes of the first tier with their program, its place and number of cards (Q-49)."""
    f = F.greatest(*[F.when(F.col(f"{s}_lfc") > 0, F.col(f"{s}_pos_fdr")).otherwise(F.col(f"{s}_neg_fdr")) for s in "bc"])
    n = F.length("gene") + F.ascii(F.right("gene", F.lit(1)))
    text = F.element_at(F.array(*map(F.lit, _CARD_TEXTS)), (n % 6 + 1).cast("int"))
    hits = _screen(spark, d).withColumn("f", f).where(F.col("f") <= 0.05).select("gene", F.lit("T1-core").alias("tier"), F.col("gene").alias("row"), text.alias("text"))
    return annotate.program_cards(hits, "T1-core", "text").select("gene", "program", "gene_cards", "place")


@query("golden_comparison", """WITH a AS (SELECT l_partkey AS k, count(*) AS n, sum(l_quantity) AS q FROM lineitem WHERE l_partkey % 50 <> 1 GROUP BY 1), b AS (SELECT l_partkey AS k, count(*) + CASE WHEN l_partkey % 20 = 0 THEN 2 ELSE 0 END AS n, sum(l_quantity) AS q FROM lineitem WHERE l_partkey % 50 <> 2 GROUP BY 1),
 j AS (SELECT a.k IS NULL OR b.k IS NULL AS one, a.n AS an, b.n AS bn, a.q AS aq, b.q AS bq FROM a FULL JOIN b ON a.k = b.k)
 SELECT 'n' AS "column", count(*) FILTER (one) AS unmatched, count(*) FILTER (NOT one AND an <> bn) AS differing, CAST(max(abs(an - bn)) AS DOUBLE) AS max_abs_diff FROM j UNION ALL SELECT 'q', count(*) FILTER (one), count(*) FILTER (NOT one AND aq <> bq), CAST(max(abs(aq - bq)) AS DOUBLE) FROM j""")
def golden_comparison(spark, d):
    """A generated table against a golden one: rows that one lacks, values that differ, and by how much (Q-59)."""
    li = table(spark, d, "lineitem")
    made = lambda skip: li.where(F.col("l_partkey") % 50 != skip).groupBy(F.col("l_partkey").alias("k")).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"))
    golden = made(2).withColumn("n", F.col("n") + F.when(F.col("k") % 20 == 0, 2).otherwise(0))
    return stats.compared(made(1), golden, ["k"], ["n", "q"])


@query("validated_join", """SELECT s_nationkey AS grp, n_name AS name, count(*) AS n, round(avg(s_acctbal), 4) AS mean FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY 1, 2""")
def validated_join(spark, d):
    """Means by group, with names joined after their keys are found to be unique (JOIN-05, Q-55)."""
    names = table(spark, d, "nation").select(F.col("n_nationkey").alias("grp"), F.col("n_name").alias("name"))
    rows = tables.validated_join(table(spark, d, "supplier").withColumnRenamed("s_nationkey", "grp"), names, ["grp"], "inner")
    return rows.groupBy("grp", "name").agg(F.count("*").alias("n"), F.round(F.avg("s_acctbal"), 4).alias("mean"))


@query("fastq_count_matrix", f"""WITH {_READS}, l AS (SELECT i AS label, substring({_DNA.format('i')}, 9, 8) AS b FROM range(0, 40) AS t(i)), x AS (SELECT label, {_RC.format('b')} AS k FROM l), h AS (SELECT id % 3 AS sample, id, label FROM r, unnest(range(1, length(seq) - 6)) AS t(i) JOIN x ON seq[i:i + 7] = k)
 SELECT CAST(label AS INT) AS label, count(*) FILTER (sample = 0) AS s0, count(*) FILTER (sample = 1) AS s1, count(*) FILTER (sample = 2) AS s2 FROM h GROUP BY 1""")
def fastq_count_matrix(spark, d):
    """Reads written as FASTQ files of three samples, read back by the source, and counted by barcode and sample (Q-02, SRC-01)."""
    folder = f"{shared_folder(spark)}/fastq-{uuid.uuid4().hex}"
    reads = _reads(spark, d).withColumn("sample", F.concat(F.lit("s"), (F.col("id") % 3).cast("string")))
    record = F.concat(F.lit("@"), F.col("id").cast("string"), F.lit("\n"), F.col("seq"), F.lit("\n+\n"), F.repeat(F.lit("I"), F.length("seq")))
    reads.select("sample", record.alias("value")).write.partitionBy("sample").option("compression", "gzip").text(folder)
    found = fastq.read_fastq(spark, f"{folder}/sample=*/*", suffixes=".txt.gz").withColumn("sample", F.regexp_extract("path", "sample=([^/]+)/", 1))
    hits = match.scan_kmers(found, _library(spark), "seq", "barcode", 8, "read_id", ["sample"])
    return hits.groupBy("label").pivot("sample", ["s0", "s1", "s2"]).agg(F.count(F.lit(1))).na.fill(0)
