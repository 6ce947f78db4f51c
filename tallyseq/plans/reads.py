"""Reads: sequence functions, matching against libraries, UMI collapse and decontamination.

The driver's tables hold no reads, so they are made from ids: md5 digits mapped to A, C, G and T, which SQL can make too.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import seq
from ..operators import aggregate as agg
from ..operators import iterate, match
from ..session import table
from .catalog import query

DIGITS, BASES = "0123456789abcdef", "ACGTACGTACGTACGT"


def dna(c):
    return F.translate(F.md5(c.cast("string").cast("binary")), DIGITS, BASES)


_DNA = f"translate(md5(CAST({{}} AS VARCHAR)), '{DIGITS}', '{BASES}')"
_READS = f"r AS (SELECT event_id AS id, user_id, {_DNA.format('user_id * 31 + event_id % 3')} || {_DNA.format('event_id % 40')} AS seq FROM events)"
_RC = "reverse(translate({}, 'ACGTNacgtn', 'TGCANtgcan'))"


def _reads(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("id"), "user_id", F.concat(dna(F.col("user_id") * 31 + F.col("event_id") % 3), dna(F.col("event_id") % 40)).alias("seq"))


def _library(spark, n: int = 40, start: int = 9, length: int = 8):
    ids = spark.range(n).select(F.col("id").cast("int").alias("label"), dna(F.col("id")).alias("s"))
    return ids.select("label", F.substring("s", start, length).alias("barcode"))


@query("revcomp_kmers", f"""WITH s AS (SELECT doc_id, {_DNA.format('doc_id')} AS s FROM documents), k AS (SELECT doc_id, s[i:i + 7] AS k FROM s, unnest(range(1, length(s) - 6)) AS t(i))
 SELECT {_RC.format('k')} AS kmer, count(*) AS n, count(DISTINCT doc_id) AS docs FROM k GROUP BY 1""")
def revcomp_kmers(spark, d):
    k = table(spark, d, "documents").select("doc_id", F.explode(seq.kmers(dna(F.col("doc_id")), 8)).alias("k"))
    return k.groupBy(seq.reverse_complement(F.col("k")).alias("kmer")).agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"))


@query("kmer_dictionary_scan", f"""WITH {_READS}, l AS (SELECT i AS label, substring({_DNA.format('i')}, 9, 8) AS b FROM range(0, 40) AS t(i)), x AS (SELECT label, {_RC.format('b')} AS k FROM l), h AS (SELECT id, label FROM r, unnest(range(1, length(seq) - 6)) AS t(i) JOIN x ON seq[i:i + 7] = k)
 SELECT CAST(label AS INT) AS label, count(*) AS hits, count(DISTINCT id) AS reads FROM h GROUP BY 1""")
def kmer_dictionary_scan(spark, d):
    hits = match.scan_kmers(_reads(spark, d), _library(spark), "seq", "barcode", 8, "id")
    return hits.groupBy("label").agg(F.count("*").alias("hits"), F.count_distinct("id").alias("reads"))


_PATTERN = "SELECT DISTINCT translate(lpad(CAST(p_partkey % 10000 AS VARCHAR), 4, '0'), '0123456789', 'acgtnacgnn') AS pattern FROM part"
_LETTERS = ", ".join(f"unnest(CASE WHEN pattern[{i}] = 'n' THEN ['a', 'c', 'g', 't'] ELSE [pattern[{i}]] END) AS t{i}(x{i})" for i in range(1, 5))


@query("degenerate_expansion", f"WITH p AS ({_PATTERN}) SELECT 'tt' || pattern || 'gg' AS pattern, 'tt' || x1 || x2 || x3 || x4 || 'gg' AS barcode FROM p, {_LETTERS}")
def degenerate_expansion(spark, d):
    """Barcodes of the patterns that the parts' numbers spell, of none to four open places (SEQ-02, Q-01)."""
    digits = F.lpad((F.col("p_partkey") % 10000).cast("string"), 4, "0")
    patterns = table(spark, d, "part").select(F.concat(F.lit("tt"), F.translate(digits, "0123456789", "acgtnacgnn"), F.lit("gg")).alias("pattern")).distinct()
    return match.expand_degenerate(patterns, "pattern", "barcode").select("pattern", "barcode")


@query("unambiguous_dictionary", """WITH t AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) || '-' || CAST(p_size AS VARCHAR) AS token, p_brand FROM part) SELECT token, min(p_brand) AS brand FROM t GROUP BY 1 HAVING count(DISTINCT p_brand) = 1""")
def unambiguous_dictionary(spark, d):
    t = table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("w"), "p_size", F.col("p_brand").alias("brand"))
    return match.unambiguous(t.select(F.concat_ws("-", "w", F.col("p_size").cast("string")).alias("token"), "brand"), "token", "brand")


_CASSETTE = f"q AS (SELECT event_id AS id, CASE WHEN event_id % 5 = 0 THEN 'ACGT' ELSE 'GGAC' END || substring({_DNA.format('user_id')}, 1, 8) || CASE WHEN event_id % 7 = 0 THEN 'TT' ELSE 'CA' END || substring({_DNA.format('event_id % 10')}, 1, 6) AS s FROM events), c AS (SELECT id, CASE WHEN id % 11 = 0 THEN left(s, 15) ELSE s END AS s FROM q)"


@query("cassette_parse", f"""WITH {_CASSETTE}, d AS (SELECT DISTINCT substring({_DNA.format('i')}, 1, 6) AS p FROM range(0, 8) AS t(i)) SELECT CASE WHEN length(s) < 20 THEN 'too_short' WHEN left(s, 4) <> 'GGAC' THEN 'anchor' WHEN s[13:14] <> 'CA' THEN 'spacer' WHEN d.p IS NULL THEN 'peptide' ELSE 'ok' END AS state, count(*) AS reads, count(DISTINCT s[5:12]) AS barcodes FROM c LEFT JOIN d ON s[15:20] = d.p GROUP BY 1""")
def cassette_parse(spark, d):
    e = table(spark, d, "events")
    s = F.concat(F.when(F.col("event_id") % 5 == 0, "ACGT").otherwise("GGAC"), F.substring(dna(F.col("user_id")), 1, 8), F.when(F.col("event_id") % 7 == 0, "TT").otherwise("CA"), F.substring(dna(F.col("event_id") % 10), 1, 6))
    rows = e.select(s.alias("s"), "event_id").withColumn("s", F.when(F.col("event_id") % 11 == 0, F.left("s", F.lit(15))).otherwise(F.col("s")))
    parsed = rows.withColumn("c", seq.cassette(F.col("s"), 0, "GGAC", 8, 0, "CA", 6))
    peptides = spark.range(8).select(F.substring(dna(F.col("id")), 1, 6).alias("peptide")).distinct().withColumn("_ok", F.lit(True))
    known = parsed.withColumn("peptide", F.col("c.peptide")).join(match.small(peptides), "peptide", "left")
    state = F.coalesce("c.failed", F.when(F.col("_ok").isNull(), "peptide"), F.lit("ok"))
    return known.groupBy(state.alias("state")).agg(F.count("*").alias("reads"), F.count_distinct("c.dcbc").alias("barcodes"))


_DICT = f"k AS (SELECT 'L' || i AS label, substring({_DNA.format('i')}, 1, 6) AS k FROM range(0, 30) AS t(i) UNION ALL SELECT 'L' || (i + 1), substring({_DNA.format('i')}, 1, 6) FROM range(0, 30, 10) AS t(i) UNION ALL SELECT 'S' || i, substring({_DNA.format('i')}, 20, 4) FROM range(0, 10) AS t(i))"


@query("window_longest_lookup", f"""WITH {_READS}, {_DICT}, w AS (SELECT id, seq[21:50] AS win FROM r), h AS (SELECT id, label, length(k) AS n, i - 1 AS p FROM w, unnest(range(1, 30)) AS t(i) JOIN k ON win[i:i + length(k) - 1] = k), m AS (SELECT *, max(n) OVER (PARTITION BY id) AS m FROM h)
 SELECT id, CASE WHEN count(DISTINCT label) = 1 THEN min(label) END AS label, CAST(min(p) AS INT) AS pos, CAST(max(n) AS INT) AS key_length FROM m WHERE n = m GROUP BY 1""")
def window_longest_lookup(spark, d):
    s = lambda n, step, name, a, b: spark.range(0, n, step).select(F.concat(F.lit(name[0]), (F.col("id") + name[1]).cast("string")).alias("label"), F.substring(dna(F.col("id")), a, b).alias("key"))
    words = s(30, 1, ("L", 0), 1, 6).unionByName(s(30, 10, ("L", 1), 1, 6)).unionByName(s(10, 1, ("S", 0), 20, 4))
    windows = _reads(spark, d).select("id", F.substring("seq", 21, 30).alias("window"))
    return match.longest_in_window(windows, words, "window", "key", "label", ["id"])


_ENDS = f"f AS (SELECT 'F' || i AS label, substring({_DNA.format('i * 31')}, 3, 7) AS k FROM range(0, 60) AS t(i)), b AS (SELECT 'B' || i AS label, substring({_DNA.format('i')}, 20, 7) AS k FROM range(0, 40) AS t(i))"


@query("two_ended_demux", f"""WITH {_READS}, {_ENDS}, o AS (SELECT id, 0 AS turned, CASE WHEN id % 2 = 0 THEN seq ELSE {_RC.format('seq')} END AS s FROM r UNION ALL SELECT id, 1, {_RC.format("CASE WHEN id % 2 = 0 THEN seq ELSE " + _RC.format('seq') + " END")} FROM r),
 hf AS (SELECT id, turned, label, instr(left(s, 30), k) + length(k) - 1 AS e, row_number() OVER (PARTITION BY id, turned ORDER BY length(k) DESC, instr(left(s, 30), k), label) AS n FROM o JOIN f ON contains(left(s, 30), k)),
 hb AS (SELECT id, turned, label, row_number() OVER (PARTITION BY id, turned ORDER BY length(k) DESC, instr(right(s, 30), k), label) AS n FROM o JOIN b ON contains(right(s, 30), k)),
 m AS (SELECT hf.id, hf.turned, hf.label AS front, hb.label AS back, hf.e, row_number() OVER (PARTITION BY hf.id ORDER BY hf.turned) AS n FROM hf JOIN hb ON hf.id = hb.id AND hf.turned = hb.turned WHERE hf.n = 1 AND hb.n = 1)
 SELECT id, turned, front, back, CAST(e AS INT) AS front_end FROM m WHERE n = 1""")
def two_ended_demux(spark, d):
    reads = _reads(spark, d).withColumn("seq", F.when(F.col("id") % 2 == 0, F.col("seq")).otherwise(seq.reverse_complement(F.col("seq"))))
    fronts = spark.range(60).select(F.concat(F.lit("F"), F.col("id").cast("string")).alias("label"), F.substring(dna(F.col("id") * 31), 3, 7).alias("barcode"))
    backs = spark.range(40).select(F.concat(F.lit("B"), F.col("id").cast("string")).alias("label"), F.substring(dna(F.col("id")), 20, 7).alias("barcode"))
    return match.two_ended(reads, fronts, backs, "id", "seq", "barcode", "label", 30).select("id", "turned", "front", "back", F.col("front_end").cast("int").alias("front_end"))


PATTERNS = [("M1", "ACgtacgtAC"), ("M2", "GTacgtacGT"), ("M3", "TGCAtgcatg"), ("M4", "CCttggaaGG")]


@query("masked_mismatch_match", f"""WITH {_READS}, p(name, must, free, mi, fi) AS (VALUES ('M1', 'ACAC', 'GTACGT', [1, 2, 9, 10], [3, 4, 5, 6, 7, 8]), ('M2', 'GTGT', 'ACGTAC', [1, 2, 9, 10], [3, 4, 5, 6, 7, 8]), ('M3', 'TGCA', 'TGCATG', [1, 2, 3, 4], [5, 6, 7, 8, 9, 10]), ('M4', 'CCGG', 'TTGGAA', [1, 2, 9, 10], [3, 4, 5, 6, 7, 8])),
 x AS (SELECT id, name, free, list_aggregate(list_transform(mi, lambda j: seq[j]), 'string_agg', '') AS m, must, list_aggregate(list_transform(fi, lambda j: seq[j]), 'string_agg', '') AS f FROM r, p) SELECT name, count(*) AS reads, CAST(sum(hamming(f, free)) AS BIGINT) AS mismatches FROM x WHERE m = must AND hamming(f, free) <= 3 GROUP BY 1""")
def masked_mismatch_match(spark, d):
    return match.masked_match(_reads(spark, d), PATTERNS, "seq").groupBy("name").agg(F.count("*").alias("reads"), F.sum("mismatches").cast("long").alias("mismatches"))


_NEAR = f"q AS (SELECT DISTINCT substring({_DNA.format('event_id')}, 1, 9) AS query FROM events), f AS (SELECT CAST(i AS INT) AS label, substring({_DNA.format('i * 7')}, 1, 9) AS reference FROM range(0, 300) AS t(i))"


@query("pigeonhole_nearest", f"""WITH {_NEAR}, h AS (SELECT query, label, hamming(query, reference) AS d FROM q, f WHERE hamming(query, reference) <= 2), m AS (SELECT *, min(d) OVER (PARTITION BY query) AS m FROM h) SELECT query, min(label) AS label, CAST(min(d) AS INT) AS distance FROM m WHERE d = m GROUP BY 1 HAVING count(*) = 1""")
def pigeonhole_nearest(spark, d):
    q = table(spark, d, "events").select(F.substring(dna(F.col("event_id")), 1, 9).alias("s"))
    refs = spark.range(300).select(F.col("id").cast("int").alias("label"), F.substring(dna(F.col("id") * 7), 1, 9).alias("reference"))
    return match.nearest(q, refs, "s", "reference", "label", 9)


_UMI = f"u AS (SELECT user_id AS id, substring({_DNA.format('event_id')}, 1, 6) AS umi, sum(CASE WHEN event_id % 60 < 3 THEN 40 ELSE 1 END) AS n FROM events GROUP BY 1, 2)"


@query("umi_collapse", f"""WITH RECURSIVE {_UMI}, e AS (SELECT c.id, c.umi AS child, p.umi AS parent, row_number() OVER (PARTITION BY c.id, c.umi ORDER BY hamming(c.umi, p.umi), p.n DESC, p.umi) AS k FROM u c JOIN u p ON c.id = p.id AND p.n >= 10 * c.n AND c.umi <> p.umi AND hamming(c.umi, p.umi) <= 3),
 w AS (SELECT u.id, u.umi, u.n, coalesce(e.parent, u.umi) AS up FROM u LEFT JOIN e ON e.id = u.id AND e.child = u.umi AND e.k = 1),
 t(id, umi, n, root, up) AS (SELECT w.id, w.umi, w.n, w.up, p.up FROM w JOIN w p ON p.id = w.id AND p.umi = w.up UNION ALL SELECT t.id, t.umi, t.n, t.up, p.up FROM t JOIN w p ON p.id = t.id AND p.umi = t.up WHERE t.root <> t.up)
 SELECT id, root AS umi, CAST(sum(n) AS BIGINT) AS n, count(*) AS members FROM t WHERE root = up GROUP BY 1, 2""")
def umi_collapse(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("id"), F.substring(dna(F.col("event_id")), 1, 6).alias("umi"), F.when(F.col("event_id") % 60 < 3, 40).otherwise(1).alias("n"))
    return iterate.collapsed_counts(iterate.collapse_umis(rows, "id", "umi", "n", 6), "id", "n")


_PAIRS = """rc AS (SELECT l_suppkey % 40 AS barcode, l_partkey % 200 AS cell_id, CAST(count(*) * CASE WHEN l_partkey % 200 = 7 THEN 60 ELSE 1 END AS BIGINT) AS n FROM lineitem WHERE l_linenumber % 2 = 0 GROUP BY 1, 2, l_partkey % 200 = 7),
 r AS (SELECT barcode, cell_id, CAST(sum(n) AS BIGINT) AS n FROM (SELECT barcode, cell_id, n FROM rc) GROUP BY 1, 2), dn AS (SELECT l_suppkey % 40 AS barcode, l_partkey % 200 AS cell_id, count(*) AS n FROM lineitem WHERE l_linenumber % 2 = 1 AND l_partkey % 200 <> 9 GROUP BY 1, 2)"""


def _pairs(spark, d):
    li = table(spark, d, "lineitem").select((F.col("l_suppkey") % 40).alias("barcode"), (F.col("l_partkey") % 200).alias("cell_id"), "l_linenumber")
    recipient = li.where("l_linenumber % 2 = 0").groupBy("barcode", "cell_id").agg(F.count("*").alias("n")).withColumn("count", F.col("n") * F.when(F.col("cell_id") == 7, 60).otherwise(1)).drop("n")
    donor = li.where("l_linenumber % 2 = 1 and cell_id != 9").groupBy("barcode", "cell_id").agg(F.count("*").alias("count"))
    return donor, recipient


@query("decontamination_step", f"""WITH {_PAIRS}, s AS (SELECT barcode, sum(n) AS donor_total, count(DISTINCT cell_id) AS ids FROM dn GROUP BY 1),
 w AS (SELECT r.barcode, r.cell_id, r.n, coalesce(dn.n, 0) AS donor_count, coalesce(donor_total, 0) AS donor_total, coalesce(ids, 0) AS ids FROM r LEFT JOIN dn ON dn.barcode = r.barcode AND dn.cell_id = r.cell_id LEFT JOIN s ON s.barcode = r.barcode),
 v AS (SELECT *, ids + sum(CAST(donor_count = 0 AS INT)) OVER (PARTITION BY barcode) AS support, CASE WHEN n > 2000 THEN 0 ELSE n END AS clean FROM w),
 x AS (SELECT *, sum(clean) OVER (PARTITION BY barcode) AS total, (donor_count + 0.5) / (donor_total + 0.5 * support) AS p FROM v)
 SELECT barcode, cell_id, n AS recipient_count, round(total * p, 6) AS expected, round((clean + 0.5) / (total * p + 0.5), 6) AS enrichment, n <= 2000 AND total >= 10 AND ids >= 10 AND donor_total > 0 AND clean >= 100 AND clean - total * p >= 100 AND (clean + 0.5) / (total * p + 0.5) >= 5 AS candidate FROM x""")
def decontamination_step(spark, d):
    rows = iterate.decontamination_candidates(iterate.decontamination_input(*_pairs(spark, d)))
    return rows.select("barcode", "cell_id", "recipient_count", F.round("expected", 6).alias("expected"), F.round("enrichment", 6).alias("enrichment"), "candidate")


@query("decontamination")
def decontamination(spark, d):
    """All rounds with tail probabilities and adjustment (ITER-02, Q-43)."""
    rows, rho, rounds = iterate.decontaminate(*_pairs(spark, d))
    return rows.select("barcode", "cell_id", "recipient_count", "clean_count", "removed_count", "p_value", "q_value", "flagged", "last_flag_round", F.lit(rho).alias("rho"), F.lit(rounds).alias("rounds"))


def _cells(spark, d):
    e = table(spark, d, "events")
    bc = F.substring(dna(F.col("event_id") % 25), 1, 8)
    typo = F.concat(F.substring(bc, 1, 7), F.when(F.substring(bc, 8, 1) == "A", "C").otherwise("A"))
    return e.select(
        F.col("user_id").cast("string").alias("cell"), F.when(F.col("event_id") % 9 == 0, typo).otherwise(bc).alias("barcode"), F.substring(dna(F.col("event_id")), 1, 10).alias("umi"),
        F.lit(3).cast("long").alias("reads"), F.col("event_type").alias("feature"), F.concat(F.lit("i"), (F.col("event_id") % 25 % 3).cast("string")).alias("identity"),
    )


@query("barcode_correction")
def barcode_correction(spark, d):
    """Corrected barcode counts of each cell (ITER-03, Q-15)."""
    return iterate.correct_barcodes(_cells(spark, d), 8)[0]


@query("barcode_correction_events")
def barcode_correction_events(spark, d):
    return iterate.correct_barcodes(_cells(spark, d), 8)[1]


_READ_GENES = """b AS (SELECT l_orderkey AS id, l_linenumber AS line, CAST(l_suppkey % 5 AS VARCHAR) AS chrom, CAST(l_partkey * 37 % 60000 AS INT) AS s, CAST(l_partkey * 37 % 60000 + l_quantity * 20 AS INT) AS e FROM lineitem), f AS (SELECT CAST(p_partkey % 5 AS VARCHAR) AS chrom, CAST(p_partkey * 101 % 60000 AS INT) AS s, CAST(p_partkey * 101 % 60000 + 40 + p_size AS INT) AS e, p_partkey AS gene FROM part),
 h AS (SELECT DISTINCT b.id, b.line, b.chrom, b.s, gene FROM b LEFT JOIN f ON b.chrom = f.chrom AND f.s < b.e AND f.e > b.s AND b.e > b.s), g AS (SELECT id, line, chrom, s, count(gene) AS n, min(gene) AS gene FROM h GROUP BY 1, 2, 3, 4)"""


def _read_genes(spark, d):
    li, part = table(spark, d, "lineitem"), table(spark, d, "part")
    at = F.col("l_partkey") * 37 % 60000
    blocks = li.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), (F.col("l_suppkey") % 5).cast("string").alias("chrom"), at.cast("int").alias("start"), (at + F.col("l_quantity") * 20).cast("int").alias("end")).withColumn("at", F.col("start"))
    p = F.col("p_partkey") * 101 % 60000
    genes = part.select((F.col("p_partkey") % 5).cast("string").alias("chrom"), p.cast("int").alias("start"), (p + 40 + F.col("p_size")).cast("int").alias("end"), F.col("p_partkey").alias("gene"))
    return match.overlaps(blocks, genes, ["id", "line", "chrom", "at"], "gene", bin_size=1024)


@query("interval_overlap_count", f"WITH {_READ_GENES} SELECT CASE WHEN n = 1 THEN gene END AS gene, count(*) AS reads FROM g WHERE n > 0 GROUP BY 1")
def interval_overlap_count(spark, d):
    """Reads of each gene that is alone under them; ambiguous reads under NULL (MAT-11)."""
    return _read_genes(spark, d).where("status != 'no_feature'").groupBy("gene").agg(F.count("*").alias("reads"))


@query("overlap_funnel", f"WITH {_READ_GENES} SELECT chrom, count(*) AS records, count(*) FILTER (n = 1) AS counted, count(*) FILTER (n = 0) AS no_feature, count(*) FILTER (n > 1) AS ambiguous FROM g GROUP BY 1")
def overlap_funnel(spark, d):
    """What became of the reads of each sample (Q-57)."""
    is_ = lambda s: F.count_if(F.col("status") == s).alias(s)
    return _read_genes(spark, d).groupBy("chrom").agg(F.count("*").alias("records"), is_("counted"), is_("no_feature"), is_("ambiguous"))


@query("interval_merge", """WITH v AS (SELECT o_custkey AS cust, CAST(date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS INT) AS s, CAST(date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) + 90 AS INT) AS e FROM orders), m AS (SELECT *, max(e) OVER (PARTITION BY cust ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM v),
 i AS (SELECT *, sum(CASE WHEN before IS NULL OR s > before THEN 1 ELSE 0 END) OVER (PARTITION BY cust ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM m) SELECT cust, min(s) AS start, max(e) AS "end", count(*) AS n FROM i GROUP BY cust, i""")
def interval_merge(spark, d):
    day = F.datediff("o_orderdate", F.lit("1990-01-01").cast("date"))
    return agg.merged_intervals(table(spark, d, "orders").select(F.col("o_custkey").alias("cust"), day.alias("start"), (day + 90).alias("end")), ["cust"])


@query("cigar_blocks", """WITH c AS (SELECT event_id AS id, CAST(event_id % 100 AS INT) AS pos, CAST(10 + event_id % 5 AS INT) AS m1, CAST(event_id % 50 AS INT) AS n, CAST(7 + event_id % 3 AS INT) AS m2 FROM events) SELECT id, pos AS start, pos + m1 AS "end" FROM c UNION ALL SELECT id, pos + m1 + n, pos + m1 + n + m2 FROM c""")
def cigar_blocks(spark, d):
    e = F.col("event_id")
    op = lambda o, n: F.struct(F.lit(o).alias("op"), n.cast("int").alias("len"))
    cigar = F.array(op("S", F.lit(5)), op("M", 10 + e % 5), op("N", e % 50), op("I", F.lit(3)), op("=", 7 + e % 3))
    rows = table(spark, d, "events").select(e.alias("id"), F.explode(seq.aligned_blocks(e % 100, cigar)).alias("b"))
    return rows.select("id", "b.start", "b.end")


_FORMS = [(name, form) for name, barcode in (("green", "ACGTAC"), ("scarlet", "TTGCAA")) for form in (f"GGAGT{barcode}TCGGC", f"GGAGT{barcode}TCGGC"[::-1].translate(str.maketrans("ACGT", "TGCA")))]


@query("approximate_context_match", f"""WITH s AS (SELECT {_DNA.format('user_id')} || CASE event_id % 3 WHEN 0 THEN 'GGAGTACGTACTCGGC' WHEN 1 THEN 'GGAGTTTGCAATCGG' ELSE 'AAAA' END || {_DNA.format('event_id % 9')} AS seq, count(*) AS n FROM events GROUP BY 1), f(grp, form) AS (VALUES {', '.join(str(x) for x in _FORMS)}),
 w AS (SELECT seq, grp, min(levenshtein(seq[i:i + len - 1], form)) AS d FROM s, f, unnest(range(1, length(seq) + 1)) AS t(i), unnest([15, 16, 17]) AS u(len) WHERE i + len - 1 <= length(seq) GROUP BY 1, 2), b AS (SELECT seq, grp FROM (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY d, grp) AS k FROM w WHERE d <= 1) WHERE k = 1)
 SELECT grp, CAST(sum(n) AS BIGINT) AS reads, round(sum(n) / CAST(sum(sum(n)) OVER () AS DOUBLE), 6) AS proportion FROM s LEFT JOIN b USING (seq) GROUP BY 1""")
def approximate_context_match(spark, d):
    """Group whose context a read matches best within one edit (MAT-09, Q-54)."""
    e = table(spark, d, "events").select("event_id", F.concat(dna(F.col("user_id")), F.when(F.col("event_id") % 3 == 0, "GGAGTACGTACTCGGC").when(F.col("event_id") % 3 == 1, "GGAGTTTGCAATCGG").otherwise("AAAA"), dna(F.col("event_id") % 9)).alias("seq"))
    hit = match.best_context(F.col("seq"), {"green": ["ACGTAC"], "scarlet": ["TTGCAA"]})
    counts = e.select(hit.alias("grp")).groupBy("grp").agg(F.count("*").alias("reads"))
    return counts.withColumn("proportion", F.round(F.col("reads") / F.sum("reads").over(agg.Window.partitionBy()), 6))


@query("approximate_occurrences")
def approximate_occurrences(spark, d):
    """Occurrences of a barcode within one edit (MAT-10)."""
    return _reads(spark, d).select("user_id", match.approximate_count(F.col("seq"), "ACGTACGT").alias("n")).groupBy("user_id").agg(F.sum("n").alias("n"))


@query("sample_names", """SELECT event_type || CASE WHEN n > 1 THEN '__' || n ELSE '' END AS sample, file FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY file) AS n FROM (SELECT DISTINCT event_type, 'run/' || event_type || '_' || CAST(user_id % 3 AS VARCHAR) || '.fastq.gz' AS file FROM events))""")
def sample_names(spark, d):
    files = table(spark, d, "events").select(F.concat(F.lit("run/"), "event_type", F.lit("_"), (F.col("user_id") % 3).cast("string"), F.lit(".fastq.gz")).alias("file")).distinct()
    base = seq.without(seq.sample_name(F.col("file")), r"_\d+$")
    n = F.row_number().over(agg.Window.partitionBy("base").orderBy("file"))
    return files.withColumn("base", base).withColumn("n", n).select(F.concat("base", F.when(F.col("n") > 1, F.concat(F.lit("__"), F.col("n").cast("string"))).otherwise("")).alias("sample"), "file")
