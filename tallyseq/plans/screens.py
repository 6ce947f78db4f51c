"""Pooled screens and count contrasts: lookups, hits, tiers, programs, volcano tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import columns, seq, special
from ..operators import annotate, ranks, stats
from ..session import table
from .catalog import query
from .counts import r

_SCREEN = """s AS (SELECT p_brand || '_' || CAST(p_size AS VARCHAR) AS gene, CAST(count(*) AS DOUBLE) AS n, avg(p_retailprice) AS m, (CAST(min(p_partkey) AS BIGINT) * 7919 % 1000) / 4000.0 AS b_pos, (CAST(min(p_partkey) AS BIGINT) * 104729 % 1000) / 4000.0 AS b_neg,
 (CAST(max(p_partkey) AS BIGINT) * 7919 % 1000) / 4000.0 AS c_pos, (CAST(max(p_partkey) AS BIGINT) * 104729 % 1000) / 4000.0 AS c_neg, (CAST(min(p_partkey) AS BIGINT) * 31 % 400) / 100.0 - 2 AS b_lfc, (CAST(max(p_partkey) AS BIGINT) * 31 % 400) / 100.0 - 2 AS c_lfc FROM part GROUP BY 1)"""


def _screen(spark, d):
    lo, hi = F.min("p_partkey"), F.max("p_partkey")
    part = table(spark, d, "part").groupBy(F.concat("p_brand", F.lit("_"), F.col("p_size").cast("string")).alias("gene"))
    return part.agg(
        (lo * 7919 % 1000 / 4000.0).alias("b_pos_fdr"), (lo * 104729 % 1000 / 4000.0).alias("b_neg_fdr"), (hi * 7919 % 1000 / 4000.0).alias("c_pos_fdr"), (hi * 104729 % 1000 / 4000.0).alias("c_neg_fdr"),
        (lo * 31 % 400 / 100.0 - 2).alias("b_lfc"), (hi * 31 % 400 / 100.0 - 2).alias("c_lfc"),
    )


@query("directional_fdr", f"WITH {_SCREEN} SELECT gene, round(CASE WHEN b_lfc > 0 THEN b_pos ELSE b_neg END, 6) AS b_fdr, round(greatest(CASE WHEN b_lfc > 0 THEN b_pos ELSE b_neg END, CASE WHEN c_lfc > 0 THEN c_pos ELSE c_neg END), 6) AS rra_maxfdr FROM s")
def directional_fdr(spark, d):
    b = columns.directional(F.col("b_lfc"), F.col("b_pos_fdr"), F.col("b_neg_fdr"))
    c = columns.directional(F.col("c_lfc"), F.col("c_pos_fdr"), F.col("c_neg_fdr"))
    return _screen(spark, d).select("gene", r(b, "b_fdr"), r(F.greatest(b, c), "rra_maxfdr"))


@query("tier_assignment", f"WITH {_SCREEN}, x AS (SELECT gene, greatest(CASE WHEN b_lfc > 0 THEN b_pos ELSE b_neg END, CASE WHEN c_lfc > 0 THEN c_pos ELSE c_neg END) AS f FROM s) SELECT gene, round(f, 6) AS rra_maxfdr, CASE WHEN f <= 0.05 THEN 'T1-core' WHEN f >= 0.05 AND f <= 0.1 THEN 'T2-nearmiss-RRA' ELSE 'untiered' END AS tier FROM x")
def tier_assignment(spark, d):
    f = directional_fdr(spark, d)
    return f.select("gene", "rra_maxfdr", columns.tier(F.col("rra_maxfdr"), annotate.TIERS).alias("tier"))


#: A row for each part: genes of several rows, folds of either sign whatever z is, a renamed pair, controls, and missing FDRs.
_ROWS = """p AS (SELECT CASE WHEN p_size % 11 = 1 THEN 'WRB' WHEN p_size % 11 = 2 THEN 'GET1' WHEN p_size % 11 = 3 THEN 'NTC_' || p_size ELSE p_brand || '_' || CAST(p_size AS VARCHAR) || '_' || CAST(p_partkey % 3 AS VARCHAR) END AS gene, CAST(p_partkey AS BIGINT) AS k FROM part),
 m AS (SELECT gene, ((k * 53 % 1009) - 504) / 100.0 AS mle_z, ((k * 59 % 1009) - 504) / 500.0 AS mle_beta, (k * 61 % 1009) / 2000.0 AS mle_fdr, ((k * 31 % 401) - 200) / 100.0 AS b_lfc, ((k * 31 % 401 + k * 7 % 31) - 215) / 100.0 AS c_lfc,
  CASE WHEN k % 17 > 0 THEN (k * 7919 % 1000) / 6000.0 END AS b_pos, (k * 104729 % 1000) / 6000.0 AS b_neg, (k * 6007 % 1000) / 6000.0 AS c_pos, CASE WHEN k % 13 > 0 THEN (k * 7001 % 1000) / 6000.0 END AS c_neg FROM p),
 x AS (SELECT *, coalesce(greatest(CASE WHEN b_lfc > 0 THEN b_pos ELSE b_neg END, CASE WHEN c_lfc > 0 THEN c_pos ELSE c_neg END), CASE WHEN b_lfc > 0 THEN b_pos ELSE b_neg END, CASE WHEN c_lfc > 0 THEN c_pos ELSE c_neg END) AS f FROM m),
 b AS (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY abs(mle_z) DESC, f NULLS LAST, mle_z, b_lfc, c_lfc) AS place FROM x)"""


def _rows(spark, d):
    k, size = F.col("p_partkey").cast("long"), F.col("p_size")
    gene = F.when(size % 11 == 1, "WRB").when(size % 11 == 2, "GET1").when(size % 11 == 3, F.concat(F.lit("NTC_"), size)).otherwise(F.concat_ws("_", "p_brand", size, k % 3))
    fdr = lambda factor: k * factor % 1000 / 6000.0
    return table(spark, d, "part").select(
        gene.alias("gene"), ((k * 53 % 1009 - 504) / 100.0).alias("mle_z"), ((k * 59 % 1009 - 504) / 500.0).alias("mle_beta"), (k * 61 % 1009 / 2000.0).alias("mle_fdr"), ((k * 31 % 401 - 200) / 100.0).alias("b_lfc"), ((k * 31 % 401 + k * 7 % 31 - 215) / 100.0).alias("c_lfc"),
        F.when(k % 17 > 0, fdr(7919)).alias("b_pos_fdr"), fdr(104729).alias("b_neg_fdr"), fdr(6007).alias("c_pos_fdr"), F.when(k % 13 > 0, fdr(7001)).alias("c_neg_fdr"),
    )


@query("screen_hits", f"""WITH {_ROWS} SELECT gene, round(mle_z, 6) AS mle_z, round(f, 6) AS rra_maxfdr, CASE WHEN f <= 0.05 THEN 'T1-core' ELSE 'T2-nearmiss-RRA' END AS tier FROM b
 WHERE place = 1 AND NOT starts_with(gene, 'NTC') AND f <= 0.1 AND ((b_lfc <= -0.25 AND c_lfc <= -0.25) OR (b_lfc >= 0.5 AND c_lfc >= 0.5))""")
def screen_hits(spark, d):
    hits = annotate.call_hits(_rows(spark, d))
    return hits.select("gene", r(F.col("mle_z"), "mle_z"), r(F.col("rra_maxfdr"), "rra_maxfdr"), "tier")


@query("screen_hits_directed", f"""WITH {_ROWS} SELECT gene, round(mle_beta, 6) AS mle_beta, round(abs(mle_z), 6) AS absz, round(mle_fdr, 6) AS mle_fdr, CASE WHEN coalesce(f, 0) <= 0.05 THEN 'T1-core' ELSE 'T2-nearmiss-RRA' END AS tier FROM b
 WHERE place = 1 AND coalesce(f, 0) <= 0.1 AND mle_beta < 0 AND b_lfc < 0 AND c_lfc < 0 AND abs(mle_z) >= 0.5 AND mle_fdr <= 0.4""")
def screen_hits_directed(spark, d):
    """Depleted genes by every bound that hits can have; the tiers alone bound the FDR (Q-48)."""
    hits = annotate.call_hits(_rows(spark, d), "Depletion", min_absz=0.5, max_mle_fdr=0.4, max_rra_fdr=None, max_neg_lfc=None, drop_ntc=False)
    return hits.select("gene", r(F.col("mle_beta"), "mle_beta"), r(F.col("absz"), "absz"), r(F.col("mle_fdr"), "mle_fdr"), "tier")


@query("sequential_hit_tables", f"WITH {_SCREEN} SELECT 'neg' AS side, gene FROM s WHERE b_neg < 0.05 AND c_neg < 0.05 AND b_lfc > -0.25 UNION ALL SELECT 'pos', gene FROM s WHERE b_pos < 0.05 AND c_pos < 0.05 AND b_lfc > -0.25")
def sequential_hit_tables(spark, d):
    s = _screen(spark, d).where("b_lfc > -0.25")
    side = lambda n: s.where((F.col(f"b_{n}_fdr") < 0.05) & (F.col(f"c_{n}_fdr") < 0.05)).select(F.lit(n).alias("side"), "gene")
    return side("neg").unionByName(side("pos"))


RULES = [("ring", ["ring$"]), ("economy", ["^ECONOMY"]), ("ring", ["small|tiny"]), ("plated", ["PLATED|COPPER"])]


@query("rule_classifier", """SELECT p_partkey, CASE WHEN regexp_matches(p_type || ' ' || p_name, 'ring$') THEN 'ring' WHEN regexp_matches(p_type || ' ' || p_name, '^ECONOMY') THEN 'economy' WHEN regexp_matches(p_type || ' ' || p_name, 'small|tiny') THEN 'ring' WHEN regexp_matches(p_type || ' ' || p_name, 'PLATED|COPPER') THEN 'plated' ELSE 'Other / unclear' END AS program FROM part""")
def rule_classifier(spark, d):
    return table(spark, d, "part").select("p_partkey", columns.classified(F.concat_ws(" ", "p_type", "p_name"), RULES, annotate.UNCLEAR).alias("program"))


#: Annotation texts that stand after the conversations' own, by turn of their number; the last fits no rule.
PHRASES = [
    "exocyst complex", "antigen processing", "TRAPP III", "protein neddylation", "GPI anchor synthesis", "E3 ubiquitin ligase", "spectrin binding", "sodium/proton antiport", "cell polarity", "COPII coat", "SNARE binding",
    "mitophagy", "tail-anchored protein", "early endosome recycling", "phospholipid translocation", "apoptotic cell clearance", "cell-cell adhesion", "aquaporin", "cortical actin", "interleukin 2 and exocytosis",
    "mRNA splicing of snRNP", "histone and mitochondrial", "NADH oxidation", "nothing of note",
]


def _program_sql(text: str) -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    cases = " ".join(f"WHEN {' OR '.join(f'regexp_matches(lower({text}), {quoted(p)})' for p in patterns)} THEN {quoted(name)}" for name, patterns in annotate.PROGRAM_RULES)
    return f"regexp_replace(CASE {cases} ELSE {quoted(annotate.UNCLEAR)} END, ' \\((identity|endo)\\)$', '')"


@query("program_of_annotation", f"""WITH t AS (SELECT conv_id, turn, coalesce(text, '') || ' ' || (ARRAY{PHRASES})[1 + (conv_id * 7 + turn) % {len(PHRASES)}] AS text FROM conversations) SELECT conv_id, turn, {_program_sql('text')} AS program FROM t""")
def program_of_annotation(spark, d):
    """The fixed program rules, in order, over conversations and annotation texts (Q-48)."""
    phrase = F.element_at(F.array(*map(F.lit, PHRASES)), ((F.col("conv_id") * 7 + F.col("turn")) % len(PHRASES) + 1).cast("int"))
    text = F.concat(F.coalesce("text", F.lit("")), F.lit(" "), phrase)
    return table(spark, d, "conversations").select("conv_id", "turn", annotate.program(text).alias("program"))


@query("coalesced_lookup", """WITH a AS (SELECT n_name AS k, n_nationkey AS v FROM nation WHERE n_nationkey % 3 = 0), b AS (SELECT 'NATION_' || n_nationkey AS k, n_nationkey + 100 AS v FROM nation WHERE n_nationkey % 2 = 0), c AS (SELECT n_name AS k, min(n_nationkey) + 200 AS v FROM nation GROUP BY 1)
 SELECT s_suppkey, coalesce(a.v, b.v, c.v) AS id FROM supplier JOIN nation ON n_nationkey = s_nationkey LEFT JOIN a ON a.k = n_name LEFT JOIN b ON b.k = n_name LEFT JOIN c ON c.k = n_name""")
def coalesced_lookup(spark, d):
    n = table(spark, d, "nation")
    named = table(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")
    a = n.where("n_nationkey % 3 = 0").select(F.col("n_name").alias("k"), F.col("n_nationkey").alias("v"))
    b = n.where("n_nationkey % 2 = 0").select(F.concat(F.lit("NATION_"), F.col("n_nationkey").cast("string")).alias("k"), (F.col("n_nationkey") + 100).alias("v"))
    c = n.select(F.col("n_name").alias("k"), (F.col("n_nationkey") + 200).alias("v"))
    return annotate.looked_up(named, "n_name", [(a, "k", "v"), (b, "k", "v"), (c, "k", "v")], "id").select("s_suppkey", "id")


@query("json_annotation_blob", """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_type || ':' || json_extract_string(props, '$.k') AS label FROM events""")
def json_annotation_blob(spark, d):
    e = table(spark, d, "events").withColumn("p", F.from_json("props", "k long"))
    return e.select("event_id", F.col("p.k").alias("k"), F.concat_ws(":", "event_type", F.col("p.k").cast("string")).alias("label"))


@query("gene_transcript_split", """WITH v AS (SELECT p_partkey, CASE WHEN p_size = 1 THEN 'NTC_1' ELSE replace(p_name, ' ', '_') END AS g FROM part) SELECT p_partkey, CASE WHEN starts_with(g, 'NTC') OR NOT contains(g, '_') THEN g ELSE split_part(g, '_', 1) END AS gene, CASE WHEN starts_with(g, 'NTC') OR NOT contains(g, '_') THEN NULL ELSE regexp_replace(g, '^[^_]*_', '') END AS transcript FROM v""")
def gene_transcript_split(spark, d):
    g = F.when(F.col("p_size") == 1, "NTC_1").otherwise(F.translate("p_name", " ", "_"))
    gene, transcript = seq.gene_and_transcript(F.col("g"))
    return table(spark, d, "part").withColumn("g", g).select("p_partkey", gene.alias("gene"), transcript.alias("transcript"))


_VOLCANO = """w AS (SELECT l_partkey AS gene, count(*) FILTER (l_returnflag = 'A') AS ref, count(*) FILTER (l_returnflag = 'R') AS test FROM lineitem GROUP BY 1), l AS (SELECT CAST(sum(ref) AS DOUBLE) AS lr, CAST(sum(test) AS DOUBLE) AS lt FROM w),
 v AS (SELECT gene, ref, test, 1e6 * ref / lr AS ref_cpm, 1e6 * test / lt AS test_cpm FROM w, l WHERE ref + test >= 15)"""


@query("volcano_counts", f"WITH {_VOLCANO} SELECT gene, ref AS reference_count, test AS test_count, round(ref_cpm, 6) AS reference_cpm, round(test_cpm, 6) AS test_cpm, round(log2((test_cpm + 0.5) / (ref_cpm + 0.5)), 6) AS log2_fc, abs(log2((test_cpm + 0.5) / (ref_cpm + 0.5))) >= 1 AS large FROM v")
def volcano_counts(spark, d):
    return _volcano(spark, d).select("gene", "reference_count", "test_count", r(F.col("reference_cpm"), "reference_cpm"), r(F.col("test_cpm"), "test_cpm"), r(F.col("log2_fc"), "log2_fc"), (F.abs("log2_fc") >= 1).alias("large"))


def _volcano(spark, d):
    w = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("gene")).agg(F.count_if(F.col("l_returnflag") == "A").alias("reference_count"), F.count_if(F.col("l_returnflag") == "R").alias("test_count"))
    libs = F.broadcast(w.agg(F.sum("reference_count").alias("lr"), F.sum("test_count").alias("lt")))
    v = w.crossJoin(libs).where("reference_count + test_count >= 15")
    v = v.withColumns({"reference_cpm": stats.cpm(F.col("reference_count"), F.col("lr")), "test_cpm": stats.cpm(F.col("test_count"), F.col("lt"))})
    return v.withColumn("log2_fc", stats.log2fc(F.col("test_cpm"), F.col("reference_cpm"), 0.5))


_FISHER = f"""{_VOLCANO}, k AS (SELECT *, test AS a, lt - test AS b, ref AS c, lr - ref AS d, unnest(range(0, CAST(test + ref AS BIGINT) + 1)) AS k FROM v, l),
 lp AS (SELECT *, lgamma(lt + 1) - lgamma(k + 1) - lgamma(lt - k + 1) + lgamma(lr + 1) - lgamma(a + c - k + 1) - lgamma(lr - (a + c - k) + 1) AS lp, lgamma(lt + 1) - lgamma(a + 1) - lgamma(b + 1) + lgamma(lr + 1) - lgamma(c + 1) - lgamma(d + 1) AS l0, lgamma(lt + lr + 1) - lgamma(a + c + 1) - lgamma(b + d + 1) AS la FROM k WHERE k <= lt AND a + c - k <= lr),
 f AS (SELECT gene, ref, test, any_value(ref_cpm) AS ref_cpm, any_value(test_cpm) AS test_cpm, least(sum(exp(lp - la)) FILTER (lp <= l0 + 1e-7), 1) AS p FROM lp GROUP BY 1, 2, 3),
 r AS (SELECT *, p * (count(*) OVER ()) / row_number() OVER (ORDER BY p, gene) AS raw FROM f), q AS (SELECT *, least(min(raw) OVER (ORDER BY p DESC, gene DESC ROWS UNBOUNDED PRECEDING), 1) AS fdr, log2((test_cpm + 0.5) / (ref_cpm + 0.5)) AS lfc FROM r)"""


@query("volcano", f"WITH {_FISHER} SELECT gene, ref AS reference_count, test AS test_count, round(lfc, 6) AS log2_fc, round(p, 6) AS pvalue, round(fdr, 6) AS fdr, round(-log10(greatest(fdr, 1e-300)), 5) AS neg_log10_fdr, fdr < 0.05 AND abs(lfc) >= 1 AS significant FROM q")
def volcano(spark, d):
    """With Fisher's exact test, adjustment and the significance flag (Q-58)."""
    v = _volcano(spark, d)
    p = special.fisher_udf()("test_count", F.col("lt") - F.col("test_count"), "reference_count", F.col("lr") - F.col("reference_count"))
    v = stats.benjamini_hochberg(v.withColumn("pvalue", p), "pvalue", "fdr")
    significant = (F.col("fdr") < 0.05) & (F.abs("log2_fc") >= 1)
    high = F.round(-F.log10(F.greatest("fdr", F.lit(1e-300))), 5).alias("neg_log10_fdr")
    return v.select("gene", "reference_count", "test_count", r(F.col("log2_fc"), "log2_fc"), r(F.col("pvalue"), "pvalue"), r(F.col("fdr"), "fdr"), high, significant.alias("significant"))


@query("program_enrichment", """WITH b AS (SELECT p_brand AS program, p_retailprice AS x FROM part), k AS (SELECT x, count(*) AS t FROM b GROUP BY 1), rk AS (SELECT x, coalesce(sum(t) OVER (ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (t + 1) / 2.0 AS rank FROM k), n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM b)
 SELECT program, count(*) AS n_in, round(sum(rank) - count(*) * (count(*) + 1) / 2.0, 3) AS u, round(2 * (sum(rank) - count(*) * (count(*) + 1) / 2.0) / (count(*) * (max(n) - count(*))) - 1, 6) AS rank_biserial FROM b JOIN rk USING (x), n GROUP BY 1""")
def program_enrichment(spark, d):
    """Each program's genes against all others: one ranking serves all programs (ST-29)."""
    b = table(spark, d, "part").select(F.col("p_brand").alias("program"), F.col("p_retailprice").alias("x"), F.lit(1).alias("all"))
    ranked = ranks.average_rank(b, "x", ["all"])
    n = F.broadcast(b.agg(F.count("*").alias("n")))
    s = ranked.groupBy("program").agg(F.count("*").alias("n_in"), F.sum("rank").alias("s")).crossJoin(n)
    u = F.col("s") - F.col("n_in") * (F.col("n_in") + 1) / 2
    return s.select("program", "n_in", F.round(u, 3).alias("u"), r(2 * u / (F.col("n_in") * (F.col("n") - F.col("n_in"))) - 1, "rank_biserial"))


@query("lfc_quantiles_before_after", """WITH v AS (SELECT l_suppkey AS id, CAST(count(*) AS DOUBLE) AS raw, CAST(count(*) FILTER (l_quantity <= 45) AS DOUBLE) AS clean, CAST(count(*) FILTER (l_returnflag = 'N') AS DOUBLE) AS ref FROM lineitem GROUP BY 1), t AS (SELECT sum(raw) AS r, sum(clean) AS c, sum(ref) AS f, count(*) AS n FROM v),
 x AS (SELECT 'before' AS stage, log2((raw + 0.5) / (r + 0.5 * n) / ((ref + 0.5) / (f + 0.5 * n))) AS lfc FROM v, t UNION ALL SELECT 'after', log2((clean + 0.5) / (c + 0.5 * n) / ((ref + 0.5) / (f + 0.5 * n))) FROM v, t)
 SELECT stage, round(quantile_cont(lfc, 0.05), 6) AS p05, round(quantile_cont(lfc, 0.5), 6) AS p50, round(quantile_cont(lfc, 0.95), 6) AS p95 FROM x GROUP BY 1""")
def lfc_quantiles_before_after(spark, d):
    v = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(F.count("*").alias("before"), F.count_if(F.col("l_quantity") <= 45).alias("after"), F.count_if(F.col("l_returnflag") == "N").alias("ref"))
    t = F.broadcast(v.agg(F.sum("before").alias("t_before"), F.sum("after").alias("t_after"), F.sum("ref").alias("t_ref"), F.count("*").alias("n")))
    x = v.crossJoin(t)
    ref = stats.cpm(F.col("ref"), F.col("t_ref"), 0.5, F.col("n"))
    long = x.select(F.explode(F.array(*[F.struct(F.lit(s).alias("stage"), F.log2(stats.cpm(F.col(s), F.col(f"t_{s}"), 0.5, F.col("n")) / ref).alias("lfc")) for s in ("before", "after")])).alias("z")).select("z.*")
    q = lambda p, name: r(F.percentile("lfc", F.lit(p)), name)
    return long.groupBy("stage").agg(q(0.05, "p05"), q(0.5, "p50"), q(0.95, "p95"))


@query("replicate_means", """WITH w AS (SELECT user_id, avg(value) FILTER (event_type = 'click') AS a, avg(value) FILTER (event_type = 'view') AS b, avg(value) FILTER (event_type = 'error' AND user_id % 2 = 0) AS c FROM events GROUP BY 1) SELECT user_id, round((coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0)) / (CAST(a IS NOT NULL AS INT) + CAST(b IS NOT NULL AS INT) + CAST(c IS NOT NULL AS INT)), 6) AS mean FROM w""")
def replicate_means(spark, d):
    at = lambda t, more=F.lit(True): F.avg(F.when((F.col("event_type") == t) & more, F.col("value")))
    w = table(spark, d, "events").groupBy("user_id").agg(at("click").alias("a"), at("view").alias("b"), at("error", F.col("user_id") % 2 == 0).alias("c"))
    return w.select("user_id", r(columns.row_mean(F.col("a"), F.col("b"), F.col("c")), "mean"))


@query("signed_rank_score", """WITH v AS (SELECT c_custkey, c_acctbal, ((c_custkey * 7919) % 1000) / 1000.0 AS p FROM customer) SELECT c_custkey, round(sign(c_acctbal) * -log10(greatest(coalesce(nullif(p, 0), 1), 1e-300)), 6) AS score FROM v""")
def signed_rank_score(spark, d):
    p = F.nullif(F.col("c_custkey") * 7919 % 1000 / 1000.0, F.lit(0.0))
    return table(spark, d, "customer").select("c_custkey", r(stats.signed_score(F.col("c_acctbal"), p), "score"))


@query("umi_per_id_summary", """WITH k AS (SELECT l_partkey, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1) SELECT count(*) AS ids, round(quantile_cont(CAST(n AS DOUBLE), 0.5), 6) AS median, round(avg(n), 6) AS mean, max(n) AS most, round(quantile_cont(CAST(n AS DOUBLE), 0.999), 6) AS p999 FROM k""")
def umi_per_id_summary(spark, d):
    k = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count_distinct("l_orderkey").alias("n"))
    return k.agg(F.count("*").alias("ids"), r(F.percentile("n", F.lit(0.5)), "median"), r(F.avg("n"), "mean"), F.max("n").alias("most"), r(F.percentile("n", F.lit(0.999)), "p999"))


@query("categorical_order", """SELECT l_returnflag, CASE l_returnflag WHEN 'N' THEN 0 WHEN 'R' THEN 1 ELSE 2 END AS place, count(*) AS n FROM lineitem WHERE l_returnflag IN ('N', 'R', 'A') GROUP BY 1, 2""")
def categorical_order(spark, d):
    order = F.array_position(F.array(*map(F.lit, ["N", "R", "A"])), F.col("l_returnflag")) - 1
    counts = table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"))
    return counts.select("l_returnflag", order.cast("int").alias("place"), "n").where("place >= 0").orderBy("place")


@query("cross_first_seen_order", """WITH f AS (SELECT event_type, min(event_id) AS seen FROM events GROUP BY 1) SELECT event_type, CAST(row_number() OVER (ORDER BY CASE WHEN event_type = 'signup' THEN 0 ELSE 1 END, seen) AS INT) AS place FROM f""")
def cross_first_seen_order(spark, d):
    """Order of first sight, with pinned names in front (SRT-05)."""
    f = table(spark, d, "events").groupBy("event_type").agg(F.min("event_id").alias("at"))
    return f.select("event_type", F.row_number().over(Window.orderBy(F.col("event_type") != "signup", "at")).alias("place"))
