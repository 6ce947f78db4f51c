"""Count tables and statistics: library equalisation, fold changes, adjustment, ranks, robust lines, grids."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import columns, special
from ..operators import aggregate as agg
from ..operators import annotate, ranks, stats
from ..operators.lineage import settle
from ..operators.match import small
from ..session import table
from .catalog import query

R = 6


def r(c, name: str):
    return F.round(c, R).alias(name)


def _type_counts(spark, d):
    """Counts of each user by event type: barcodes by sample, with 'view' as the reference pool."""
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


def _equalised(spark, d):
    counts = _type_counts(spark, d)
    ref = counts.where("event_type = 'view'").select("user_id", F.col("n").alias("k"))
    tests = counts.where("event_type != 'view'")
    total = tests.groupBy("event_type").agg(F.sum("n").alias("j_total"))
    k_total = ref.agg(F.sum("k").alias("k_total"))
    rows = tests.join(F.broadcast(total), "event_type").crossJoin(F.broadcast(k_total)).join(ref, "user_id", "left").na.fill(0, ["k"])
    norm = F.col("n") * F.col("k_total") / F.col("j_total")
    return rows.withColumn("norm", norm).withColumn("lfc", stats.log2fc(F.col("norm"), F.col("k"), 0.5))


_EQ = """
c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2),
k AS (SELECT user_id, n AS k FROM c WHERE event_type = 'view'),
t AS (SELECT event_type, sum(n) AS j_total FROM c WHERE event_type <> 'view' GROUP BY 1),
e AS (SELECT c.user_id, c.event_type, c.n, coalesce(k.k, 0) AS k, CAST(c.n AS DOUBLE) * (SELECT sum(k) FROM k) / t.j_total AS norm
      FROM c JOIN t USING (event_type) LEFT JOIN k USING (user_id) WHERE c.event_type <> 'view'),
l AS (SELECT *, log2((norm + 0.5) / (k + 0.5)) AS lfc FROM e)
"""


@query("equalized_log2fc", f"WITH {_EQ} SELECT user_id, event_type, CAST(n AS BIGINT) AS n, CAST(k AS BIGINT) AS k, round(norm, 6) AS norm, round(lfc, 6) AS lfc FROM l")
def equalized_log2fc(spark, d):
    return _equalised(spark, d).select("user_id", "event_type", "n", "k", r(F.col("norm"), "norm"), r(F.col("lfc"), "lfc"))


@query("group_log2fc_summary", f"""WITH {_EQ} SELECT event_type, user_id % 4 AS grp, count(*) AS barcodes, round(avg(CAST(k > 0 AS INT)), 6) AS detected_fraction, round(avg(lfc), 6) AS lfc_mean,
 round(quantile_cont(lfc, 0.5), 6) AS lfc_median, round(stddev_samp(lfc), 6) AS lfc_sd, round(min(lfc), 6) AS lfc_min, round(max(lfc), 6) AS lfc_max, round(quantile_cont(lfc, 0.25), 6) AS lfc_q25, round(quantile_cont(lfc, 0.75), 6) AS lfc_q75
 FROM l GROUP BY 1, 2""")
def group_log2fc_summary(spark, d):
    rows = _equalised(spark, d).withColumn("grp", F.col("user_id") % 4)
    rows, keys = settle(rows), ["event_type", "grp"]
    out = rows.groupBy(*keys).agg(F.count("*").alias("barcodes"), F.avg((F.col("k") > 0).cast("int")).alias("detected_fraction"))
    out = out.join(ranks.group_summary(rows, "lfc", keys, "lfc"), keys, "left")
    return out.select(*keys, "barcodes", *[r(F.col(c), c) for c in ("detected_fraction", *[f"lfc_{x}" for x in ("mean", "median", "sd", "min", "max", "q25", "q75")])])


@query("reference_scale_factors", """WITH t AS (SELECT event_type, CAST(count(*) AS DOUBLE) AS raw_total FROM events GROUP BY 1)
 SELECT event_type, raw_total, round(avg(raw_total) OVER () / raw_total, 6) AS scale_factor, round(raw_total / sum(raw_total) OVER (), 6) AS share FROM t""")
def reference_scale_factors(spark, d):
    totals = table(spark, d, "events").groupBy("event_type").agg(F.count("*").cast("double").alias("raw_total"))
    whole = F.broadcast(totals.agg(F.avg("raw_total").alias("m"), F.sum("raw_total").alias("s")))
    return totals.crossJoin(whole).select("event_type", "raw_total", r(F.col("m") / F.col("raw_total"), "scale_factor"), r(F.col("raw_total") / F.col("s"), "share"))


_PF = "q AS (SELECT l_partkey AS part, l_returnflag AS flag, sum(l_quantity) AS n FROM lineitem GROUP BY 1, 2)"


def _part_flags(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("part"), F.col("l_returnflag").alias("flag")).agg(F.sum("l_quantity").alias("n"))


@query("cpm_log2fc", f"""WITH {_PF}, w AS (SELECT part, coalesce(sum(n) FILTER (flag = 'A'), 0) AS a, coalesce(sum(n) FILTER (flag = 'R'), 0) AS b FROM q GROUP BY 1),
 t AS (SELECT sum(a) AS la, sum(b) AS lb, count(*) AS n FROM w)
 SELECT part, a, b, round(log2((1e6 * (a + 0.5) / (la + 0.5 * n)) / (1e6 * (b + 0.5) / (lb + 0.5 * n))), 6) AS lfc, round(log2((1e6 * a / la + 0.5) / (1e6 * b / lb + 0.5)), 6) AS lfc_prior FROM w, t""")
def cpm_log2fc(spark, d):
    wide = _part_flags(spark, d).groupBy("part").pivot("flag", ["A", "R"]).agg(F.sum("n")).na.fill(0.0).toDF("part", "a", "b")
    t = F.broadcast(wide.agg(F.sum("a").alias("la"), F.sum("b").alias("lb"), F.count("*").alias("n")))
    a = stats.cpm(F.col("a"), F.col("la"), 0.5, F.col("n"))
    b = stats.cpm(F.col("b"), F.col("lb"), 0.5, F.col("n"))
    prior = stats.log2fc(stats.cpm(F.col("a"), F.col("la")), stats.cpm(F.col("b"), F.col("lb")), 0.5)
    return wide.crossJoin(t).select("part", "a", "b", r(F.log2(a / b), "lfc"), r(prior, "lfc_prior"))


@query("proportion_lfc", f"""WITH {_PF}, p AS (SELECT part, flag, n / sum(n) OVER (PARTITION BY flag) AS p FROM q)
 SELECT part, round(log2((coalesce(max(p) FILTER (flag = 'A'), 0) + 1e-9) / (coalesce(max(p) FILTER (flag = 'N'), 0) + 1e-9)), 6) AS lfc FROM p GROUP BY part""")
def proportion_lfc(spark, d):
    rows = _part_flags(spark, d)
    totals = F.broadcast(rows.groupBy("flag").agg(F.sum("n").alias("t")))
    wide = rows.join(totals, "flag").withColumn("p", F.col("n") / F.col("t")).groupBy("part").pivot("flag", ["A", "N"]).agg(F.max("p")).na.fill(0.0)
    return wide.select("part", r(stats.log2fc(F.col("A"), F.col("N"), 1e-9), "lfc"))


@query("control_centered_lfc", """WITH b AS (SELECT p_brand, log2(avg(p_retailprice)) AS lfc FROM part GROUP BY 1),
 c AS (SELECT avg(lfc) AS m, quantile_cont(lfc, 0.5) AS md FROM b WHERE p_brand IN ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#4'))
 SELECT p_brand, round(lfc, 6) AS lfc, round(lfc - m, 6) AS centered, round(lfc - md, 6) AS median_centered FROM b, c""")
def control_centered_lfc(spark, d):
    rows = table(spark, d, "part").groupBy("p_brand").agg(F.log2(F.avg("p_retailprice")).alias("lfc"))
    control = F.col("p_brand").isin("Brand#1", "Brand#2", "Brand#3", "Brand#4")
    out = stats.control_centred(stats.control_centred(rows, "lfc", control, "centered"), "lfc", control, "median_centered", median=True)
    return out.select("p_brand", *[r(F.col(c), c) for c in ("lfc", "centered", "median_centered")])


@query("lfc_by_compare_map", """WITH m(s, ref) AS (VALUES ('click', 'view'), ('purchase', 'click'), ('error', 'view')), c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), u AS (SELECT DISTINCT user_id FROM events)
 SELECT u.user_id, s AS sample, ref AS reference, round(log2((coalesce(a.n, 0) + 1.0) / (coalesce(b.n, 0) + 1.0)), 6) AS lfc FROM u CROSS JOIN m
 LEFT JOIN c a ON a.user_id = u.user_id AND a.event_type = s LEFT JOIN c b ON b.user_id = u.user_id AND b.event_type = ref""")
def lfc_by_compare_map(spark, d):
    counts = _type_counts(spark, d)
    pairs = F.broadcast(spark.createDataFrame([("click", "view"), ("purchase", "click"), ("error", "view")], "sample string, reference string"))
    grid = counts.select("user_id").distinct().crossJoin(pairs)  # a handful of comparisons
    a, b = counts.select("user_id", F.col("event_type").alias("sample"), F.col("n").alias("a")), counts.select("user_id", F.col("event_type").alias("reference"), F.col("n").alias("b"))
    out = grid.join(a, ["user_id", "sample"], "left").join(b, ["user_id", "reference"], "left").na.fill(0, ["a", "b"])
    return out.select("user_id", "sample", "reference", r(stats.log2fc(F.col("a"), F.col("b"), 1.0), "lfc"))


_P = "p AS (SELECT event_id, event_type, CASE WHEN event_id % 50 = 0 THEN NULL ELSE CAST((event_id * 7919) % 10007 AS DOUBLE) / 10007 END AS p FROM events)"


def _p_values(spark, d):
    p = F.when(F.col("event_id") % 50 != 0, ((F.col("event_id") * 7919) % 10007).cast("double") / 10007)
    return table(spark, d, "events").select("event_id", "event_type", p.alias("p"))


def _bh_sql(family: str) -> str:
    by = f"PARTITION BY {family} " if family else ""
    order = f"PARTITION BY {family} ORDER BY" if family else "ORDER BY"
    return f"""WITH {_P}, k AS (SELECT *, p * (count(p) OVER ({by})) / row_number() OVER ({order} p NULLS LAST, event_id) AS raw FROM p)
 SELECT event_id, round(p, 9) AS p, CASE WHEN p IS NOT NULL THEN round(least(min(raw) OVER ({order} p DESC NULLS LAST, event_id DESC ROWS UNBOUNDED PRECEDING), 1.0), 6) END AS q FROM k"""


@query("bh_adjust_global", _bh_sql(""))
def bh_adjust_global(spark, d):
    return stats.benjamini_hochberg(_p_values(spark, d), "p").select("event_id", F.round("p", 9).alias("p"), r(F.col("q"), "q"))


@query("bh_by_family", _bh_sql("event_type"))
def bh_by_family(spark, d):
    return stats.benjamini_hochberg(_p_values(spark, d), "p", keys=["event_type"]).select("event_id", F.round("p", 9).alias("p"), r(F.col("q"), "q"))


def _simpson(f: str, top: str, steps: int = 2000) -> str:
    """DuckDB SQL for the integral of f (an expression in x) from 0 to ``top``."""
    at = f"({top}) * i / {steps}.0"
    weight = f"CASE WHEN i = 0 OR i = {steps} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    return f"(({top}) / {3 * steps}.0 * list_sum(list_transform(range(0, {steps + 1}), lambda i: {weight} * ({f.replace('{x}', '(' + at + ')')}))))"


_MANN_WHITNEY = """WITH v AS (SELECT l_linestatus AS grp, l_quantity AS x, l_returnflag = 'A' AS a FROM lineitem), k AS (SELECT grp, x, count(*) AS t, count(*) FILTER (a) AS t1 FROM v GROUP BY 1, 2),
 rk AS (SELECT *, coalesce(sum(t) OVER (PARTITION BY grp ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (t + 1) / 2.0 AS rank FROM k),
 s AS (SELECT grp, CAST(sum(t1) AS DOUBLE) AS n1, CAST(sum(t - t1) AS DOUBLE) AS n2, CAST(sum(rank * t1) AS DOUBLE) AS r1, sum(CAST(t AS DOUBLE) * t * t - t) AS ties FROM rk GROUP BY 1),
 u AS (SELECT *, r1 - n1 * (n1 + 1) / 2 AS u, n1 + n2 AS n FROM s)
 SELECT grp, CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, round(u, 3) AS u, ties, round((u - n1 * n2 / 2 - 0.5 * sign(u - n1 * n2 / 2)) / sqrt(n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1)))), 6) AS z, round(2 * u / (n1 * n2) - 1, 6) AS rank_biserial FROM u WHERE n1 > 0 AND n2 > 0"""


@query("mann_whitney_u", _MANN_WHITNEY)
def mann_whitney_u(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_linestatus").alias("grp"), F.col("l_quantity").alias("x"), (F.col("l_returnflag") == "A").alias("a"))
    out = stats.mann_whitney(rows, "x", "a", ["grp"]).where("n1 > 0 and n2 > 0")
    return out.select("grp", "n1", "n2", F.round("u", 3).alias("u"), "ties", r(F.col("z"), "z"), r(F.col("rank_biserial"), "rank_biserial"))


@query("mann_whitney_p", f"SELECT *, round(greatest(1 - 2 * {_simpson('exp(-{x} * {x} / 2) / sqrt(2 * pi())', 'least(abs(z), 40)', 20000)}, 0), 6) + 0 AS p_value FROM ({_MANN_WHITNEY})")
def mann_whitney_p(spark, d):
    """With the two-sided normal tail (ST-17)."""
    return mann_whitney_u(spark, d).withColumn("p_value", r(F.least(2 * special.normal_udf()(F.abs("z")), F.lit(1.0)), "p_value"))


_REV = "rev AS (SELECT c_mktsegment AS seg, c_custkey, coalesce(sum(o_totalprice), 0.0) AS x FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2)"


def _revenue(spark, d):
    orders = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").alias("x"))
    return table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("seg")).join(orders, "c_custkey", "left").na.fill(0.0, ["x"])


_WELCH = f"""{_REV}, m AS (SELECT seg, CAST(count(*) AS DOUBLE) AS n, avg(x) AS mean, greatest(var_samp(x), 0) AS v, avg(CAST(x > 0 AS INT)) AS det FROM rev GROUP BY 1),
 w AS (SELECT a.seg, a.n AS n1, a.mean AS m1, a.v AS v1, a.det AS d1, b.n AS n2, b.mean AS m2, b.v AS v2, b.det AS d2 FROM m a, m b WHERE b.seg = 'BUILDING' AND a.seg <> 'BUILDING')"""


def _segment_pairs(spark, d):
    x = F.col("x")
    m = _revenue(spark, d).groupBy("seg").agg(F.count("*").cast("double").alias("n"), F.avg("x").alias("m"), stats.sparse_variance(F.sum(x), F.sum(x * x), F.count("*")).alias("v"), F.avg((x > 0).cast("int")).alias("d"))
    b = m.where("seg = 'BUILDING'").select(F.col("n").alias("n2"), F.col("m").alias("m2"), F.col("v").alias("v2"), F.col("d").alias("d2"))
    return m.where("seg != 'BUILDING'").toDF("seg", "n1", "m1", "v1", "d1").crossJoin(F.broadcast(b))  # one row


_WELCH_T = f"WITH {_WELCH} SELECT seg, round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 6) AS t, round(power(v1 / n1 + v2 / n2, 2) / (power(v1 / n1, 2) / (n1 - 1) + power(v2 / n2, 2) / (n2 - 1)), 4) AS df FROM w"


@query("welch_moments", _WELCH_T)
def welch_moments(spark, d):
    t, df = stats.welch(*[F.col(c) for c in ("m1", "v1", "n1", "m2", "v2", "n2")])
    return _segment_pairs(spark, d).select("seg", r(t, "t"), F.round(df, 4).alias("df"))


_STUDENT = "exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(df * pi()) * power(1 + {x} * {x} / df, -(df + 1) / 2)"


@query("welch_p", f"SELECT *, round(greatest(1 - 2 * {_simpson(_STUDENT, 'abs(t)')}, 0), 6) + 0 AS p_value FROM ({_WELCH_T})")
def welch_p(spark, d):
    """With Student's two-sided tail (ST-13)."""
    return welch_moments(spark, d).withColumn("p_value", r(special.student_udf()("t", "df"), "p_value"))


@query("cohen_d", f"WITH {_WELCH} SELECT seg, round((m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)), 6) AS d FROM w")
def cohen_d(spark, d):
    return _segment_pairs(spark, d).select("seg", r(stats.cohen_d(*[F.col(c) for c in ("m1", "v1", "n1", "m2", "v2", "n2")]), "d"))


@query("detection_odds", f"WITH {_WELCH} SELECT seg, round(d1 - d2, 6) AS delta, round(log2(((d1 + 0.01) / (1.01 - d1)) / ((d2 + 0.01) / (1.01 - d2))), 6) AS log2_odds FROM w")
def detection_odds(spark, d):
    return _segment_pairs(spark, d).select("seg", r(F.col("d1") - F.col("d2"), "delta"), r(stats.detection_log2_odds(F.col("d1"), F.col("d2")), "log2_odds"))


@query("pearson_spearman_ols", """WITH v AS (SELECT l_returnflag AS grp, l_quantity AS x, l_extendedprice AS y FROM lineitem), a AS (SELECT grp, x, y, rank() OVER (PARTITION BY grp ORDER BY x) + (count(*) OVER (PARTITION BY grp, x) - 1) / 2.0 AS rx,
 rank() OVER (PARTITION BY grp ORDER BY y) + (count(*) OVER (PARTITION BY grp, y) - 1) / 2.0 AS ry FROM v)
 SELECT grp, round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman, round(regr_slope(y, x), 4) AS slope, round(regr_intercept(y, x), 4) AS intercept, round(regr_r2(y, x), 6) AS r2 FROM a GROUP BY 1""")
def pearson_spearman_ols(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("grp"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))
    ranked = ranks.average_rank(ranks.average_rank(rows, "x", ["grp"], "rx"), "y", ["grp"], "ry")
    return ranked.groupBy("grp").agg(
        r(F.corr("x", "y"), "pearson"), r(F.corr("rx", "ry"), "spearman"), F.round(F.regr_slope("y", "x"), 4).alias("slope"), F.round(F.regr_intercept("y", "x"), 4).alias("intercept"), r(F.regr_r2("y", "x"), "r2")
    )


_SMALL_PAIRS = "v AS (SELECT c_nationkey AS grp, c_custkey, c_acctbal AS x, coalesce(sum(o_totalprice), 0) AS y FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2, 3)"


@query("correlation_p", f"""WITH {_SMALL_PAIRS}, a AS (SELECT grp, x, y, rank() OVER (PARTITION BY grp ORDER BY x) + (count(*) OVER (PARTITION BY grp, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY grp ORDER BY y) + (count(*) OVER (PARTITION BY grp, y) - 1) / 2.0 AS ry FROM v),
 s AS (SELECT grp, count(*) AS n, corr(x, y) AS pearson, corr(rx, ry) AS spearman FROM a GROUP BY 1), t AS (SELECT *, pearson * sqrt((n - 2) / nullif(1 - pearson * pearson, 0)) AS tp, spearman * sqrt((n - 2) / nullif(1 - spearman * spearman, 0)) AS ts FROM s WHERE n > 2),
 g AS (SELECT *, lgamma((n - 1) / 2.0) - lgamma((n - 2) / 2.0) - 0.5 * ln(pi() * (n - 2)) AS c FROM t),
 p AS (SELECT *, {_simpson('exp(c - (n - 1) / 2.0 * ln(1 + {x} * {x} / (n - 2)))', 'abs(tp)')} AS half_p, {_simpson('exp(c - (n - 1) / 2.0 * ln(1 + {x} * {x} / (n - 2)))', 'abs(ts)')} AS half_s FROM g)
 SELECT grp, n, round(pearson, 6) AS pearson, round(CASE WHEN abs(pearson) >= 1 THEN 0 ELSE greatest(1 - 2 * half_p, 0) END, 5) + 0 AS pearson_p, round(spearman, 6) AS spearman, round(CASE WHEN abs(spearman) >= 1 THEN 0 ELSE greatest(1 - 2 * half_s, 0) END, 5) + 0 AS spearman_p FROM p""")
def correlation_p(spark, d):
    """Pearson's and Spearman's correlation of balance and revenue by nation, with two-sided p-values by Student's t (ST-19, Q-27)."""
    orders = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").alias("y"))
    rows = table(spark, d, "customer").join(orders, "c_custkey", "left").select(F.col("c_nationkey").alias("grp"), F.col("c_acctbal").alias("x"), F.coalesce("y", F.lit(0.0)).alias("y"))
    found = stats.correlations(settle(rows), "x", "y", ["grp"])
    return found.select("grp", "n", r(F.col("pearson"), "pearson"), (F.round("pearson_p", 5) + 0).alias("pearson_p"), r(F.col("spearman"), "spearman"), (F.round("spearman_p", 5) + 0).alias("spearman_p"))


@query("robust_mad", """WITH v AS (SELECT l_returnflag AS grp, l_extendedprice AS x FROM lineitem), m AS (SELECT grp, quantile_cont(x, 0.5) AS md FROM v GROUP BY 1)
 SELECT v.grp, round(any_value(md), 6) AS median, round(1.4826 * quantile_cont(abs(x - md), 0.5), 6) AS sigma FROM v JOIN m ON v.grp = m.grp GROUP BY 1""")
def robust_mad(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("grp"), F.col("l_extendedprice").alias("x"))
    return ranks.mad_sigma(rows, "x", ["grp"]).select("grp", r(F.col("median"), "median"), r(F.col("sigma"), "sigma"))


@query("huber_read_support_flags")
def huber_read_support_flags(spark, d):
    """Rows far below the robust line of log price on log quantity, fitted for each return flag (ST-20, ST-21, Q-17)."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", F.log10("l_quantity").alias("x"), F.log10("l_extendedprice").alias("y"))
    out = None
    for flag in ("A", "N", "R"):
        part = rows.where(F.col("l_returnflag") == flag)
        slope, intercept, middle, sigma = stats.huber_line(part, "x", "y")
        residual = F.col("y") - slope * F.col("x") - intercept
        part = part.withColumn("residual", residual).withColumn("low_read_support", (F.col("residual") < middle - 4.5 * sigma) & (F.col("l_quantity") >= 10))
        out = part if out is None else out.unionByName(part)
    return out


_OC = "o AS (SELECT o_custkey AS id, o_orderpriority AS pr, count(*) AS n FROM orders GROUP BY 1, 2)"


@query("overdispersion_rho", f"""WITH {_OC}, t AS (SELECT id, CAST(sum(n) AS DOUBLE) AS total FROM o GROUP BY 1), s AS (SELECT pr, CAST(sum(n) AS DOUBLE) / (SELECT sum(n) FROM o) AS p FROM o GROUP BY 1),
 q AS (SELECT total * p AS mu, (power(n - total * p, 2) / (total * p * (1 - p)) - 1) / greatest(total - 1, 1) AS q FROM o JOIN t USING (id) JOIN s USING (pr) WHERE total > 1 AND total * p * (1 - p) > 1e-8 AND total * p >= 0.5),
 c AS (SELECT quantile_cont(q, 0.05) AS lo, quantile_cont(q, 0.95) AS hi FROM q), k AS (SELECT least(greatest(mu, 0.5), 50) AS w, q FROM q, c WHERE q BETWEEN lo AND hi)
 SELECT round(least(greatest(sum(w * q) / sum(w), 0), 0.2), 6) AS rho FROM k""")
def overdispersion_rho(spark, d):
    n = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("pr")).agg(F.count("*").alias("n"))
    total = n.groupBy("id").agg(F.sum("n").alias("total"))
    share = n.groupBy("pr").agg(F.sum("n").alias("s")).crossJoin(F.broadcast(n.agg(F.sum("n").alias("all")))).select("pr", (F.col("s") / F.col("all")).alias("p"))
    rows = n.join(total, "id").join(F.broadcast(share), "pr")
    return stats.overdispersion(rows, "n", "total", "p", F.lit(True)).select(r(F.col("rho"), "rho"))


_DOM = """v AS (SELECT l_partkey AS part, l_suppkey AS supp, CAST(count(*) AS BIGINT) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2),
 k AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY n DESC, q DESC, supp DESC) AS rn, sum(n) OVER (PARTITION BY part) AS total, count(*) OVER (PARTITION BY part) AS components FROM v)"""


@query("dominant_identity", f"WITH {_DOM} SELECT part, supp, n AS dominant, CAST(total AS BIGINT) AS total, components, round(n / total, 6) AS fraction, n / total >= 0.9 AS assigned FROM k WHERE rn = 1")
def dominant_identity(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), F.lit(1).cast("long").alias("n"), F.col("l_quantity").alias("q"))
    return agg.dominant(rows, ["part"], ["supp"], ["n", "q"], 0.9).withColumn("fraction", F.round("fraction", R))


@query("unique_mode_or_drop", """WITH c AS (SELECT user_id, date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2, 3), m AS (SELECT *, max(n) OVER (PARTITION BY user_id, hour) AS m FROM c),
 t AS (SELECT *, count(*) OVER (PARTITION BY user_id, hour) AS k FROM m WHERE n = m) SELECT user_id, CAST(epoch(hour) AS BIGINT) AS hour, event_type, n AS count FROM t WHERE k = 1""")
def unique_mode_or_drop(spark, d):
    rows = table(spark, d, "events").select("user_id", F.date_trunc("hour", "ts").cast("timestamp").alias("hour"), "event_type")
    return agg.unique_mode(rows, ["user_id", "hour"], ["event_type"]).select("user_id", F.unix_timestamp("hour").alias("hour"), "event_type", "count")


@query("coupling_categories", """WITH v AS (SELECT event_type, event_id % 3 AS bc, (event_id // 3) % 3 AS g1, (event_id // 7) % 3 AS g2 FROM events), c AS (SELECT event_type, CASE WHEN bc = g1 AND bc = g2 THEN 'triplet' WHEN (bc = g1) <> (bc = g2) THEN 'exactly_one' WHEN g1 = g2 THEN 'g1_eq_g2_not_bc' ELSE 'other' END AS category FROM v)
 SELECT event_type, category, count(*) AS n, round(CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY event_type), 6) AS proportion FROM c GROUP BY 1, 2""")
def coupling_categories(spark, d):
    e = F.col("event_id")
    v = table(spark, d, "events").select("event_type", (e % 3).alias("bc"), (F.floor(e / 3) % 3).alias("g1"), (F.floor(e / 7) % 3).alias("g2"))
    a, b = F.col("bc") == F.col("g1"), F.col("bc") == F.col("g2")
    category = columns.first_match([("triplet", a & b), ("exactly_one", a != b), ("g1_eq_g2_not_bc", F.col("g1") == F.col("g2"))], "other")
    counts = v.groupBy("event_type", category.alias("category")).agg(F.count("*").alias("n"))
    return counts.withColumn("proportion", F.round(columns.ratio(F.col("n"), F.sum("n").over(Window.partitionBy("event_type"))), R))


@query("group_totals_transform", """SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey), 2) AS customer_total, round(o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_custkey), 6) AS share FROM orders""")
def group_totals_transform(spark, d):
    total = F.sum("o_totalprice").over(Window.partitionBy("o_custkey"))
    return table(spark, d, "orders").select("o_orderkey", F.round(total, 2).alias("customer_total"), r(F.col("o_totalprice") / total, "share"))


_NF = "m AS (SELECT n_name, l_returnflag AS flag, avg(l_extendedprice) AS x FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY 1, 2)"


def _nation_flags(spark, d):
    places = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")
    return table(spark, d, "lineitem").join(small(places), F.col("l_suppkey") == F.col("s_suppkey")).groupBy("n_name", F.col("l_returnflag").alias("flag")).agg(F.avg("l_extendedprice").alias("x"))


@query("zscore_rows", f"WITH {_NF} SELECT n_name, flag, round(coalesce((x - avg(x) OVER w) / nullif(stddev_pop(x) OVER w, 0), 0), 6) AS z FROM m WINDOW w AS (PARTITION BY n_name)")
def zscore_rows(spark, d):
    return _nation_flags(spark, d).select("n_name", "flag", r(agg.zscore(F.col("x"), ["n_name"]), "z"))


@query("group_zscore", f"WITH {_NF} SELECT n_name, flag, round(coalesce((x - avg(x) OVER w) / nullif(stddev_samp(x) OVER w, 0), 0), 6) AS z FROM m WINDOW w AS (PARTITION BY flag)")
def group_zscore(spark, d):
    return _nation_flags(spark, d).select("n_name", "flag", r(agg.zscore(F.col("x"), ["flag"], population=False), "z"))


@query("log_histogram", """WITH e AS (SELECT i, power(10, 2.5 + i * 0.25) AS lo, power(10, 2.75 + i * 0.25) AS hi FROM range(0, 14) AS t(i)) SELECT CAST(i AS INT) AS bin, round(sqrt(lo * hi), 6) AS center, count(*) AS n FROM orders JOIN e ON o_totalprice >= lo AND (o_totalprice < hi OR (i = 13 AND o_totalprice = hi)) GROUP BY 1, 2""")
def log_histogram(spark, d):
    edges = [10 ** (2.5 + i * 0.25) for i in range(15)]
    centers = F.array(*[F.lit((edges[i] * edges[i + 1]) ** 0.5) for i in range(14)])
    return table(spark, d, "orders").select(agg.histogram(F.col("o_totalprice"), edges).alias("bin")).where("bin is not null").groupBy("bin").agg(F.count("*").alias("n")).select("bin", r(centers[F.col("bin")], "center"), "n")


@query("quantile_summary", """SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.05), 4) AS p05, round(quantile_cont(l_extendedprice, 0.25), 4) AS p25, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.75), 4) AS p75, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90, round(quantile_cont(l_extendedprice, 0.95), 4) AS p95, round(quantile_cont(l_extendedprice, 0.99), 4) AS p99 FROM lineitem GROUP BY 1""")
def quantile_summary(spark, d):
    points = {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}
    q = ranks.group_quantiles(table(spark, d, "lineitem"), "l_extendedprice", ["l_returnflag"], points)
    return q.select("l_returnflag", *[F.round(n, 4).alias(n) for n in points])


@query("grid_completed_bubble", """WITH s(seg) AS (VALUES ('AUTOMOBILE'), ('BUILDING'), ('FURNITURE'), ('HOUSEHOLD'), ('MACHINERY'), ('NONE')), p(pr) AS (VALUES ('1-URGENT'), ('2-HIGH'), ('3-MEDIUM'), ('4-NOT SPECIFIED'), ('5-LOW')), t(st) AS (VALUES ('F'), ('O'), ('P')),
 v AS (SELECT c_mktsegment AS seg, o_orderpriority AS pr, o_orderstatus AS st, count(*) AS n, exp(avg(ln(o_totalprice)) FILTER (o_totalprice > 0)) AS g FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3)
 SELECT seg AS segment, pr AS priority, st AS status, coalesce(n, 0) AS n, round(coalesce(g, 0), 4) AS geomean FROM s CROSS JOIN p CROSS JOIN t LEFT JOIN v USING (seg, pr, st)""")
def grid_completed_bubble(spark, d):
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    sums = rows.groupBy(F.col("c_mktsegment").alias("segment"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), agg.geometric_mean(F.col("o_totalprice")).alias("geomean"))
    dims = {"segment": ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY", "NONE"], "priority": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"], "status": ["F", "O", "P"]}
    return agg.grid(sums, dims, ["n", "geomean"]).select(*dims, "n", F.round("geomean", 4).alias("geomean"))


@query("label_selection", """WITH b AS (SELECT p_partkey AS part, round(p_retailprice - 10 * p_size, 2) AS score FROM part), l AS (SELECT part, score, 1 AS p, 'low' AS source FROM (SELECT * FROM b ORDER BY score, part LIMIT 25)),
 h AS (SELECT part, score, 2 AS p, 'high' AS source FROM (SELECT * FROM b ORDER BY score DESC, part LIMIT 10)), f AS (SELECT part, score, 0 AS p, 'forced' AS source FROM b WHERE part IN (1, 2, 3, 5, 8, 13)),
 u AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY p) AS n FROM (SELECT * FROM l UNION ALL SELECT * FROM h UNION ALL SELECT * FROM f)) SELECT part, score, source FROM u WHERE n = 1""")
def label_selection(spark, d):
    score = F.round(F.col("p_retailprice") - 10 * F.col("p_size"), 2)
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("part"), score.alias("score"))
    return annotate.labels(rows, "part", "score", 25, 10, [1, 2, 3, 5, 8, 13]).select("part", "score", "source")


@query("adaptive_top_links", """WITH e AS (SELECT o_custkey AS cust, l_suppkey AS supp, count(*) AS n, sum(l_quantity) AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2 HAVING sum(l_quantity) >= 5), t AS (SELECT CASE WHEN count(*) > 2500 THEN quantile_cont(q, 0.9) ELSE 0 END AS c FROM e)
 SELECT cust, supp, n, q FROM e, t WHERE q >= c ORDER BY q DESC, cust, supp LIMIT 2500""")
def adaptive_top_links(spark, d):
    """Links from a floor on; above 2500 links the floor rises to the 90 % point, and the best 2500 stay (SRT-07)."""
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    links = rows.groupBy(F.col("o_custkey").alias("cust"), F.col("l_suppkey").alias("supp")).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q")).where("q >= 5")
    floor = F.broadcast(links.agg(F.when(F.count("*") > 2500, F.percentile("q", F.lit(0.9))).otherwise(0.0).alias("c")))
    return links.crossJoin(floor).where("q >= c").orderBy(F.col("q").desc(), "cust", "supp").limit(2500).drop("c")


@query("axis_positions", """WITH b AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1), s AS (SELECT *, coalesce(sum(n + 25) OVER (ORDER BY p_brand ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM b) SELECT p_brand, n, CAST(start - 0.5 AS DOUBLE) AS start, CAST(start + n - 0.5 AS DOUBLE) AS "end", start + (n - 1) / 2.0 AS center FROM s""")
def axis_positions(spark, d):
    out = agg.block_positions(table(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("n")), "p_brand", F.col("p_brand"), 25)
    return out.select("p_brand", "n", *[F.col(c).cast("double").alias(c) for c in ("start", "end", "center")])


@query("melt_and_pivot", """SELECT o_orderstatus AS status, priority, n FROM (SELECT o_orderstatus, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent, count(*) FILTER (o_orderpriority = '5-LOW') AS low FROM orders GROUP BY 1) UNPIVOT (n FOR priority IN (urgent, low))""")
def melt_and_pivot(spark, d):
    wide = table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status")).pivot("o_orderpriority", ["1-URGENT", "5-LOW"]).agg(F.count(F.lit(1))).na.fill(0).toDF("status", "urgent", "low")
    return wide.unpivot(["status"], ["urgent", "low"], "priority", "n")


@query("full_outer_count_table", """WITH a AS (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1), b AS (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1), x AS (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'signup' GROUP BY 1)
 SELECT coalesce(a.user_id, b.user_id, x.user_id) AS user_id, coalesce(a.n, 0) AS click, coalesce(b.n, 0) AS error, coalesce(x.n, 0) AS signup FROM a FULL JOIN b ON a.user_id = b.user_id FULL JOIN x ON coalesce(a.user_id, b.user_id) = x.user_id""")
def full_outer_count_table(spark, d):
    """One long table and a pivot instead of a chain of full joins (JOIN-03, Q-44)."""
    kinds = ["click", "error", "signup"]
    return table(spark, d, "events").where(F.col("event_type").isin(kinds)).groupBy("user_id").pivot("event_type", kinds).agg(F.count(F.lit(1))).na.fill(0)


@query("funnel_counters", """SELECT event_type, count(*) AS records, count(*) FILTER (value < 1) AS too_short, count(*) FILTER (value >= 1 AND user_id % 2 = 0) AS no_match, count(*) FILTER (value >= 1 AND user_id % 2 = 1) AS matched FROM events GROUP BY 1""")
def funnel_counters(spark, d):
    state = columns.first_match([("too_short", F.col("value") < 1), ("no_match", F.col("user_id") % 2 == 0)], "matched")
    rows = table(spark, d, "events").withColumn("state", state)
    return rows.groupBy("event_type").agg(F.count("*").alias("records"), *[F.count_if(F.col("state") == s).alias(s) for s in ("too_short", "no_match", "matched")])


@query("keep_first_dedup", """SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) WHERE n = 1""")
def keep_first_dedup(spark, d):
    return agg.first_by(table(spark, d, "orders"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("semi_anti_split", """SELECT 'with' AS side, count(*) AS n, round(sum(c_acctbal), 2) AS bal FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') UNION ALL SELECT 'without', count(*), round(sum(c_acctbal), 2) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""")
def semi_anti_split(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    side = lambda how, name: c.join(o, "c_custkey", how).agg(F.lit(name).alias("side"), F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("bal"))
    return side("left_semi", "with").unionByName(side("left_anti", "without"))


@query("top_k_per_group", """SELECT o_orderstatus, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n <= 5""")
def top_k_per_group(spark, d):
    return agg.top_per_group(table(spark, d, "orders"), ["o_orderstatus"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], 5).select("o_orderstatus", "o_orderkey", "o_totalprice")


@query("weighted_sample", """WITH u AS (SELECT o_orderkey, o_orderstatus, o_totalprice, (CAST('0x' || substring(md5('475|' || CAST(o_orderkey AS VARCHAR)), 1, 13) AS BIGINT) + 1) / 4503599627370497.0 AS u FROM orders)
 SELECT o_orderkey, o_orderstatus, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY -ln(u) * sqrt(o_totalprice), o_orderkey) AS n FROM u) WHERE n <= 200""")
def weighted_sample(spark, d):
    """200 orders of each status, cheap ones likelier; the draw is a hash of the order's key (RND-01, RND-02)."""
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return agg.weighted_sample(rows, ["o_orderstatus"], 1 / F.sqrt("o_totalprice"), 200, 475, ["o_orderkey"])


@query("fisher_exact_2x2", """WITH s AS (SELECT p_brand, CAST(count(*) FILTER (p_size <= 10) AS DOUBLE) AS a, CAST(count(*) FILTER (p_size > 10) AS DOUBLE) AS b FROM part GROUP BY 1), m AS (SELECT s.p_brand, s.a, s.b, r.a AS c, r.b AS d FROM s, s r WHERE r.p_brand = 'Brand#1' AND s.p_brand <> 'Brand#1'),
 k AS (SELECT *, unnest(range(CAST(greatest(0, a + c - (c + d)) AS BIGINT), CAST(least(a + b, a + c) AS BIGINT) + 1)) AS k FROM m),
 p AS (SELECT *, lgamma(a + b + 1) - lgamma(k + 1) - lgamma(a + b - k + 1) + lgamma(c + d + 1) - lgamma(a + c - k + 1) - lgamma(c + d - (a + c - k) + 1) - (lgamma(a + b + c + d + 1) - lgamma(a + c + 1) - lgamma(b + d + 1)) AS lp,
   lgamma(a + b + 1) - lgamma(a + 1) - lgamma(b + 1) + lgamma(c + d + 1) - lgamma(c + 1) - lgamma(d + 1) - (lgamma(a + b + c + d + 1) - lgamma(a + c + 1) - lgamma(b + d + 1)) AS l0 FROM k)
 SELECT p_brand, CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, round(least(sum(exp(lp)) FILTER (lp <= l0 + 1e-7), 1), 6) AS p_value FROM p GROUP BY 1, 2, 3""")
def fisher_exact_2x2(spark, d):
    s = table(spark, d, "part").groupBy("p_brand").agg(F.count_if(F.col("p_size") <= 10).alias("a"), F.count_if(F.col("p_size") > 10).alias("b"))
    ref = F.broadcast(s.where("p_brand = 'Brand#1'").select(F.col("a").alias("c"), F.col("b").alias("d")))
    return s.where("p_brand != 'Brand#1'").crossJoin(ref).select("p_brand", "a", "b", r(special.fisher_udf()("a", "b", "c", "d"), "p_value"))
