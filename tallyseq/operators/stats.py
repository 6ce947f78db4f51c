"""Statistics over groups. Everything but the tails of distributions is a Column expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import special
from .lineage import settle
from .ranks import average_rank, mean_ranks, met, quantiles_of_counts, value_counts


def log2fc(a: Column, b: Column, pseudo: float) -> Column:
    """log2((a + pseudo) / (b + pseudo)) (ST-01, ST-02, ST-05, ST-06)."""
    return F.log2((a + pseudo) / (b + pseudo))


def cpm(count: Column, library: Column, pseudo: float = 0.0, rows: Column | float = 0.0) -> Column:
    """Counts per million; the pseudocount goes to every row and so into the library (ST-03)."""
    return 1e6 * (count + pseudo) / (library + pseudo * rows)


def benjamini_hochberg(df: DataFrame, p: str, out: str = "q", keys: list[str] | None = None) -> DataFrame:
    """Adjusted p-values, by family if ``keys`` are given; NULL and NaN pass through as NULL (ST-08, ST-09).

    Equal p-values get one result, so ranks are taken over distinct values with their counts: rows that share a
    p-value, or have none, never meet in a task. Within a family values are ranked in buckets whose sizes and least
    results are carried over from a summary of one row a bucket, so a family needs no single ordered task either.
    """
    keys = keys or []
    good = F.col(p).isNotNull() & ~F.isnan(p)
    buckets = 4096
    # a finer cut near zero, where p-values crowd
    bucket = F.floor(F.sqrt(F.least(F.greatest(F.col("_p"), F.lit(0.0)), F.lit(1.0))) * buckets).cast("int")
    family = [f"_k{i}" for i in range(len(keys))]
    values = df.where(good).select(*[F.col(k).alias(f) for k, f in zip(keys, family)], F.col(p).alias("_p")).groupBy(*family, "_p").agg(F.count("*").alias("_n")).withColumn("_b", bucket)
    local = Window.partitionBy(*family, "_b")
    ranked = values.withColumn("_r", F.sum("_n").over(local.orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)))
    across = Window.partitionBy(*family)
    before = F.coalesce(F.sum("_s").over(across.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = values.groupBy(*family, "_b").agg(F.sum("_n").alias("_s")).select(*family, "_b", before.alias("_base"), F.sum("_s").over(across).alias("_m"))
    raw = met(ranked, bases, [*family, "_b"]).withColumn("_q", F.col("_p") * F.col("_m") / (F.col("_base") + F.col("_r")))
    after = F.min("_q").over(across.orderBy(F.col("_b").desc()).rowsBetween(Window.unboundedPreceding, -1))
    laters = raw.groupBy(*family, "_b").agg(F.min("_q").alias("_q")).select(*family, "_b", after.alias("_later"))
    q = F.least(F.min("_q").over(local.orderBy(F.col("_p").desc()).rowsBetween(Window.unboundedPreceding, 0)), F.coalesce("_later", F.lit(1.0)), F.lit(1.0))
    done = met(raw, laters, [*family, "_b"]).select(*family, "_p", q.alias("_q"))
    same = F.col(p) == F.col("_p")
    for k, f in zip(keys, family):
        same &= F.col(k).eqNullSafe(F.col(f))
    return df.join(done, same, "left").withColumn(out, F.when(good, F.col("_q"))).drop(*family, "_p", "_q")


def mann_whitney(df: DataFrame, value: str, inside: str, keys: list[str], most: int | None = None) -> DataFrame:
    """U of the rows with ``inside`` against the rest, z (tie- and continuity-corrected), rank-biserial effect (ST-17, ST-18).

    Counts of equal values meet first, so a group costs a row for each distinct value, and these are ranked by ranges.
    """
    per = value_counts(df, keys, value, t1=F.sum(F.col(inside).cast("long"))).withColumnRenamed("n", "t")
    ranked = mean_ranks(per, keys, value, "t", most=most)
    t = F.col("t").cast("double")
    sums = ranked.groupBy(*keys).agg(F.sum("t1").alias("n1"), F.sum(F.col("t") - F.col("t1")).alias("n2"), F.sum(F.col("rank") * F.col("t1")).alias("r1"), F.sum(t * t * t - t).alias("ties"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n, u = n1 + n2, F.col("r1") - n1 * (n1 + 1) / 2
    sd = F.sqrt(n1 * n2 / 12 * (n + 1 - F.try_divide(F.col("ties"), n * (n - 1))))
    off = u - n1 * n2 / 2
    z = F.try_divide(off - 0.5 * F.signum(off), sd)
    return sums.select(*keys, "n1", "n2", u.alias("u"), "ties", z.alias("z"), (F.try_divide(2 * u, n1 * n2) - 1).alias("rank_biserial"), F.try_divide(u, n1 * n2).alias("effect"))


def correlations(df: DataFrame, x: str, y: str, keys: list[str], most: int | None = None) -> DataFrame:
    """n, Pearson's r and Spearman's rho of each group with two-sided p-values by Student's t of n - 2 degrees (ST-19).

    Rows that lack either value don't count. A group of fewer than three rows, or with a column of one value, has no p-value.
    """
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, x, y)
    ranked = average_rank(average_rank(rows, x, keys, "_rx", most), y, keys, "_ry", most)
    # a built-in correlation fails where a column has one value
    corr = lambda a, b: F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
    found = ranked.groupBy(*keys).agg(F.count("*").alias("n"), corr(x, y).alias("pearson"), corr("_rx", "_ry").alias("spearman"))
    student = special.student_udf()
    for name in ("pearson", "spearman"):
        c = F.when(F.isnan(name), None).when(F.col(name) > 1, 1.0).when(F.col(name) < -1, -1.0).otherwise(F.col(name))
        free = F.when(F.col("n") > 2, (F.col("n") - 2).cast("double"))
        t = c * F.sqrt(F.try_divide(free, 1 - c * c))  # a perfect correlation has p = 0
        found = found.withColumn(name, c).withColumn(f"{name}_p", F.when(F.abs(F.col(name)) >= 1, F.when(free.isNotNull(), 0.0)).otherwise(student(F.when(F.abs(F.col(name)) < 1, t), free)))
    return found


def welch(m1: Column, v1: Column, n1: Column, m2: Column, v2: Column, n2: Column) -> tuple[Column, Column]:
    """(t, degrees of freedom) from means and unbiased variances (ST-13)."""
    a, b = v1 / n1, v2 / n2
    return F.try_divide(m1 - m2, F.sqrt(a + b)), F.try_divide((a + b) ** 2, a * a / (n1 - 1) + b * b / (n2 - 1))


def sparse_variance(total: Column, squares: Column, n: Column) -> Column:
    """Unbiased variance with the zeros that are not stored, never below 0 (ST-14)."""
    mean = total / n
    return F.greatest((squares / n - mean * mean) * F.try_divide(n, n - 1), F.lit(0.0))


def cohen_d(m1: Column, v1: Column, n1: Column, m2: Column, v2: Column, n2: Column) -> Column:
    """By the pooled deviation; 0 where that is 0 (ST-15)."""
    pooled = F.sqrt(F.try_divide((n1 - 1) * v1 + (n2 - 1) * v2, n1 + n2 - 2))
    return F.when(pooled > 0, (m1 - m2) / pooled).otherwise(0.0)


def detection_log2_odds(d1: Column, d2: Column) -> Column:
    """log2 odds ratio of detection rates, 0.01 added to each rate and 1.01 taken as the whole (ST-16)."""
    return F.log2(((d1 + 0.01) / (1.01 - d1)) / ((d2 + 0.01) / (1.01 - d2)))


def signed_score(lfc: Column, p: Column) -> Column:
    """ST-28."""
    return F.signum(lfc) * -F.log10(F.greatest(F.coalesce(p, F.lit(1.0)), F.lit(1e-300)))


def control_centred(df: DataFrame, value: str, is_control: Column, out: str, keys: list[str] | None = None, median: bool = False) -> DataFrame:
    """Values less the mean (or median) of the control rows (ST-07)."""
    x = F.when(is_control, F.col(value))
    middle = (F.percentile(x, F.lit(0.5)) if median else F.avg(x)).alias("_c")
    centre = df.groupBy(*(keys or [])).agg(middle)
    joined = df.join(F.broadcast(centre), keys) if keys else df.crossJoin(F.broadcast(centre))  # one row
    return joined.withColumn(out, F.col(value) - F.col("_c")).drop("_c")


#: Up to so many rows an exact quantile is taken in one aggregate; beyond it the rows are narrowed down first.
QUANTILE_ROWS = 1_000_000


def quantile(rows: DataFrame, c: Column, q: float, n: int, most: int | None = None) -> float | None:
    """The exact quantile (linear between neighbours) of n values without NULL, as ``percentile`` has it.

    Of many rows only the two neighbours' surroundings are ordered: counts in 1024 even buckets narrow the range down
    round by round, so no task holds the values.
    """
    most = QUANTILE_ROWS if most is None else most
    if n == 0:
        return None
    at = q * (n - 1)
    values = rows.select(c.cast("double").alias("v"))

    if n <= most:
        return values.agg(F.percentile("v", F.lit(q))).first()[0]
    k, share = int(at), at - int(at)
    low, high = values.agg(F.min("v"), F.max("v")).first()
    below, inside = 0, n
    while inside > most and low < high:
        step = (high - low) / 1024
        if step == 0 or low + step == low:
            break
        bin_ = F.least(F.floor((F.col("v") - low) / step), F.lit(1023))
        found = sorted(values.where(F.col("v").between(low, high)).groupBy(bin_.alias("b")).agg(F.count("*"), F.min("v"), F.max("v")).collect())
        for _, size, lowest, highest in found:
            if below + size > k:
                low, high, inside = lowest, highest, size
                break
            below += size
    # both neighbours in one pass: the upper one is in the range too, or the least value behind it
    near = F.when(F.col("v").between(low, high), F.col("v"))
    place = lambda i: F.percentile(near, F.lit(min(i - below, inside - 1) / max(inside - 1, 1)))
    first, second, behind = values.where(F.col("v") >= low).agg(place(k), place(k + 1), F.min(F.when(F.col("v") > high, F.col("v")))).first()
    return first if share == 0 else first + share * ((second if k + 1 < below + inside else behind) - first)


def overdispersion(df: DataFrame, count: str, total: str, p: str, eligible: Column, least: int = 100, cap: float = 0.2) -> DataFrame:
    """One row (rho): trimmed, weighted Pearson excess; 0 below ``least`` rows at any step (ST-12)."""
    n, mu = F.col(total).cast("double"), F.col(total) * F.col(p)
    var = mu * (1 - F.col(p))
    rows = df.where(eligible & (n > 1) & (var > 1e-8) & (mu >= 0.5)).select(mu.alias("mu"), (((F.col(count) - mu) ** 2 / var - 1) / F.greatest(n - 1, F.lit(1.0))).alias("q"))
    rows = settle(rows.where(F.col("q").isNotNull() & ~F.isnan("q") & (F.abs("q") < float("inf"))))
    seen = rows.count()
    low, high = (quantile(rows, F.col("q"), x, seen) for x in (0.05, 0.95))
    kept = rows.where(F.lit(seen >= least) & F.col("q").between(low, high))
    w = F.least(F.greatest("mu", F.lit(0.5)), F.lit(50.0))
    rho = F.when(F.count("*") >= least, F.least(F.greatest(F.sum(w * F.col("q")) / F.sum(w), F.lit(0.0)), F.lit(cap))).otherwise(0.0)
    return kept.agg(rho.alias("rho"))


def huber_line(df: DataFrame, x: str, y: str, tuning: float = 1.345, rounds: int = 100, tol: float = 1e-10) -> tuple[float, float, float, float]:
    """(slope, intercept, median residual, sigma) by reweighted least squares (ST-20).

    A round takes five weighted sums and two medians over the data, which is computed once; only those numbers reach
    the driver.
    """
    rows = settle(df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x is not null and y is not null"))
    n = rows.count()
    if n < 2:
        mid = rows.agg(F.percentile("y", F.lit(0.5))).first()[0] or 0.0
        return 0.0, float(mid), 0.0, 0.0

    def fit(weight: Column) -> tuple[float, float]:
        s = rows.agg(*[F.sum(weight * c) for c in (F.lit(1.0), F.col("x"), F.col("y"), F.col("x") * F.col("x"), F.col("x") * F.col("y"))]).first()
        w, sx, sy, sxx, sxy = s
        spread = w * sxx - sx * sx
        slope = (w * sxy - sx * sy) / spread if abs(spread) > 1e-300 else 0.0
        return slope, (sy - slope * sx) / w

    slope, intercept = fit(F.lit(1.0))
    middle = sigma = 0.0
    for _ in range(rounds):
        r = F.col("y") - slope * F.col("x") - intercept
        middle = quantile(rows, r, 0.5, n)
        sigma = 1.4826 * quantile(rows, F.abs(r - middle), 0.5, n)
        if sigma <= 0:
            break
        size = F.abs(r - middle) / (tuning * sigma)
        new = fit(F.when(size <= 1, 1.0).otherwise(1 / size))
        moved = max(abs(new[0] - slope), abs(new[1] - intercept))
        slope, intercept = new
        if moved < tol:
            break
    return slope, intercept, middle, sigma


def pairwise_against(df: DataFrame, group: str, value: str, reference: str, least: int = 5, most: int | None = None) -> DataFrame:
    """Each group against the reference group: sizes, medians and their difference, rank-biserial effect, z (ST-17, ST-18, Q-33).

    Groups or references of fewer than ``least`` values give no row. Values are counted first, so a pair of groups costs a
    row for each distinct value, and these are ranked by ranges.
    """
    rows = df.where(F.col(value).isNotNull()).groupBy(F.col(group).alias("_g"), F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    ref, own = rows.where(F.col("_g") == reference), rows.where(F.col("_g") != reference)
    groups = own.select("_g").distinct()
    stacked = own.withColumn("_in", F.lit(1)).unionByName(ref.drop("_g").crossJoin(F.broadcast(groups)).withColumn("_in", F.lit(0)))  # groups are names
    per = settle(stacked.groupBy("_g", "_v").agg(F.sum("_n").alias("t"), F.sum(F.col("_n") * F.col("_in")).alias("t1")))
    ranked = mean_ranks(per, ["_g"], "_v", "t", most=most)
    t = F.col("t").cast("double")
    s = ranked.groupBy("_g").agg(
        F.sum("t1").alias("n1"), F.sum(F.col("t") - F.col("t1")).alias("n2"), F.sum(F.col("rank") * F.col("t1")).alias("r1"), F.sum(t * t * t - t).alias("ties"),
    )
    counts = per.withColumn("t2", F.col("t") - F.col("t1"))
    for side, name in (("t1", "median_group"), ("t2", "median_reference")):
        s = s.join(quantiles_of_counts(counts, ["_g"], "_v", {name: 0.5}, side, most), "_g", "left")
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n, u = n1 + n2, F.col("r1") - n1 * (n1 + 1) / 2
    sd = F.sqrt(n1 * n2 / 12 * (n + 1 - F.try_divide(F.col("ties"), n * (n - 1))))
    off = u - n1 * n2 / 2
    z = F.try_divide(off - 0.5 * F.signum(off), sd)
    enough = s.where((F.col("n1") >= least) & (F.col("n2") >= least))
    return enough.select(
        F.col("_g").alias(group), F.col("n1").alias("n_group"), F.col("n2").alias("n_reference"), "median_group", "median_reference",
        (F.col("median_group") - F.col("median_reference")).alias("median_diff"), (2 * u / (n1 * n2) - 1).alias("rank_biserial"), z.alias("z"),
    )


def compared(generated: DataFrame, golden: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """For each value column: rows only one side has, rows that differ, and the greatest absolute difference (Q-59)."""
    a = generated.select(*keys, *[F.col(v).cast("double").alias(f"_a_{v}") for v in values], F.lit(True).alias("_a"))
    b = golden.select(*keys, *[F.col(v).cast("double").alias(f"_b_{v}") for v in values], F.lit(True).alias("_b"))
    met = a.join(b, keys, "full")
    one = F.col("_a").isNull() | F.col("_b").isNull()
    parts = []
    for v in values:
        x, y = F.col(f"_a_{v}"), F.col(f"_b_{v}")
        parts.append(F.struct(F.lit(v).alias("column"), F.count_if(one).alias("unmatched"), F.count_if(~one & ~x.eqNullSafe(y)).alias("differing"), F.coalesce(F.max(F.abs(x - y)), F.lit(0.0)).alias("max_abs_diff")))
    return met.agg(F.array(*parts).alias("_p")).select(F.explode("_p").alias("_p")).select("_p.*")
