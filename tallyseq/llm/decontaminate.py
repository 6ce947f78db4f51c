"""Benchmark decontamination by winnowing, in DataFrame operations only.

A text's k-grams of words are hashed; of every ``w`` consecutive hashes the least is kept. Two texts that share
k + w - 1 words in a row share a kept hash, whatever surrounds them. With k = 6 and w = 8 every window of 13
words is guaranteed. The benchmark's windows are filed under the least hash of their first w k-grams; documents
meet them by their kept hashes, and each hit is extended from its k-gram to the window around it and compared
word by word, so that the result is exact whatever the hashes do. Items of fewer words are one window each and
get their own k and w, chosen from the shortest of them; without such items that work is not done.

A document is read once. Its hits travel with a row of its own, so documents without hits keep their row and one
shuffle of small rows brings everything together. Distinct windows are broadcast while they take no more
than ``BROADCAST_BYTES``, as counted; beyond that documents and windows meet in shuffled joins on the hash.

Defined results: a null or empty text has no words and is clean; items without words are ignored, repeated items
and ids are listed once, a null item_id counts in hits but is not listed; repeated documents keep a row each; an
empty benchmark leaves all clean; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import cut, documents, lower_ascii

WINDOW = 13
LONG = (6, 8)
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BROADCAST_BYTES = 48 << 20
#: No hash of a window: the row that keeps documents without hits.
OWN = -1


def words(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), GAPS), "")


def _first(array: Column, n: Column) -> Column:
    return F.slice(array, 1, F.greatest(n, F.lit(0)))


def _paired(left: Column, right: Column, shift: int, size: Column, f) -> Column:
    """f(left[i], right[i + shift]) for i < size."""
    return F.zip_with(_first(left, size), F.slice(right, shift + 1, F.greatest(size, F.lit(0))), f)


def _doubled(base: Column, n: Column, width: int, f) -> Column:
    """f over every run of ``width`` elements of ``base`` (n of them), by runs of powers of two that are joined end to end."""
    runs, span = {1: base}, 1
    while span * 2 <= width:
        runs[span * 2] = _paired(runs[span], runs[span], span, n - (span * 2 - 1), f)
        span *= 2
    out, done = runs[span], span
    while done < width:
        step = 1 << ((width - done).bit_length() - 1)
        out = _paired(out, runs[step], done, n - (done + step - 1), f)
        done += step
    return out


def gram_hashes(hashes: Column, n: Column, k: int) -> Column:
    """A hash of every k consecutive words, from the words' own."""
    return _doubled(hashes, n, k, lambda a, b: F.xxhash64(a, b))


def least_of(values: Column, n: Column, w: int) -> Column:
    """The least of every w consecutive values."""
    runs, span = values, 1
    while span * 2 <= w:
        runs = _paired(runs, runs, span, n - (span * 2 - 1), lambda a, b: F.least(a, b))
        span *= 2
    return runs if span == w else _paired(runs, runs, w - span, n - (w - 1), lambda a, b: F.least(a, b))


def windows_of(items: DataFrame, short: tuple[int, int] | None, window: int = WINDOW, long: tuple[int, int] = LONG) -> DataFrame:
    """Distinct windows: kind, fp (the hash they are filed under), at (its k-gram's place), gram."""
    distinct = item_grams(items, window).select("gram").distinct()
    size, hashes = F.size("gram"), F.transform("gram", lambda x: F.xxhash64(x))
    kinds = [(0, long, size == window)] + ([(1, short, size < window)] if short else [])
    out = None
    for kind, (k, w), fits in kinds:
        grams = gram_hashes(hashes, size, k)
        filed = distinct.where(fits).withColumn("h", F.slice(grams, 1, w)).withColumn("fp", F.array_min("h"))
        rows = filed.select(F.lit(kind).alias("kind"), "fp", (F.array_position("h", F.col("fp")) - 1).cast("int").alias("at"), "gram")
        out = rows if out is None else out.unionByName(rows)
    return out


def item_grams(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id (as text) and gram, a row for each window of each item."""
    listed = items.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    n = F.size("w")
    runs = F.when(n < window, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.greatest(n - window, F.lit(0))))
    return listed.withColumn("i", F.explode(runs)).select("item_id", F.slice("w", F.col("i") + 1, window).alias("gram"))


def items_of(windows: DataFrame, items: DataFrame) -> DataFrame:
    """window and item_id, a row for each item that holds it. A window of very many items is as many rows, and none of them a list."""
    return item_grams(items).join(windows.select("window", "gram"), "gram").select("window", "item_id").distinct()


def short_setting(items: DataFrame, window: int = WINDOW, k: int = LONG[0]) -> tuple[int, int] | None:
    """k and w for items below the window's length, from the shortest; None where there are none."""
    n = F.size(words(F.col("text")))
    least = items.select(n.alias("n")).where((F.col("n") > 0) & (F.col("n") < window)).agg(F.min("n")).first()[0]
    return None if least is None else (min(k, least), least - min(k, least) + 1)


def _fingerprinted(docs: DataFrame, settings: list[tuple[int, int]], keep: list[str]) -> DataFrame:
    """``keep`` with w (words), h<kind> (k-gram hashes) and fps<kind> (kept hashes)."""
    out = docs.select(*keep, words(F.col("text")).alias("w"))
    out = out.withColumn("n", F.size("w")).withColumn("_wh", F.transform("w", lambda x: F.xxhash64(x)))
    for kind, (k, w) in enumerate(settings):
        out = out.withColumn(f"h{kind}", gram_hashes(F.col("_wh"), F.col("n"), k))
        out = out.withColumn(f"fps{kind}", F.array_distinct(least_of(F.col(f"h{kind}"), F.col("n") - (k - 1), w)))
    return out.drop("_wh")


def _tagged(kinds: int) -> Column:
    """(kind, fp) of the kept hashes."""

    def tag(kind: int) -> Column:
        return F.transform(f"fps{kind}", lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("fp")))

    return F.concat(*map(tag, range(kinds)))


def _starts(kinds: int) -> Column:
    """Where the window occurs: its k-gram's places, each extended to the whole window and compared word by word."""
    h = F.col("h0")
    for i in range(1, kinds):
        h = F.when(F.col("kind") == i, F.col(f"h{i}")).otherwise(h)
    places = F.filter(F.transform(h, lambda x, i: F.when(x == F.col("fp"), i - F.col("at"))), lambda i: i >= 0)
    return F.filter(places, lambda i: F.slice(F.col("w"), i + 1, F.size("gram")) == F.col("gram"))


def find_hits(docs: DataFrame, items: DataFrame, keep: list[str], broadcast_bytes: int = BROADCAST_BYTES, with_items: bool = True) -> DataFrame:
    """A row for each document: ``keep``, n_words, n_hit and, if asked for, items (sorted item ids as strings).

    Windows go by numbers; whose they are is looked up at the end, once for each distinct set of windows that documents have.
    """
    small = items.select("item_id", "text")
    short = short_setting(small)
    settings = [LONG] + ([short] if short else [])
    filed = cut(windows_of(small, short).withColumn("window", F.monotonically_increasing_id()))
    held = filed.agg(F.coalesce(F.sum(F.octet_length(F.array_join("gram", " ")) + 24 * F.size("gram") + 100), F.lit(0))).first()[0]
    kinds = len(settings)
    if held <= broadcast_bytes:
        base = _fingerprinted(docs.withColumn("_row", F.monotonically_increasing_id()), settings, ["_row", *keep])
        own = filed.sparkSession.range(1).select(
            F.lit(OWN).alias("kind"), F.lit(0).cast("long").alias("fp"), F.lit(0).alias("at"), F.array().cast("array<string>").alias("gram"), F.lit(None).cast("long").alias("window")
        )
        each = F.explode(F.concat(F.array(F.struct(F.lit(OWN).alias("kind"), F.lit(0).cast("long").alias("fp"))), _tagged(kinds)))
        met = base.withColumn("_e", each).withColumns({"kind": F.col("_e.kind"), "fp": F.col("_e.fp")}).drop("_e").join(F.broadcast(filed.unionByName(own)), ["kind", "fp"])
    else:
        rows = cut(docs.withColumn("_row", F.monotonically_increasing_id()).select("_row", "text", *[c for c in keep if c != "text"]))
        base = _fingerprinted(rows, settings, ["_row", *keep])
        # kept hashes fetch their windows as rows of their own, so that a passage in very many documents moves no texts
        found = base.select("_row", F.explode(_tagged(kinds)).alias("_e")).select("_row", "_e.kind", "_e.fp").join(filed, ["kind", "fp"])
        hit = base.join(found, "_row")
        own = base.withColumns({"kind": F.lit(OWN), "fp": F.lit(0).cast("long"), "at": F.lit(0), "gram": F.array().cast("array<string>"), "window": F.lit(None).cast("long")})
        met = hit.unionByName(own)
    hits = (
        met.withColumn("_s", F.when(F.col("kind") == OWN, F.array().cast("array<int>")).otherwise(_starts(kinds)))
        .where((F.col("kind") == OWN) | (F.size("_s") > 0))
        .select("_row", *keep, "n", F.transform("_s", lambda i: F.struct(i.alias("a"), (i + F.size("gram")).alias("b"))).alias("_s"), "window")
    )
    gathered = hits.groupBy("_row", *keep, "n").agg(F.flatten(F.collect_list("_s")).alias("_s"), F.array_sort(F.collect_set("window")).alias("windows"))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("total"))
    covered = F.aggregate(
        F.array_sort(F.array_distinct("_s")),
        start,
        lambda acc, x: F.struct(
            F.greatest(acc["end"], x["b"]).alias("end"), (acc["total"] + F.greatest(F.lit(0), x["b"] - F.greatest(acc["end"], x["a"]))).cast("long").alias("total")
        ),
        lambda acc: acc["total"],
    )
    out = gathered.select(*keep, F.col("n").cast("long").alias("n_words"), covered.alias("n_hit"), "windows")
    if not with_items:
        return out.drop("windows")
    out = cut(out)
    sets = out.where(F.size("windows") > 0).select(F.col("windows").alias("set")).distinct()
    of = sets.withColumn("window", F.explode("set")).join(items_of(filed, small), "window").groupBy("set").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    return out.join(of, out.windows == of.set, "left").select(*keep, "n_words", "n_hit", F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def contaminated(n_hit: Column, n_words: Column) -> Column:
    """The contract's rule: at least a twentieth of the words are hit."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against every benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = find_hits(documents(spark, sf_dir).select("doc_id", "text"), items, ["doc_id"])
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
HITS_CTES = rf"""
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
g AS (SELECT item_id, len(w) AS n, w AS gram FROM b WHERE len(w) BETWEEN 1 AND 12
      UNION SELECT item_id, 13, w[i:i + 12] FROM b, unnest(range(1, len(w) - 11)) AS t(i) WHERE len(w) >= 13),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
p AS (SELECT doc_id, m.n, i, w[i:i + m.n - 1] AS gram FROM d, (SELECT DISTINCT n FROM g) AS m, unnest(range(1, len(w) + 2 - m.n)) AS t(i)),
hit AS (SELECT p.doc_id, p.i, p.n, g.item_id FROM p JOIN g ON p.gram = g.gram),
place AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM hit) GROUP BY doc_id),
item AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hit) GROUP BY doc_id)
"""
OP10_SQL = rf"""
WITH {HITS_CTES}
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN place USING (doc_id) LEFT JOIN item USING (doc_id)
"""
