"""Dictionaries of several lengths and masks in one pass, and sequences compared by bits."""

import random

from pyspark.sql import functions as F

from tallyseq.functions import seq
from tallyseq.operators import match


def word(rng, n, letters="ACGT"):
    return "".join(rng.choice(letters) for _ in range(n))


def scans(df) -> int:
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")


def test_packed_distance_is_the_letters(spark):
    rng = random.Random(1)
    rows = []
    for _ in range(400):
        n = rng.choice([1, 5, 30, 31, 32, 40])
        a = word(rng, n, rng.choice(["ACGT", "ACGT", "ACGTN", "acgt"]))
        b = "".join(x if rng.random() < 0.7 else rng.choice("ACGTN") for x in a) if rng.random() < 0.9 else word(rng, n + 1)
        rows.append((a, b))
    rows += [("", ""), ("A", "AA"), (None, "A"), ("T" * 31, "A" * 31), ("T" * 31, "T" * 31)]
    df = spark.createDataFrame(rows, "a string, b string")
    a, b = F.col("a"), F.col("b")
    got = df.select(seq.distance(a, b, seq.packed(a), seq.packed(b)).alias("x"), seq.hamming(a, b).alias("y"), seq.packed(a).alias("p")).collect()
    assert [r.x for r in got] == [r.y for r in got] and sum(r.p is not None for r in got) > 100


def test_words_of_all_lengths_are_found_in_one_pass(spark, tmp_path):
    rng = random.Random(2)
    words = sorted({word(rng, rng.randint(2, 9), "AC") for _ in range(60)})
    segments = [(i, word(rng, rng.randint(0, 40), "AC")) for i in range(120)]
    spark.createDataFrame(segments, "id long, s string").write.parquet(str(tmp_path / "s"))
    df = spark.read.parquet(str(tmp_path / "s"))
    listed = spark.createDataFrame([(w, f"L{w}") for w in words], "w string, label string")
    found = match.dictionary_hits(df, listed, "s", "w", ["id"])
    plain = sorted((i, w, at) for i, s in segments for w in words for at in range(len(s)) if s.startswith(w, at))
    assert sorted((r.id, r.w, r["_p"]) for r in found.collect()) == plain and scans(found) == 1
    best = match.best_substring(df, listed, "s", "w", "label", ["id"])
    want = {}
    for i, w, at in plain:
        want[i] = min(want.get(i, (0, 0, "")) if i in want else (-len(w), at, f"L{w}"), (-len(w), at, f"L{w}"))
    assert {r.id: (r.label, r.end) for r in best.collect()} == {i: (label, at - n) for i, (n, at, label) in want.items()}
    longest = match.longest_in_window(df, listed, "s", "w", "label", ["id"])
    assert {r.id: r.key_length for r in longest.collect()} == {i: -n for i, (n, _, _) in want.items()} and scans(longest) == 1
    assert match.dictionary_hits(df, listed.limit(0), "s", "w", ["id"]).count() == 0


def test_a_thousand_patterns_are_one_pass(spark, tmp_path):
    rng = random.Random(3)
    shapes = ["".join(rng.choice("ul") for _ in range(12)) for _ in range(8)]
    library = [(f"p{i}", "".join(x if s == "u" else x.lower() for x, s in zip(word(rng, 12, "AC" if i % 50 else "ACN"), shapes[i % 8]))) for i in range(1000)]
    reads = [(i, word(rng, rng.choice([3, 12, 20]), rng.choice(["AC", "ACN", "ac"]))) for i in range(200)]
    spark.createDataFrame(reads, "id long, s string").write.parquet(str(tmp_path / "r"))
    found = match.masked_match(spark.read.parquet(str(tmp_path / "r")), library, "s", 2)
    plain = []
    for i, s in reads:
        for name, pattern in library:
            if len(s) >= 12:
                own = s.upper()
                off = sum(own[k] != pattern[k].upper() for k in range(12) if pattern[k].islower())
                if off <= 2 and all(own[k] == pattern[k] for k in range(12) if pattern[k].isupper()):
                    plain.append((i, name, off))
    assert sorted((r.id, r.name, r.mismatches) for r in found.collect()) == sorted(plain) and len(plain) > 20
    assert scans(found) == 1
