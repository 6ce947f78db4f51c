"""Hit calling against a plain version; discovery, SQLite types, and rows without keys."""

import os
import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from tallyseq.operators import annotate, iterate
from tallyseq.sources import fastq, sqlite

GENES = "gene string, mle_beta double, mle_z double, mle_fdr double, b_lfc double, b_pos_fdr double, b_neg_fdr double, c_lfc double, c_pos_fdr double, c_neg_fdr double"


def plain_hits(rows, direction=None, min_absz=None, max_mle_fdr=None, max_rra_fdr=0.1, donors=True, low=-0.25, high=0.5, drop_ntc=True):
    best = {}
    for r in rows:
        if r[0] not in best or abs(r[2]) > abs(best[r[0]][2]):
            best[r[0]] = r
    for gene, beta, z, fdr, b, bp, bn, c, cp, cn in best.values():
        worst = max(bp if b > 0 else bn, cp if c > 0 else cn)
        down = (b <= low and c <= low) if low is not None else (b < 0 and c < 0)
        up = (b >= high and c >= high) if high is not None else (b > 0 and c > 0)
        side = {"depletion": down, "enrichment": up, None: down or up}[direction]
        sign = {"depletion": beta < 0, "enrichment": beta > 0, None: True}[direction]
        fits = (side or not donors) and sign and (min_absz is None or abs(z) >= min_absz) and (max_mle_fdr is None or fdr <= max_mle_fdr) and (max_rra_fdr is None or worst <= max_rra_fdr)
        tier = "T1-core" if worst <= 0.05 else "T2-nearmiss-RRA" if worst <= 0.1 else None
        if fits and tier and not (drop_ntc and gene.startswith("NTC")):
            yield gene, z, tier


@pytest.mark.parametrize("options", [{}, {"direction": "depletion"}, {"direction": "enrichment", "low": None, "high": None}, {"min_absz": 1.0, "max_mle_fdr": 0.5}, {"donors": False, "max_rra_fdr": None}, {"max_rra_fdr": 0.05, "drop_ntc": False}])
def test_hits_are_called_in_order(spark, options):
    rng = random.Random(5)
    names = ["WRB", "GET1", "NTC_1", "NTC_2", *[f"G{i}" for i in range(60)]]
    rows = [(rng.choice(names), rng.uniform(-2, 2), rng.uniform(-5, 5), rng.random(), rng.uniform(-2, 2), *[rng.random() / 6 for _ in range(2)], rng.uniform(-2, 2), *[rng.random() / 6 for _ in range(2)]) for _ in range(400)]
    renamed = {"donors": "require_both_donor_lfc", "low": "max_neg_lfc", "high": "min_pos_lfc"}
    got = annotate.call_hits(spark.createDataFrame(rows, GENES), **{renamed.get(k, k): v for k, v in options.items()}).collect()
    assert sorted((r.gene, r.mle_z, r.tier) for r in got) == sorted(plain_hits(rows, **options))


def test_hits_by_hand(spark):
    rows = [
        ("two rows", 1.0, -5.0, 0.1, -1.0, 0.9, 0.5, -1.0, 0.9, 0.5), ("two rows", 1.0, -2.0, 0.1, -1.0, 0.9, 0.01, -1.0, 0.9, 0.01),  # the stronger row fails, so the gene does
        ("signs differ", 1.0, -1.0, 0.1, 0.9, 0.01, 0.9, 0.9, 0.01, 0.9),  # folds up in both donors, whatever z is
        ("WRB", 1.0, 3.0, 0.1, 0.9, 0.01, 0.9, 0.9, 0.08, 0.9), ("GET1", 1.0, 4.0, 0.1, 0.9, 0.01, 0.9, 0.9, 0.01, 0.9),  # names stay apart
        ("one fdr", 1.0, 1.0, 0.1, 0.9, None, 0.9, 0.9, 0.04, 0.9), ("no fold", 1.0, 1.0, 0.1, None, 0.01, 0.01, 0.9, 0.01, 0.9),
    ]
    table = spark.createDataFrame(rows, GENES).withColumn("surfaceome", F.when(F.col("gene") == "WRB", "Surface"))
    hits = annotate.call_hits(table)
    assert {r.gene: (r.tier, r.surface) for r in hits.collect()} == {"signs differ": ("T1-core", False), "WRB": ("T2-nearmiss-RRA", True), "GET1": ("T1-core", False), "one fdr": ("T1-core", False)}
    known = spark.createDataFrame([("GET1", "Guided entry | tail-anchored protein"), ("one fdr", "mRNA splicing")], "gene string, annotation string")
    told = {r.gene: (r.preferred_symbol, r.program, r.program_evidence, r.likely_general) for r in annotate.annotated_hits(hits, known).collect()}
    assert told["WRB"] == ("GET1", "Membrane-protein biogenesis (ER/GET/ERAD)", "tail-anchored", False) and told["GET1"] == told["WRB"]
    assert told["one fdr"] == ("one fdr", "Spliceosome / RNA processing (likely general)", "mrna splic", True)
    assert told["signs differ"] == ("signs differ", "Other / unclear", "no keyword match", False)
    with pytest.raises(ValueError):
        annotate.call_hits(table, "sideways")


def test_patterns_stay_in_their_folder(tmp_path):
    for name in ("run/a.fastq.gz", "run/sub/b.fastq.gz", "run/sub/deep/c.fq", "other/a.fastq.gz", "run/notes.txt"):
        os.makedirs(tmp_path / os.path.dirname(name), exist_ok=True)
        (tmp_path / name).write_bytes(b"")
    found = lambda pattern: [os.path.relpath(f, tmp_path) for f in fastq.listed(f"{tmp_path}/{pattern}")]
    assert found("run/*.fastq.gz") == found("run") == found("run/*") == ["run/a.fastq.gz"]
    assert found("run/*/*") == found("run/s?b/*.gz") == ["run/sub/b.fastq.gz"]
    assert found("*/a.fastq.gz") == ["other/a.fastq.gz", "run/a.fastq.gz"]
    assert found("run/**/*") == ["run/a.fastq.gz", "run/sub/b.fastq.gz", "run/sub/deep/c.fq"]
    assert found("run/a.fastq.gz") == ["run/a.fastq.gz"] and found("none/*") == found("run/none.fastq") == []


def test_sqlite_types_and_tables_without_row_numbers(spark, tmp_path):
    path = str(tmp_path / "x.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE typed (a BIGINT, b FLOAT, c DOUBLE PRECISION, d NUMERIC(9, 2), e BOOLEAN, f VARCHAR(9), g BLOB, h, i DATE, j TINYINT)")
        db.executemany("INSERT INTO typed VALUES (?,?,?,?,?,?,?,?,?,?)", [(2**60, 1, 2, 3, True, "x", b"\x00\xff", 5, "2024-01-01", 3), (None,) * 10, ("7", "1.5", 2.5, 3.25, 0, 9, "t", "u", "v", 1)])
        db.execute("CREATE TABLE keyed (k TEXT PRIMARY KEY, n INT) WITHOUT ROWID")
        db.executemany("INSERT INTO keyed VALUES (?, ?)", [(f"k{i}", i) for i in range(50)])
        db.execute('CREATE TABLE taken (rowid TEXT, n INT)')
        db.executemany("INSERT INTO taken VALUES (?, ?)", [(f"r{i}", i) for i in range(50)])
        db.execute("CREATE VIEW seen AS SELECT n FROM keyed WHERE n < 9")
    typed = sqlite.read_sqlite(spark, path, "typed", 3)
    assert [t for _, t in typed.dtypes] == ["bigint", "double", "double", "double", "bigint", "string", "binary", "string", "string", "bigint"]
    got = sorted(map(tuple, typed.collect()), key=repr)
    assert (2**60, 1.0, 2.0, 3.0, 1, "x", b"\x00\xff", "5", "2024-01-01", 3) in got and (7, 1.5, 2.5, 3.25, 0, "9", b"t", "u", "v", 1) in got and (None,) * 10 in got
    assert sorted(r.n for r in sqlite.read_sqlite(spark, path, "keyed").collect()) == list(range(50))
    assert sorted((r.n, r.rowid) for r in sqlite.read_sqlite(spark, path, "taken", 4).collect()) == [(i, f"r{i}") for i in range(50)]
    assert sqlite.read_sqlite(spark, path, "taken", 4).rdd.getNumPartitions() == 4
    assert sqlite.read_sqlite(spark, path, "seen").count() == 9


def test_rows_without_a_key_or_umi_keep_their_counts(spark):
    rows = [("a", "ACGTAC", 100), ("a", "ACGTAT", 3), (None, "ACGTAC", 7), (None, "ACGTAC", 1), ("a", None, 5), (None, None, 2)]
    links = iterate.collapse_umis(spark.createDataFrame(rows, "k string, u string, n long"), "k", "u", "n", 6)
    got = {(r.k, r.u): (r.root, r.n) for r in links.collect()}
    assert got == {("a", "ACGTAC"): ("ACGTAC", 100), ("a", "ACGTAT"): ("ACGTAC", 3), (None, "ACGTAC"): ("ACGTAC", 8), ("a", None): (None, 5), (None, None): (None, 2)}
    assert sum(r.n for r in iterate.collapsed_counts(links, "k", "n").collect()) == sum(n for *_, n in rows)
