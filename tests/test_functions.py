"""Functions and operators on tiny frames, against plain Python and published figure tables."""

import csv
import gzip
import math
import os
import struct

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyseq.functions import columns, seq, special
from tallyseq.operators import aggregate as agg
from tallyseq.operators import annotate, iterate, match, matrix, small, stats
from tallyseq.sources import alignments, fastq, provenance, sqlite, tables
from tallyseq.streaming import counts as stream

def values(spark, rows, schema, *exprs):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*exprs).collect()]


def test_sequences(spark):
    s = F.col("s")
    rows = values(spark, [("ACGTN",), ("acgg",)], "s string", seq.reverse_complement(s), seq.kmers(s, 3), seq.cut(s, 1, 3), seq.window_after(s, F.lit(1), 1, 9))
    assert rows == [("NACGT", ["ACG", "CGT", "GTN"], "CG", "GTN"), ("ccgt", ["acg", "cgg"], "cg", "gg")]
    assert values(spark, [("ACGT", "AGGA"), ("AC", "ACG")], "a string, b string", seq.hamming(F.col("a"), F.col("b"))) == [(2,), (3,)]
    keys = [set(r[0]) for r in values(spark, [("ACGT",), ("ATGA",), ("TTTA",)], "s string", seq.mask_keys(s, 4))]
    assert keys[0] & keys[1] and not keys[0] & keys[2] and len(keys[0]) == 1 + 4 + 6
    assert values(spark, [(["a|b", " b | c"],)], "s array<string>", seq.merged_tokens(s)) == [("a|b|c",)]
    assert seq.case_pattern("ACgtA") == ([0, 1, 4], [2, 3])


@given(st.text("ACGT", max_size=12))
@settings(max_examples=50, deadline=None)
def test_complement_twice_is_the_sequence(s):
    flip = lambda x: x.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    assert flip(flip(s)) == s


def test_column_rules(spark):
    x = F.col("x")
    got = values(spark, [(0.05,), (0.051,), (0.2,), (None,)], "x double", columns.tier(x, annotate.TIERS))
    assert [g[0] for g in got] == ["T1-core", "T2-nearmiss-RRA", "untiered", "untiered"]
    assert values(spark, [(1.0, None, 4.0), (None, None, None)], "a double, b double, c double", columns.row_mean(F.col("a"), F.col("b"), F.col("c"))) == [(2.5,), (None,)]
    assert values(spark, [(1.0, 0.0)], "a double, b double", columns.ratio(F.col("a"), F.col("b"))) == [(0.0,)]
    assert values(spark, [("Exocyst complex; nucleosome",), ("nhe exchanger",), ("x",)], "t string", annotate.program(F.col("t"))) == [("Polarized exocytosis & fusion",), ("Endosomal pH & recycling",), (annotate.UNCLEAR,)]


def test_tails_against_plain_sums():
    table = lambda a, b, c, d: [math.comb(a + b, k) * math.comb(c + d, a + c - k) / math.comb(a + b + c + d, a + c) for k in range(max(0, a - d), min(a + b, a + c) + 1)]
    for a, b, c, d in ((3, 1, 1, 3), (8, 2, 1, 5), (0, 5, 5, 0)):
        p = table(a, b, c, d)
        seen = p[a - max(0, a - d)]
        assert special.fisher_two_sided(a, b, c, d) == pytest.approx(sum(x for x in p if x <= seen * (1 + 1e-7)), rel=1e-9)
    assert special.binomial_tail(3, 10, 0.2) == pytest.approx(sum(math.comb(10, k) * 0.2**k * 0.8 ** (10 - k) for k in range(3, 11)))
    assert special.betabinomial_tail(3, 10, 0.2, 1e-9) == pytest.approx(special.binomial_tail(3, 10, 0.2), rel=1e-5)
    assert special.betabinomial_tail(2, 10, 0.2, 0.1) == pytest.approx(1 - special.betabinomial_tail(0, 10, 0.2, 0.1) + special.betabinomial_tail(2, 10, 0.2, 0.1), rel=1e-9)
    assert special.student_two_sided(2.0, 1e9) == pytest.approx(2 * special.normal_tail(2.0), rel=1e-6)
    assert special.student_two_sided(1.0, 1) == pytest.approx(0.5)
    assert special.student_two_sided(float("nan"), 3) == 1


@given(st.lists(st.floats(0, 1), min_size=1, max_size=20))
@settings(max_examples=30, deadline=None)
def test_adjustment_rule(p):
    order = sorted(range(len(p)), key=lambda i: p[i])
    q, low = [0.0] * len(p), 1.0
    for rank in range(len(p), 0, -1):
        low = min(low, p[order[rank - 1]] * len(p) / rank)
        q[order[rank - 1]] = low
    assert all(b >= a - 1e-12 for a, b in zip(p, q))


def test_adjustment_in_one_family_and_in_many(spark):
    rng = np.random.default_rng(1)
    p = [float(x) for x in rng.random(300) ** 3] + [0.0, 0.0, 1.0, None, float("nan")]
    rows = [(i, x, i % 3) for i, x in enumerate(p)]
    df = spark.createDataFrame(rows, "i int, p double, g int")

    def plain(group):
        good = sorted((x, i) for i, x, g in rows if g in group and x is not None and x == x)
        out, low = {}, 1.0
        for rank in range(len(good), 0, -1):
            low = min(low, good[rank - 1][0] * len(good) / rank)
            out[good[rank - 1][1]] = low
        return out

    want = plain({0, 1, 2})
    for r in stats.benjamini_hochberg(df, "p").collect():
        assert (r.q is None) == (r.i not in want) and (r.q is None or r.q == pytest.approx(want[r.i]))
    want = plain({0}) | plain({1}) | plain({2})
    for r in stats.benjamini_hochberg(df, "p", keys=["g"]).collect():
        assert (r.q is None) == (r.i not in want) and (r.q is None or r.q == pytest.approx(want[r.i]))


#: Published values: raw totals with their scale factors, and fold changes with those centred on four controls.
TOTALS = [(488022.0, 1.2315039076107224), (563592.0, 1.0663760308875925), (677576.0, 0.8869868472318972), (674814.0, 0.8906172663874786)]
CENTRED = [("N4", 1.8369, 2.33806), ("A2", 1.1207, 1.62186), ("Q4", 0.50503, 1.00619), ("E1", -0.4362, 0.06496), ("CATNB", -0.48036, 0.0208), ("LCMV", -0.42832, 0.07284), ("TB", -0.51889, -0.01773), ("MCMV", -0.57707, -0.07591)]
VOLCANO = [(33.31435340587904, 0.6307302500225223, -4.902309064608191), (5.2747726225975144, 0.2102434166741741, -3.023378683508991), (12.492882527204639, 1.1563387917079575, -2.9716518338216176)]


def test_published_scale_factors():
    mean = np.mean([t for t, _ in TOTALS])
    assert all(mean / t == pytest.approx(f, rel=1e-12) for t, f in TOTALS)


def test_published_control_centring(spark):
    df = spark.createDataFrame(CENTRED, "name string, x double, want double")
    out = stats.control_centred(df, "x", F.col("name").isin("CATNB", "LCMV", "TB", "MCMV"), "got")
    assert all(abs(r.got - r.want) < 1e-9 for r in out.collect())


def test_published_fold_changes(spark):
    df = spark.createDataFrame(VOLCANO, "r double, t double, want double")
    assert all(abs(r.got - r.want) < 1e-9 for r in df.select("want", stats.log2fc(F.col("t"), F.col("r"), 0.5).alias("got")).collect())


def test_axis_positions(spark):
    df = spark.createDataFrame([(i, 1023) for i in range(4)], "i int, n int")
    got = [(r["start"], r["end"], r["center"]) for r in agg.block_positions(df, "i", F.col("i"), 25).orderBy("i").collect()]
    assert got[:2] == [(-0.5, 1022.5, 511.0), (1047.5, 2070.5, 1559.0)] and got[3] == (3143.5, 4166.5, 3655.0)


def test_huber_line_ignores_outliers(spark):
    rows = [(float(x), 2.0 * x + 1 + (0.01 if x % 2 else -0.01) - (50 if x % 17 == 0 else 0)) for x in range(100)]
    slope, intercept, _, _ = stats.huber_line(spark.createDataFrame(rows, "x double, y double"), "x", "y")
    assert slope == pytest.approx(2, abs=0.01) and intercept == pytest.approx(1, abs=0.3)


def test_collapse_conserves_counts_and_follows_chains(spark):
    rows = [(1, "AAAAAA", 1000), (1, "AAAAAT", 100), (1, "AAATTT", 10), (1, "GGGGGG", 5), (2, "AAAAAT", 7)]
    links = iterate.collapse_umis(spark.createDataFrame(rows, "id int, umi string, n int"), "id", "umi", "n", 6)
    got = {(r.id, r.umi): r.root for r in links.collect()}
    assert got == {(1, "AAAAAA"): "AAAAAA", (1, "AAAAAT"): "AAAAAA", (1, "AAATTT"): "AAAAAA", (1, "GGGGGG"): "GGGGGG", (2, "AAAAAT"): "AAAAAT"}
    assert iterate.collapsed_counts(links, "id", "n").agg(F.sum("n")).first()[0] == 1122


def test_merging_barcodes_conserves_reads():
    rows = pd.DataFrame([("AAAA", "u1", 5, "f", "i"), ("AAAA", "u2", 5, "f", "i"), ("AAAT", "u1", 4, "g", "i"), ("TTTT", "u3", 9, "f", "j"), ("AATT", "u9", 2, "f", None)], columns=["barcode", "umi", "reads", "feature", "identity"])
    kept, events = iterate.merge_barcodes("c", rows, least_reads=0)
    assert [k[0] for k in kept] == ["AAAA", "AATT", "TTTT"] and kept[0][2:] == (2, 14)
    assert events == [(1, "AAAT", "AAAA", 1, 1, 2, 4, 10, 1, 2, 14)]


def test_correction_is_the_same_for_quiet_and_busy_cells(spark):
    rows = [("a", "AAAA", "u1", 20, "f", "i"), ("a", "AAAT", "u2", 5, "g", "i"), ("b", "AAAA", "u1", 20, "f", "i"), ("b", "TTTT", "u2", 5, "g", "i")]
    kept, events = iterate.correct_barcodes(spark.createDataFrame(rows, "cell string, barcode string, umi string, reads long, feature string, identity string"), 4)
    assert sorted((r.cell, r.barcode, r.umis, r.reads) for r in kept.collect()) == [("a", "AAAA", 2, 25), ("b", "AAAA", 1, 20)]
    assert [(r.cell, r.candidate, r.seed, r.distance) for r in events.collect()] == [("a", "AAAT", "AAAA", 1)]


def test_fuzzy_context(spark):
    reads = [("TTGGAGTACGTACTCGGCAA",), ("TTGGAGTACGACTCGGCAA",), ("AAAAAAAAAAAA",), (None,)]
    got = values(spark, reads, "s string", match.best_context(F.col("s"), {"green": ["ACGTAC"], "red": ["TTTTTT"]}))
    assert [g[0] for g in got] == ["green", "green", None, None]


def test_interval_join(spark):
    blocks = spark.createDataFrame([(1, "c", 0, 10), (2, "c", 10, 20), (3, "c", 5, 16), (4, "c", 10, 15), (5, "x", 0, 9), (6, "c", 5, 5), (7, "c", 1, 2), (7, "c", 16, 18), (8, "c", 0, 2), (8, "c", 3, 9)], "id int, chrom string, start int, end int")
    genes = spark.createDataFrame([("c", 0, 10, "g"), ("c", 15, 30, "h")], "chrom string, start int, end int, gene string")
    want = {1: ("counted", "g"), 2: ("counted", "h"), 3: ("ambiguous", None), 4: ("no_feature", None), 5: ("no_feature", None), 6: ("no_feature", None), 7: ("ambiguous", None), 8: ("counted", "g")}
    for size in (1, 4, 64):
        assert {r.id: (r.status, r.gene) for r in match.overlaps(blocks, genes, ["id"], "gene", bin_size=size).collect()} == want


def test_adjustment_spreads_missing_and_equal_values(spark):
    """Rows without a p-value, or with the same one, do not meet in a task."""
    df = spark.range(20_000).select("id", F.when(F.col("id") % 10 == 0, F.col("id") / 20_000).when(F.col("id") % 10 == 1, F.lit(1.0)).alias("p"))
    q = stats.benjamini_hochberg(df, "p")
    assert q.count() == 20_000 and q.where("q is not null").count() == 4_000
    plan = df.sparkSession._jvm.PythonSQLUtils.explainString(q._jdf.queryExecution(), "simple")
    before_windows = [x for x in plan.split("\n") if "HashAggregate" in x and "partial_count" in x]
    assert before_windows  # values are counted before they are exchanged
    many = spark.createDataFrame([(g, p) for g in ("a", None) for p in (0.01, 0.01, 0.04, 0.03, None, 0.9)], "g string, p double")
    for r in stats.benjamini_hochberg(many, "p", keys=["g"]).collect():
        ps = sorted(x for x in (0.01, 0.01, 0.04, 0.03, 0.9))
        want = None if r.p is None else min(min(1.0, ps[i] * 5 / (i + 1)) for i in range(5) if ps[i] >= r.p)
        assert r.q == (None if want is None else pytest.approx(want))


def test_quantile_narrows_down_to_the_same_value(spark):
    rows = spark.range(5000).select((F.pmod(F.xxhash64("id"), F.lit(700)) ** 3 / 7.0).alias("v"))
    exact = rows.agg(F.percentile("v", F.array(*[F.lit(q) for q in (0.0, 0.05, 0.5, 0.77, 1.0)]))).first()[0]
    for q, want in zip((0.0, 0.05, 0.5, 0.77, 1.0), exact):
        assert stats.quantile(rows, F.col("v"), q, 5000, most=50) == pytest.approx(want, rel=1e-12)
        assert stats.quantile(rows, F.col("v"), q, 5000) == pytest.approx(want, rel=1e-12)


def test_patterns_are_expanded_whole(spark):
    patterns = spark.createDataFrame([("a" + "n" * 11,), ("acgt",), ("nn",)], "p string")
    got = match.expand_degenerate(patterns, "p", "b").agg(F.count("*"), F.count_distinct("b"), F.count_if(F.col("b").contains("n"))).first()
    assert tuple(got) == (4**11 + 1 + 16, 4**11 + 1 + 16, 0)


def test_marker_score_divides_by_the_markers_that_are_there(spark):
    expr = spark.createDataFrame([("a", 1, 2.0), ("b", 1, 4.0), ("c", 1, 9.0), ("a", 2, 1.0)], "gene string, cell int, expr double")
    markers = spark.createDataFrame([("a",), ("b",), ("zz",), ("a",)], "gene string")
    assert {r.cell: r.score for r in matrix.marker_score(expr, markers, expr).collect()} == {1: 3.0, 2: 0.5}
    genes = spark.createDataFrame([("a",), ("b",), ("c",), ("zz",)], "gene string")
    assert {r.cell: r.score for r in matrix.marker_score(expr, markers, genes).collect()} == {1: 2.0, 2: pytest.approx(1 / 3)}


def test_barcodes_merge_as_by_comparing_all(spark):
    """The mask index gives what scanning all pairs in order of support gives."""
    import random

    import pandas as pd

    def plain(rows, most=2):
        umis, reads, identity = {}, {}, {}
        for b, u, n, _, i in rows:
            umis.setdefault(b, set()).add(u)
            reads[b] = reads.get(b, 0) + n
            identity[b] = i or None
        support, events = (lambda b: (len(umis[b]), reads[b], b)), []
        while True:
            step = None
            for low in sorted(umis, key=support):
                for high in sorted((b for b in umis if b != low and identity[low] and identity[b] == identity[low]), key=support, reverse=True):
                    if (d := sum(x != y for x, y in zip(low, high))) <= most:
                        step = low, high, d
                        break
                if step:
                    break
            if not step:
                return events
            low, high, d = step
            umis[high] |= umis.pop(low)
            reads[high] += reads.pop(low)
            events.append((low, high, d, len(umis[high]), reads[high]))

    rng = random.Random(3)
    for _ in range(30):
        rows = [("".join(rng.choice("AC") for _ in range(7)), f"u{rng.randint(0, 30)}", rng.randint(1, 9), "f", rng.choice(["x", "y", None])) for _ in range(60)]
        identity = {r[0]: r[4] for r in rows}
        rows = [(b, u, n, f, identity[b]) for b, u, n, f, _ in rows]
        _, events = iterate.merge_barcodes("c", pd.DataFrame(rows, columns=["barcode", "umi", "reads", "feature", "identity"]))
        assert [(e[1], e[2], e[3], e[9], e[10]) for e in events] == plain(rows)


def test_fastq_sources(spark, tmp_path):
    with gzip.open(tmp_path / "a_1.fastq.gz", "wt") as f:
        f.write("@r1 x\nacgt\n+\nIIII\n@r2\nGGCC\n+\nIIII\n")
    (tmp_path / "b_1.fq").write_text("@r3\nTTTT\n+\nIIII\n")
    got = sorted((r.file, r.read_idx, r.read_id, r.seq, r.seq_len) for r in fastq.read_fastq(spark, str(tmp_path)).collect())
    assert got == [("a_1.fastq.gz", 0, "r1", "ACGT", 4), ("a_1.fastq.gz", 1, "r2", "GGCC", 4), ("b_1.fq", 0, "r3", "TTTT", 4)]
    assert fastq.read_pairs(spark, str(tmp_path / "b_1.fq"), str(tmp_path / "b_1.fq")).first()[2:] == ("TTTT", "TTTT")
    bad = tmp_path / "bad"
    bad.mkdir()
    (bad / "c.fastq").write_text("@r\nAC\n+\n")
    with pytest.raises(Exception, match="incomplete"):
        fastq.read_fastq(spark, str(bad)).collect()
    assert fastq.read_fastq(spark, str(bad), strict="false").count() == 1


def test_bam_and_gtf(spark, tmp_path):
    def rec(ref, pos, flag, ops, tags=b""):
        body = struct.pack("<iiBBHHHiiii", ref, pos, 2, 0, 0, len(ops), flag, 4, -1, -1, 0) + b"r\0" + b"".join(struct.pack("<I", n << 4 | "MIDNSHP=X".index(o)) for o, n in ops) + b"\x11\x11" + b"IIII" + tags
        return struct.pack("<i", len(body)) + body

    head = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 1) + struct.pack("<i", 2) + b"c\0" + struct.pack("<i", 1000)
    with gzip.open(tmp_path / "x.bam", "wb") as f:
        f.write(head + rec(0, 5, 0, [("M", 4)], b"ASC\x01NHC\x01") + rec(0, 5, 4, [("M", 4)]) + rec(0, 9, 0, [("M", 2), ("N", 5), ("M", 2)], b"XXZab\0NHi" + struct.pack("<i", 3)))
    bam = alignments.read_bam(spark, str(tmp_path))
    assert [(r.ref, r.pos, r.flag, r.nh) for r in bam.orderBy("read_idx").collect()] == [("c", 5, 0, 1), ("c", 5, 4, None), ("c", 9, 0, 3)]
    assert alignments.usable(bam).count() == 1
    (tmp_path / "g.gtf").write_text('#x\nc\ts\texon\t1\t10\t.\t+\t.\tgene_id "G"; gene_name "N";\nc\ts\texon\t5\t20\t.\t+\t.\tgene_id "G"; gene_name "N";\nc\ts\tgene\t1\t20\t.\t+\t.\tgene_id "G";\n')
    assert [(r.start, r.end, r.gene_id) for r in alignments.read_gtf(spark, str(tmp_path / "g.gtf")).collect()] == [(0, 20, "G")]


def test_tables(spark, tmp_path):
    (tmp_path / "r.txt").write_text("a\tg\tacgt\nb,g,TTTT\nc g cc\nshort\n\n")
    assert sorted(tuple(r) for r in tables.ragged_reference(spark.read.text(str(tmp_path / "r.txt"))).collect()) == [("a", "g", "ACGT"), ("b", "g", "TTTT"), ("c", "g", "CC")]
    (tmp_path / "s.csv").write_text("﻿id ;x\n1;2\n")
    assert tables.read_sniffed(spark, str(tmp_path / "s.csv"), ["id", "x"]).collect()[0].asDict() == {"id": "1", "x": "2"}
    with pytest.raises(ValueError, match="missing"):
        tables.read_strings(spark, str(tmp_path / "s.csv"), ["nope"])
    wide = spark.createDataFrame([("K", "0.5", "-1")], "model string, `A (12)` string, `B (x)` string")
    assert sorted((r.symbol, r.gene_id, r.score) for r in tables.wide_row(wide, "model", "K").collect()) == [("A", 12, 0.5), ("B", None, -1.0)]
    log = tmp_path / "logs"
    log.mkdir()
    (log / "a.log").write_text("x\nINFO Parameters: /opt/bin/mageck test -k t\nParameters: second\n")
    assert tables.logged_commands(spark, str(log)).collect()[0].command == "mageck test -k t"
    tables.write_table(wide, str(tmp_path / "out"), gz=True)
    assert any(n.endswith(".csv.gz") for n in os.listdir(tmp_path / "out"))
    assert tables.file_manifest(spark, str(log)).first().sha256 == provenance.sha256_file(str(log / "a.log"))
    with pytest.raises(ValueError, match="more than one"):
        tables.assert_unique(wide.unionByName(wide), "model")


def test_matrix_archive_and_xlsx(spark, tmp_path):
    import io
    import tarfile
    import zipfile

    with tarfile.open(tmp_path / "m.tar.gz", "w:gz") as tar:
        for name, text in (("x/features.tsv.gz", "g1\tA\tGene\ng2\tB\tGene\n"), ("x/barcodes.tsv.gz", "c1\n"), ("x/matrix.mtx.gz", "%%MatrixMarket\n2 1 1\n2 1 5\n")):
            data = gzip.compress(text.encode())
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    triples, features, cells = tables.read_matrix_archive(spark, str(tmp_path / "m.tar.gz"))
    assert [tuple(r) for r in triples.collect()] == [(1, 0, 5.0)] and features.count() == 2 and cells.first().barcode == "c1"
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>gene</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>n</t></is></c></row></sheetData></worksheet>')
    assert tables.xlsx_rows(str(tmp_path / "b.xlsx")) == [["gene", None, "n"]]


def test_small_groups(spark):
    rows = np.array([[0.0, 0], [10, 10], [0, 1], [10, 11]])
    order = small.leaf_order(rows)
    assert sorted(order) == [0, 1, 2, 3] and {order[0], order[1]} in ({0, 2}, {1, 3})
    df = spark.createDataFrame([(g, float(x + (5 if i else 0)), bool(i)) for g in "ab" for x in range(30) for i in (0, 1)], "g string, x double, i boolean")
    got = small.bootstrap_median_difference(df, ["g"], "x", "i").collect()
    assert all(r["diff"] == 5 and r["low"] <= 5 <= r["high"] for r in got)
    assert sorted(map(tuple, got)) == sorted(map(tuple, small.bootstrap_median_difference(df.repartition(3), ["g"], "x", "i").collect()))


def test_provenance(tmp_path):
    (tmp_path / "a.csv").write_text("x")
    manifest = {r["path"]: r["sha256"] for r in provenance.build_manifest(str(tmp_path))}
    assert provenance.check_package(str(tmp_path), manifest) == []
    (tmp_path / "a.csv").write_text("y")
    assert provenance.check_package(str(tmp_path), manifest | {"b": ""}) == ["a.csv: changed", "b: absent"]
    assert provenance.plain({"a": float("nan"), "b": np.int64(3)}) == {"a": None, "b": 3}
    ran = []
    provenance.run_steps({"one": lambda: ran.append(1), "two": lambda: ran.append(2)}, start_at="two")
    assert ran == [2]


def test_streamed_counts_equal_the_batch(spark, tmp_path):
    spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "k string, n long").repartition(3).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("k string, n long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = source.writeStream.foreachBatch(stream.merge_into(str(tmp_path / "out"), ["k"], "n")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert dict(stream.merged(spark, str(tmp_path / "out"), ["k"], "n").collect()) == {"a": 4, "b": 2}


def test_sqlite_rows_come_back_in_ranges(spark, tmp_path):
    import sqlite3

    path = str(tmp_path / "x.db")
    with sqlite3.connect(path) as db:
        db.execute('CREATE TABLE "umi store" (CellBC TEXT, Reads INTEGER, f REAL, b BLOB)')
        db.executemany('INSERT INTO "umi store" VALUES (?, ?, ?, ?)', [(f"c{i % 7}", i, i / 2, None if i % 5 else b"x") for i in range(1, 1001)])
        db.execute("CREATE TABLE none (a TEXT)")
    df = sqlite.read_sqlite(spark, path, "umi store", 4)
    assert df.dtypes == [("CellBC", "string"), ("Reads", "bigint"), ("f", "double"), ("b", "binary")] and df.rdd.getNumPartitions() == 4
    assert df.agg(F.count("*"), F.sum("Reads"), F.sum("f"), F.count("b")).first() == (1000, 500500, 250250.0, 200)
    assert sqlite.read_sqlite(spark, path, "none").count() == 0
    parts = sqlite.read_sqlite(spark, path, "umi store", 4, "CellBC").select("CellBC", F.spark_partition_id().alias("p")).distinct()
    assert parts.count() == 7
    with pytest.raises(Exception, match="no table"):
        sqlite.read_sqlite(spark, path, "other")


def test_snapshot_keys_must_be_those_wanted(spark, tmp_path):
    import json

    path = str(tmp_path / "s.json")
    with open(path, "w") as f:
        json.dump({"species": "human", "genes": {"A": {"name": "x"}, "B": {"name": "y", "n": 1}}}, f, indent=1)
    genes = lambda *g: spark.createDataFrame([(x,) for x in g], "gene string")
    got = {r.gene: json.loads(r.value) for r in tables.read_snapshot(spark, path, genes("A", "B", "A")).collect()}
    assert got == {"A": {"name": "x"}, "B": {"name": "y", "n": 1}}
    with pytest.raises(ValueError, match="missing .'C'., extra .'B'."):
        tables.read_snapshot(spark, path, genes("A", "C"))


def test_joins_are_validated(spark):
    a, b = spark.createDataFrame([(1,), (1,), (2,)], "k int"), spark.createDataFrame([(1, "x"), (3, "y")], "k int, v string")
    assert tables.validated_join(a, b, ["k"]).count() == 3
    for kind in ("one_to_one", "one_to_many"):
        with pytest.raises(ValueError, match="more than one row"):
            tables.validated_join(a, b, ["k"], validate=kind)


def test_column_rules(spark):
    row = spark.createDataFrame([(1.5, float("nan"), float("inf"), None, "True", "no")], "a double, b double, c double, d double, t string, f string")
    got = row.select(*[columns.finite(F.col(c)).alias(c) for c in "abcd"], columns.truthy(F.col("t")).alias("t"), columns.truthy(F.col("f")).alias("f"), columns.clipped(F.col("a"), 2.0, 3.0).alias("low"), columns.clipped(F.col("a"), high=1.0).alias("high")).first()
    assert tuple(got) == (True, False, False, False, True, False, 2.0, 1.0)
    assert columns.no_nan(row).select("b").first().b is None
    assert tables.first_present(spark.createDataFrame([(1,)], "Gene int"), "id", "gene") == "Gene"
    assert seq.safe_name("a b/c") != "a b/c"
    assert values(spark, [("xxGAAGACGTACGTACGTACGTTGAA",)], "s string", seq.captured(F.col("s"), "GAAG([ACGT]{16})TGAA"))[0][0] == "ACGTACGTACGTACGT"


def test_same_named_files_of_several_folders(spark, tmp_path):
    for folder in ("a", "b"):
        (tmp_path / folder).mkdir()
        with gzip.open(tmp_path / folder / "s.fastq.gz", "wt") as f:
            f.write(f"@r {folder}\nacgt\n+\nIIII\n")
    got = fastq.read_fastq(spark, f"file://{tmp_path}/*/s.fastq.gz")
    assert {(r.file, r.read_idx, r.seq) for r in got.collect()} == {("s.fastq.gz", 0, "ACGT")} and got.select("path").distinct().count() == 2
    with open(tmp_path / "t.fastq", "w") as f:
        f.write("@r\nacgt\n+\n")
    with pytest.raises(Exception, match="quality"):
        fastq.read_fastq(spark, f"{tmp_path}/t.fastq", strict="false", quality="true").collect()
    assert fastq.read_fastq(spark, f"{tmp_path}/t.fastq", strict="false").count() == 1


def test_tails_in_chunks_equal_whole_sums(monkeypatch):
    """Sums in chunks that end early, against every term at once."""
    def whole(x, n, p, rho):
        kappa = 1 / rho - 1
        a, b = p * kappa, (1 - p) * kappa
        k = np.arange(x, n + 1, dtype=float)
        logs = special.log_choose(n, k) + special._LGAMMA(k + a) + special._LGAMMA(n - k + b) - math.lgamma(n + a + b) - (math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b))
        return min(1.0, math.exp(special.log_sum(logs)))

    monkeypatch.setattr(special, "CHUNK", 7)
    for n in (1, 5, 40, 300):
        for x in range(1, n + 1, max(1, n // 13)):
            for p in (0.001, 0.2, 0.5, 0.93):
                assert special.betabinomial_tail(x, n, p, 0.05) == pytest.approx(whole(x, n, p, 0.05), rel=1e-9, abs=1e-12)
                exact = sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(x, n + 1))
                assert special.binomial_tail(x, n, p) == pytest.approx(exact, rel=1e-9, abs=1e-12)


def test_clustering_is_bounded(spark):
    with pytest.raises(ValueError, match="more than 3 rows"):
        small.clustered(spark.range(5).select(F.col("id").alias("n"), F.lit(1.0).alias("x")), "n", ["x"], 3)


def test_robust_line_equals_plain_reweighting(spark):
    """The line of ``huber_line``, and its median residual and sigma, by numpy alone; also where quantiles are narrowed down."""
    rng = np.random.default_rng(6)
    x = rng.normal(0, 2, 400).round(3)
    y = 1.5 * x - 0.7 + rng.standard_t(2, 400).round(3)
    slope, intercept = np.polyfit(x, y, 1)
    for _ in range(100):
        r = y - slope * x - intercept
        middle = np.median(r)
        sigma = 1.4826 * np.median(np.abs(r - middle))
        size = np.abs(r - middle) / (1.345 * sigma)
        w = np.where(size <= 1, 1, 1 / np.maximum(size, 1e-300))
        d = w.sum() * (w * x * x).sum() - (w * x).sum() ** 2
        new = (w.sum() * (w * x * y).sum() - (w * x).sum() * (w * y).sum()) / d
        moved, slope = abs(new - slope), new
        intercept = ((w * y).sum() - slope * (w * x).sum()) / w.sum()
        if moved < 1e-12:
            break
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)] + [(None, 1.0)], "x double, y double")
    assert stats.huber_line(df, "x", "y") == pytest.approx((slope, intercept, middle, sigma), rel=1e-6, abs=1e-6)
