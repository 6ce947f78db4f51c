"""Spelling variants against a comparison of all words."""

import random
import re
import zlib
from collections import Counter

from tallyseq.llm import spelling

from .helpers import save


def plain_words(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                i = h % len(run)
                run = run[:i] + run[i + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(words):
    form, out = {}, {}
    for w, n in words.items():
        others = [o for o in words if abs(len(o) - len(w)) <= 1 and o != w and near(w, o)]
        best = min(others, key=lambda o: (-words[o], o), default=None)
        form[w] = best if best is not None and words[best] >= 5 * n else None
        out[w] = len(others)
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        yield (w, form[w], root, words[w], out[w], words.get(form[w]))


def damaged(rng, word):
    i = rng.randrange(len(word))
    return rng.choice([word[:i] + word[i + 1 :], word[:i] + rng.choice("abé") + word[i:], word[:i] + rng.choice("abé") + word[i + 1 :]])


def corpus(seed=3, lengths=(5, 9)):
    rng = random.Random(seed)
    texts = []
    for _ in range(40):
        base = "".join(rng.choice("aabéc") for _ in range(rng.randint(*lengths)))
        words, size = [base], 3
        for _ in range(3):
            words.append(damaged(rng, words[-1]))
        for w in words:
            texts.append((rng.randrange(10**6), " ".join([w, w.upper() if w.isascii() else w] * rng.choice([3, 4, 20, 100, 700])) + "; " + damaged(rng, base)))
            size *= 5
    return texts


def check(spark, tmp_path, rows):
    save(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), tmp_path)
    got = sorted(map(repr, (tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in spelling.op13_spelling(spark, str(tmp_path)).collect())))
    want = sorted(map(repr, plain(plain_words(rows))))
    assert got == want and len(want) > 20
    return want


def test_rows_equal_a_comparison_of_all_words(spark, tmp_path):
    rows = corpus() + [(None, "Nullid nullid NULLID nullid nullid nullod " * 5), (1, None), (2, ""), (3, "x" * 6 + " aaaaaaa aaaaaab aaaaaa aaaaaba" * 6)]
    rows += [(i, "repeated words of a repeated row, straße Straße ÉTÉÉTÉ étéété") for i in range(9)] * 2
    want = check(spark, tmp_path, rows)
    assert any("None" not in w.split(",")[1] for w in want)


def test_long_words_by_hashes_equal_short_ones(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(spelling, "LONG", 7)
    check(spark, tmp_path, corpus(5))


def test_words_of_megabytes(spark, tmp_path):
    a = "ab" * 300_000
    b = a[:1000] + "c" + a[1001:]
    words = spark.createDataFrame([(a, 50), (b, 5), (a[1:], 7), (a[1:-1], 300), ("x" * 64, 5), ("x" * 65, 26)], "word string, n long")
    got = {r.word: (r.form, r.root, r.n_near, r.form_n) for r in spelling.variants(words).collect()}
    assert got[a] == (None, a, 2, None) and got[b] == (a, a, 1, 50)
    assert got[a[1:]] == (a[1:-1], a[1:-1], 2, 300) and got[a[1:-1]] == (None, a[1:-1], 1, None)
    assert got["x" * 64] == ("x" * 65, "x" * 65, 1, 26)


def test_forms_follow_one_another(spark):
    words = [("wordaaaa", 5), ("wordaaab", 25), ("wordaabb", 125), ("wordabbb", 625), ("wordbbbb", 3125), ("other", 9)]
    got = {r.word: (r.form, r.root) for r in spelling.variants(spark.createDataFrame(words, "word string, n long")).collect()}
    assert got["wordaaaa"] == ("wordaaab", "wordbbbb") and got["other"] == (None, "other")
