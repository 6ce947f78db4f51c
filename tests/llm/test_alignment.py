"""Cross-tokenizer alignment against plain Python."""

import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tallyseq.llm import alignment

from .helpers import LONG, documents, save

p = pytest.importorskip("public_tokenizers")
COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def plain(rows):
    """The contract's rows by the libraries' own calls on whole texts and a walk over both token lists."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(p.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=p.path("piece_bpe_32k.model"))
    mapped = {c: i for i, c in enumerate(alignment.byte_characters())}
    aligned = []
    for doc_id, text in rows:
        groups, links = [], []
        if text:
            ids = a.encode(" " + text, add_special_tokens=False).ids
            spelt_a = [bytes(mapped[c] for c in a.id_to_token(i)) for i in ids]
            other = b.encode(text)
            spelt_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in other]
            if b"".join(spelt_a) == b"".join(spelt_b) == (" " + text).encode():
                i = j = at_a = at_b = 0
                group = ([], [])
                while i < len(ids) and j < len(other):
                    links.append((ids[i], other[j]))
                    end_a, end_b = at_a + len(spelt_a[i]), at_b + len(spelt_b[j])
                    if end_a <= end_b:
                        group[0].append(ids[i])
                        i, at_a = i + 1, end_a
                    if end_b <= end_a:
                        group[1].append(other[j])
                        j, at_b = j + 1, end_b
                    if end_a == end_b:
                        groups.append(group)
                        group = ([], [])
        aligned.append((doc_id, groups, links))
    counts = Counter(pair for _, _, links in aligned for pair in set(links))
    most = defaultdict(int)
    for (x, _), n in counts.items():
        most[x] = max(most[x], n)
    for doc_id, groups, links in aligned:
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        yield (doc_id, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(links), sum(counts[x] == most[x[0]] for x in links), sum(counts[x] for x in links), hashlib.sha256(said.encode()).hexdigest() if groups else "")


TEXTS = [
    "The quick brown fox's jump, over  two   lazy\tdogs.\n And newlines\r\n\n  end ", "", None, "▁ a text with the other's space", "<|endoftext|> <s> </s> <unk> <0x41> are plain", " leading", "trailing ", " ", "  ", "\n",
    "漢字仮名交じり文を空白なしで書くと長い断片になる" * 9, "🎉👩‍👩‍👧 é  no-break　wide  em", "a\x00b", "über Österreich naïve ÀÉÎ", "x" * 500, "1234567890.55e-7", "the the the", "the the the",
]


@pytest.mark.parametrize("limit", [alignment.BROADCAST_PAIRS, 3])
def test_rows_equal_the_libraries_own_calls(spark, tmp_path, limit):
    rows = [*enumerate(TEXTS), (7, "a repeated id"), (None, "no id"), (30, LONG[:40_000])]
    save(spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("links", F.lit(1)), tmp_path)
    got = [tuple(r[c] for c in ["doc_id", *COLUMNS]) for r in alignment.op11_alignment(spark, str(tmp_path), limit).collect()]
    assert sorted(got, key=repr) == sorted(plain(rows), key=repr)


def test_long_pieces_are_placed_as_short_ones(spark, monkeypatch):
    rows = [*enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    args = (docs, ["doc_id"], p.path("byte_bpe_50k.json"), p.path("piece_bpe_32k.model"))
    want = sorted(map(repr, alignment.align(*args).collect()))
    for short in (0, 10**9):
        monkeypatch.setattr(alignment, "SHORT", short)
        assert sorted(map(repr, alignment.align(*args).collect())) == want


def test_columns_are_kept_but_not_those_that_are_made(spark):
    docs = documents(spark, extra=True)
    keep = ["doc_id", "whole_text", "text", "lang"]
    got = alignment.align(docs, keep, p.path("byte_bpe_50k.json"), p.path("piece_bpe_32k.model"))
    assert got.columns == [*keep, *alignment.MADE] and got.count() == docs.count()
    with pytest.raises(ValueError):
        alignment.align(docs.withColumn("links", docs.doc_id), ["links"], p.path("byte_bpe_50k.json"), p.path("piece_bpe_32k.model"))


def test_words_of_one_shape_are_aligned_once(spark):
    words = [a + b + c for a in ("ka", "lo", "mi") for b in ("ren", "tus", "vol") for c in ("da", "qui", "xe")]
    docs = spark.createDataFrame([(0, " ".join(words)), (1, "漢字仮名 " + " ".join(words)), (2, "▁ a"), (3, None)], "doc_id long, text string").coalesce(1)
    vocabulary, model = p.path("byte_bpe_50k.json"), p.path("piece_bpe_32k.model")
    (row,) = alignment.tokenise(docs, ["doc_id"], vocabulary, model).collect()
    a, b = alignment.first_side(vocabulary), alignment.second_side(model)
    shapes = list(zip(row.a_ends, row.b_ends))
    assert len(set(map(repr, shapes))) == len(shapes) < len(row.ids)
    spelt = set()
    for ids, s in zip(row.ids, row.shape):
        n = len(row.a_ends[s])
        for side, base, own, ends, cover in ((a, 0, ids[:n], row.a_ends[s], row.a_cover[s]), (b, n, ids[n:], row.b_ends[s], row.b_cover[s])):
            lengths = [int(side.lengths[i]) for i in own]
            assert ends == [sum(lengths[: k + 1]) for k in range(len(own))]
            assert cover == [base + k for k, size in enumerate(lengths) for _ in range(size)]
        spelt.add(b"".join(a.spelt[i] for i in ids[:n]).decode())
    assert {" " + w for w in words} <= spelt
    assert [t.n_a for t in row.texts] == [sum(len(row.a_ends[row.shape[c]]) for c in t.pieces) for t in row.texts]
