"""Operators against brute force, exact round trips and held-out accuracy."""

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyseq.llm import binary_tokens, bpe, chunks, components, decontaminate, media, near_dedup, registry, sharding, simhash, suffix_tree, toxicity, url_filter, warc

from .helpers import LONG, documents, save

p = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sf(spark):
    import os

    if not os.path.isdir(SF):
        pytest.skip("no test data")
    return SF


def test_urls_inline_and_joined_agree_with_plain_matching(spark):
    urls = [f"{s}://{h}{q}" for s in ("http", "x") for h in ("example.com", "a.Example.com", "notexample.com", "net", "b.net", "org.", "example.net") for q in ("", "/", "/en/7", "/en/", "/de/88?x", "/es/#a", "/EN/")]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = url_filter.CONTRACT_RULES + url_filter.GENERAL_RULES
    a = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(df, rules).collect()}
    b = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(df, rules, inline=0).collect()}
    assert a == b
    plain = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "block"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = rest[:end].lower(), rest[end:].split("?")[0].split("#")[0]
        fit = max(((len(h + q), h + q, v) for h, q, v in plain if (host == h or host.endswith("." + h)) and path.startswith(q)), default=None)
        assert a[i] == (host, path, fit and fit[1], fit[2] if fit else "allow")


def test_rules_are_filed_under_their_rarest_whole_token():
    r = url_filter.host_rule("example.com", "/en/7", "allow")
    assert r.tokens == ("example", "com", "en")  # 7 may go on, so it is no whole token
    assert url_filter.index_rules([r], {"com": 9, "example": 5, "en": 7})[0][0] == "example"
    assert url_filter.pattern_rule("*a*", "block").tokens == ()


def test_golay_code_is_perfect_and_keys_lose_no_link():
    words = np.arange(1 << 23)
    assert (np.bincount(simhash.golay_index(words), minlength=4096) == 2048).all()  # balls of radius 3 fill the space
    rng = random.Random(1)
    for _ in range(300):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), rng.randint(0, 3)):
            y ^= 1 << b
        kx, ky = (set(simhash.keys_of(np.array([v], np.uint64))[0].tolist()) for v in (x, y))
        assert kx & ky


def test_fingerprint_follows_the_contract():
    import xxhash

    text = "One two\tthree Four five two three"
    words = text.lower().split()
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(len(words) - 2)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash.fingerprint(text.encode()) == want
    assert simhash.fingerprint(b" \n") == 0
    assert simhash.fingerprint(b"One") == xxhash.xxh64_intdigest(b"one", 42)


def _classes(n, links):
    label = list(range(n))
    for _ in range(n):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return label


def test_simhash_components_match_brute_force(spark, sf):
    rows = simhash.op2_simhash(spark, sf).collect()
    fps = sorted({int(r.fingerprint, 16) for r in rows})
    links = [(i, j) for i, j in itertools.combinations(range(len(fps)), 2) if bin(fps[i] ^ fps[j]).count("1") <= 3]
    label = dict(zip(fps, _classes(len(fps), links)))
    least = {}
    for r in rows:
        k = label[int(r.fingerprint, 16)]
        least[k] = min(least.get(k, r.doc_id), r.doc_id)
    assert all(r.component_id == least[label[int(r.fingerprint, 16)]] for r in rows)


def test_large_groups_give_few_links_and_one_class(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 64)
    near = [(1 << a) | (1 << b) for a, b in itertools.combinations(range(20), 2)] + [0]
    nodes = spark.createDataFrame([(v, v) for v in near], "node long, f0 long")
    links = simhash.golay_links(nodes, ["f0"]).distinct()
    roots = components.components(links).collect()
    assert {r.root for r in roots} == {0} and len(roots) == len(near)


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[100 + i] == 100 for i in range(30))


def test_near_dedup_keeps_one_of_each_class(spark):
    base = [f"w{i}" for i in range(200)]
    edited = base[:100] + ["changed"] + base[101:]
    other = [f"z{i}" for i in range(200)]
    rows = [(1, " ".join(base)), (2, " ".join(edited)), (3, " ".join(other)), (4, " ".join(base)), (4, " ".join(base)), (5, None), (6, ""), (None, "Alone here")]
    kept = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0) for r in kept) == [0, 1, 3, 5]


def test_near_dedup_finds_block_edits(spark):
    """Copies cut short, lengthened or with a passage replaced, all at 0.8 or more, against brute force."""
    rng = np.random.default_rng(11)
    texts = []
    for _ in range(60):
        n = int(rng.integers(200, 1000))
        base = [f"v{x}" for x in rng.zipf(1.3, n) % 5000]
        new = [f"n{x}" for x in rng.integers(0, 1 << 40, n)]
        k, c, m = n * 19 // 100, n * 10 // 100, n // 3
        texts += [base, base[: n - k], base + new[: n * 24 // 100], base[:m] + new[:c] + base[m + c :], base[k:]]
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    links = [(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    label = _classes(len(sets), links)
    want = sorted({min(i for i, x in enumerate(label) if x == k) for k in label})
    assert len(links) > 200
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert sorted(r.doc_id for r in near_dedup.near_dedup(docs).collect()) == want


def _planted(seed, groups, edit):
    """Texts and near copies of them, edited in scattered words, a cut, an addition or a replaced passage, as the share ``edit`` allows."""
    rng = np.random.default_rng(seed)
    texts = []
    for _ in range(groups):
        n = int(rng.integers(40, 600))
        base = [f"v{x}" for x in rng.zipf(1.3, n) % 5000]
        new = [f"n{x}" for x in rng.integers(0, 1 << 40, n)]
        k, m = max(1, int(n * edit)), n // 3
        scattered = list(base)
        for i in rng.choice(n, max(1, k // 5), replace=False):
            scattered[i] = new[i]
        texts += [base, scattered, base[: n - k], base + new[:k], base[:m] + new[: k // 2] + base[m + k // 2 :]]
    return texts


def _jaccard_classes(texts):
    sets = [{tuple(t[i : i + 5]) for i in range(max(1, len(t) - 4))} for t in texts]
    links = [(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])]
    label = _classes(len(sets), links)
    return links, sorted({min(i for i, x in enumerate(label) if x == k) for k in label})


@pytest.mark.parametrize("exact", [False, True])
def test_near_dedup_equals_brute_force_on_planted_copies(spark, monkeypatch, exact):
    """Both ways find every link of near copies at 0.8 or more, also where groups are dealt in blocks."""
    monkeypatch.setattr(near_dedup, "GROUP", 3)
    monkeypatch.setattr(near_dedup, "GROUP_BYTES", 4000)
    monkeypatch.setattr(near_dedup, "BLOCK", 2)
    texts = _planted(4, 40, 0.15)
    links, want = _jaccard_classes(texts)
    assert len(links) > 100
    docs = spark.createDataFrame([(f"id{i:05d}", " ".join(t), i) for i, t in enumerate(texts)], "doc_id string, text string, _h long")
    kept = near_dedup.near_dedup(docs, exact)
    assert kept.columns == docs.columns
    assert sorted(r._h for r in kept.collect()) == want


def test_near_dedup_joins_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BROADCAST_KEYS", 0)
    texts = _planted(6, 10, 0.1)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts + texts[:3])], "doc_id long, text string")
    assert sorted(r.doc_id for r in near_dedup.near_dedup(docs).collect()) == _jaccard_classes(texts)[1]


def test_similar_sets_are_joined_exactly():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, 40)) for _ in range(40)]
    want = _classes(40, [(i, j) for i, j in itertools.combinations(range(40), 2) if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))])
    assert _classes(40, near_dedup.similar(sets)) == want


TEXTS = ["", " ", "a  b \n c", "it's we'll 'd  x", "\n\n a\n", " \x1c b", "a\x1c \x85 b　 c", "é. É\nb, 12 3.4\t x", "<|endoftext|> a", "a.\nb.", "漢字 ab́ c", "don't.\nWe're", " " * 50 + "x" + " " * 3, "ab" * 3000, "▁▁ ▁a<s>", LONG[:5000]]


SPECIAL = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y  <|endoftext|>  z", " <|endoftext|>'s it's", "<|endoftext|><|endoftext|>\n <|endof text|>", "many words stand here <|endoftext|>, and <|endoftext|>. more"]


@pytest.mark.parametrize("name", ["byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken"])
def test_bpe_equals_the_library_and_round_trips(name):
    import tiktoken

    code = bpe.Codec(p.path(name), p.PATTERN)
    own = tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=code.whole, special_tokens={})
    rng = random.Random(2)
    letters = "abcXYZ é漢🎉 \n\t\x00\x1c\x85\xa0　'.,!?01٣ÀñΩא﻿|▁"
    texts = TEXTS + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(500)]
    for text, ids in zip(texts, code.encode(pa.array(texts)[:])):
        assert list(ids) == own.encode_ordinary(text), text
        assert code.decode(ids) == text.encode()


def _library_ids(texts):
    import tiktoken

    own = tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=bpe.Codec(p.path("byte_bpe_multi_50k.tiktoken"), p.PATTERN).whole, special_tokens={})
    return [own.encode_ordinary(t or "") for t in texts]


def _sha(data):
    return hashlib.sha256(data).hexdigest()


def test_bpe_query_equals_the_library(spark, sf, tmp_path):
    """Counts and digests of whole texts, those of the test data and odd ones."""
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()] + TEXTS + SPECIAL + [None]
    folder = save(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), tmp_path)
    got = {r.doc_id: r for r in bpe.op3_byte_bpe(spark, folder).collect()}
    for i, (text, ids) in enumerate(zip(texts, _library_ids(texts))):
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), _sha(",".join(map(str, ids)).encode()), _sha((text or "").encode())), text


def test_pieces_start_at_spaces_after_no_white_space():
    texts = [*TEXTS, *(f"a{c} b {c}{c} c{c}" for c in chunks.SPACES), *(f"{c} x" for c in "àá…é0\u2010\u3001"), ""]
    column = pa.array(["cut off", *texts])[1:]
    data, offsets = chunks.column_bytes(column)
    first = set(chunks.bounds(data, offsets).tolist())
    import public_tokenizers
    import regex

    assert chunks.CLASSES == public_tokenizers.PATTERN
    rng = random.Random(5)
    signs = ["a", "B", "7", "'", "s", "'s", "'t", "'ve", ".", ",", "&", "_", " ", "  ", "\n", "\n\n", "\t", "é", "í\u0301", "٣", "\u3000", "…", "’", "漢", "🎉", "-", '"', "x\n", "<|endoftext|>"]
    mixed = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 25))) for _ in range(4000)] + texts
    d, at = chunks.column_bytes(pa.array(mixed))
    cuts = chunks.bounds(d, at, classes=True)
    for text, low, high in zip(mixed, at, at[1:]):
        raw, own = text.encode(), [*cuts[(cuts >= low) & (cuts < high)] - low, high - low]
        pieces = [raw[i:j].decode() for i, j in zip(own, own[1:])]
        assert [t for piece in pieces for t in regex.findall(chunks.CLASSES, piece)] == regex.findall(chunks.CLASSES, text), text
    for text, low, high in zip(texts, offsets, offsets[1:]):
        want = {len(text[:i].encode()) for i in range(1, len(text)) if text[i] == " " and text[i - 1] not in chunks.SPACES} | ({0} if text else set())
        assert {x - low for x in first if low <= x < high} == want, text


def test_generations_of_pieces_give_the_same_ids():
    cache = chunks.PieceCache(lambda ps: [np.array([len(p), 7], "<u4").tobytes() for p in ps], "<u4", limit=3, longest=4)
    texts = ["aa bb cc dd ee", "", "aa longerpiece bb", " aa  bb", "cc dd ee ff gg hh"] * 3
    for low in range(0, len(texts), 2):
        ids, counts = cache.of(pa.array(texts[low : low + 2]))
        pieces = [[]if not t else [p for p in __import__("re").findall(r"(?:^| )? *[^ ]+", t)] for t in texts[low : low + 2]]
        assert counts.tolist() == [2 * len(p) for p in pieces]
        assert ids[::2].tolist() == [len(x) for p in pieces for x in p]


def test_token_files_equal_the_library(spark, sf, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(p.path("byte_bpe_50k.json"))
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()] + TEXTS + SPECIAL
    rng = random.Random(7)
    signs = ["a", "Be", "7", "'", "'s", "'ve", ".", "&&", " ", "  ", "\n", "\n\n", "\t", "é", "\u3000", "…", "’", "漢", " the", "endoftext", "<|", "|>", "<|endoftext|>"]
    texts += ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(800)]
    docs = list(enumerate(texts))
    folder = save(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), tmp_path)
    got = {r.doc_id: r for r in binary_tokens.op7_binary_tokens(spark, folder).collect()}
    start = 0
    for doc_id, text in docs:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        assert (got[doc_id].start, got[doc_id].n_tokens, got[doc_id].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_images_decode_resize_and_hash():
    rng = np.random.default_rng(1)
    for shape in ((5, 7), (5, 7, 3), (24, 24), (1, 1)):
        a = rng.integers(0, 256, shape, dtype=np.uint8)
        assert (media.decode_image(media.encode_netpbm(a)) == a).all() and (media.decode_image(media.encode_bmp(a)) == a).all()
    assert (media.decode_image(b"P2\n# c\n2 1\n255\n7 9\n") == [[7, 9]]).all()
    assert (media.decode_image(b"P4\n9 1\n\x80\x00") == [[0] + [255] * 8]).all()
    a = rng.integers(0, 256, (13, 29)).astype(float)
    exact = np.repeat(np.repeat(a, 4, 0), 6, 1).reshape(4, 13, 6, 29).mean((1, 3))
    assert np.allclose(media.area_resize(a, 4, 6), exact)
    with pytest.raises(ValueError):
        media.decode_image(b"GIF89a")


def _exact_means(image, rows, columns):
    """Area means by repeating every sample."""
    big = np.repeat(np.repeat(image.astype(float), rows, 0), columns, 1)
    return big.reshape(rows, image.shape[0], columns, image.shape[1]).mean((1, 3))


def test_media_query_equals_plain_images(spark, odd):
    """Payload, stored form, feature and tile of every text, made again without the operator."""
    import io
    import struct

    kinds = set()
    texts = sorted(documents(spark).collect(), key=lambda r: (r.doc_id or 0))
    for r, t in zip(sorted(media.op4_media(spark, odd).collect(), key=lambda r: (r.doc_id or 0, r.payload_sha256)), texts):
        raw = (t.text or "").encode()
        pad = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-32:]))
        rows = len(pad) // 24
        palette = b"".join(bytes([g, g, g, g]) for g in range(256))
        bitmap = b"BM" + struct.pack("<IHHIIiiHHIIiiII", 1078 + len(pad), 0, 0, 1078, 40, 24, -rows, 1, 8, 0, len(pad), 2835, 2835, 256, 0) + palette
        stored = (b"P5\n24 %d\n255\n" % rows if zlib.crc32(raw) % 2 == 0 else bitmap) + pad
        kinds.add(stored[:2])
        assert (r.media_bytes, r.media_sha256, r.width, r.height) == (len(stored), hashlib.sha256(stored).hexdigest(), 24, rows)
        if rows > 1000:
            continue
        tile = np.rint(_exact_means(np.frombuffer(pad, np.uint8).reshape(rows, 24), 16, 16)).astype(np.uint8)
        small = np.round(_exact_means(tile, 8, 9), 6)
        assert r.feature == np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()
        file = io.BytesIO()
        np.save(file, tile)
        assert r.tile_sha256 == hashlib.sha256(file.getvalue()).hexdigest()
    assert len(kinds) == 2


def test_tiles_are_written_and_read(spark, tmp_path):
    images = spark.createDataFrame([(i, bytearray(media.encode_netpbm(np.full((9, 9), i, np.uint8)))) for i in range(5)] + [(9, None), (10, bytearray(b"no"))], "slot long, media binary")
    found = media.media_features(images, "media", ["slot"])
    placed = media.write_tiles(found, f"file://{tmp_path}/t")
    assert placed.columns[-2:] == ["file", "_slot"]
    for r in placed.collect():
        assert (r.file is None) == (r.slot >= 9)
        if r.file:
            assert (np.load(r.file.removeprefix("file://"))[r._slot] == r.slot).all()
    assert found.where("media_error is not null").count() == 1
    got = media.read_tiles(placed, "file", "_slot").collect()
    assert len({r.tile_sha256 for r in got}) == 6 and sum(r.dhash is None for r in got) == 2


def test_base_scores_are_exact_and_contexts_help(spark, sf):
    rows = {r.doc_id: r for r in suffix_tree.op5_suffix_tree(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    counts = Counter(w for d in docs if not held(d.doc_id) for w in [*d.text.encode().lower().split(), "end"])
    n, v = sum(counts.values()), len(counts)
    for d in docs:
        words, r = [*d.text.encode().lower().split(), "end"], rows[d.doc_id]
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words), rel=1e-9)
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(words), sum(w in counts for w in words), n, held(d.doc_id))
    unseen = [r for r in rows.values() if r.held_out]
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen)


class _PlainTree:
    """The tree of the module's description, by dictionaries."""

    def __init__(self, texts, depth):
        self.depth, self.grams, self.totals = depth, Counter(), Counter()
        self.words = Counter(w for t in texts for w in t)
        self.n = sum(self.words.values())
        for t in texts:
            for i in range(len(t)):
                for k in range(1, min(i, depth) + 1):
                    self.grams[t[i - k : i], t[i]] += 1
                    self.totals[t[i - k : i]] += 1
        self.entries = {}
        for (c, x), n in self.grams.items():
            if n >= 2:
                self.entries.setdefault(c, {})[x] = n
        self.left = {}
        for c in sorted(self.entries, key=len):
            short = {x: self.value(c[1:], x) for x in self.entries[c]}
            own = {x: (n - 0.5) / self.totals[c] for x, n in self.entries[c].items()}
            room = 1 - sum(10**v for v in short.values())
            if room <= 1e-6:
                continue
            left = math.log10(1 - sum(own.values())) - math.log10(room)
            gain = sum(n * (math.log10(own[x]) - short[x]) for x, n in self.entries[c].items()) + (self.totals[c] - sum(self.entries[c].values())) * left
            if gain > 0.5 * math.log10(self.n) * len(own):
                self.left[c] = left

    def value(self, history, x):
        out = math.log10((self.words[x] + 1) / (self.n + len(self.words) + 1))
        for k in range(1, min(len(history), self.depth) + 1):
            c = history[len(history) - k :]
            if c in self.left:
                n = self.entries[c].get(x)
                out = math.log10((n - 0.5) / self.totals[c]) if n else self.left[c] + out
        return out

    def score(self, text):
        return sum(self.value(text[max(0, i - self.depth) : i], text[i]) for i in range(len(text)))


def _symbols(text):
    return (*(text or "").encode().lower().split(), None)


@pytest.mark.parametrize("split", [10, 20_000])
def test_tree_scores_equal_plain_dictionaries(spark, sf, monkeypatch, split):
    """Blocks of a few hundred tokens, contexts dealt over parts, whole texts of the test data and repeated ones."""
    monkeypatch.setattr(suffix_tree, "BLOCK", 700)
    monkeypatch.setattr(suffix_tree, "SPLIT", split)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(60).collect()]
    rng = random.Random(4)
    rows += [(1000 + i, " ".join(rng.choice("abcde") for _ in range(rng.randint(0, 60)))) for i in range(60)] + [(2000, None), (2001, "")]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("trains", F.expr("crc32(cast(cast(doc_id as string) as binary)) % 7 <> 2"))
    got = {r.doc_id: r for r in suffix_tree.scores(docs, ["doc_id"], "trains").collect()}
    tree = _PlainTree([_symbols(t) for i, t in rows if not held(i)], suffix_tree.DEPTH)
    assert {len(c) for c in tree.left} == {1, 2, 3}
    for i, t in rows:
        assert got[i].score == pytest.approx(tree.score(_symbols(t)), rel=1e-4, abs=1e-4), t
    for c in random.Random(1).sample(sorted(tree.left, key=repr), 20):
        unseen = tree.value(c, "never seen")
        assert sum(10 ** tree.value(c, x) for x in tree.words) + 10**unseen == pytest.approx(1, abs=1e-6)


def test_tree_learns_what_occurs_twice(spark):
    """The model grows with the corpus: texts that stand in it twice are told apart, however few they are."""
    rng = random.Random(9)
    made = [" ".join(f"v{rng.randint(0, 300)}" for _ in range(80)) for _ in range(220)]
    docs = spark.createDataFrame(list(enumerate(made + made[:20])), "doc_id long, text string").withColumn("trains", F.lit(True))
    gain = {r.doc_id: (r.score - r.base_score) / r.n_tokens for r in suffix_tree.scores(docs, ["doc_id"], "trains").collect()}
    assert min(gain[i] for i in range(20)) > max(gain[i] for i in range(20, 220)) + 0.5


def test_no_training_texts_and_no_texts(spark):
    docs = spark.createDataFrame([(1, "a b a b"), (2, None)], "doc_id long, text string")
    got = suffix_tree.scores(docs.withColumn("trains", F.lit(False)), ["doc_id"], "trains").collect()
    assert [(r.n_known, r.train_tokens, r.base_score, r.score) for r in got] == [(0, 0, 0.0, 0.0)] * 2


def test_packed_arrays_come_back():
    rng = np.random.default_rng(2)
    arrays = [np.sort(rng.integers(0, 1 << 63, 1000).astype(np.uint64)), np.zeros(0, np.int64), rng.random(7).astype(np.float32), rng.integers(0, 9, 50)]
    got = suffix_tree.unpack(suffix_tree.pack(suffix_tree.steps(arrays[0]), *arrays[1:]))
    assert (np.cumsum(got[0]) == arrays[0]).all() and all((a == b).all() and a.dtype == b.dtype for a, b in zip(got[1:], arrays[1:]))


def test_shards_are_even_and_slots_gapless(spark, sf):
    rows = sharding.op6_histogram_sharding(spark, sf).collect()
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert all((r["size"], r.text_crc32, r.law, r.grown_shard) == (len(texts[r.doc_id]) + 1, zlib.crc32(texts[r.doc_id]), "bytes", None) for r in rows) and len(rows) == len(texts)
    size, slots = Counter(), {}
    for r in rows:
        size[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
    total = sum(size.values())
    most = max(r.size for r in rows)
    assert all(abs(s - total / 16) <= most + 0.01 * total / 16 for s in size.values()) and len(size) == 16
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_places_equal_plain_comparison():
    rng = np.random.default_rng(8)
    keys = sorted({tuple(k) for k in rng.integers(0, 4, (40, 3)).tolist()})
    rows = rng.integers(0, 5, (500, 3))
    a, b, c = (np.array([k[i] for k in keys]) for i in range(3))
    got = sharding.place(*rows.T, a, b, c)
    assert got.tolist() == [sum(k <= tuple(r) for k in keys) for r in rows.tolist()]


def test_a_hot_text_is_split(spark):
    docs = spark.createDataFrame([(i % 3, "same text") for i in range(800)] + [(i, f"other {i}") for i in range(800)], "doc_id long, text string")
    rows = sharding.histogram_shards(sharding.shard_keys(docs).drop("text"), 8, part_bytes=500).collect()
    size = Counter()
    for r in rows:
        size[r.shard] += r.size
    assert max(size.values()) - min(size.values()) <= 40


def test_audit_finds_damage_and_only_that(spark):
    pages = spark.createDataFrame([(i, f"http://x/{i}", "h" * i) for i in range(60)], "page_id long, url string, html string").repartition(7)
    from tallyseq.llm.runtime import shared_folder

    a, b = shared_folder(spark, "a"), shared_folder(spark, "b")
    bad = {3, 17, 44}
    files = warc.write_archive(pages, [a, b], lambda i: i in bad)
    records = warc.read_records(spark, a, files, contents=True)
    trees = warc.fixity_trees(records, warc.read_records(spark, b, files))
    assert trees[0].root != trees[1].root and trees[0].root == warc.fixity_trees(records)[0].root
    found = records.join(warc.differing(*trees), ["file", "seq"]).select("page_id").collect()
    assert {r.page_id for r in found} == bad
    assert warc.differing(trees[0], trees[0]).count() == 0
    # a replica that lacks most records has a lower tree of its own; in step with the other it is still found by descent
    few = records.where("seq < 3 or file > 0")
    lacks = warc.differing(*warc.fixity_trees(records, few)).collect()
    assert {(r.file, r.seq) for r in lacks} == {(r.file, r.seq) for r in records.where("seq >= 3 and file = 0").collect()}
    assert {(r.page_id, r.url, r.payload_sha256) for r in records.collect()} == {(i, f"http://x/{i}", hashlib.sha256(b"h" * i).hexdigest()) for i in range(60)}


def _toxic_corpus(n, seed):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("aeioubcdfg") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    out = []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(20, 300))]
        if toxic := int(i % 3 == 0):
            for k in range(0, len(words), 40):
                words[k] = "zlork" + rng.choice(["", "er", "ish", "ed", "ling", "ot"])
        out.append((" ".join(words).encode(), toxic))
    return out


def test_toxicity_on_unseen_texts_and_misspellings():
    train, test = _toxic_corpus(240, 1), _toxic_corpus(120, 2)
    model = toxicity.train([t for t, _ in train], [y for _, y in train], 0.33)
    got = toxicity.scores([t for t, _ in test], model)
    assert np.mean([(s >= 0.3) == y for s, (_, y) in zip(got, test)]) > 0.95
    assert toxicity.scores([b"zlorkkest aeb zlorkly"], model)[0] > 0.5 > toxicity.scores([b""], model)[0]


def _benchmark_words(text):
    import re

    return [w for w in re.split(decontaminate.GAPS, "".join(c.lower() if c.isascii() else c for c in (text or ""))) if w]


def _brute_hits(text, items):
    split = _benchmark_words
    doc, hit, found = split(text), set(), set()
    for item, t in items:
        w = split(t)
        for i in range(max(1, len(w) - 12)) if w else ():
            g = w[i : i + 13]
            for j in range(len(doc) - len(g) + 1):
                if doc[j : j + len(g)] == g:
                    hit |= set(range(j, j + len(g)))
                    found.add(str(item))
    return len(doc), len(hit), sorted(found)


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_BYTES, 0])
def test_winnowing_finds_every_window(spark, limit):
    rng = random.Random(5)
    pool = [f"v{i}" for i in range(30)]
    items = [(i, " ".join(rng.choice(pool) for _ in range(rng.choice([2, 5, 12, 13, 14, 30])))) for i in range(25)] + [(3, "É v1, v2"), (99, None), (98, "")]
    docs = []
    for i in range(40):
        w = [rng.choice(pool) for _ in range(rng.randint(0, 80))]
        at = rng.randint(0, len(w))
        w[at:at] = (rng.choice(items)[1] or "").upper().split()
        docs.append((i, " ".join(w)))
    docs += [(100, None), (101, "")]
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontaminate.find_hits(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), ["doc_id"], limit).collect()}
    for i, t in docs:
        assert got[i] == _brute_hits(t, items), (i, t)


def test_pipeline_filters_and_keeps_clean_documents(spark, sf):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept, before = docs, docs.count()
    for name, stage in pipeline.STAGES[:-1]:
        kept = stage(spark, kept, sf)
        assert kept.columns == docs.columns, name
    assert 0.5 * before < kept.count() < before
    assert pipeline.run(spark, sf).count() == kept.count()


def test_pipeline_equals_brute_force(spark, sf):
    """Every stage on all that its predecessor kept, against plain Python: scores of the model, all pairs' Jaccard, all windows, the library's ids."""
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"), F.expr("crc32(cast(cast(doc_id as string) as binary)) % 4 <> 2"))
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    rows = [r for r, s in zip(rows, toxicity.scores([(t or "").encode() for _, t in rows], model)) if s < 0.3]
    words = [(t or "").encode().lower().split() for _, t in rows]
    rows = [rows[i] for i in _jaccard_classes(words)[1]]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    grams = {}
    for item, t in items:
        w = _benchmark_words(t)
        for i in range(max(1, len(w) - 12)) if w else ():
            grams.setdefault(len(w[i : i + 13]), set()).add(tuple(w[i : i + 13]))
    kept = []
    for i, t in rows:
        w, hit = _benchmark_words(t), set()
        for n, found in grams.items():
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in found:
                    hit |= set(range(j, j + n))
        if not (hit and 20 * len(hit) >= len(w)):
            kept.append((i, t))
    want = sorted((i, len(ids), _sha(",".join(map(str, ids)).encode())) for (i, t), ids in zip(kept, _library_ids([t for _, t in kept])))
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in pipeline.run(spark, sf).collect()) == want


def test_toxicity_on_the_held_out_labels(spark):
    """The shipped settings on the labelled documents of the fold that is not learnt from."""
    import os

    folder = "/root/testdata/sf0.1"
    if not os.path.isdir(folder):
        pytest.skip("no test data")
    marks = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = [(r.score, marks[r.doc_id]) for r in toxicity.op9_toxicity(spark, folder).collect() if r.held_out and r.doc_id in marks]
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    assert len(pos) > 50 and len(neg) > 500
    assert np.mean([a > b for a in pos for b in neg]) > 0.95
    assert np.mean([s >= 0.3 for s in pos]) > 0.85 and np.mean([s >= 0.3 for s in neg]) < 0.02


def test_pipeline_on_odd_and_empty_tables(spark, odd, empty):
    pipeline = pytest.importorskip("corpus_pipeline")
    assert pipeline.run(spark, empty).count() == 0
    assert 4 <= pipeline.run(spark, odd).count() <= 8


def test_pipeline_keeps_columns_of_any_name_and_ids_of_any_type(spark, odd, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = documents(spark, extra=True)
    for name, stage in pipeline.STAGES[:-1]:
        kept = stage(spark, docs, odd)
        assert kept.columns == docs.columns, name
        assert {r._h for r in kept.collect()} <= {1, 2, 3, 4, 5, 6, 8, None}
        text_ids = docs.withColumn("doc_id", F.concat(F.lit("id"), F.col("doc_id").cast("string")))
        assert stage(spark, text_ids, odd).count() == kept.count(), name


def test_queries_are_named_by_number():
    assert sorted({int(n[2:].split("_")[0]) for n in registry.queries()}) == list(range(1, 11))
