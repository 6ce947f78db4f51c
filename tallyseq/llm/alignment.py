"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes of a text.

One Arrow step tokenises. Texts are cut at spaces, where no token of either vocabulary can reach across (the vocabularies are looked
at for it), and a batch of texts becomes one row: the batch's distinct pieces, each with its token ids by both tokenizers and the index
of its shape; the distinct shapes, which are the byte offsets at which the tokens end and which token covers each byte; and each text as the
indices of its pieces. All that follows is Spark's higher-order functions on these arrays. ``array_intersect`` of a shape's end arrays is where
both end a token, and so where groups end. Between two neighbouring ends of either tokenizer lies exactly one pair of tokens that overlap, a link.
How many of a tokenizer's ends lie below a group's end is read off a sort of both sorted arrays together, so the work on a shape is
linear in its bytes (its sort merges two runs) even where a whole text is one piece. Many words share a shape, which says at which places of a
piece's ids its groups and links find theirs; a piece only fetches them. A text's groups and links are those of its pieces in order.

How many texts hold an id pair linked is counted over all texts, and each text's links look their pairs' counts up: in a broadcast
table while the distinct pairs, counted first, are few enough, else by a shuffled join of each text's pairs. Both give the same rows.

Defined results: a null or empty text, and one whose tokens of either tokenizer don't spell it (a text with U+2581, which the second
tokenizer reads as a space), has no tokens: zeros and an empty digest. Strings of special tokens are ordinary text. Repeated rows, and
rows of one id, count as texts of their own. An empty table gives an empty result; extra columns are kept by ``align`` if asked for, under
any name but those it makes.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chunks
from .bpe import byte_characters
from .runtime import cut, documents, fresh, small_batches, tidy

#: Bytes of texts that become one row.
BATCH = 3 << 20
#: Pieces a worker keeps in each of two generations.
PIECES = 250_000
#: Pieces that are tokenised in one call.
TOGETHER = 2000
#: Up to this many distinct id pairs are broadcast (some 50 bytes each); beyond it they are joined.
BROADCAST_PAIRS = 1_000_000
#: Up to this many ends a value's place among them is found by looking through them.
SHORT = 64

SPACE = "\u2581"
MADE = ["n_a", "n_b", "n_groups", "n_links", "groups", "links"]


class Side:
    """A tokenizer: what each id spells, and ``encode``, which gives a text's ids; both take texts that start with a space."""

    def __init__(self, spelt: list[bytes], encode: Callable[[str], list[int]]):
        self.spelt, self.encode = spelt, encode
        self.lengths = np.array([len(t) for t in spelt], np.int64)

    def ids_of(self, pieces: list[str]) -> list[bytes | None]:
        """Each piece's ids as 32-bit integers; None for one that they don't spell.

        Pieces that end in no white space are tokenised in one text, as it would be cut between them: their ends are ends of
        tokens there. If the tokens of such a text don't spell it its pieces are looked at one by one.
        """
        out: dict[str, bytes | None] = {}
        plain = [p for p in pieces if p[-1] not in chunks.SPACES]
        for low in range(0, len(plain), TOGETHER):
            part = plain[low : low + TOGETHER]
            ids, right = self._spelt_right("".join(part))
            if right:
                ends = np.cumsum(self.lengths[ids])
                cuts = np.cumsum([len(p.encode()) for p in part])
                at = np.searchsorted(ends, cuts)
                if (ends[at] == cuts).all():
                    data, bounds = ids.tobytes(), (4 * at + 4).tolist()
                    out.update(zip(part, [data[i:j] for i, j in zip([0, *bounds], bounds)]))
        for p in pieces:
            if p not in out:
                ids, right = self._spelt_right(p)
                out[p] = ids.tobytes() if right else None
        return [out[p] for p in pieces]

    def _spelt_right(self, text: str) -> tuple[np.ndarray, bool]:
        ids = self.encode(text)
        return np.array(ids, "<i4"), b"".join(map(self.spelt.__getitem__, ids)) == text.encode()


def first_side(vocabulary: str) -> Side:
    """A byte-level BPE vocabulary of the tokenizers library."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary)
    tokenizer.no_truncation()
    tokenizer.encode_special_tokens = True
    back = {c: b for b, c in enumerate(byte_characters())}
    names = tokenizer.get_vocab()
    spelt = [b""] * (max(names.values()) + 1)
    for name, i in names.items():
        spelt[i] = bytes([back[c] for c in name]) if all(c in back for c in name) else name.encode()
    return Side(spelt, lambda text: tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids)


def second_side(model: str) -> Side:
    """A sentencepiece BPE model that puts a space before each text and falls back to bytes."""
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_file=model)
    names = [processor.id_to_piece(i) for i in range(processor.get_piece_size())]
    if any(SPACE in name.lstrip(SPACE) for name in names):
        raise ValueError("a piece holds a space after other characters: texts can't be cut at spaces")
    spelt = [bytes([int(name[3:5], 16)]) if processor.is_byte(i) else name.replace(SPACE, " ").encode() for i, name in enumerate(names)]
    lone = [processor.piece_to_id(SPACE)]  # the library gives an empty text no token, not even the space before it
    return Side(spelt, lambda text: processor.encode(text[1:], num_threads=1) if text != " " else lone)


class Pieces(chunks.PieceCache):
    """Texts as pieces, and each piece's ids by both tokenizers: how many the first has (-1 if either doesn't spell it), and all of them."""

    def __init__(self, vocabulary: str, model: str):
        self.sides = first_side(vocabulary), second_side(model)
        super().__init__(self._both, "<i4", limit=PIECES)

    def _both(self, pieces: list[str]) -> list[bytes]:
        a, b = (side.ids_of(pieces) for side in self.sides)
        return [(len(x) // 4).to_bytes(4, "little") + x + y if x is not None and y is not None else b"\xff\xff\xff\xff" for x, y in zip(a, b)]

    def row(self, column: pa.Array) -> tuple[list[pa.Array], list[pa.Array]]:
        """(the distinct pieces' ids and shapes, the distinct shapes' ends and covers of either side; each text's pieces, as indices, n_a and n_b)."""
        data, offsets = chunks.column_bytes(column)
        first = chunks.bounds(data, offsets)
        pieces = _runs(np.ascontiguousarray(data), np.append(first, len(data))).dictionary_encode()
        codes = pieces.indices.to_numpy()
        found = self._found(pieces.dictionary.to_pylist())
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat = np.frombuffer(b"".join(found), "<i4")
        at = np.cumsum(sizes) - sizes
        n_a = flat[at]
        counts = np.diff(np.searchsorted(first, offsets))
        good = np.ones(len(column), bool)
        if (n_a < 0).any():
            owner = np.repeat(np.arange(len(column)), counts)
            good[owner[n_a[codes] < 0]] = False
            codes, counts = codes[good[owner]], np.where(good, counts, 0)
        n_a = np.maximum(n_a, 0)
        place = np.arange(len(flat)) - np.repeat(at, sizes)
        is_a = place <= np.repeat(n_a, sizes)
        is_a[at] = False
        is_b = place > np.repeat(n_a, sizes)
        lengths = flat.copy()  # each token's length where its id is; n_a tells the sides apart
        for side, own in zip(self.sides, (is_a, is_b)):
            lengths[own] = side.lengths[flat[own]]
        shape = _runs(lengths, 4 * np.append(at, len(flat))).dictionary_encode().indices
        one = np.unique(shape.to_numpy(), return_index=True)[1]
        n_b = sizes - 1 - n_a
        a, b = _shapes(lengths[is_a], n_a, one, np.zeros(len(one), np.int64)), _shapes(lengths[is_b], n_b, one, n_a[one])
        upto = np.concatenate([[0], np.cumsum(counts)])
        totals = [pa.array(np.diff(np.concatenate([[0], np.cumsum(n[codes], dtype=np.int64)])[upto])) for n in (n_a, n_b)]
        return [_lists(flat[is_a | is_b], sizes - 1), shape, *a, *b], [_lists(codes, counts), *totals]


def _shapes(lengths: np.ndarray, counts: np.ndarray, one: np.ndarray, base: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Of the pieces ``one``: where their tokens end, and which token, from ``base`` on, covers each byte."""
    sizes, lengths = counts[one], _lists(lengths, counts).take(pa.array(one)).flatten().to_numpy()
    spent = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    begins = np.cumsum(sizes) - sizes
    ends = spent[1:] - np.repeat(spent[begins], sizes)
    index = np.arange(len(lengths)) - np.repeat(begins - base, sizes)
    return _lists(ends, sizes), _lists(np.repeat(index, lengths), spent[begins + sizes] - spent[begins])


def _runs(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(data)])


def _lists(flat: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(flat.astype(np.int32)))


_PIECES: dict[tuple[str, str], Pieces] = {}


def pieces_of(vocabulary: str, model: str) -> Pieces:
    """Both tokenizers, made once for each worker."""
    if (vocabulary, model) not in _PIECES:
        _PIECES[vocabulary, model] = Pieces(vocabulary, model)
    return _PIECES[vocabulary, model]


def tokenise(docs: DataFrame, keep: list[str], vocabulary: str, model: str, text: str = "text") -> DataFrame:
    """Rows of texts (``keep``, their pieces as indices, n_a and n_b; a space stands before each), of distinct pieces (ids of both sides, shape) and of shapes (ends and cover of either side)."""
    small_batches(docs.sparkSession, size=BATCH)
    (whole,) = fresh(keep, "whole_text")
    chosen = docs.select(*keep, F.when(F.length(text) > 0, F.concat(F.lit(" "), F.col(text))).otherwise("").alias(whole))
    kept = "".join(f"`{f.name}`: {f.dataType.simpleString()}, " for f in chosen.schema[:-1])
    (own,) = fresh(keep, "pieces")
    lists = {"ids": "array<array<int>>", "shape": "array<int>"} | dict.fromkeys(["a_ends", "a_cover", "b_ends", "b_cover"], "array<array<int>>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        cutter = pieces_of(vocabulary, model)
        for batch in tidy(batches):
            found, made = cutter.row(batch.column(batch.num_columns - 1))
            texts = pa.StructArray.from_arrays([*batch.columns[:-1], *made], [*keep, own, "n_a", "n_b"])
            rows = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (texts, *found)]
            yield pa.RecordBatch.from_arrays(rows, ["texts", *lists])

    return chosen.mapInArrow(run, f"texts array<struct<{kept}`{own}`: array<int>, n_a: bigint, n_b: bigint>>, " + ", ".join(f"{n} {kind}" for n, kind in lists.items()))


def _places(of: Column, within: Column) -> Column:
    """Where each value of a rising array stands, from 1, in a rising array that holds them all.

    Short arrays are looked through for each value. Longer ones are sorted together, in which a value's own place and the number of
    values of ``of`` before it tell how many of ``within`` lie below it.
    """
    both = F.sort_array(F.concat(F.transform(of, lambda x: x * 2), F.transform(within, lambda x: x * 2 + 1)))
    found = F.filter(F.transform(both, lambda x, at: F.when(x % 2 == 0, at)), F.isnotnull)
    merged = F.transform(found, lambda at, k: (at - k + 1).cast("long"))
    return F.when(F.size(within) <= SHORT, F.transform(of, lambda x: F.array_position(within, x))).otherwise(merged)


def _before(k: Column, last: Column) -> Column:
    return F.when(k > 0, F.get(last, k - 1)).otherwise(0)


def _sides(last_a: Column, last_b: Column, n_a: Column) -> Column:
    """Each group's places in a piece's ids, of one side and the other; ``last``: how many of a side's tokens there are up to each group's end."""

    def group(x: Column, k: Column) -> Column:
        return F.array(F.sequence(_before(k, last_a), x - 1), F.sequence(n_a + _before(k, last_b), n_a + F.get(last_b, k) - 1))

    return F.flatten(F.transform(last_a, group)).cast("array<array<int>>")


def _order(sides: Column, n: Column) -> Column:
    """Places in the order of the groups' text, with ``n`` for a bar and n + 1 for a semicolon."""
    return F.flatten(F.flatten(F.transform(sides, lambda side, k: F.when(k == 0, F.array(side)).otherwise(F.array(F.array(n + (k + 1) % 2), side)))))


def align(docs: DataFrame, keep: list[str], vocabulary: str, model: str, text: str = "text", id_width: int | None = None) -> DataFrame:
    """``keep``, n_a, n_b, n_groups, n_links, groups (text) and links (array, one for each link: the first id times ``id_width`` plus the second)."""
    width = id_width or len(second_side(model).spelt)
    clash = {c.lower() for c in keep} & {*MADE}
    if clash:
        raise ValueError(f"columns that the alignment makes: {sorted(clash)}")
    tokens = tokenise(docs, keep, vocabulary, model, text)
    (own,) = fresh(keep, "pieces")
    piece = ["texts", "ids", "shape", "a_cover", "b_cover"]
    last = [F.zip_with(F.zip_with("a_ends", "b_ends", F.array_intersect), f"{side}_ends", _places) for side in "ab"]
    sides = F.transform(F.arrays_zip(last[0].alias("a"), last[1].alias("b"), F.transform("a_ends", F.size).alias("n")), lambda s: _sides(s.a, s.b, s.n))
    ends = F.zip_with("a_ends", "b_ends", lambda a, b: F.sort_array(F.array_union(a, b)))
    n = F.zip_with("a_ends", "b_ends", lambda a, b: F.size(a) + F.size(b))
    found = tokens.select(F.inline(F.array(F.struct(*piece, sides.alias("sides"), ends.alias("ends"), n.alias("n")))))
    links = [F.zip_with("ends", f"{side}_cover", lambda x, cover: F.transform(x, lambda end: F.get(cover, end - 1))).alias(f"links_{side}") for side in "ab"]
    made = F.struct(*piece[:-2], F.zip_with("sides", "n", _order).alias("order"), *links)
    shapes = found.select(F.inline(F.array(made)))  # in rows of its own what a shape gives is made once, and not again for each piece

    def said(names: Column, s: Column) -> Column:
        joined = F.array_join(F.transform(F.get("order", s), lambda at: F.get(names, at)), ",")
        return F.replace(F.replace(joined, F.lit(",|,"), F.lit("|")), F.lit(",;,"), F.lit(";"))

    def linked(ids: Column, s: Column) -> Column:
        return F.zip_with(F.get("links_a", s), F.get("links_b", s), lambda i, j: F.get(ids, i).cast("long") * width + F.get(ids, j))

    names = F.transform(F.col("ids").cast("array<array<string>>"), lambda x: F.concat(x, F.array(F.lit("|"), F.lit(";"))))
    groups = F.zip_with(names, "shape", said)
    aligned = shapes.select("texts", groups.alias("groups"), F.zip_with("ids", "shape", linked).alias("links"))

    def whole(t: Column) -> Column:
        codes = t[own]
        return F.struct(*[t[c].alias(c) for c in keep], t["n_a"].alias("n_a"), t["n_b"].alias("n_b"),
                        F.array_join(F.transform(codes, lambda c: F.get("groups", c)), ";").alias("groups"), F.flatten(F.transform(codes, lambda c: F.get("links", c))).alias("links"))

    rows = aligned.select(F.inline(F.transform("texts", whole)))
    n_a, n_b = F.col("n_a"), F.col("n_b")
    n_links = F.size("links").cast("long")  # all ends; those of both sides count once
    return rows.select(*keep, "n_a", "n_b", (n_a + n_b - n_links).alias("n_groups"), n_links.alias("n_links"), "groups", "links")


def pair_counts(aligned: DataFrame, width: int) -> DataFrame:
    """pair, n (rows that hold it in ``links``) and best (no pair of the same first id has more)."""
    held = aligned.select(F.explode(F.array_distinct("links")).alias("pair"))
    counts = cut(held.groupBy("pair").agg(F.count("*").alias("n")))
    first = F.floor(F.col("pair") / width)
    most = counts.groupBy(first.alias("first")).agg(F.max("n").alias("most"))  # as many rows as the first vocabulary has ids
    return counts.withColumn("first", first).join(F.broadcast(most), "first").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def link_counts(aligned: DataFrame, counts: DataFrame, keep: list[str], broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """``keep`` (which tells the rows of ``aligned`` apart) with n_best and count_sum, the sum of its links' counts."""
    links = aligned.select(*keep, F.explode_outer("links").alias("pair"))
    if counts.count() <= broadcast_pairs:
        times, found = F.lit(1), links.join(F.broadcast(counts), "pair", "left")
    else:
        times, found = F.col("times"), links.groupBy(*keep, "pair").agg(F.count("*").alias("times")).join(counts, "pair", "left")
    n_best = F.sum(F.when(F.col("best"), times).otherwise(0)).cast("long")
    return found.groupBy(*keep).agg(n_best.alias("n_best"), F.coalesce(F.sum(times * F.col("n")), F.lit(0)).cast("long").alias("count_sum"))


def op11_alignment(spark: SparkSession, sf_dir: str, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """Every document's groups and links, and how its links stand among all documents' links."""
    import public_tokenizers as p

    vocabulary, model = p.path("byte_bpe_50k.json"), p.path("piece_bpe_32k.model")
    width = len(second_side(model).spelt)
    found = align(documents(spark, sf_dir), ["doc_id"], vocabulary, model, id_width=width)
    digest = F.when(F.col("n_a") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise("")
    keep = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    kept = cut(found.select(F.monotonically_increasing_id().alias("row"), *keep[1:-1], digest.alias("groups_sha256"), "links"))
    return link_counts(kept, pair_counts(kept, width), keep, broadcast_pairs).select(*keep[1:-1], "n_best", "count_sum", "groups_sha256")
