"""Spelling variants: words that differ by one character, grouped without making pairs of words.

Each word belongs to one wildcard group for each of its positions, that of all words with the same characters before and behind it. A group
keeps its size and its two most frequent words, so each member knows how many others there are and which of them leads; two words that
differ by a replacement share exactly one group. A group holds no more words than there are characters. A word's deletions join the
vocabulary: those that are words are near, and the word is near to them; equal characters in a row have one deletion. What a word
gathers this way is one row a position, combined by word.

A word's form is its near word of largest count, if that count is ``RATIO`` times its own; as counts grow by that factor from word to form, a chain
has few links, and the roots are found by doubling them.

Words longer than ``LONG`` characters don't travel once for each position. Their groups and deletions are known by polynomial hashes
of 124 bits, all of which follow from the sums of a word's prefixes; a false match has probability below 1e-30 for each two words.

Defined results: a null or empty text has no words; a null id counts as empty text where words are damaged; repeated rows count each; an
empty table gives an empty result; extra columns are not read. Counts and orders are those of code points.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .runtime import cut, documents, lower_ascii, tidy

#: Maximal runs of these, after A-Z are lower-cased, are words.
LETTERS = "[a-zÀ-ÿ]+"
#: Code points of a word and occurrences of it, at least; how much more frequent a form is.
LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
#: One in so many occurrences loses a code point.
DAMAGED = 199
#: Words of more code points are known by hashes.
LONG = 64
#: Rows of a long word's positions that are sent at a time.
ROWS = 50_000

_PRIME = (1 << 31) - 1
_BASES = (48271, 69621, 16807, 39373)


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, damaged: int = DAMAGED) -> DataFrame:
    """word and n: the words of all texts, some of their occurrences damaged, that are long and frequent enough."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(lower_ascii(F.col("text")), F.lit(LETTERS), F.lit(0))).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    length = F.char_length("run")
    told = runs.where(length >= least_length).select("run", h.alias("h"), length.alias("size"))
    at = (F.col("h") % F.col("size")).cast("int")
    word = F.when(F.col("h") % damaged == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.col("size")))).otherwise(F.col("run"))
    return told.select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n")).where((F.char_length("word") >= least_length) & (F.col("n") >= least_count))


def _first_and_second(rows: DataFrame, group: list[str], member: Column) -> DataFrame:
    """``rows`` of groups of several, with ``near``, the others' number, and ``other``, the first other (n, member) by falling n and rising member."""
    entry = F.struct((-F.col("n")).alias("less"), member.alias("member"))
    ordered = Window.partitionBy(*group).orderBy(F.desc("n"), member)
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    told = rows.select("*", F.row_number().over(ordered).alias("place"), F.count("*").over(whole).alias("members"), F.first(entry).over(whole).alias("leads"), F.nth_value(entry, 2).over(whole).alias("next"))
    return told.where("members > 1").withColumn("near", F.col("members") - 1).withColumn("other", F.when(F.col("place") == 1, F.col("next")).otherwise(F.col("leads")))


def _short_links(words: DataFrame) -> DataFrame:
    """word, near, other (less, member) of words of up to ``LONG`` code points among themselves."""
    short = words.where(F.char_length("word") <= LONG)
    places = short.select("n", "word", F.explode(F.sequence(F.lit(1), F.char_length("word"))).alias("at"))
    split = places.select("n", F.substring("word", F.lit(1), F.col("at") - 1).alias("prefix"), F.substring("word", F.col("at"), F.lit(1)).alias("char"), F.substring("word", F.col("at") + 1, F.lit(LONG)).alias("suffix"))
    replaced = _first_and_second(split, ["prefix", "suffix"], F.col("char"))
    spelt = lambda char: F.concat("prefix", char, "suffix")
    replaced = replaced.select(spelt(F.col("char")).alias("word"), "near", F.struct(F.col("other.less").alias("less"), spelt(F.col("other.member")).alias("member")).alias("other"))
    # of equal characters in a row only the first one's deletion counts
    deleted = split.where(~F.endswith("prefix", "char")).select(F.concat("prefix", "suffix").alias("shorter"), spelt(F.col("char")).alias("longer"), F.col("n").alias("n_longer"))
    there = deleted.join(short.select(F.col("word").alias("shorter"), F.col("n").alias("n_shorter")), "shorter")
    return replaced.unionByName(_both_ways(there))


def _both_ways(there: DataFrame) -> DataFrame:
    """A row for the longer and one for the shorter word of each deletion that is a word."""
    rows = F.array(*[F.struct(F.col(a).alias("word"), F.lit(1).cast("long").alias("near"), F.struct((-F.col(f"n_{b}")).alias("less"), F.col(b).alias("member")).alias("other")) for a, b in (("longer", "shorter"), ("shorter", "longer"))])
    return there.select(F.inline(rows))


def _sums(chars: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """(each character's share of its word's hash, the sums of the shares before each place and at the end), modulo the prime."""
    powers = np.ones(len(chars), np.int64)
    done, step = 1, base
    while done < len(chars):
        powers[done : 2 * done] = powers[: min(done, len(chars) - done)] * step % _PRIME
        done, step = 2 * done, step * step % _PRIME
    shares = chars * powers % _PRIME
    return shares, np.concatenate([[0], np.cumsum(shares)]) % _PRIME


def hashed(word: str) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...], tuple[int, int]]:
    """(keys of the word without each character, with a gap; of each deletion; of the word): two 62-bit numbers each."""
    chars = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64) + 1
    gaps, deletions, own = [], [], []
    for base in _BASES:
        shares, sums = _sums(chars, base)
        gaps.append((sums[-1] - shares) % _PRIME)
        deletions.append((sums[:-1] + (sums[-1] - sums[1:]) % _PRIME * pow(base, -1, _PRIME)) % _PRIME)
        own.append(int(sums[-1]))
    joined = lambda x: (x[0] << 31 | x[1], x[2] << 31 | x[3])
    return joined(gaps), joined(deletions), joined(own)


_KEYS = "kind string, size int, at int, k1 long, k2 long, word_id string, n long, char int"


def _long_keys(words: DataFrame) -> DataFrame:
    """Rows of hashed keys: ``gap`` and ``deletion`` of words over ``LONG`` code points, ``own`` of those of ``LONG`` and more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in _KEYS.split(", ")]
        for batch in tidy(batches):
            for row in batch.to_pylist():
                word, n = row["word"], row["n"]
                size = len(word)
                gaps, deletions, own = hashed(word)
                yield pa.RecordBatch.from_pydict(dict(zip(names, (["own"], pa.array([size], pa.int32()), pa.array([-1], pa.int32()), [own[0]], [own[1]], [row["word_id"]], [n], pa.array([-1], pa.int32())))))
                if size <= LONG:
                    continue
                chars = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int32)
                first = np.append(True, chars[1:] != chars[:-1])
                for low in range(0, size, ROWS):
                    at = np.arange(low, min(low + ROWS, size), dtype=np.int32)
                    for kind, length, keys, mine in (("gap", size, gaps, at), ("deletion", size - 1, deletions, at[first[at]])):
                        k = len(mine)
                        place = mine if kind == "gap" else np.full(k, -1, np.int32)
                        yield pa.RecordBatch.from_pydict(dict(zip(names, ([kind] * k, pa.array(np.full(k, length, np.int32)), pa.array(place), keys[0][mine], keys[1][mine], [row["word_id"]] * k, [n] * k, pa.array(chars[mine])))))

    return words.mapInArrow(run, _KEYS)


def _long_links(words: DataFrame) -> DataFrame:
    """As ``_short_links``, for words over ``LONG`` code points and those of ``LONG`` that are their deletions."""
    long = words.where(F.char_length("word") >= LONG).select("word", "n", F.sha2(F.col("word").cast("binary"), 256).alias("word_id"))
    keys = cut(_long_keys(long))
    key = ["size", "at", "k1", "k2"]
    replaced = _first_and_second(keys.where("kind = 'gap'"), key, F.struct("char", "word_id")).select("word_id", "near", F.col("other.less").alias("less"), F.col("other.member.word_id").alias("other_id"))
    shorter = keys.where("kind = 'own'").select(*key, F.col("word_id").alias("shorter_id"), F.col("n").alias("n_shorter"))
    there = keys.where("kind = 'deletion'").select(*key, F.col("word_id").alias("longer_id"), F.col("n").alias("n_longer")).join(shorter, key)
    names = long.select("word", "word_id")

    def named(df: DataFrame, id_: str, name: str) -> DataFrame:
        return df.join(names.select(F.col("word_id").alias(id_), F.col("word").alias(name)), id_)

    replaced = named(named(replaced, "word_id", "word"), "other_id", "member").select("word", "near", F.struct("less", "member").alias("other"))
    return replaced.unionByName(_both_ways(named(named(there, "longer_id", "longer"), "shorter_id", "shorter")))


def near_words(words: DataFrame) -> DataFrame:
    """``words`` (word, n) with n_near, how many words differ by one character, and best (less: minus its count, member: the word), the first by falling count and rising word."""
    rows = _short_links(words)
    if words.where(F.char_length("word") > LONG).limit(1).count():
        rows = rows.unionByName(_long_links(words))
    none = F.lit(None).cast("struct<less: bigint, member: string>")
    rows = rows.select("word", F.lit(None).cast("long").alias("n"), "near", "other").unionByName(words.select("word", "n", F.lit(0).cast("long").alias("near"), none.alias("other")))
    return rows.groupBy("word").agg(F.max("n").alias("n"), F.sum("near").alias("n_near"), F.min("other").alias("best"))


def roots(forms: DataFrame, greatest: int, ratio: int = RATIO) -> DataFrame:
    """word and root of ``forms`` (word, form): the last of the forms that follow one another. ``greatest``: no count is larger."""
    known = forms.select("word", F.col("form").alias("root"))
    links = max(1, math.ceil(math.log(max(greatest, 2), ratio)))  # counts grow by the ratio, so no chain is longer
    for _ in range(math.ceil(math.log2(links)) + 1):
        known = cut(known)
        ahead = known.select(F.col("word").alias("root"), F.col("root").alias("further"))
        if not known.join(ahead, "root", "left_semi").limit(1).count():
            break
        known = known.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"))
    return known


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n of a vocabulary (word, n)."""
    near = near_words(words)
    is_form = -F.col("best.less") >= ratio * F.col("n")
    told = cut(near.select("word", F.when(is_form, F.col("best.member")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, -F.col("best.less")).alias("form_n")))
    greatest = told.agg(F.max("n")).first()[0] or 1
    found = roots(told.where("form is not null"), greatest, ratio)
    return told.join(found, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spelling variants of all words of the documents."""
    return variants(cut(word_counts(documents(spark, sf_dir))))
