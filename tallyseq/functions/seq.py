"""Sequence and string expressions; all stay inside the JVM."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalised(c: Column) -> Column:
    """Stripped and upper-cased (PRJ-02)."""
    return F.upper(F.trim(c))


def reverse_complement(c: Column) -> Column:
    """Reverse complement; case and other letters are kept (SEQ-01)."""
    return F.reverse(F.translate(c, "ACGTNacgtn", "TGCANtgcan"))


def kmers(c: Column, k: int) -> Column:
    """All overlapping windows of length k, in order (SEQ-03)."""
    n = F.length(c) - (k - 1)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(c, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def cut(c: Column, start: int, end: int | None = None) -> Column:
    """The slice [start, end) with 0-based bounds (SEQ-04)."""
    return F.substring(c, F.lit(start + 1), F.length(c) if end is None else F.lit(end - start))


def window_after(c: Column, end: Column, low: int, high: int) -> Column:
    """Letters low..high, both included, counted from a match's end and clamped to the read (SEQ-05)."""
    first = F.greatest(end + low, F.lit(0))
    last = F.least(end + high, F.length(c) - 1)
    return F.when(last >= first, F.substring(c, first + 1, last - first + 1)).otherwise("")


def head(c: Column, n: int) -> Column:
    return F.left(c, F.lit(n))


def tail(c: Column, n: int) -> Column:
    return F.right(c, F.lit(n))


def captured(c: Column, pattern: str, group: int = 1) -> Column:
    """First match's group, NULL where there is none (SEQ-08, SEQ-10)."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def without(c: Column, pattern: str) -> Column:
    """SEQ-09."""
    return F.regexp_replace(c, pattern, "")


def sample_name(path: Column) -> Column:
    """A FASTQ file's name without folder and suffix (SEQ-11)."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?i)\.(fastq|fq)(\.gz)?$", "")


#: Bases that fit a long, two bits each, and the lower bit of each.
PACKED, LOWER = 31, 0x1555555555555555


def packed(c: Column) -> Column:
    """A, C, G and T as two bits each, the first in the highest place; NULL for other letters and for more than ``PACKED``."""
    clean = (F.length(c) <= PACKED) & c.rlike("^[ACGT]+$")
    return F.when(clean, F.conv(F.translate(c, "ACGT", "0123"), 4, 10).cast("long"))


def packed_mismatches(a: Column, b: Column) -> Column:
    """Places in which two packed sequences of one length differ."""
    x = a.bitwiseXOR(b)
    return F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(LOWER))).cast("int")


def distance(a: Column, b: Column, packed_a: Column, packed_b: Column) -> Column:
    """``hamming`` of two sequences of which the packed forms are at hand: by bits where both have one, else letter by letter."""
    by_bits = packed_a.isNotNull() & packed_b.isNotNull() & (F.length(a) == F.length(b))
    return F.when(by_bits, packed_mismatches(packed_a, packed_b)).otherwise(hamming(a, b))


def gene_and_transcript(c: Column, exempt: str = "NTC") -> tuple[Column, Column]:
    """Split at the first underscore; control names stay whole (SEQ-12)."""
    whole = c.startswith(exempt) | ~c.contains("_")
    return F.when(whole, c).otherwise(F.substring_index(c, "_", 1)), F.when(whole, F.lit(None)).otherwise(F.regexp_replace(c, "^[^_]*_", ""))


def hamming(a: Column, b: Column) -> Column:
    """Differing places of equally long sequences; else the longer length (SEQ-15)."""
    apart = F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, x: s + x)
    return F.when(F.length(a) == F.length(b), apart).otherwise(F.greatest(F.length(a), F.length(b)))


def mask_keys(c: Column, length: int, most: int = 2) -> Column:
    """The sequence with up to ``most`` places masked: two sequences share a key within that distance (SEQ-16)."""
    keys = []
    for n in range(most + 1):
        for places in combinations(range(length), n):
            parts, at = [], 0
            for p in places:
                parts += [cut(c, at, p), F.lit("*")]
                at = p + 1
            keys.append(F.concat(*parts, cut(c, at)) if parts else c)
    return F.array(*keys)


def seed_chunks(c: Column, length: int, most: int) -> Column:
    """(chunk, seed) of the ``most`` + 1 segments, one of which is free of errors (SEQ-17)."""
    size, extra = divmod(length, most + 1)
    out, at = [], 0
    for i in range(most + 1):
        end = at + size + (i < extra)
        out.append(F.struct(F.lit(i).alias("chunk"), cut(c, at, end).alias("seed")))
        at = end
    return F.array(*out)


def merged_tokens(lists: Column) -> Column:
    """Strings of |-separated tokens, merged in order without repeats (SEQ-19)."""
    tokens = F.flatten(F.transform(lists, lambda s: F.transform(F.split(s, r"\|"), lambda t: F.trim(t))))
    return F.array_join(F.array_distinct(F.filter(tokens, lambda t: t != "")), "|")


def aligned_blocks(pos: Column, cigar: Column) -> Column:
    """Reference blocks [start, end) of an alignment; cigar is array<struct<op: string, len: int>> (SEQ-20)."""
    empty = F.array().cast("array<struct<start:int,end:int>>")
    begin = F.struct(pos.cast("int").alias("at"), empty.alias("blocks"))

    def step(acc, x):
        uses = x["op"].isin("M", "=", "X", "D", "N")
        aligned = x["op"].isin("M", "=", "X")
        nxt = acc["at"] + F.when(uses, x["len"]).otherwise(0)
        block = F.array(F.struct(acc["at"].alias("start"), nxt.alias("end")))
        return F.struct(nxt.alias("at"), F.when(aligned, F.concat(acc["blocks"], block)).otherwise(acc["blocks"]).alias("blocks"))

    return F.aggregate(cigar, begin, step, lambda acc: acc["blocks"])


#: Status of a parsed cassette, in the order in which the checks are made (SEQ-07).
CASSETTE_STATES = ("too_short", "anchor", "spacer", "treatment", "peptide", "ok")


def cassette(c: Column, start: int, anchor: str, dcbc: int, treatment: int, spacer: str, peptide: int) -> Column:
    """Struct of the anchored cassette's parts and whether anchor and spacer stand where they should (SEQ-07)."""
    sizes = [("anchor", len(anchor)), ("dcbc", dcbc), ("treatment", treatment), ("spacer", len(spacer)), ("peptide", peptide)]
    parts, at = [], start
    for name, n in sizes:
        parts.append(cut(c, at, at + n).alias(name))
        at += n
    read = F.struct(*parts)
    state = F.when(F.length(c) < at, "too_short").when(read["anchor"] != anchor, "anchor").when(read["spacer"] != spacer, "spacer")
    return F.struct(*[read[n].alias(n) for n, _ in sizes], state.alias("failed"))


def case_pattern(pattern: str) -> tuple[list[int], list[int]]:
    """Places of a mixed-case pattern that must match (upper) and that have the mismatch budget (lower) (SEQ-14)."""
    must = [i for i, x in enumerate(pattern) if x.isupper()]
    return must, [i for i, x in enumerate(pattern) if x.islower()]


def safe_name(text: str) -> str:
    """A name that files can have (SEQ-13)."""
    import re

    return re.sub(r"[^A-Za-z0-9._-]+", "_", text).strip("_")


def same_label(a: Column, b: Column) -> Column:
    """Labels that differ by case or outer blanks alone (SEQ-18)."""
    return F.lower(F.trim(a)) == F.lower(F.trim(b))
