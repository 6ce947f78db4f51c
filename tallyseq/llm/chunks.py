"""Cutting texts at spaces where byte-level tokenizers always cut too, so that pieces can be encoded once and kept.

The pre-tokenisation pattern lets a token start with one space but never run from a non-space into white space.
A text may therefore be cut before every ASCII space whose left neighbour is not white space; the tokens of the
pieces, one after another, are the tokens of the text. Where white space stands before a space the run stays
in one piece. Under the pattern ``CLASSES``, whose tokens are letters, numbers or other signs alone but for contractions,
texts are cut between ASCII characters of different classes as well, and around single line ends. A batch of texts is cut, its distinct pieces are found and its ids put together by whole arrays; Python
sees a piece once a batch.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space by any of the libraries' definitions.
SPACES = "\t\n\v\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


#: Fixed value: the pre-tokenisation pattern whose texts may be cut between classes of characters.
CLASSES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _class_cuts() -> np.ndarray:
    """By two bytes, the first times 256: if a text may be cut between them.

    Letters, digits and signs of ASCII part from one another; an apostrophe parts from what stands before it, but what
    follows it may be its contraction.
    """
    kind = np.zeros(256, np.int64)
    for i, chars in enumerate(("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~", "'"), 1):
        kind[list(chars.encode())] = i
    a, b = kind[:, None], kind[None]
    cut = (a > 0) & (b > 0) & (a != b) & (a != 4)
    cut &= ~((a == 3) & (b == 4))  # signs and an apostrophe are one run
    return cut.ravel()


_VISIBLE = np.zeros(256, bool)
_VISIBLE[33:127] = True


def _last_bytes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By last byte: if it is white space of one byte; and by the last two and three bytes, as numbers, white space of more."""
    one = np.zeros(256, bool)
    longer: dict[int, list[int]] = {2: [], 3: []}
    for c in SPACES:
        raw = c.encode()
        if len(raw) == 1:
            one[raw[0]] = True
        else:
            longer[len(raw)].append(int.from_bytes(raw, "big"))
    return one, np.array(sorted(longer[2])), np.array(sorted(longer[3]))


_ONE, _TWO, _THREE = _last_bytes()
_CUT = _class_cuts()


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, offsets of the values) of a string or binary column without nulls."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def bounds(data: np.ndarray, offsets: np.ndarray, classes: bool = False, whole: np.ndarray | None = None) -> np.ndarray:
    """Where pieces start: at the start of every text that is not empty, at the spaces where it may be cut, and with ``classes`` between classes of characters, but not in the texts ``whole``."""
    starts = np.zeros(len(data) + 1, bool)
    starts[offsets[:-1]] = True
    starts = starts[:-1]
    at = np.flatnonzero(data == 32)
    at = at[~starts[at]]
    after = data[at - 1].astype(np.int64)
    white = _ONE[after]
    high = np.flatnonzero(after >= 0x80)
    if len(high):
        two = data[at[high] - 2].astype(np.int64) << 8 | after[high]
        three = data[at[high] - 3].astype(np.int64) << 16 | two
        white[high] = np.isin(two, _TWO) | np.isin(three, _THREE)
    starts[at[~white]] = True
    if classes and len(data) > 1:
        fine = np.zeros(len(data), bool)
        fine[1:] = _CUT[data[:-1].astype(np.uint16) << 8 | data[1:]]
        line = np.flatnonzero(data[1:-1] == 10) + 1
        line = line[_VISIBLE[data[line - 1]] & _VISIBLE[data[line + 1]]]
        fine[line] = fine[line + 1] = True
        for i in np.flatnonzero(whole) if whole is not None else ():
            fine[offsets[i] : offsets[i + 1]] = False
        starts |= fine
    return np.flatnonzero(starts)


class PieceCache:
    """Piece -> its encoding (bytes), for one worker. Two generations of ``limit`` pieces bound its memory."""

    def __init__(self, encode_all: Callable[[list[str]], list[bytes]], dtype: str, classes: bool = False, whole: list[str] | None = None, limit: int = 200_000, longest: int = 48):
        """``classes``: the pattern is ``CLASSES``. ``whole``: strings that the tokenizer takes as they stand, so that they may not be cut."""
        self.encode_all, self.dtype, self.limit, self.longest = encode_all, np.dtype(dtype), limit, longest
        self.classes, self.whole = classes, whole or []
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _found(self, pieces: list[bytes]) -> list[bytes]:
        """Each distinct piece's encoding."""
        if len(self.known) > self.limit:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        new = [p for p in pieces if p not in known]
        if older:
            known.update([(p, older[p]) for p in new if p in older])
            new = [p for p in new if p not in known]
        known.update(zip(new, self.encode_all([p.decode() for p in new])))
        out = list(map(known.__getitem__, pieces))
        for p in new:  # long pieces are rarely met again
            if len(p) > self.longest:
                del known[p]
        return out

    def of(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, one after another; how many each text has) of a string column without nulls."""
        data, offsets = column_bytes(column)
        whole = None
        for string in self.whole if self.classes else ():
            there = pc.match_substring(column, string).to_numpy(zero_copy_only=False)
            whole = there if whole is None else whole | there
        first = bounds(data, offsets, self.classes, whole)
        if not len(first):
            return np.zeros(0, self.dtype), np.zeros(len(column), np.int64)
        ends = pa.py_buffer(np.append(first, len(data)).astype(np.int32))
        pieces = pa.Array.from_buffers(pa.binary(), len(first), [None, ends, pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        codes = pieces.indices.to_numpy()
        found = self._found(pieces.dictionary.to_pylist())
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // self.dtype.itemsize
        flat = np.frombuffer(b"".join(found), self.dtype)
        size = sizes[codes]
        total = np.cumsum(size)
        at = np.repeat((np.cumsum(sizes) - sizes)[codes] - (total - size), size)
        at += np.arange(len(at))
        counts = np.diff(np.concatenate([[0], total])[np.searchsorted(first, offsets)])
        return flat[at], counts
