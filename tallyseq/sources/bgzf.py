"""Blocked gzip files in byte ranges: blocks, BAM headers and records that start in a range, and a writer of both.

A BGZF file is a row of gzip members of at most 64 KB, each of which says its own length. A record's place is its virtual offset, the
file offset of the block it starts in times 65 536 plus its offset in that block's data; it is the same however a file is split. A range owns the
records whose block starts in it: the reader looks for the first block there, for the first record in its blocks, and reads on
beyond the range's end for the rest of the last one.
"""

from __future__ import annotations

import bisect
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: How a block starts, the empty block that ends a file, and what a block holds at most.
MAGIC = b"\x1f\x8b\x08\x04"
END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
MOST = 1 << 16
#: Bytes of data in a block that is written.
PAYLOAD = 0xFF00
#: Compressed bytes that are read at a time, and records or blocks in a row that must look right where a range starts.
CHUNK, CHAIN = 1 << 20, 8
#: Bytes of data whose records are taken at once.
STRETCH = 4 << 20


def block_size(head: bytes) -> int | None:
    """Length of the block that starts with these bytes (18 at least); None if it is none."""
    if len(head) < 18 or head[:4] != MAGIC:
        return None
    extra = struct.unpack_from("<H", head, 10)[0]
    at, end = 12, 12 + extra
    while at + 4 <= min(end, len(head)):
        name, size = head[at : at + 2], struct.unpack_from("<H", head, at + 2)[0]
        if name == b"BC" and size == 2 and at + 6 <= len(head):
            return struct.unpack_from("<H", head, at + 4)[0] + 1
        at += 4 + size
    return None


class Window:
    """A file's bytes by offset, of which a stretch is in memory."""

    def __init__(self, file):
        self.file, self.size = file, file.size()
        self.low, self.data = 0, b""

    def at(self, offset: int, n: int) -> bytes:
        """Up to ``n`` bytes from ``offset``."""
        if offset < self.low or offset + n > self.low + len(self.data):
            self.file.seek(offset)
            self.low, self.data = offset, self.file.read(max(n, CHUNK))
        return self.data[offset - self.low : offset - self.low + n]


def inflated(block: bytes) -> bytes:
    return zlib.decompress(block, 31)


def blocks(window: Window, offset: int) -> Iterator[tuple[int, bytes]]:
    """(file offset, data) of the blocks from the one at ``offset`` on."""
    while offset < window.size:
        size = block_size(window.at(offset, MOST))
        if size is None:
            raise ValueError(f"no block at {offset}")
        yield offset, inflated(window.at(offset, size))
        offset += size


def first_block(window: Window, low: int, high: int) -> int | None:
    """Offset of the first block that starts in a range: its length leads to another block, and so on, or to the file's end."""
    at = low
    while at < high:
        chunk = window.at(at, CHUNK)
        if not chunk:
            return None
        found = chunk.find(MAGIC)
        if found < 0:
            at += max(1, len(chunk) - len(MAGIC) + 1)
            continue
        at += found
        if at < high and _chained(window, at):
            return at
        at += 1
    return None


def _chained(window: Window, at: int) -> bool:
    for _ in range(CHAIN):
        if at == window.size:
            return True
        size = block_size(window.at(at, MOST))
        if size is None or at + size > window.size:
            return False
        try:
            inflated(window.at(at, size))
        except zlib.error:
            return False
        at += size
    return True


@dataclass(frozen=True)
class Header:
    """A BAM file's references (name and length), and the virtual offset of its first record."""

    names: tuple[str, ...]
    lengths: tuple[int, ...]
    first: int


class Data:
    """Data of a row of blocks as one, of which what has been passed is let go."""

    def __init__(self, window: Window, offset: int):
        self.rows = blocks(window, offset)
        self.data, self.marks, self.at, self.base = bytearray(), [], 0, 0

    def has(self, n: int) -> bool:
        """If ``n`` bytes follow the present place; blocks are read for it."""
        while len(self.data) - self.at < n:
            got = next(self.rows, None)
            if got is None:
                return False
            if got[1]:
                if self.at > 1 << 22:
                    del self.data[: self.at]
                    self.base, self.at = self.base + self.at, 0
                    while len(self.marks) > 1 and self.marks[1][0] <= self.base:
                        self.marks.pop(0)
                self.marks.append((self.base + len(self.data), got[0]))
                self.data += got[1]
        return True

    def take(self, n: int) -> bytes:
        if not self.has(n):
            raise ValueError("the file ends within a record")
        self.at += n
        return bytes(self.data[self.at - n : self.at])

    def place(self) -> tuple[int, int]:
        """(file offset of its block, offset in it) of the present place, which must have a byte."""
        here = self.base + self.at
        while len(self.marks) > 1 and self.marks[1][0] <= here:
            self.marks.pop(0)
        return self.marks[0][1], here - self.marks[0][0]


def read_header(window: Window, path: str = "") -> Header:
    data = Data(window, 0)
    if not data.has(4) or data.take(4) != b"BAM\1":
        raise ValueError(f"{path}: no BAM file")
    data.take(struct.unpack("<i", data.take(4))[0])
    names, lengths = [], []
    for _ in range(struct.unpack("<i", data.take(4))[0]):
        names.append(data.take(struct.unpack("<i", data.take(4))[0])[:-1].decode())
        lengths.append(struct.unpack("<i", data.take(4))[0])
    block, inner = data.place() if data.has(1) else (window.size, 0)
    return Header(tuple(names), tuple(lengths), block << 16 | inner)


def _likely(data: Data, at: int, header: Header) -> int | None:
    """Length of a record that may start ``at`` bytes on; None if nothing like one does, -1 at the end of the data."""
    if not data.has(at + 36):
        return -1 if not data.has(at + 1) else None
    size, ref, pos, name_len, _, _, n_ops, _, seq_len, next_ref, next_pos, _ = struct.unpack_from("<iiiBBHHHiiii", data.data, data.at + at)
    references = len(header.names)
    if not (-1 <= ref < references and -1 <= next_ref < references and pos >= -1 and next_pos >= -1 and name_len >= 1 and seq_len >= 0):
        return None
    if ref >= 0 and pos >= max(header.lengths[ref], 1) or size < 32 + name_len + 4 * n_ops + (seq_len + 1) // 2 + seq_len:
        return None
    if not data.has(at + 36 + name_len + 4 * n_ops):
        return None
    name = data.data[data.at + at + 36 : data.at + at + 36 + name_len]
    if name[-1] != 0 or any(not 33 <= c <= 126 for c in name[:-1]):
        return None
    ops = struct.unpack_from(f"<{n_ops}I", data.data, data.at + at + 36 + name_len)
    return 4 + size if all(x & 15 <= 8 for x in ops) else None


def _record_from(data: Data, header: Header) -> bool:
    """If records, ``CHAIN`` of them or all there are, follow one another from the present place on."""
    at = 0
    for k in range(CHAIN):
        size = _likely(data, at, header)
        if size == -1:
            return k > 0
        if size is None:
            return False
        at += size
    return True


def first_record(window: Window, block: int, high: int, header: Header) -> tuple[int, int] | None:
    """(block, offset in it) of the first record that starts in a block from ``block`` on and below ``high``."""
    for offset, own in blocks(window, block):
        if offset >= high:
            return None
        data = Data(window, offset)  # this block, and those after it that a candidate asks for
        for inner in range(len(own)):
            if data.has(inner + 1):
                data.at = inner
                if _record_from(data, header):
                    return offset, inner
                data.at = 0
    return None


def stretches(file, header: Header, low: int, high: int) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """Records whose block starts at ``low`` or later and below ``high``, many at a time: data, where in it each record starts (after its length), their lengths and their virtual offsets."""
    window = Window(file)
    block, inner = header.first >> 16, header.first & 0xFFFF
    if block >= high:
        return
    if low > block:
        start = first_block(window, low, high)
        found = first_record(window, start, high, header) if start is not None else None
        if found is None:
            return
        block, inner = found
    rows, ended = blocks(window, block), False
    data, at, edges, origins = bytearray(), inner, [], []  # edges: where blocks begin in the data, origins: where in the file
    size_at = struct.Struct("<i").unpack_from
    while not ended:
        want = len(data) + STRETCH
        while len(data) < want:
            got = next(rows, None)
            if got is None:
                ended = True
                break
            if got[1]:
                edges.append(len(data))
                origins.append(got[0])
                data += got[1]
            if got[0] >= high:
                break
        beyond = bisect.bisect_left(origins, high)
        stop = edges[beyond] if beyond < len(edges) else len(data)
        begins, sizes, whole = [], [], len(data)
        while at < stop and at + 4 <= whole:
            (size,) = size_at(data, at)
            if size < 32:
                raise ValueError(f"no record at {at} of the data from block {origins[0]} on")
            if at + 4 + size > whole:
                break
            begins.append(at + 4)
            sizes.append(size)
            at += 4 + size
        if begins:
            starts, marks = np.array(begins, np.int64), np.array(edges, np.int64)
            own = np.searchsorted(marks, starts - 4, "right") - 1
            yield bytes(data), starts, np.array(sizes, np.int64), np.array(origins, np.int64)[own] << 16 | (starts - 4 - marks[own])
        if at >= stop and beyond < len(edges):
            return
        passed = bisect.bisect_right(edges, at) - 1  # blocks before the one of the present place
        if passed >= 0:
            cut = edges[passed]
            del data[:cut]
            edges, origins, at = [e - cut for e in edges[passed:]], origins[passed:], at - cut
    if at < len(data):
        raise ValueError("the file ends within a record")


#: A record's fixed fields, its length first.
_FIXED = np.dtype([("size", "<i4"), ("ref", "<i4"), ("pos", "<i4"), ("name", "u1"), ("quality", "u1"), ("bin", "<u2"), ("ops", "<u2"), ("flag", "<u2"), ("bases", "<i4"), ("next_ref", "<i4"), ("next_pos", "<i4"), ("length", "<i4")])


class Writer:
    """Data as BGZF blocks; ``write`` and ``close`` give the bytes to write."""

    def __init__(self, level: int = 6, payload: int = PAYLOAD):
        self.level, self.payload, self.rest = level, payload, bytearray()

    def _block(self, data: bytes) -> bytes:
        packer = zlib.compressobj(self.level, zlib.DEFLATED, -15)
        body = packer.compress(data) + packer.flush()
        head = MAGIC + bytes([0, 0, 0, 0, 0, 255, 6, 0]) + b"BC" + struct.pack("<HH", 2, len(body) + 25)
        return head + body + struct.pack("<II", zlib.crc32(data), len(data))

    def write(self, data: bytes) -> bytes:
        self.rest += data
        out = []
        while len(self.rest) >= self.payload:
            out.append(self._block(bytes(self.rest[: self.payload])))
            del self.rest[: self.payload]
        return b"".join(out)

    def close(self) -> bytes:
        return (self._block(bytes(self.rest)) if self.rest else b"") + END


def bam_header(references: list[tuple[str, int]]) -> bytes:
    text = "".join(f"@SQ\tSN:{n}\tLN:{size}\n" for n, size in references).encode()
    named = b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", size) for n, size in references)
    return b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(references)) + named


def bam_record(name: str, ref: int, pos: int, flag: int, cigar: list[tuple[int, int]], tags: bytes = b"") -> bytes:
    """A record without bases. cigar: (operation, length)."""
    body = struct.pack("<iiBBHHHiiii", ref, pos, len(name) + 1, 255, 4680, len(cigar), flag, 0, -1, -1, 0)
    body += name.encode() + b"\0" + struct.pack(f"<{len(cigar)}I", *[n << 4 | op for op, n in cigar]) + tags
    return struct.pack("<i", len(body)) + body


def spread(counts: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The places of runs that follow one another: ``starts[0]``, ``starts[0] + 1``, and so on for each run's count."""
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)


def bam_records(names: np.ndarray, name_sizes: np.ndarray, refs: np.ndarray, positions: np.ndarray, flags: np.ndarray, cigar: np.ndarray, n_ops: np.ndarray, hits: np.ndarray, has_hits: np.ndarray) -> bytes:
    """The bytes that ``bam_record`` gives for each of many records, one after the other. names: all names' bytes; cigar: all operations as BAM packs them; hits: NH where ``has_hits``."""
    for what, values, least, most in (("name length", name_sizes, 0, 254), ("operations", n_ops, 0, 0xFFFF), ("flag", flags, 0, 0xFFFF)):
        if len(values) and not (least <= values.min() and values.max() <= most):
            raise ValueError(f"a record's {what} is beyond {least} to {most}")
    sizes = 36 + name_sizes + 1 + 4 * n_ops + 7 * has_hits
    at = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.uint8)
    fixed = np.zeros(len(sizes), _FIXED)
    for field, value in {"size": sizes - 4, "ref": refs, "pos": positions, "name": name_sizes + 1, "quality": 255, "bin": 4680, "ops": n_ops, "flag": flags, "next_ref": -1, "next_pos": -1}.items():
        fixed[field] = value
    out[at[:, None] + np.arange(36)] = fixed.view(np.uint8).reshape(-1, 36)
    out[spread(name_sizes, at + 36)] = names
    out[spread(4 * n_ops, at + 37 + name_sizes)] = cigar.astype("<u4").view(np.uint8)
    tags = np.zeros((int(has_hits.sum()), 7), np.uint8)
    tags[:, :3] = np.frombuffer(b"NHi", np.uint8)
    tags[:, 3:] = hits[has_hits].astype("<i4").view(np.uint8).reshape(-1, 4)
    out[(at + sizes - 7)[has_hits][:, None] + np.arange(7)] = tags
    return out.tobytes()
