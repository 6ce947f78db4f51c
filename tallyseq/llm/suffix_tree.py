"""LM scoring by a probabilistic suffix tree over words.

The symbols are words and one end a text. The root is the add-one distribution over all training tokens, with a
share for what was never seen. The last one to ``DEPTH`` words are a candidate context wherever they occur ``LEAST``
times or more in the training texts, and a symbol has an entry in a context with which it occurs as often; both
are plain counts, so the tree grows with the corpus. A candidate is kept if its next symbols diverge enough from
those of the longest kept suffix of it: the gain in log likelihood must pay half the logarithm of the corpus for each
entry. In a kept context an entry has its discounted relative frequency, and what is left is spread over all other
symbols as the suffix has it. A text is scored by the longest kept suffix at each word.

The tree never is in one place. Texts are cut into words once and written as blocks of numbered words to the shared
folder. The first round counts words: each block sends its distinct words with its own counts to the tasks that hold their
parts, and hears their numbers and sums, which give the base score. Then all lengths of context are settled in one exchange: a
block sends each distinct run of a word and the words before it, with its own count, to the task that holds the last word of its
context. There all longer contexts that end in this word meet, so the task counts and settles them from the shortest to the
longest and answers each block with the log probability of its runs. A run travels once whatever is kept, so
the exchange grows as the input does. A word with more than a task's share of all tokens is settled before that: its pairs are dealt over parts by
their symbols, only the sums of such contexts, a few a part, meet on the driver, and runs after it go to the task of their last two words; a
frequent context of several words is treated alike, in a round for each length that has any.

Defined results: a null or empty text is the end alone; a null id counts as empty text in the fold; repeated rows
count each time; without training texts the base is uniform over nothing (each token has probability 1) and so is
the score; an empty table gives an empty result; extra columns are not read. A text stays whole in one block.
Words are known by 64-bit hashes, longer contexts by hashes of their words' numbers of at least 20 bits more than the tokens' number has.
"""

from __future__ import annotations

import gc
import math
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import buffers, cut, doc_bucket, documents, filesystem, fresh, remove_folder, shared_folder, small_batches, tidy, utf8, write_file

DEPTH = 3
LEAST = 2
DISCOUNT = 0.5
#: The hash that stands for a text's end; a word with the same hash would be taken for it.
END = np.uint64(0)
#: Tokens a block has, and bytes of text that are cut into words at a time.
BLOCK = 1_500_000
BATCH = 4 << 20
#: A context is dealt over parts if it occurs more often than this and than an even share of all tokens.
SPLIT = 20_000
#: Runs whose contexts a task settles at a time, unless one context has more.
SLICE = 500_000
#: Below so much of the suffix's probability outside the entries a context is not kept: what is left could not be spread.
ROOM = 1e-6

ANSWER = "level int, part int, block long, payload binary"


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes, each by byte planes and compressed."""
    codec, out = pa.Codec("zstd", compression_level=1), []
    for a in arrays:
        planes = np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T).tobytes() if len(a) else b""
        body = codec.compress(planes, asbytes=True) if planes else b""
        out += [struct.pack("<3sqq", a.dtype.str.encode(), len(a), len(body)), body]
    return b"".join(out)


def narrow(a: np.ndarray) -> np.ndarray:
    """Numbers from 0 in as few bytes each as they need."""
    return a.astype(np.min_scalar_type(int(a.max()) if len(a) else 0))


def unpack(data: bytes) -> list[np.ndarray]:
    codec, out, at = pa.Codec("zstd"), [], 0
    while at < len(data):
        kind, n, size = struct.unpack_from("<3sqq", data, at)
        at += struct.calcsize("<3sqq")
        dtype = np.dtype(kind.decode())
        if n:
            planes = np.frombuffer(codec.decompress(data[at : at + size], n * dtype.itemsize, asbytes=True), np.uint8)
            out.append(np.ascontiguousarray(planes.reshape(dtype.itemsize, n).T).view(dtype).ravel())
        else:
            out.append(np.zeros(0, dtype))
        at += size
    return out


def steps(ascending: np.ndarray) -> np.ndarray:
    """Differences of ascending unsigned numbers, which pack better; ``np.cumsum`` undoes it."""
    return np.diff(ascending, prepend=ascending.dtype.type(0))


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of two unsigned 64-bit arrays."""
    x = (a ^ (a >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of the wanted values among the ascending keys, or -1."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


def changes(values: np.ndarray) -> np.ndarray:
    """Where a value differs from the one before it; the first does."""
    new = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=new[1:])
    return new


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ascending distinct values, a place of each, which of them each value is); numpy's own way sorts stably, which takes several times as long."""
    order = np.argsort(values)
    ascending = values[order]
    new = changes(ascending)
    which = np.empty(len(values), np.int32)
    which[order] = np.cumsum(new, dtype=np.int32) - 1
    return ascending[new], order[new], which


def read_file(uri: str) -> bytes:
    fs, path = filesystem(uri)
    with fs.open_input_stream(path, compression=None) as stream:
        return stream.read()


def tokenised(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words and ends, tokens a text)."""
    import xxhash

    words = [t.lower().split() for t in texts]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    out = np.full(int(sizes.sum()) + len(words), END, np.uint64)
    ends = np.cumsum(sizes + 1) - 1
    place = np.ones(len(out), bool)
    place[ends] = False
    out[place] = np.fromiter(map(xxhash.xxh64_intdigest, chain.from_iterable(words)), np.uint64, int(sizes.sum()))
    return out, sizes + 1


def firsts(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


@dataclass(frozen=True)
class Corpus:
    """What every task knows: parts of the tree, longest contexts, tokens and distinct tokens of the training texts, occurrences up to which a context stays in one part, and the results by level of those that don't."""

    folder: str
    labels: np.ndarray
    depth: int = DEPTH
    tokens: int = 0
    kinds: int = 0
    most: int = 0
    hot: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)

    @property
    def parts(self) -> int:
        return len(self.labels)

    @property
    def log_all(self) -> float:
        return math.log10(self.tokens + self.kinds + 1)

    @property
    def bits(self) -> int:
        """Bits of a context's key: so many more than the corpus has tokens that one context in a million meets another's key."""
        return min(64, max(40, (self.tokens + 2).bit_length() + 20))

    def logs(self, short: np.ndarray) -> np.ndarray:
        """Log probabilities that were sent as they are, or as counts where they are the root's."""
        return short.astype(float) if short.dtype.kind == "f" else np.log10(short + 1.0) - self.log_all

    def key(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        return mix(context, word) >> np.uint64(64 - self.bits)

    def part_of(self, keys: np.ndarray, bits: int) -> np.ndarray:
        """The part of each key of so many bits: an even share of their range, so that keys of a part lie close."""
        return ((keys >> np.uint64(bits - 32)) * np.uint64(self.parts) >> np.uint64(32)).astype(np.int64)


def undealt(tokens: int, parts: int) -> int:
    """Occurrences up to which a context stays in one part."""
    return max(SPLIT, tokens // parts)


def block_bytes(rows: pa.Table, trains: np.ndarray, sizes: np.ndarray, hashes: np.ndarray) -> tuple[bytes, bytes]:
    """A block's texts, and its distinct words, which only the first round reads."""
    words, codes = np.unique(hashes, return_inverse=True)
    often = np.argsort(-np.bincount(codes), kind="stable")  # frequent words have small numbers, which pack better
    rank = np.empty(len(words), np.uint32)
    rank[often] = np.arange(len(words), dtype=np.uint32)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as out:
        out.write_table(rows)
    packed = pack(sizes, trains.astype(np.uint8), often.astype(np.uint32), rank[codes])
    return struct.pack("<q", len(packed)) + packed + sink.getvalue().to_pybytes(), pack(steps(words))


def write_blocks(docs: DataFrame, keep: list[str], trains: str, folder: str) -> DataFrame:
    """(block) of every block of the documents' words written to the folder, with ``keep`` and if the text trains."""
    small_batches(docs.sparkSession, size=BATCH)
    (text,) = fresh([*keep, trains], "bytes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, tokens = TaskContext.get().partitionId() << 24, [], 0

        def flush() -> pa.RecordBatch:
            rows = pa.Table.from_batches([h[0] for h in held])
            block, words = block_bytes(rows, *[np.concatenate([h[i] for h in held]) for i in (1, 2, 3)])
            write_file(f"{folder}/{number}.block", iter([block]))
            write_file(f"{folder}/words/{number}", iter([words]))
            return pa.RecordBatch.from_pydict({"block": [number]})

        for batch in tidy(batches):
            if not batch.num_rows:
                continue
            hashes, sizes = tokenised(buffers(batch.column(len(keep) + 1)))
            flags = np.asarray(batch.column(len(keep)).to_numpy(zero_copy_only=False), bool)
            held.append((batch.select(keep), flags, sizes, hashes))
            tokens += len(hashes)
            if tokens >= BLOCK:
                yield flush()
                number, held, tokens = number + 1, [], 0
        if held:
            yield flush()

    return docs.select(*keep, trains, utf8(F.col("text")).alias(text)).mapInArrow(run, "block long")


@dataclass
class Runs:
    """A block's distinct runs (context, symbol, the words before the context) whose context has ``level`` words: tokens that end one,
    which run each ends, a token of each run, its words before, and for each context its key, its part and its runs, in order of part and key."""

    level: int
    tokens: np.ndarray
    which: np.ndarray
    at: np.ndarray
    before: np.ndarray
    keys: np.ndarray
    parts: np.ndarray
    order: np.ndarray
    sizes: np.ndarray


class Block:
    """A block's tokens, and what has been answered so far: for each token the log probability by the longest kept context."""

    def __init__(self, corpus: Corpus, number: int):
        self.corpus, self.number = corpus, number
        data = read_file(f"{corpus.folder}/{number}.block")
        (size,) = struct.unpack_from("<q", data)
        self.sizes, trains, often, ranks = unpack(data[8 : 8 + size])
        self.codes = often[ranks].astype(np.int32)
        self.rows = pa.ipc.open_stream(data[8 + size :]).read_all()
        self.train = np.repeat(trains.astype(bool), self.sizes)
        self.place = (np.arange(len(self.codes)) - np.repeat(firsts(self.sizes), self.sizes)).astype(np.int32)

    def ask_words(self) -> Iterator[tuple[int, bytes]]:
        """(part, words and their training counts)."""
        words = np.cumsum(unpack(read_file(f"{self.corpus.folder}/words/{self.number}"))[0])
        counts = np.bincount(self.codes[self.train], minlength=len(words))
        for p, low, high in runs(self.corpus.part_of(words, 64)):
            yield p, pack(steps(words[low:high]), counts[low:high])

    def hear_words(self, answers: list[bytes]) -> None:
        got = [unpack(a) for a in answers]
        ids, counts = (np.concatenate([g[i] for g in got]) for i in (0, 1))
        order = np.argsort(ids)  # from now on a word's code is its place among the block's numbers
        code = np.empty(len(ids), np.int32)
        code[order] = np.arange(len(ids), dtype=np.int32)
        self.ids, self.counts, self.codes = ids[order], counts[order], code[self.codes]
        self.value = (np.log10(self.counts + 1.0) - self.corpus.log_all)[self.codes]
        first = firsts(self.sizes)
        self.known = np.add.reduceat((self.counts > 0)[self.codes], first, dtype=np.int64)
        self.base = np.add.reduceat(self.value, first)
        self.told = (self.counts >= LEAST)[self.codes]
        # of the first length of context: the word before
        self.level, self.suffix_count, self.frequent = 1, self.counts[self.codes], []
        self.context = self._after(self.codes, 1)
        self.keys, self.totals = self.ids, self.counts
        self._look()

    def _after(self, values: np.ndarray, words: int) -> np.ndarray:
        """Each token's value of the token before, or -1 where fewer ``words`` stand before it in its text."""
        out = np.full(len(values), -1, np.int32)
        out[1:] = values[:-1]
        out[self.place < words] = -1
        return out

    def _look(self) -> None:
        """Tokens after frequent contexts of the current length, and the pairs of both."""
        open_ = np.flatnonzero(self.context >= 0)
        self.open = open_ = open_[self.totals[self.context[open_]] > self.corpus.most]
        self.frequent.append(np.zeros(len(self.codes), bool))
        self.frequent[-1][open_] = True
        pairs, at, self.pair = distinct(self.context[open_].astype(np.int64) << 32 | self.codes[open_])
        self.pair_context, self.pair_code = pairs >> 32, pairs & 0xFFFFFFFF
        self.there = open_[at]

    def _listed(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs whose suffix was counted often enough, in order of part, and their parts: as many a context as it has shares."""
        corpus = self.corpus
        listed = np.flatnonzero(self.suffix_count[self.there] >= LEAST)
        context, symbol = self.pair_context[listed], self.ids[self.pair_code[listed]]
        shares = (1 + self.totals[context] // corpus.most).astype(np.uint64)
        part = ((self.keys[context] % np.uint64(corpus.parts) + mix(symbol, symbol) % shares * np.uint64(7919)) % np.uint64(corpus.parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        return listed[order], part[order]

    def ask_frequent(self) -> Iterator[tuple[int, bytes]]:
        """(part, frequent contexts and pairs with their training counts and the suffix's log probability) of the current length."""
        listed, part = self._listed()
        n = np.bincount(self.pair[self.train[self.open]], minlength=len(self.pair_code))[listed]
        context, symbol, there = self.pair_context[listed], self.ids[self.pair_code[listed]], self.there[listed]
        short = narrow(self.suffix_count[there]) if self.level == 1 else self.value[there].astype(np.float32)
        for p, low, high in runs(part):
            first = np.flatnonzero(changes(context[low:high]))
            c = context[low:high][first]
            yield p, pack(*map(narrow, (self.keys[c], self.totals[c], np.diff(np.append(first, high - low)), symbol[low:high], n[low:high])), short[low:high])

    def hear_frequent(self, answers: list[bytes]) -> None:
        """Take in the answers to what was asked last, and go on to contexts one word longer."""
        level, count = self.level, np.zeros(len(self.pair_context), np.int64)
        if answers:
            count[self._listed()[0]] = np.concatenate([unpack(a)[0] for a in answers])
        keys, values = self.corpus.hot[level]
        at = find(keys, self.keys[self.pair_context])
        spread = np.where(at >= 0, values[at] if len(values) else np.nan, np.nan)[self.pair]
        n, i = count[self.pair], self.open
        own = np.log10(np.maximum(n, 1) - DISCOUNT) - np.log10(self.totals[self.pair_context])[self.pair]
        self.value[i] = np.where(np.isnan(spread), self.value[i], np.where(n >= LEAST, own, self.value[i] + spread))
        if level == self.corpus.depth:
            return
        self.suffix_count = np.zeros(len(self.codes), np.int64)
        self.suffix_count[i] = n
        ended = np.full(len(self.codes), -1, np.int32)
        ended[i] = self.pair
        self.context = self._after(ended, level + 1)
        self.keys, self.totals, self.level = self.corpus.key(self.keys[self.pair_context], self.ids[self.pair_code]), count, level + 1
        self._look()

    def _ending(self, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which sequence of up to so many words ends at each token, and for each the sequence before its last word plus 1 and that word); words counted less often than ``LEAST`` end what stands before, as no context holds them."""
        if words not in self.sequences:
            if words == 1:
                found = self.codes, np.zeros(len(self.ids), np.int64), np.arange(len(self.ids))
            else:
                before = np.where(self.told, self._ending(words - 1)[0] + 1, 0)
                keys, _, which = distinct((self._after(before, 1).clip(0)).astype(np.int64) << 32 | self.codes)
                if words == 2:
                    self.pairs = which
                by_last = np.argsort((keys & 0xFFFFFFFF) << 32 | keys >> 32)  # so that runs whose contexts agree in more words stand together
                rank = np.empty(len(keys), np.int32)
                rank[by_last] = np.arange(len(keys), dtype=np.int32)
                found = rank[which], (keys >> 32)[by_last], (keys & 0xFFFFFFFF)[by_last]
            self.sequences[words] = found
        return self.sequences[words]

    def _runs(self) -> Iterator[Runs]:
        """Runs by the length of the shortest context before a token that is not frequent."""
        corpus, self.sequences = self.corpus, {}
        open_ = np.ones(len(self.codes), bool)
        for level in range(1, corpus.depth + 1):
            frequent = self.frequent[level - 1] if level <= len(self.frequent) else np.zeros(len(open_), bool)
            tokens = np.flatnonzero(open_ & ~frequent & (self.place >= level))
            tokens = tokens[self.told[tokens - level]]
            open_ = frequent
            context = (self._ending(level)[0] if len(tokens) else self.codes)[tokens - 1]
            if level == 1 and corpus.depth > 2:
                self._ending(2)
                pair = self.pairs[tokens]
            else:
                pair = distinct(context.astype(np.int64) << 32 | self.codes[tokens])[2]
            before = np.zeros(len(tokens), np.int64)
            if level < corpus.depth:
                more = np.flatnonzero(self.place[tokens] > level)
                end = tokens[more] - level - 1
                before[more] = np.where(self.told[end], self._ending(corpus.depth - level)[0][end] + 1, 0)
            found, at, which = distinct(pair.astype(np.int64) << 32 | before)
            first = np.flatnonzero(changes(context[at]))
            sizes, there = np.diff(np.append(first, len(at))), tokens[at[first]]
            keys = self.ids[self.codes[there - level]]
            for back in range(level - 1, 0, -1):
                keys = corpus.key(keys, self.ids[self.codes[there - back]])
            parts = corpus.part_of(keys, corpus.bits) if level > 1 else (keys % np.uint64(corpus.parts)).astype(np.int64)
            by = np.lexsort((keys, parts))
            sizes, first = sizes[by], first[by]
            order = np.repeat(first - firsts(sizes), sizes) + np.arange(len(at))
            yield Runs(level, tokens, which, tokens[at[order]], (found & 0xFFFFFFFF)[order], keys[by], parts[by], order, sizes)

    def ask(self) -> Iterator[tuple[int, bytes]]:
        """(part, for each length of context the contexts, their symbols with the suffix's log probability or, where the root is the suffix, the symbol's count, the words before and training counts)."""
        out: dict[int, list[bytes]] = {}
        for r in self._runs():
            n = np.bincount(r.which[self.train[r.tokens]], minlength=len(r.at))[r.order]
            code, starts = self.codes[r.at], np.zeros(len(r.at), bool)
            starts[firsts(r.sizes)] = True
            pair = np.flatnonzero(changes(code) | starts)
            starts = starts[pair]
            several = np.diff(np.append(pair, len(code)))  # runs a pair
            pairs = np.diff(np.append(np.flatnonzero(starts), len(pair)))  # pairs a context
            symbol = self.ids[code[pair]]
            ahead = np.where(starts, symbol, symbol - np.append(symbol[:1], symbol[:-1]))  # a context's symbols ascend
            short = narrow(self.counts[code[pair]]) if r.level == 1 else self.value[r.at[pair]].astype(np.float32)
            words, rest = [], r.before
            for length in range(self.corpus.depth - r.level, 0, -1):
                _, earlier, last = self._ending(length)
                i = np.maximum(rest - 1, 0)
                words.append(np.where(rest > 0, self.ids[last[i]] + np.uint64(1), np.uint64(0)))
                rest = np.where(rest > 0, earlier[i], 0)
            pair_ends, ends = np.cumsum(pairs), np.cumsum(r.sizes)
            for p, low, high in runs(r.parts):
                x, own = slice(pair_ends[low] - pairs[low], pair_ends[high - 1]), slice(ends[low] - r.sizes[low], ends[high - 1])
                ints = [steps(r.keys[low:high]), pairs[low:high], ahead[x], several[x], n[own], *[w[own] for w in words]]
                own_short = short[x] if r.level > 1 else short[x][np.unique(symbol[x], return_index=True)[1]]  # a symbol's count once
                out.setdefault(p, []).append(struct.pack("<q", r.level) + pack(own_short, *map(narrow, ints)))
        for p in sorted(out):
            yield p, joined(out[p])

    def hear(self, answers: list[bytes]) -> None:
        got = [parted(a) for a in answers]
        heard: dict[int, list[np.ndarray]] = {}
        for part in got:
            for x in part:
                new, values = unpack(x[8:])
                heard.setdefault(struct.unpack_from("<q", x)[0], []).append(values[np.cumsum(new, dtype=np.int64) - 1])
        for r in self._runs():
            if r.level in heard:
                values = np.empty(len(r.order))
                values[r.order] = np.concatenate(heard[r.level])
                self.value[r.tokens] = values[r.which]

    def scores(self) -> list[np.ndarray]:
        """(tokens, known tokens, base score, score) of each text."""
        return [self.sizes, self.known, self.base, np.add.reduceat(self.value, firsts(self.sizes))]


def joined(parts: list[bytes]) -> bytes:
    return b"".join(x for p in parts for x in (struct.pack("<q", len(p)), p))


def parted(data: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(data):
        (size,) = struct.unpack_from("<q", data, at)
        out.append(data[at + 8 : at + 8 + size])
        at += 8 + size
    return out


def runs(ascending: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, start, end) of each run of equal values."""
    if len(ascending):
        edge = np.flatnonzero(np.diff(ascending)) + 1
        for low, high in zip([0, *edge], [*edge, len(ascending)]):
            yield int(ascending[low]), int(low), int(high)


def settled(total: np.ndarray, own: np.ndarray, there: np.ndarray, gain: np.ndarray, seen: np.ndarray, entries: np.ndarray, tokens: int) -> np.ndarray:
    """For each context the log of what it leaves to each other symbol over the suffix's, or NaN if it is not kept."""
    room = 1 - there
    left = np.log10(np.maximum(1 - own, 1e-12)) - np.log10(np.maximum(room, 1e-12))
    paid = gain + (total - seen) * left > 0.5 * math.log10(max(tokens, 2)) * entries
    return np.where(paid & (room > ROOM), left, np.nan)


def answer_words(corpus: Corpus, part: int, asked: list[tuple[int, bytes]]) -> Iterator[tuple[int, bytes]]:
    """(block, numbers and counts of its words), then (-1, distinct words and tokens of the part, and the most that a word occurs)."""
    got = [unpack(a) for _, a in asked]
    words, at = np.unique(np.concatenate([np.cumsum(g[0]) for g in got]), return_inverse=True)
    n = np.bincount(at, np.concatenate([g[1] for g in got]), len(words)).astype(np.int64)
    ids = np.empty(len(words), np.uint64)
    ids[np.lexsort((words, -n))] = np.arange(len(words), dtype=np.uint64) * np.uint64(corpus.parts) + np.uint64(part)  # frequent words have small numbers
    ends = np.cumsum([len(g[0]) for g in got])
    for (block, _), high, g in zip(asked, ends, got):
        own = at[high - len(g[0]) : high]
        yield block, pack(ids[own], n[own])
    yield -1, pack(np.array([(n > 0).sum(), n.sum(), n.max()]))


def sums(where: np.ndarray, short: np.ndarray, n: np.ndarray, total: np.ndarray) -> list[np.ndarray]:
    """For each context what ``settled`` wants of its entries: their shares, the suffix's shares, gains, occurrences and number."""
    share = (n - DISCOUNT) / total[where]
    return [np.bincount(where, w, len(total)) for w in (share, 10**short, n * (np.log10(share) - short), n, np.ones(len(n)))]


def answer_frequent(corpus: Corpus, part: int, asked: list[tuple[int, bytes]]) -> Iterator[tuple[int, bytes]]:
    """(block, its pairs' counts), then (-1, sums of the part's share of frequent contexts, and the most that a pair occurs)."""
    got = [unpack(a) for _, a in asked]
    keys, at = np.unique(np.concatenate([g[0].astype(np.uint64) for g in got]), return_inverse=True)
    total = np.zeros(len(keys), np.int64)
    total[at] = np.concatenate([g[1] for g in got])
    context = np.repeat(at, np.concatenate([g[2] for g in got]))
    _, symbol = np.unique(np.concatenate([g[3] for g in got]), return_inverse=True)
    pairs, first, pair = distinct(context << 32 | symbol)
    n = np.bincount(pair, np.concatenate([g[4] for g in got]), len(pairs)).astype(np.int64)
    n[n < LEAST] = 0
    entry = n > 0
    of_entries = sums((pairs >> 32)[entry], corpus.logs(np.concatenate([g[5] for g in got])[first])[entry], n[entry], total)
    e = 0
    for (block, _), g in zip(asked, got):
        yield block, pack(narrow(n[pair[e : e + len(g[3])]]))
        e += len(g[3])
    yield -1, pack(keys, *[x.astype(float) for x in (total, *of_entries)], n.max(keepdims=True))


def symbols(pairs: np.ndarray, ahead: np.ndarray) -> np.ndarray:
    """The symbols of contexts with so many pairs each, from how far each is ahead of the one before in its context."""
    starts = firsts(pairs.astype(np.int64))
    symbol = np.cumsum(ahead, dtype=np.uint64)
    return symbol - np.repeat(symbol[starts] - ahead[starts], pairs)


def values_of(corpus: Corpus, level: int, got: list[list[np.ndarray]]) -> np.ndarray:
    """The log probability of each run that was sent, by the longest kept context; the contexts of ``level`` words are the shortest."""
    short, pairs, ahead, several, n, *words = (np.concatenate([g[i] for g in got]) for i in (0, *range(2, len(got[0]))))
    short = corpus.logs(short)
    symbol = symbols(pairs, ahead)
    context = np.repeat(np.concatenate([np.cumsum(g[1], dtype=np.uint64) for g in got]), pairs)
    run_pair = np.repeat(np.arange(len(several)), several)
    contexts, there, symbol = [context[run_pair]], [None], symbol[run_pair]
    for w in words:
        contexts.append(mix(contexts[-1], w.astype(np.uint64)))
        there.append(w > 0)
    # from the longest contexts to the shortest: distinct pairs, a run of each, and their counts
    which, at, counts = [], [np.arange(len(symbol))], [n.astype(np.int64)]
    for keys in reversed(contexts):
        _, first, pair = distinct(mix(keys[at[0]], symbol[at[0]]))
        counts.insert(0, np.bincount(pair, counts[0], len(first)).astype(np.int64))
        at.insert(0, at[0][first])
        which.insert(0, pair)
    value = short[run_pair[at[0]]]
    for keys, exists, own, m, pair in zip(contexts, there, at, counts, which):
        names, _, where = distinct(keys[own])
        total = np.bincount(where, m, len(names))
        real = np.ones(len(own), bool) if exists is None else exists[own]
        entry = (m >= LEAST) & real
        left = settled(total, *sums(where[entry], value[entry], m[entry], total), corpus.tokens)[where]
        share = np.log10(np.maximum(m, 1) - DISCOUNT) - np.log10(np.maximum(total, 1))[where]
        value = np.where(np.isnan(left) | ~real, value, np.where(entry, share, value + left))[pair]
    return value.astype(np.float32)


def answer(corpus: Corpus, part: int, asked: list[tuple[int, bytes]]) -> Iterator[tuple[int, bytes]]:
    """(block, the log probabilities of its runs, of which equal neighbours are said once)."""
    by_level: dict[int, list[tuple[int, list[np.ndarray]]]] = {}
    for i, (_, data) in enumerate(asked):
        for x in parted(data):
            (level,), g = struct.unpack_from("<q", x), unpack(x[8:])
            if level == 1:
                g[0] = g[0][np.unique(symbols(g[2], g[3]), return_inverse=True)[1]]
            by_level.setdefault(level, []).append((i, g))
    out: list[list[bytes]] = [[] for _ in asked]
    for level in sorted(by_level):
        found = by_level.pop(level)
        made = [np.empty(len(g[5]), np.float32) for _, g in found]
        keys = [np.cumsum(g[1], dtype=np.uint64) for _, g in found]
        slices = -(-sum(map(len, made)) // SLICE)
        for k in range(slices):
            taken = []
            for (_, g), own in zip(found, keys):
                context = mix(own, own) >> np.uint64(32) & np.uint64(0xFFFF)
                context = context % np.uint64(slices) == k
                pair = np.repeat(context, g[2])
                taken.append((context, pair, np.repeat(pair, g[4])))
            chosen = [[g[0][pair], steps(own[context]), g[2][context], g[3][pair], g[4][pair], *[x[run] for x in g[5:]]] for (_, g), own, (context, pair, run) in zip(found, keys, taken)]
            values, low = values_of(corpus, level, chosen), 0
            for own, (_, _, run) in zip(made, taken):
                high = low + int(run.sum())
                own[run] = values[low:high]
                low = high
        for (i, _), own in zip(found, made):
            new = changes(own)
            out[i].append(struct.pack("<q", level) + pack(new, own[new]))
    for (block, _), parts in zip(asked, out):
        yield block, joined(parts)


def combined(shares: list[list[np.ndarray]], tokens: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, what they leave) of the frequent contexts, from their parts' sums: at most a few a part, as each holds a part's share of all tokens."""
    if not shares:
        return np.zeros(0, np.uint64), np.zeros(0)
    keys, at = np.unique(np.concatenate([g[0] for g in shares]), return_inverse=True)
    columns = [np.concatenate([g[i] for g in shares]) for i in range(1, 7)]
    total = np.zeros(len(keys))
    total[at] = columns[0]
    return keys, settled(total, *[np.bincount(at, c, len(keys)) for c in columns[1:]], tokens)


def grouped(batches: Iterator[pa.RecordBatch], key: int) -> Iterator[tuple[int, list[tuple]]]:
    """(value of the key column, its rows) of rows that come sorted by it."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            if held and held[0][key] != row[key]:
                yield held[0][key], held
                held = []
            held.append(row)
    if held:
        yield held[0][key], held


def replayed(corpus: Corpus, number: int, levels: int, rows: list[tuple] | None = None) -> Block:
    """A block that has heard the answers of the first ``levels`` rounds. rows: level, part, block, payload of the last of them, in order.

    Answers travel once: those of earlier rounds are in files beside the block, and the last ones are put there.
    """
    block = Block(corpus, number)
    for level in range(levels):
        name = f"{corpus.folder}/{number}.heard-{level}"
        if rows is not None and level == levels - 1:
            answers = [r[3] for r in rows if r[0] == level]
            write_file(name, iter([joined(answers)]))
        else:
            answers = parted(read_file(name))
        block.hear_words(answers) if level == 0 else block.hear_frequent(answers)
    return block


def free(spark: SparkSession) -> None:
    """The files of a finished round's exchange go when the driver has collected its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def part_labels(spark: SparkSession, parts: int) -> np.ndarray:
    """Ascending numbers that Spark's hash partitioning deals to one partition each, all different."""
    drawn = spark.range(int(parts * (math.log(parts + 1) + 12))).select(F.col("id").cast("int").alias("label"))
    found = drawn.groupBy(F.pmod(F.hash("label"), F.lit(parts))).agg(F.min("label").alias("label")).collect()
    return np.array(sorted(r.label for r in found))


def scores(docs: DataFrame, keep: list[str], trains: str, depth: int = DEPTH) -> DataFrame:
    """``keep`` with n_tokens, n_known, train_tokens, base_score and score; the rows for which the column ``trains`` holds are learnt from."""
    spark = docs.sparkSession
    folder = shared_folder(spark, "suffix-tree")
    blocks = cut(write_blocks(docs, keep, trains, folder))
    corpus = Corpus(folder, part_labels(spark, int(spark.conf.get("spark.sql.shuffle.partitions"))), depth)
    parts = corpus.parts
    # a block that asked nothing has no answer but goes on
    every = blocks.select(F.lit(-1).alias("level"), F.lit(-1).alias("part"), "block", F.lit(None).cast("binary").alias("payload"))

    def by_block(answers: DataFrame) -> DataFrame:
        return answers.where("block >= 0").unionByName(every).repartition(parts, "block").sortWithinPartitions("block", "part")

    def round_(level: int, corpus: Corpus, answers: DataFrame | None, last: bool = False) -> DataFrame:
        """What the blocks hear when they have asked with the answers of the round before."""

        def asking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = ((b, None) for batch in tidy(batches) for b in batch.column(0).to_pylist()) if level == 0 else grouped(tidy(batches), 2)
            for number, rows in found:
                block = replayed(corpus, number, level, rows)
                asked = list(block.ask_words() if level == 0 else block.ask() if last else block.ask_frequent())
                if asked:
                    yield pa.RecordBatch.from_arrays([pa.array([int(corpus.labels[p]) for p, _ in asked], pa.int32()), pa.array([number] * len(asked)), pa.array([x for _, x in asked], pa.binary())], ["part", "block", "payload"])

        def answering(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for label, rows in grouped(tidy(batches), 0):
                part = int(find(corpus.labels, np.array([label]))[0])
                for block, payload in (answer_words if level == 0 else answer if last else answer_frequent)(corpus, part, [r[1:] for r in rows]):
                    yield pa.RecordBatch.from_arrays([pa.array([level], pa.int32()), pa.array([label], pa.int32()), pa.array([block]), pa.array([payload], pa.binary())], ["level", "part", "block", "payload"])

        source = blocks if level == 0 else by_block(answers)
        asked = source.mapInArrow(asking, "part int, block long, payload binary").repartition(parts, "part").sortWithinPartitions("part", "block")
        answered = asked.mapInArrow(answering, ANSWER)
        if last:
            return answered
        # written, not checkpointed: a checkpoint's frame holds on to the exchange it came from, and so to its files
        answered.write.parquet(f"{folder}/answers-{level}")
        free(spark)
        return spark.read.schema(ANSWER).parquet(f"{folder}/answers-{level}")

    def told(answered: DataFrame) -> list[list[np.ndarray]]:
        return [unpack(bytes(r.payload)) for r in answered.where("block < 0").select("payload").collect()]

    answers = round_(0, corpus, None)
    remove_folder(f"{folder}/words")
    words = np.array([t[0] for t in told(answers)] or [[0, 0, 0]])
    (kinds, tokens, _), largest = words.sum(axis=0).tolist(), int(words[:, 2].max())
    corpus = Corpus(folder, corpus.labels, depth, tokens, kinds, undealt(tokens, parts))
    level = 1
    while level <= depth and largest > corpus.most:
        answers = round_(level, corpus, answers)
        shares = told(answers)
        largest = max((int(s[-1][0]) for s in shares), default=0)
        corpus = replace(corpus, hot=corpus.hot | {level: combined(shares, tokens)})
        remove_folder(f"{folder}/answers-{level - 1}")  # heard by the blocks
        level += 1
    answers = round_(level, corpus, answers, last=True)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, rows in grouped(tidy(batches), 2):
            block = replayed(corpus, number, level)
            block.hear([r[3] for r in rows if r[0] == level])
            table = block.rows.combine_chunks()
            size, known, base, score = block.scores()
            made = [pa.array(x) for x in (size, known, np.full(len(size), corpus.tokens), base, score)]
            columns = [c.chunk(0) for c in table.columns]
            yield pa.RecordBatch.from_arrays([*columns, *made], names)

    names = [*keep, "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    out = cut(by_block(answers).mapInArrow(finish, f"{kept}, n_tokens long, n_known long, train_tokens long, base_score double, score double"))
    remove_folder(folder)
    return out


def op5_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log10 probability; learnt from the folds other than 2 of 7."""
    docs = documents(spark, sf_dir).select("doc_id", "text", (doc_bucket(F.col("doc_id"), 7) == 2).alias("held_out")).withColumn("trains", ~F.col("held_out"))
    return scores(docs, ["doc_id", "held_out"], "trains")
