"""Byte-level BPE on a sentencepiece model that is written straight from a rank vocabulary.

Every byte is mapped to one printable character, so a token is a string of mapped characters. The model file is a
protocol buffer of pieces, one for each token, scored by its negative rank, with identity normalisation and no
white-space handling; merging the best-scored pair first is then merging the lowest rank first. A text is
split by the vocabulary's pattern and each pre-token encoded for itself; a pre-token that is a token is that
token. Ids are decoded by the inverse mapping.

Defined results: a null or empty text has no ids; special-token strings are ordinary text; repeated rows are kept;
an empty table gives an empty result; extra columns are kept by ``encode_decode`` and not read by the query.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chunks
from .runtime import documents, fresh, small_batches, tidy

#: Bytes of texts that are encoded at a time, and pieces a worker keeps in each of two generations.
BATCH = 3 << 20
PIECES = 120_000

UNKNOWN, NORMAL = 2, 1
BPE = 2


def byte_characters() -> list[str]:
    """One printable, distinct character for each byte: itself where printable Latin-1, else from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table, spare = [""] * 256, 0x100
    for b in range(256):
        if b in printable:
            table[b] = chr(b)
        else:
            table[b], spare = chr(spare), spare + 1
    return table


def load_ranks(path: str) -> list[bytes]:
    """Token bytes by rank from a file of base64 token and rank."""
    with open(path, "rb") as lines:
        ranked = {int(r): base64.b64decode(t) for t, r in map(bytes.split, lines)}
    return [ranked[i] for i in range(len(ranked))]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int | float) -> bytes:
    """A protocol buffer field: bytes are length-delimited, floats 32-bit, integers varints."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(int(value))


def sentencepiece_model(tokens: list[bytes]) -> bytes:
    """The serialised model; piece 0 is the unknown piece, piece i + 1 has rank i."""
    chars = byte_characters()
    out = [_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, UNKNOWN))]
    for rank, token in enumerate(tokens):
        piece = "".join(chars[b] for b in token).encode()
        out.append(_field(1, _field(1, piece) + _field(2, float(-rank)) + _field(3, NORMAL)))
    trainer = _field(3, BPE) + _field(4, len(tokens) + 1) + _field(24, 0) + _field(35, 0) + _field(40, 0)
    trainer += b"".join(_field(n, (1 << 64) - 1) for n in (41, 42, 43))  # no bos, eos or pad
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(out) + _field(2, trainer) + _field(3, normalizer)


class Codec:
    """Encoder and decoder of one vocabulary, made once for each worker."""

    def __init__(self, vocabulary: str, pattern: str):
        import regex
        import sentencepiece

        self.tokens = load_ranks(vocabulary)
        self.whole = {t: i for i, t in enumerate(self.tokens)}
        self.names = [str(i) for i in range(len(self.tokens))]
        self.model = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(self.tokens))
        self.split = regex.compile(pattern).findall
        self.map = byte_characters()
        self.pieces = chunks.PieceCache(self._encode_pieces, "<u4", pattern == chunks.CLASSES, limit=PIECES)

    def _encode_pieces(self, pieces: list[str]) -> list[bytes]:
        pre = [[p.encode() for p in self.split(piece)] for piece in pieces]
        rare = [p for p in {p for ps in pre for p in ps} if p not in self.whole]
        chars = self.map
        got = self.model.encode(["".join([chars[b] for b in p]) for p in rare], num_threads=1) if rare else []
        ids = dict(zip(rare, got))
        return [
            b"".join([struct.pack("<I", self.whole[p]) if p in self.whole else struct.pack(f"<{len(ids[p])}I", *[i - 1 for i in ids[p]]) for p in ps]) for ps in pre
        ]

    def encode(self, texts: pa.Array) -> Iterator[list[int]]:
        """Each text's ids, of a string column without nulls."""
        ids, counts = self.pieces.of(texts)
        ends = np.cumsum(counts).tolist()
        for low, high in zip([0, *ends], ends):
            yield ids[low:high].tolist()

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(vocabulary: str, pattern: str) -> Codec:
    key = (vocabulary, pattern)
    if key not in _CODECS:
        _CODECS[key] = Codec(*key)
    return _CODECS[key]


def encode_decode(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", ids: bool = True, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with ids (array, if asked for), n_tokens, ids_sha256 and decoded_sha256; columns of those names are replaced."""
    small_batches(docs.sparkSession, size=BATCH)
    made = [*(["ids"] if ids else []), "n_tokens", "ids_sha256", "decoded_sha256"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in made]
    types = {"ids": "array<int>", "n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in keep] + [f"{n} {types[n]}" for n in made])
    chosen = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias(*fresh([*docs.columns, *made], "whole_text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = codec(vocabulary, pattern)
        for batch in tidy(batches):
            names, counts, digests, decoded, kept = code.names, [], [], [], []
            for row in code.encode(batch.column(batch.num_columns - 1)):  # a row at a time: numbers take many times their bytes
                counts.append(len(row))
                digests.append(hashlib.sha256(",".join(map(names.__getitem__, row)).encode()).hexdigest())
                decoded.append(hashlib.sha256(code.decode(row)).hexdigest())
                if ids:
                    kept.append(pa.array(row, pa.int32()))
            got = {"n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(digests, pa.string()), "decoded_sha256": pa.array(decoded, pa.string())}
            if ids:
                ends = np.cumsum([0, *counts]).astype(np.int32)
                got["ids"] = pa.ListArray.from_arrays(pa.array(ends), pa.concat_arrays(kept) if kept else pa.array([], pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *[got[n] for n in made]], [*keep, *made])

    return chosen.mapInArrow(run, schema)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the bytes they decode to."""
    import public_tokenizers as p

    return encode_decode(documents(spark, sf_dir), p.path("byte_bpe_multi_50k.tiktoken"), p.PATTERN, ids=False, keep=["doc_id"])
