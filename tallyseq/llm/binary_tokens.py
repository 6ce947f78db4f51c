"""Token ids as flat unsigned integer files with 64-bit document offsets.

Documents are dealt by range of doc_id, so partition p's documents all come before those of p + 1. Each task
encodes its documents in order and writes three files: ``.bin`` (ids, the narrowest unsigned type that holds the
vocabulary), ``.idx`` (64-bit offsets, one more than documents) and ``.doc`` (64-bit document ids). A file
appears whole under its final name, so a task that is run again replaces it with the same bytes. The start of
each file in the whole sequence is the prefix sum over the files' token counts. Readers map the files into
memory and touch only what they return.

Defined results: a null text is empty and gives the end id alone; strings of the vocabulary's added tokens get the ids
that the library's own call gives them; rows with a null doc_id come first; repeated
rows are kept, ordered by a hash of the text; an empty table gives no files and no rows; extra columns are not
read. A doc_id that a third of all rows share is dealt over partitions by the hash.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chunks
from .runtime import cut, documents, filesystem, remove_folder, shared_folder, small_batches, tidy, write_file

END_ID = 0


@dataclass(frozen=True)
class TokenFile:
    part: int
    n_docs: int
    n_null_ids: int
    n_tokens: int
    start: int = 0


#: A space and letters, digits or signs of ASCII, or letters beyond it; and the same without the space.
_PLAIN = re.compile(r" [^\s\x1c-\x1f\x85\xa0]+").fullmatch
_BARE = re.compile(r"[^\s\x1c-\x1f\x85\xa0]+").fullmatch

_ENCODERS: dict[tuple[str, str], chunks.PieceCache] = {}


def encoder(vocabulary: str, dtype: str) -> chunks.PieceCache:
    """One cached encoder for each worker and vocabulary: piece -> its ids as bytes."""
    key = (vocabulary, dtype)
    if key not in _ENCODERS:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(vocabulary)
        tokenizer.no_truncation()
        added = list(tokenizer.get_added_tokens_decoder().values())
        if any(t.lstrip or t.rstrip or t.normalized or any(c.isspace() for c in t.content) for t in added):
            raise ValueError("added tokens that take in white space: texts can't be cut at spaces")
        special = [t.content for t in added]  # the library's call gives their strings in a text their own ids
        vocabulary_ids = tokenizer.get_vocab()
        opens = np.zeros(max(vocabulary_ids.values()) + 1, bool)  # tokens that start with the mapped space
        opens[[i for t, i in vocabulary_ids.items() if t.startswith("Ġ")]] = True
        line = vocabulary_ids.get("Ċ")
        width = np.dtype(dtype).itemsize
        kinds = json.loads(tokenizer.to_str())["pre_tokenizer"] or {}
        classes = kinds.get("type") == "ByteLevel" and bool(kinds.get("use_regex", True)) and not kinds.get("add_prefix_space")

        def separately(pieces: list[str]) -> list[bytes]:
            return [np.array(e.ids, dtype).tobytes() for e in tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

        def ids_of(text: str) -> np.ndarray:
            return np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype)

        def spaced(pieces: list[str]) -> list[bytes]:
            """Pieces that start with a space, have no other and end with none, in one call: each one's first token, and no other, starts with the space."""
            ids = ids_of("".join(pieces))
            at = (np.flatnonzero(opens[ids]) * width).tolist()
            if len(at) != len(pieces):
                return separately(pieces)
            data = ids.tobytes()
            return [data[i:j] for i, j in zip(at, [*at[1:], len(data)])]

        def lined(pieces: list[str]) -> list[bytes]:
            """Pieces without white space, a line each, in one call: between two of them stands the line end's token, and nowhere else."""
            ids = ids_of("\n".join(pieces))
            at = (np.flatnonzero(ids == line) * width).tolist()
            if line is None or len(at) != len(pieces) - 1:
                return separately(pieces)
            data = ids.tobytes()
            return [data[i:j] for i, j in zip([0, *[k + width for k in at]], [*at, len(data)])]

        def encode_all(pieces: list[str]) -> list[bytes]:
            odd = {p for s in special for p in pieces if s in p}
            out: dict[str, bytes] = {}
            with_space = [p for p in pieces if p[:1] == " " and _PLAIN(p) and p not in odd]
            without = [p for p in pieces if _BARE(p) and p not in odd] if classes else []
            for group, together in ((with_space, spaced), (without, lined)):
                for low in range(0, len(group), 20_000):
                    part = group[low : low + 20_000]
                    out.update(zip(part, together(part)))
            rest = [p for p in pieces if p not in out]
            out.update(zip(rest, separately(rest)))
            return [out[p] for p in pieces]

        _ENCODERS[key] = chunks.PieceCache(encode_all, dtype, classes, special)
    return _ENCODERS[key]


def id_type(vocabulary: str) -> str:
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(vocabulary).get_vocab_size() <= 1 << 16 else "<u4"


def write_token_files(docs: DataFrame, folder: str, vocabulary: str, end_id: int = END_ID) -> list[TokenFile]:
    """Write every document's ids, with ``end_id`` after each; as many manifest rows come back as there are files."""
    spark = docs.sparkSession
    small_batches(spark)
    dtype = id_type(vocabulary)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    dealt = rows.repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        part, known = TaskContext.get().partitionId(), encoder(vocabulary, dtype)
        lengths, ids, nulls = [], [], 0

        def encoded() -> Iterator[bytes]:
            nonlocal nulls
            for batch in batches:
                own, counts = known.of(batch.column(1))
                out, last = np.full(len(own) + len(counts), end_id, dtype), np.cumsum(counts + 1) - 1
                inner = np.ones(len(out), bool)
                inner[last] = False
                out[inner] = own
                lengths.append(counts + 1)
                nulls += batch.column(0).null_count
                ids.append(batch.column(0).fill_null(0).to_numpy())
                yield out.tobytes()

        first = next(batches, None)
        if first is None:
            return
        batches = tidy(_again(first, batches))
        name = f"{folder}/part-{part:06d}"
        write_file(f"{name}.bin", encoded())
        sizes = np.concatenate(lengths)
        write_file(f"{name}.idx", iter([np.concatenate([[0], np.cumsum(sizes)]).astype("<i8").tobytes()]))
        write_file(f"{name}.doc", iter([np.concatenate(ids).astype("<i8").tobytes()]))
        yield pa.RecordBatch.from_pydict({"part": [part], "n_docs": [len(sizes)], "n_null_ids": [nulls], "n_tokens": [int(sizes.sum())]})

    manifest = dealt.mapInArrow(write, "part long, n_docs long, n_null_ids long, n_tokens long").collect()
    files, start = [], 0
    for r in sorted(manifest):
        files.append(TokenFile(*r, start))
        start += r.n_tokens
    return files


def _again(first, rest):
    yield first
    yield from rest


def map_file(uri: str, dtype: str) -> np.ndarray:
    """The file as an array: memory-mapped where it is on a mounted file system, else read."""
    fs, path = filesystem(uri)
    if fs.type_name == "local":
        return np.memmap(path, dtype, "r")
    with fs.open_input_stream(path, compression=None) as stream:
        return np.frombuffer(stream.read(), dtype)


def read_token_files(spark: SparkSession, folder: str, files: list[TokenFile], dtype: str, per_document, schema: str) -> DataFrame:
    """``per_document(ids) -> tuple`` for every document of the files, after doc_id, start and n_tokens."""
    if not files:
        return spark.createDataFrame([], schema)
    names = [f.strip().split()[0] for f in schema.split(",")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                file = files[k]
                name = f"{folder}/part-{file.part:06d}"
                ids, at, docs = map_file(f"{name}.bin", dtype), map_file(f"{name}.idx", "<i8"), map_file(f"{name}.doc", "<i8")
                for low in range(0, file.n_docs, 4096):
                    high = min(low + 4096, file.n_docs)
                    rows = [per_document(ids[at[i] : at[i + 1]]) for i in range(low, high)]
                    doc_id = pa.array(docs[low:high], pa.int64(), mask=np.arange(low, high) < file.n_null_ids)
                    columns = [doc_id, pa.array(at[low:high] + file.start), pa.array(np.diff(at[low : high + 1])), *map(pa.array, zip(*rows))]
                    yield pa.RecordBatch.from_arrays(columns, names)

    return spark.range(0, len(files), 1, len(files)).mapInArrow(read, schema)


def op7_binary_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place and digest, read back from the files."""
    import public_tokenizers

    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    folder = shared_folder(spark, "token-ids")
    files = write_token_files(documents(spark, sf_dir), folder, vocabulary)

    def digest(ids: np.ndarray) -> tuple[int]:
        return (zlib.crc32(ids.astype("<u4").tobytes()),)

    found = cut(read_token_files(spark, folder, files, id_type(vocabulary), digest, "doc_id long, start long, n_tokens long, ids_crc32 long"))
    remove_folder(folder)  # the digests are kept; nothing reads the files any more
    return found
