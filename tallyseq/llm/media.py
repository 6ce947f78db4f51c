"""Media columns: Netpbm and BMP bytes decoded to numpy arrays, area-resized by integral images, kept as NPY tiles with difference hashes.

Arrays are (height, width) for grey and (height, width, 3) for colour, 8 bits a sample (16-bit Netpbm samples keep
their type). ``area_resize`` takes each target pixel as the mean of the source area it covers, from an integral
image read at fractional places; the image is summed in bands, so an image of any height needs the memory of
one band. The difference hash compares neighbours in a 9 x 8 resize. Tiles are NPY files: a column of them, or
stacked, one file a batch of rows, in a shared folder, each row with its file and slot. The query stores each text as a
grey map or a BMP, writes the tiles to such files and takes feature and tile_sha256 from what it reads back.

Defined results: null media gives nulls; bytes that are no such image give nulls and the reason in ``media_error``;
repeated rows are kept; an empty table gives an empty result; columns named like the new ones are replaced.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import cut, documents, filesystem, fresh, remove_folder, shared_folder, small_batches, tidy, utf8, write_file

#: Payloads of the contract's query are padded to whole squares of this width.
WIDTH = 24
TILE = 16
BAND_BYTES = 1 << 20


def _netpbm_fields(data: bytes, count: int) -> tuple[list[int], int]:
    """The header's numbers after the magic, comments skipped, and the place after the one white space that ends them."""
    out, at = [], 2
    while len(out) < count:
        m = re.compile(rb"(?:\s|#[^\r\n]*[\r\n])*(\d+)").match(data, at)
        if not m:
            raise ValueError("short Netpbm header")
        out.append(int(m[1]))
        at = m.end()
    return out, at + 1


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6. Bitmaps become 0 and 255, black being 0."""
    kind = data[1] - ord("0")
    if kind not in range(1, 7):
        raise ValueError("no Netpbm image of the types P1 to P6")
    fields, at = _netpbm_fields(data, 2 if kind in (1, 4) else 3)
    width, height, most = (*fields, 1)[:3]
    channels = 3 if kind in (3, 6) else 1
    count = width * height * channels
    if kind == 1:
        found = re.findall(rb"[01]", re.sub(rb"#[^\r\n]*", b"", data[at - 1 :]))[:count]
        samples = 255 * (1 - np.array(found, np.uint8))
    elif kind in (2, 3):
        found = re.sub(rb"#[^\r\n]*", b"", data[at - 1 :]).split()[:count]
        samples = np.array(found, np.uint8 if most < 256 else np.uint16)
    elif kind == 4:
        row = (width + 7) // 8
        bits = np.unpackbits(np.frombuffer(data, np.uint8, row * height, at).reshape(height, row), axis=1)[:, :width]
        samples = 255 * (1 - bits)
    else:
        samples = np.frombuffer(data, np.uint8 if most < 256 else ">u2", count, at)
    if samples.size != count:
        raise ValueError("short Netpbm raster")
    return samples.reshape((height, width, 3) if channels == 3 else (height, width))


def encode_netpbm(array: np.ndarray) -> bytes:
    """P5 or P6 of an 8-bit array."""
    kind = b"P6" if array.ndim == 3 else b"P5"
    return b"%b\n%d %d\n255\n" % (kind, array.shape[1], array.shape[0]) + np.ascontiguousarray(array, np.uint8).tobytes()


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 1, 4, 8, 24 or 32 bits a pixel; palettes of greys give a grey array."""
    if len(data) < 54:
        raise ValueError("short BMP header")
    start, head, width, height, _, depth, packing = struct.unpack_from("<IIiiHHI", data, 10)
    if packing not in (0, 3) or depth not in (1, 4, 8, 24, 32):
        raise ValueError(f"BMP of {depth} bits, compression {packing}")
    rows, stride = abs(height), (width * depth + 31) // 32 * 4
    raster = np.frombuffer(data, np.uint8, rows * stride, start).reshape(rows, stride)
    if depth >= 24:
        out = raster[:, : width * depth // 8].reshape(rows, width, depth // 8)[:, :, 2::-1]
    else:
        used = struct.unpack_from("<I", data, 46)[0] or 1 << depth
        palette = np.frombuffer(data, np.uint8, used * 4, 14 + head).reshape(used, 4)[:, 2::-1]
        bits = np.unpackbits(raster, axis=1)[:, : width * depth].reshape(rows, width, depth)
        index = bits.dot(1 << np.arange(depth - 1, -1, -1))
        out = palette[index]
        if (palette == palette[:, :1]).all():
            out = out[:, :, 0]
    return out if height < 0 else out[::-1]


def encode_bmp(array: np.ndarray) -> bytes:
    """A 24-bit BMP, or an 8-bit one with a grey palette."""
    rows, width = array.shape[:2]
    depth = 24 if array.ndim == 3 else 8
    palette = b"" if depth == 24 else np.repeat(np.arange(256, dtype=np.uint8), 4).reshape(256, 4).copy().tobytes()
    stride = (width * depth + 31) // 32 * 4
    raster = np.zeros((rows, stride), np.uint8)
    raster[:, : width * depth // 8] = (array[::-1, :, ::-1] if depth == 24 else array[::-1]).reshape(rows, -1)
    start = 54 + len(palette)
    head = struct.pack("<2sIHHIIiiHHIIiiII", b"BM", start + raster.size, 0, 0, start, 40, width, rows, 1, depth, 0, raster.size, 2835, 2835, len(palette) // 4, 0)
    return head + palette + raster.tobytes()


def decode_image(data: bytes) -> np.ndarray:
    if data[:2] == b"BM":
        return decode_bmp(data)
    if data[:1] == b"P" and len(data) > 2:
        return decode_netpbm(data)
    raise ValueError("neither Netpbm nor BMP")


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """(height, width[, 3]) means of the areas covered, as floats."""
    rows, columns = image.shape[:2]
    if not rows or not columns:
        raise ValueError("empty image")
    edges_x = np.linspace(0, columns, width + 1)
    low_x, part_x = np.floor(edges_x).astype(int), edges_x - np.floor(edges_x)
    edges_y = np.linspace(0, rows, height + 1)
    # the integral image at the target's edges only: whole rows above each edge, and a part of the row it cuts
    above = np.zeros((height + 1, columns, *image.shape[2:]))
    running = np.zeros((columns, *image.shape[2:]))
    at = 0
    step = max(1, BAND_BYTES // max(1, columns))
    for i, edge in enumerate(edges_y):
        whole = int(np.floor(edge))
        while at < whole:
            end = min(whole, at + step)
            running += image[at:end].sum(0, dtype=np.float64)
            at = end
        above[i] = running + ((edge - whole) * image[whole] if whole < rows and edge > whole else 0)
    integral = np.concatenate([np.zeros_like(above[:, :1]), np.cumsum(above, axis=1)], axis=1)
    nxt = np.minimum(low_x + 1, columns)
    shape = (1, -1, *[1] * (image.ndim - 2))
    corner = integral[:, low_x] + part_x.reshape(shape) * (integral[:, nxt] - integral[:, low_x])
    return np.diff(np.diff(corner, axis=0), axis=1) / ((rows / height) * (columns / width))


def grey(image: np.ndarray) -> np.ndarray:
    return image if image.ndim == 2 else image @ np.array([0.299, 0.587, 0.114])


def difference_hash(image: np.ndarray) -> str:
    """16 hex digits: each bit tells if a pixel of the 8 x 9 resize is less than its right neighbour."""
    small = area_resize(grey(image), 8, 9)
    return np.packbits(np.round(small[:, :-1], 6) < np.round(small[:, 1:], 6)).tobytes().hex()


def npy(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array(out, np.ascontiguousarray(array), version=(1, 0))
    return out.getvalue()


def tile_of(image: np.ndarray, side: int = TILE) -> np.ndarray:
    return np.clip(np.rint(area_resize(image, side, side)), 0, 255).astype(np.uint8)


def media_features(table: DataFrame, media: str, keep: list[str], samples: bool = False, side: int = TILE) -> DataFrame:
    """``keep``, then width, height, dhash, tile (NPY bytes), media_error; with ``samples`` the digests of the decoded samples."""
    small_batches(table.sparkSession)
    made = {"media_bytes": "long", "media_sha256": "string", "width": "int", "height": "int", "dhash": "string", "tile": "binary", "media_error": "string"}
    made |= {"payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long"} if samples else {}
    keep = [c for c in keep if c not in made]
    chosen = table.select(*keep, F.col(media).alias("_media"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema[:-1]] + [f"{n} {t}" for n, t in made.items()])

    def features(data: bytes | None) -> dict:
        if data is None:
            return {}
        row = {"media_bytes": len(data), "media_sha256": hashlib.sha256(data).hexdigest()}
        try:
            image = decode_image(data)
            row |= {"width": image.shape[1], "height": image.shape[0], "dhash": difference_hash(image), "tile": npy(tile_of(image, side))}
        except (ValueError, IndexError, struct.error) as error:
            return row | {"media_error": str(error)}
        if samples:
            payload = image.tobytes()
            row |= {"payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-32:])}
        return row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
        for batch in tidy(batches):
            rows = [features(x) for x in batch.column(batch.num_columns - 1).to_pylist()]
            new = [pa.array([r.get(n) for r in rows], types[t]) for n, t in made.items()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *new], [*keep, *made])

    return chosen.mapInArrow(run, schema)


def write_tiles(tiles: DataFrame, folder: str, tile: str = "tile") -> DataFrame:
    """Stacked NPY files, one a batch of rows, in a shared folder; the table with (file, slot) instead of the tile. Null tiles have neither."""
    kept = [c for c in tiles.columns if c != tile]
    file, slot = fresh(kept, "file", "slot")
    chosen = tiles.select(*kept, tile)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema[:-1]) + f", `{file}` string, `{slot}` int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for n, batch in enumerate(tidy(batches)):
            found = [x and np.load(io.BytesIO(x)) for x in batch.column(len(kept)).to_pylist()]
            stack = [x for x in found if x is not None]
            name = f"{folder}/tiles-{part:06d}-{n:06d}.npy"
            if stack:
                write_file(name, iter([npy(np.stack(stack))]))
            there = np.array([x is not None for x in found], bool)
            slots = pa.array(np.cumsum(there) - 1, pa.int32(), mask=~there)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([name if x else None for x in there], pa.string()), slots], [*kept, file, slot])

    return chosen.mapInArrow(run, schema)


def read_tiles(placed: DataFrame, file: str = "file", slot: str = "slot") -> DataFrame:
    """The table of ``write_tiles`` with tile_sha256 (of the tile as an NPY file of its own) and dhash, from the files, instead of file and slot."""
    kept = [c for c in placed.columns if c not in (file, slot, "tile_sha256", "dhash")]
    chosen = placed.select(*kept, file, slot)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema[:-2]) + ", tile_sha256 string, dhash string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, stack = None, None
        for batch in tidy(batches):
            shas, hashes = [], []
            for where, k in zip(batch.column(len(kept)).to_pylist(), batch.column(len(kept) + 1).to_pylist()):
                if where is None:
                    shas.append(None)
                    hashes.append(None)
                    continue
                if where != name:  # rows of a file stand together
                    fs, path = filesystem(where)
                    with fs.open_input_stream(path, compression=None) as stream:
                        name, stack = where, np.load(io.BytesIO(stream.read()))
                shas.append(hashlib.sha256(npy(stack[k])).hexdigest())
                hashes.append(difference_hash(stack[k]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(shas, pa.string()), pa.array(hashes, pa.string())], [*kept, "tile_sha256", "dhash"])

    return chosen.mapInArrow(run, schema)


def _little(n: Column) -> Column:
    """A non-negative number below 2^31 as four bytes, the least first."""
    digits = F.lpad(F.hex(n), 8, "0")
    return F.concat(*[F.unhex(F.substring(digits, i, 2)) for i in (7, 5, 3, 1)])


#: What an 8-bit BMP has between its sizes and its raster: one plane, 8 bits, no compression, and a palette of 256 greys.
_PLANES = struct.pack("<HHI", 1, 8, 0)
_PALETTE = np.repeat(np.arange(256, dtype=np.uint8), 4).tobytes()


def payload_image(text: Column) -> Column:
    """A text's bytes, padded with 255 to whole squares, as a grey image of width 24: a binary grey map (P5) or, for half of the texts by their checksum, a BMP with rows from the top."""
    raw = utf8(text)
    size = F.octet_length(raw)
    square = WIDTH * WIDTH
    whole = (F.greatest(F.lit(1), F.ceil(size / square)) * square).cast("int")
    rows = (whole / WIDTH).cast("int")
    grey_map = F.concat(F.lit(f"P5\n{WIDTH} "), rows.cast("string"), F.lit("\n255\n")).cast("binary")
    start = 54 + len(_PALETTE)
    from_top = F.concat(*[F.unhex(F.substring(F.hex(F.lit(1 << 32) - rows), i, 2)) for i in (7, 5, 3, 1)])  # a negative height
    sizes = F.concat(F.lit(struct.pack("<III", 0, start, 40)), F.lit(struct.pack("<i", WIDTH)), from_top, F.lit(_PLANES))
    bitmap = F.concat(F.lit(b"BM"), _little(whole + start), sizes, _little(whole), F.lit(struct.pack("<iiII", 2835, 2835, 256, 0) + _PALETTE))
    padding = F.unhex(F.repeat(F.lit("FF"), whole - size))
    return F.concat(F.when(F.crc32(raw) % 2 == 0, grey_map).otherwise(bitmap), raw, padding)


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's payload as an image: what was stored, what is read back, and the features of the tiles read from their files."""
    docs = documents(spark, sf_dir).select("doc_id", F.octet_length(utf8(F.col("text"))).cast("long").alias("n_bytes"), payload_image(F.col("text")).alias("media"))
    found = media_features(docs, "media", ["doc_id", "n_bytes"], samples=True).drop("dhash", "media_error")
    folder = shared_folder(spark, "tiles")
    out = cut(read_tiles(cut(write_tiles(found, folder))))
    remove_folder(folder)  # the digests are kept
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", F.col("dhash").alias("feature"), "tile_sha256", "width", "height")
