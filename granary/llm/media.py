"""Media columns: Netpbm and BMP bytes decoded to numpy arrays, resized by area, written as NPY tiles with hashes.

A resize averages each target cell over the source area it covers, edges weighted by the part covered, from one
integral image. The difference hash compares neighbours of a 9 x 8 grey tile row by row, first bit highest.

Null media give null columns. Bytes that are no image the reader knows, or are cut short, give nulls and the reason in
column error; nothing is raised. Null ids are ids like others, repeated rows stay. A very long text is one image, which a
worker holds with its integral image, eight bytes a sample. An empty table gives an empty result. Only the id and the
media or text columns are read, so other columns can't clash.
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
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, materialize, ship

_TOKEN = re.compile(rb"(?:\s|#[^\n\r]*[\n\r])*([^\s#]+)")


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 as an array of height x width, with a third axis of 3 for colour; bitmaps as 0 (black) and 1."""
    kind = data[:2]
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise ValueError("no Netpbm magic")
    at, numbers = 2, []
    for _ in range(2 if kind in (b"P1", b"P4") else 3):
        m = _TOKEN.match(data, at)
        if not m or not m[1].isdigit():
            raise ValueError("a header number is missing")
        numbers.append(int(m[1]))
        at = m.end()
    width, height, top = numbers[0], numbers[1], numbers[2] if len(numbers) > 2 else 1
    if not (width > 0 and height > 0 and 0 < top < 65536):
        raise ValueError("a header number is out of range")
    planes = 3 if kind in (b"P3", b"P6") else 1
    count = width * height * planes
    if kind == b"P1":
        digits = re.sub(rb"#[^\n\r]*|\s", b"", data[at:])
        flat = 1 - (np.frombuffer(digits[:count], np.uint8) - 48)
    elif kind in (b"P2", b"P3"):
        flat = np.array(re.sub(rb"#[^\n\r]*", b"", data[at:]).split()[:count], np.int64)
    elif kind == b"P4":
        line = -(-width // 8)
        rows = np.frombuffer(data, np.uint8, offset=at + 1)[: line * height]
        if len(rows) < line * height:
            raise ValueError("samples are missing")
        flat = 1 - np.unpackbits(rows.reshape(height, line), axis=1)[:, :width].reshape(-1)
    else:
        flat = np.frombuffer(data, ">u2" if top > 255 else np.uint8, offset=at + 1, count=-1 if len(data) - at - 1 < count * (1 + (top > 255)) else count)
    if len(flat) < count:
        raise ValueError("samples are missing")
    flat = flat[:count].astype(np.uint16 if top > 255 else np.uint8, copy=False)
    return flat.reshape((height, width, 3) if planes == 3 else (height, width))


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 8 (palette), 24 or 32 bits a pixel as an array of height x width x 3, in RGB order."""
    if data[:2] != b"BM" or len(data) < 54:
        raise ValueError("no BMP header")
    offset, header, width, height, _, bits, packing = struct.unpack_from("<I", data, 10)[0], *struct.unpack_from("<IiiHHI", data, 14)
    if packing not in (0, 3) or bits not in (8, 24, 32) or width <= 0 or height == 0 or (packing == 3 and bits != 32):
        raise ValueError("this kind of BMP is not read")
    line = (width * bits + 31) // 32 * 4
    rows = np.frombuffer(data, np.uint8, offset=min(offset, len(data)))[: line * abs(height)]
    if len(rows) < line * abs(height):
        raise ValueError("samples are missing")
    rows = rows.reshape(abs(height), line)[:: -1 if height > 0 else 1]
    if bits == 8:
        colours = struct.unpack_from("<I", data, 46)[0] or 256
        palette = np.frombuffer(data, np.uint8, offset=14 + header, count=4 * colours).reshape(-1, 4)
        if int(rows[:, :width].max()) >= colours:
            raise ValueError("a sample is not in the palette")
        return palette[rows[:, :width]][:, :, 2::-1]
    return rows[:, : width * bits // 8].reshape(abs(height), width, bits // 8)[:, :, 2::-1]


def decode(data: bytes) -> np.ndarray:
    """Netpbm or BMP bytes as an array."""
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def encode_pgm(payload: bytes, width: int) -> bytes:
    """A grey 8-bit image that holds the payload's bytes row by row."""
    return b"P5\n%d %d\n255\n" % (width, len(payload) // width) + payload


def grey(image: np.ndarray) -> np.ndarray:
    """Luma of a colour image, in whole numbers; grey images stay."""
    if image.ndim == 2:
        return image.astype(np.int64)
    return (image.astype(np.int64) @ np.array([299, 587, 114])) // 1000


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means of a grey image over the areas of a height x width grid, exact to the rounding of a double."""
    table = np.zeros((image.shape[0] + 1, image.shape[1] + 1))
    np.cumsum(np.cumsum(image, axis=0, dtype=np.int64), axis=1, out=table[1:, 1:])

    def sampled(t: np.ndarray, n: int, axis: int) -> np.ndarray:
        at = np.arange(n + 1) * ((t.shape[axis] - 1) / n)
        low = np.minimum(at.astype(np.int64), t.shape[axis] - 2)
        part = (at - low).reshape((-1, 1) if axis == 0 else (1, -1))
        return np.take(t, low, axis) * (1 - part) + np.take(t, low + 1, axis) * part

    sums = np.diff(np.diff(sampled(sampled(table, height, 0), width, 1), axis=0), axis=1)
    return sums / (image.shape[0] / height * (image.shape[1] / width))


def difference_hash(image: np.ndarray) -> str:
    """16 hexadecimal digits: whether each cell of a 9 x 8 tile is brighter than its right neighbour."""
    tile = np.round(area_resize(grey(image), 8, 9), 6)
    return np.packbits(tile[:, :-1] > tile[:, 1:]).tobytes().hex()


def npy_tile(image: np.ndarray, side: int) -> bytes:
    """A grey side x side tile of unsigned bytes in NPY form; 16-bit samples keep their high byte."""
    tile = area_resize(grey(image), side, side)
    tile = tile / 257 if image.dtype.itemsize == 2 else tile
    out = io.BytesIO()
    np.save(out, np.clip(np.rint(tile), 0, 255).astype(np.uint8), allow_pickle=False)
    return out.getvalue()


def media_tiles(media: DataFrame, id_col: str = "media_id", media_col: str = "media", side: int = 32) -> DataFrame:
    """(id, height, width, planes, tile, dhash, error) of every row; tile: NPY bytes."""
    ship(media.sparkSession)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, 1):
            out = []
            for data in batch.column(1).to_pylist():
                row: dict = {}
                if data is not None:
                    try:
                        image = decode(data)
                        row = {"height": image.shape[0], "width": image.shape[1], "planes": image.shape[2] if image.ndim == 3 else 1, "tile": npy_tile(image, side), "dhash": difference_hash(image)}
                    except (ValueError, struct.error, OverflowError) as e:
                        row = {"error": str(e)}
                out.append(row)
            found = pa.array(out, pa.struct([("height", pa.int32()), ("width", pa.int32()), ("planes", pa.int32()), ("tile", pa.binary()), ("dhash", pa.string()), ("error", pa.string())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), *found.flatten()], names=[id_col, "height", "width", "planes", "tile", "dhash", "error"])

    kind = media.schema[id_col].dataType.simpleString()
    return media.select(id_col, F.col(media_col).cast("binary").alias("_media")).mapInArrow(look, f"`{id_col}` {kind}, height int, width int, planes int, tile binary, dhash string, error string")


def store_texts(docs: DataFrame, block: int = 576, width: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media) of every text as a grey image: its UTF-8 bytes, then bytes 255 up to a positive multiple of
    block. The table is written to the shared folder, compressed. Nulls count as empty texts."""
    ship(docs.sparkSession)
    if block % width:
        raise ValueError("a block must fill whole rows")

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, 1):
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            media = [encode_pgm(t + b"\xff" * (block * max(1, -(-len(t) // block)) - len(t)), width) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array(media, pa.binary())], names=["id", "n_bytes", "media"])

    kind = docs.schema[id_col].dataType.simpleString()
    drawn = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("_text")).mapInArrow(draw, f"id {kind}, n_bytes long, media binary")
    return materialize(drawn, "media", compression="zstd")


def read_media(stored: DataFrame, side: int = 32) -> DataFrame:
    """(id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media, tile, feature) of stored images (id, n_bytes, media).

    The stored bytes are decoded: payload columns are of the samples, tail_crc32 of the last 32, tile is a side x side
    tile in NPY form, feature the difference hash.
    """

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, 2):
            out = []
            for media in batch.column(2).to_pylist():
                image = decode(media)
                payload = image.tobytes()
                out.append({"payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-32:]), "tile": npy_tile(image, side), "feature": difference_hash(image)})
            found = pa.array(out, pa.struct([("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("tile", pa.binary()), ("feature", pa.string())]))
            yield pa.RecordBatch.from_arrays([*batch.columns, *found.flatten()], names=["id", "n_bytes", "media", *(f.name for f in found.type)])

    kind = stored.schema["id"].dataType.simpleString()
    return stored.mapInArrow(look, f"id {kind}, n_bytes long, media binary, payload_bytes long, payload_sha256 string, tail_crc32 long, tile binary, feature string")


def text_media(docs: DataFrame, block: int = 576, width: int = 24, side: int = 32, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text stored as a grey image and read back: store_texts, then read_media."""
    return read_media(store_texts(docs, block, width, id_col, text_col), side).withColumnRenamed("id", id_col)
