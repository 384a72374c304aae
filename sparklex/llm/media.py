"""Media columns: binary Netpbm and BMP images as numpy arrays, tiles and hashes.

``decode`` reads PGM (P5), PPM (P6), PBM (P4) and uncompressed 8- and 24-bit BMP.
``area_resize`` averages exact areas with an integral image, of which only the
rows at the cuts are kept.  A tile is the resized array in NPY format; the
difference hash compares neighbours of a 9 x 8 grey version.

:func:`pack_text` stores any bytes without loss as an image, 64 RGB pixels or
192 grey ones in a row, which makes every text column a media column.

Defined cases: a null text counts as an empty one; equal texts give equal
values; a broken or unknown image gives nulls in :func:`tiles`; images of any
height are resized in blocks of rows; neighbours of equal brightness give a 0 in
the hash; repeated rows each give a row; an empty table gives an empty result;
other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructField, StructType

from .common import id_and_text, map_slices

ROW_BYTES = 192
KINDS = ("ppm", "pgm", "bmp")
TILE_SIZE = 32
#: Rows of an image summed at once.
BLOCK_ROWS = 4096


def encode_ppm(pixels: np.ndarray) -> bytes:
    """P6 of an array (height, width, 3)."""
    return b"P6\n%d %d\n255\n" % (pixels.shape[1], pixels.shape[0]) + pixels.tobytes()


def encode_pgm(pixels: np.ndarray) -> bytes:
    """P5 of an array (height, width)."""
    return b"P5\n%d %d\n255\n" % (pixels.shape[1], pixels.shape[0]) + pixels.tobytes()


def encode_bmp(pixels: np.ndarray) -> bytes:
    """Bottom-up 24-bit BMP of an array (height, width, 3) of RGB."""
    height, width, _ = pixels.shape
    stride = (3 * width + 3) // 4 * 4
    rows = np.zeros((height, stride), np.uint8)
    rows[:, : 3 * width] = pixels[::-1, :, ::-1].reshape(height, 3 * width)
    size = stride * height
    return struct.pack("<2sIHHI", b"BM", 54 + size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, size, 2835, 2835, 0, 0) + rows.tobytes()


def _netpbm_header(data: bytes) -> tuple[list[int], int]:
    """The numbers after the magic, and where the samples begin; comments run from # to the line's end."""
    count = 2 if data[:2] == b"P4" else 3
    numbers, at = [], 2
    while len(numbers) < count:
        while data[at : at + 1].isspace() or data[at : at + 1] == b"#":
            at = data.index(b"\n", at) if data[at : at + 1] == b"#" else at + 1
        end = at
        while data[end : end + 1].isdigit():
            end += 1
        numbers.append(int(data[at:end]))
        at = end
    return numbers, at + 1


def _decode_netpbm(data: bytes) -> np.ndarray:
    numbers, at = _netpbm_header(data)
    width, height = numbers[:2]
    if data[:2] == b"P4":
        stride = (width + 7) // 8
        packed = np.frombuffer(data, np.uint8, stride * height, at).reshape(height, stride)
        return (1 - np.unpackbits(packed, axis=1)[:, :width]) * np.uint8(255)
    if not 0 < numbers[2] < 256:
        raise ValueError("only 8-bit samples are read")
    shape = (height, width, 3) if data[:2] == b"P6" else (height, width)
    return np.frombuffer(data, np.uint8, int(np.prod(shape)), at).reshape(shape)


def _decode_bmp(data: bytes) -> np.ndarray:
    (offset,) = struct.unpack_from("<I", data, 10)
    header, width, height, _, bits, compression = struct.unpack_from("<IiiHHI", data, 14)
    if compression or bits not in (8, 24):
        raise ValueError("only uncompressed 8- and 24-bit BMP is read")
    channels = bits // 8
    stride = (channels * width + 3) // 4 * 4
    rows = np.frombuffer(data, np.uint8, stride * abs(height), offset).reshape(abs(height), stride)[:, : channels * width]
    rows = rows[::-1] if height > 0 else rows
    if channels == 3:
        return rows.reshape(abs(height), width, 3)[:, :, ::-1]
    (colours,) = struct.unpack_from("<I", data, 46)
    palette = np.frombuffer(data, np.uint8, 4 * (colours or 256), 14 + header).reshape(-1, 4)[:, 2::-1]
    return palette[rows]


def decode(data: bytes) -> np.ndarray:
    """The pixels: (height, width) if grey, (height, width, 3) if coloured."""
    if data[:2] in (b"P4", b"P5", b"P6"):
        return _decode_netpbm(data)
    if data[:2] == b"BM":
        return _decode_bmp(data)
    raise ValueError("neither binary Netpbm nor BMP")


def grey(pixels: np.ndarray) -> np.ndarray:
    """Integer luma of a coloured image; a grey one as it is."""
    if pixels.ndim == 2:
        return pixels
    return ((pixels.astype(np.uint32) * np.array([299, 587, 114], np.uint32)).sum(2) // 1000).astype(np.uint8)


def _integral_rows(image: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Rows of the integral image: sums of everything above each row and left of each column."""
    sums = np.zeros((len(rows), image.shape[1]), np.float64)
    total, at, k = np.zeros(image.shape[1]), 0, 0
    order = np.argsort(rows, kind="stable")
    for k in order:
        while at < rows[k]:
            end = min(int(rows[k]), at + BLOCK_ROWS)
            total = total + image[at:end].sum(0, dtype=np.float64)
            at = end
        sums[k] = total
    out = np.zeros((len(rows), image.shape[1] + 1))
    np.cumsum(sums, axis=1, out=out[:, 1:])
    return out


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of the exact area under each new pixel, of a grey image."""
    y, x = np.linspace(0, image.shape[0], height + 1), np.linspace(0, image.shape[1], width + 1)
    below = np.minimum(np.floor(y).astype(np.int64), image.shape[0] - 1)
    integral = _integral_rows(image, np.concatenate([below, below + 1]))
    low, high = integral[: height + 1], integral[height + 1 :]
    at_y = low + (high - low) * (y - below)[:, None]
    left = np.minimum(np.floor(x).astype(np.int64), image.shape[1] - 1)
    at = at_y[:, left] + (at_y[:, left + 1] - at_y[:, left]) * (x - left)
    cells = at[1:, 1:] - at[:-1, 1:] - at[1:, :-1] + at[:-1, :-1]
    return cells / ((image.shape[0] / height) * (image.shape[1] / width))


def to_uint8(values: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(values + 0.5), 0, 255).astype(np.uint8)


def difference_hash(image: np.ndarray) -> str:
    """64 bits in hex: is each of 9 x 8 area means darker than its right neighbour?"""
    small = to_uint8(area_resize(image, 8, 9))
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def npy_tile(image: np.ndarray, size: int = TILE_SIZE) -> bytes:
    """The image resized to a square, as an NPY file."""
    out = io.BytesIO()
    np.save(out, np.ascontiguousarray(to_uint8(area_resize(image, size, size))))
    return out.getvalue()


def pack_text(text: str | None) -> tuple[bytes, int, str]:
    """A text's UTF-8, padded with blanks to whole rows, as an image; its length unpadded; the kind of image."""
    raw = (text or "").encode()
    payload = raw + b" " * ((-len(raw)) % ROW_BYTES or ROW_BYTES * (not raw))
    kind = KINDS[zlib.crc32(payload) % len(KINDS)]
    pixels = np.frombuffer(payload, np.uint8)
    if kind == "pgm":
        return encode_pgm(pixels.reshape(-1, ROW_BYTES)), len(raw), kind
    coloured = pixels.reshape(-1, ROW_BYTES // 3, 3)
    return (encode_ppm if kind == "ppm" else encode_bmp)(coloured), len(raw), kind


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, media, n_bytes, kind``: every text as an image."""
    schema = StructType(
        [StructField("doc_id", docs.schema[id_col].dataType), StructField("media", BinaryType()), StructField("n_bytes", LongType()), StructField("kind", StringType())]
    )

    def turn(batch: pa.RecordBatch):
        packed = [pack_text(text) for text in batch.column(1).to_pylist()]
        return {"doc_id": batch.column(0), "media": [p[0] for p in packed], "n_bytes": [p[1] for p in packed], "kind": [p[2] for p in packed]}

    return map_slices(id_and_text(docs, id_col, text_col), lambda: turn, schema)


def tiles(media: DataFrame, id_col: str = "doc_id", media_col: str = "media", size: int = TILE_SIZE) -> DataFrame:
    """``doc_id, height, width, tile, dhash`` of every image; write the result as Parquet to keep the tiles."""
    schema = StructType(
        [
            StructField("doc_id", media.schema[id_col].dataType),
            StructField("height", IntegerType()),
            StructField("width", IntegerType()),
            StructField("tile", BinaryType()),
            StructField("dhash", StringType()),
        ]
    )

    def one(data: bytes | None):
        try:
            image = grey(decode(data or b""))
            return image.shape[0], image.shape[1], npy_tile(image, size), difference_hash(image)
        except (ValueError, IndexError, struct.error):
            return None, None, None, None

    def turn(batch: pa.RecordBatch):
        rows = [one(data) for data in batch.column(1).to_pylist()]
        return {"doc_id": batch.column(0)} | {name: [r[i] for r in rows] for i, name in enumerate(("height", "width", "tile", "dhash"))}

    return map_slices(media.select(F.col(id_col), F.col(media_col)), lambda: turn, schema)


def text_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store each text as an image, read the stored bytes back, and describe both; ``tile`` is the NPY tile of the image."""
    strings = ("payload_sha256", "media_sha256", "feature")
    longs = ("n_bytes", "payload_bytes", "tail_crc32", "media_bytes")
    schema = StructType([StructField("doc_id", docs.schema[id_col].dataType), *(StructField(c, LongType()) for c in longs), *(StructField(c, StringType()) for c in strings), StructField("tile", BinaryType())])

    def one(text: str | None) -> dict:
        stored, n_bytes, kind = pack_text(text)
        pixels = decode(stored)
        payload = np.ascontiguousarray(pixels).tobytes()
        image = grey(pixels)
        tile = npy_tile(image)
        return {
            "n_bytes": n_bytes,
            "payload_bytes": len(payload),
            "payload_sha256": hashlib.sha256(payload).hexdigest(),
            "tail_crc32": zlib.crc32(payload[-16:]),
            "media_bytes": len(stored),
            "media_sha256": hashlib.sha256(stored).hexdigest(),
            "tile": tile,
            "feature": f"{kind}:{image.shape[1]}x{image.shape[0]}:{difference_hash(image)}:{zlib.crc32(tile):08x}",
        }

    def turn(batch: pa.RecordBatch):
        rows = [one(text) for text in batch.column(1).to_pylist()]
        return {"doc_id": batch.column(0)} | {name: [r[name] for r in rows] for name in (*longs, *strings, "tile")}

    return map_slices(id_and_text(docs, id_col, text_col), lambda: turn, schema)
