"""Media columns: images as PNG in binary columns, read back with checks, and hashed by their low frequencies."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, in_batches, texts_of

SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHUNK = 1 << 16
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def entropy(a: np.ndarray) -> float:
    n = np.bincount(a.ravel(), minlength=256)
    p = n[n > 0] / a.size
    return float(-(p * np.log2(p)).sum())


def encode_png(pixels: np.ndarray, level: int = 6) -> bytes:
    """An 8-bit image, height x width (grey) or height x width x channels, as PNG.

    The image's rows are filtered by none, left or upper neighbour, whichever leaves the bytes with the least entropy.
    """
    rows = np.ascontiguousarray(pixels, np.uint8)
    channels = 1 if rows.ndim == 2 else rows.shape[2]
    height, width = rows.shape[:2]
    flat = rows.reshape(height, width * channels)
    left, up = flat.copy(), flat.copy()
    left[:, channels:] -= flat[:, :-channels]
    up[1:] -= flat[:-1]
    kind, best = min(enumerate((flat, left, up)), key=lambda x: entropy(x[1]))
    lines = np.empty((height, width * channels + 1), np.uint8)
    lines[:, 0], lines[:, 1:] = kind, best
    packed = zlib.compress(lines.tobytes(), level)
    color = {n: c for c, n in CHANNELS.items()}[channels]
    out = [SIGNATURE, _chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, color, 0, 0, 0))]
    out += [_chunk(b"IDAT", packed[k : k + CHUNK]) for k in range(0, len(packed), CHUNK)]
    return b"".join(out + [_chunk(b"IEND", b"")])


def unfilter(lines: np.ndarray, kinds: np.ndarray, channels: int) -> np.ndarray:
    """Undo the row filters. Runs of rows with one of the first three filters are done at once, by sums modulo 256."""
    out = np.empty_like(lines)
    height, stride = lines.shape
    before = np.zeros(stride, np.uint8)
    cuts = [0, *(np.flatnonzero(np.diff(kinds)) + 1).tolist(), height]
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        kind, block = int(kinds[lo]), lines[lo:hi]
        if kind == 0:
            out[lo:hi] = block
        elif kind == 1:
            out[lo:hi] = np.cumsum(block.reshape(hi - lo, -1, channels), axis=1, dtype=np.uint8).reshape(hi - lo, stride)
        elif kind == 2:
            out[lo:hi] = np.cumsum(block, axis=0, dtype=np.uint8) + before
        elif kind in (3, 4):
            for y in range(lo, hi):
                up = before.astype(np.int64)
                row = lines[y].astype(np.int64)
                for x in range(0, stride, channels):
                    a = row[x - channels : x] if x else np.zeros(channels, np.int64)
                    b = up[x : x + channels]
                    c = up[x - channels : x] if x else np.zeros(channels, np.int64)
                    if kind == 3:
                        guess = (a + b) // 2
                    else:
                        pa_, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                        guess = np.where((pa_ <= pb) & (pa_ <= pc), a, np.where(pb <= pc, b, c))
                    row[x : x + channels] = (row[x : x + channels] + guess) & 255
                out[y] = before = row.astype(np.uint8)
        else:
            raise ValueError(f"row filter {kind}")
        before = out[hi - 1]
    return out


def decode_png(data: bytes) -> np.ndarray:
    """The pixels of an 8-bit, not interlaced PNG. Raises ValueError on a wrong signature, checksum, order or length."""
    if data[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, packed, head, ended = 8, [], None, False
    while at < len(data) and not ended:
        if at + 12 > len(data):
            raise ValueError("chunk cut short")
        (size,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + size]
        if len(body) < size or zlib.crc32(kind + body) != struct.unpack_from(">I", data, at + 8 + size)[0]:
            raise ValueError(f"checksum of chunk {kind!r}")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        ended = kind == b"IEND"
        at += 12 + size
    if head is None or not ended:
        raise ValueError("chunks missing")
    width, height, depth, color, _, _, interlaced = head
    if depth != 8 or color not in CHANNELS or interlaced:
        raise ValueError("only 8-bit images that aren't interlaced")
    channels = CHANNELS[color]
    raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)
    if raw.size != height * (width * channels + 1):
        raise ValueError("length of the pixel data")
    lines = raw.reshape(height, width * channels + 1)
    flat = unfilter(lines[:, 1:], lines[:, 0], channels)
    return flat if channels == 1 else flat.reshape(height, width, channels)


def cosine_matrix(size: int, keep: int) -> np.ndarray:
    k, x = np.arange(keep)[:, None], np.arange(size)[None, :]
    return np.cos(np.pi * k * (2 * x + 1) / (2 * size))


def shrink(pixels: np.ndarray, size: int) -> np.ndarray:
    """Means over a size x size grid; a side shorter than that repeats its lines."""
    out = pixels.astype(np.float64)
    for axis in (0, 1):
        n = out.shape[axis]
        cut = np.arange(size) * n // size
        if n >= size:
            counts = np.diff(np.append(cut, n))
            out = np.add.reduceat(out, cut, axis=axis) / (counts[:, None] if axis == 0 else counts[None, :])
        else:
            out = np.take(out, cut, axis=axis)
    return out


COSINES = cosine_matrix(32, 8)


def low_frequency_hash(pixels: np.ndarray) -> int:
    """64 bits: which of the 8 x 8 lowest frequencies of the cosine transform of the 32 x 32 image are above their median."""
    grey = pixels if pixels.ndim == 2 else pixels.mean(axis=2)
    low = np.round((COSINES @ shrink(grey, 32) @ COSINES.T).ravel(), 6)
    bits = low > np.median(low[1:])
    return int(np.packbits(bits).tobytes().hex(), 16)


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 64) -> DataFrame:
    """(id, n_bytes, media binary): each text's UTF-8 bytes, zero-padded to a positive multiple of width, as a grey image.

    A null text counts as empty; a null id is passed on; repeated rows give repeated rows and equal texts equal images; an
    empty table gives an empty result. A text of any length is one image, held by one worker. Other columns are not used,
    so their names can't clash.
    """

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, media = [], []
            for text in texts_of(batch):
                raw = text.encode("utf-8", "replace")
                rows = max(1, -(-len(raw) // width))
                sizes.append(len(raw))
                media.append(encode_png(np.frombuffer(raw.ljust(rows * width, b"\0"), np.uint8).reshape(rows, width)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["id", "n_bytes", "media"])

    kind = docs.schema[id_col].dataType.simpleString()
    return in_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(store, f"id {kind}, n_bytes long, media binary")


def read_media(media: DataFrame, media_col: str = "media") -> DataFrame:
    """The other columns with `pixels` binary (as read back) and `feature` (hexadecimal low-frequency hash).

    A null image gives null pixels and feature. A damaged one fails the job: its checksum names the chunk.
    """
    rest = [c for c in media.columns if c not in (media_col, "pixels", "feature")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pixels, features = [], []
            for data in batch.column(media_col).to_pylist():
                image = None if data is None else decode_png(data)
                pixels.append(None if image is None else image.tobytes())
                features.append(None if image is None else f"{low_frequency_hash(image):016x}")
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), batch.column(media_col), pa.array(pixels, pa.binary()), pa.array(features, pa.string())], [*rest, media_col, "pixels", "feature"])

    kept = ", ".join(f"`{c}` {media.schema[c].dataType.simpleString()}" for c in [*rest, media_col])
    return in_batches(media).select(*rest, media_col).mapInArrow(read, f"{kept}, pixels binary, feature string")


def op2_png_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a PNG, read back, checked and hashed."""
    out = read_media(store_texts(documents(spark, sf_dir)))
    return out.select(
        F.col("id").alias("doc_id"),
        "n_bytes",
        F.octet_length("pixels").cast("long").alias("payload_bytes"),
        F.sha2("pixels", 256).alias("payload_sha256"),
        F.crc32(F.substring("pixels", -64, 64)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )
