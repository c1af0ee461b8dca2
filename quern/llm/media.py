"""Media columns: lossless 8-bit greyscale PNG in a binary column, and cosine-transform hashes of it.

Encoding and decoding are written out here (zlib and numpy only): chunks with
their CRC-32, the zlib stream with its Adler-32, and the five row filters.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ._shared import documents, lean, record_batches, utf8, write_shared

#: Samples in a row of the picture; also what payloads are padded to a multiple of.
WIDTH = 64
#: The eight bytes that open a PNG file (a fixed value of the format).
SIGNATURE = b"\x89PNG\r\n\x1a\n"
HASH_SIDE, HASH_GRID = 8, 32
#: Rows that are filtered at a time; channels of the colour types (fixed values of the format).
ROWS_AT_ONCE, CHANNELS = 1 << 14, {0: 1, 2: 3, 4: 2, 6: 4}


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(payload: bytes, level: int = 1) -> bytes:
    """A PNG of width 64 whose samples are ``payload`` (a positive multiple of 64 bytes).

    Each row takes the filter of none, sub and up with the least sum of absolute
    differences, ties to the first.  Some thousand rows are filtered at a time.
    """
    every = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    packer, packed = zlib.compressobj(level), []
    for at in range(0, len(every), ROWS_AT_ONCE):
        rows = every[at : at + ROWS_AT_ONCE]
        made = np.stack([rows, rows, rows])
        made[1, :, 1:] -= rows[:, :-1]
        made[2, 1:] -= rows[:-1]
        if at:
            made[2, 0] -= every[at - 1]
        cost = np.abs(made.view(np.int8).astype(np.int16)).sum(axis=2)
        kind = cost.argmin(axis=0)
        body = np.empty((len(rows), WIDTH + 1), np.uint8)
        body[:, 0] = kind
        body[:, 1:] = made[kind, np.arange(len(rows))]
        packed.append(packer.compress(body.tobytes()))
    head = struct.pack(">IIBBBBB", WIDTH, len(every), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", b"".join([*packed, packer.flush()])) + _chunk(b"IEND", b"")


def unfilter(kind: np.ndarray, raw: np.ndarray, channels: int = 1) -> np.ndarray:
    """The bytes of filtered rows of ``channels`` bytes a pixel (all five filters)."""
    if (kind > 4).any():
        raise ValueError("unknown PNG row filter")
    out = np.empty_like(raw)
    for at in range(0, len(raw), ROWS_AT_ONCE):
        some, rows = kind[at : at + ROWS_AT_ONCE], raw[at : at + ROWS_AT_ONCE]
        if at:  # the row above, undone already
            some, rows = np.concatenate([[0], some]), np.concatenate([out[at - 1 : at], rows])
        done = (_unfilter_by_diagonal if (some > 2).any() else _unfilter_by_filter)(some, rows, channels)
        out[at : at + ROWS_AT_ONCE] = done[1:] if at else done
    return out


def _unfilter_by_filter(kind: np.ndarray, raw: np.ndarray, channels: int) -> np.ndarray:
    """Rows of no filter, then of sub, then of up, each at once."""
    out = raw.copy()
    sub = kind == 1
    if sub.any():
        out[sub] = np.cumsum(raw[sub].reshape(int(sub.sum()), -1, channels), axis=1, dtype=np.uint8).reshape(-1, raw.shape[1])
    up = kind == 2
    if up.any():
        # An up row is the nearest row above that is no up row, plus the sum of the up rows since.
        total = np.cumsum(np.where(up[:, None], raw, 0), axis=0, dtype=np.uint8)
        base = np.maximum.accumulate(np.where(up, -1, np.arange(len(kind))))
        at = base[up]
        start = np.where((at < 0)[:, None], 0, out[at] - total[at])
        out[up] = total[up] + start.astype(np.uint8)
    return out


def _unfilter_by_diagonal(kind: np.ndarray, raw: np.ndarray, channels: int) -> np.ndarray:
    """Pixels of a diagonal depend on earlier diagonals only, so each is undone at once."""
    h, w = len(raw), raw.shape[1] // channels
    coded, out = raw.reshape(h, w, channels), np.zeros((h + 1, w + 1, channels), np.int16)
    for s in range(h + w - 1):
        y = np.arange(max(0, s - w + 1), min(h, s + 1))
        x = s - y
        left, above, corner = out[y + 1, x], out[y, x + 1], out[y, x]
        p = left + above - corner
        by = np.stack([np.abs(p - left), np.abs(p - above), np.abs(p - corner)]).argmin(axis=0)  # ties to the first
        nearest = np.choose(by, [left, above, corner])
        guess = np.choose(kind[y][:, None], [np.zeros_like(left), left, above, (left + above) // 2, nearest])
        out[y + 1, x + 1] = (coded[y, x] + guess) & 255
    return out[1:, 1:].astype(np.uint8).reshape(h, -1)


def decode_png(blob: bytes) -> np.ndarray:
    """The samples of a PNG of 8 bits a sample, without palette or interlacing: rows of pixels, and of
    channels where there are several.  ValueError if a checksum, a length or the form is wrong."""
    if blob[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, parts, shape, ended = 8, [], None, False
    while at < len(blob) and not ended:
        if at + 12 > len(blob):
            raise ValueError("a PNG chunk is cut off")
        (n,) = struct.unpack_from(">I", blob, at)
        kind, body = blob[at + 4 : at + 8], blob[at + 8 : at + 8 + n]
        if len(body) != n or at + 12 + n > len(blob):
            raise ValueError("a PNG chunk is cut off")
        if struct.unpack_from(">I", blob, at + 8 + n)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise ValueError(f"the checksum of chunk {kind!r} is wrong")
        if kind == b"IHDR":
            if n != 13:
                raise ValueError("IHDR of a wrong length")
            w, h, depth, colour, packing, filtering, lace = struct.unpack(">IIBBBBB", body)
            if (depth, packing, filtering, lace) != (8, 0, 0, 0) or colour not in CHANNELS or not w or not h:
                raise ValueError("not a PNG of 8 bits a sample without palette or interlacing")
            shape = (h, w, CHANNELS[colour])
        elif kind == b"IDAT":
            parts.append(body)
        ended = kind == b"IEND"
        at += 12 + n
    if shape is None or not ended:
        raise ValueError("a PNG without IHDR or IEND")
    h, w, channels = shape
    size = h * (w * channels + 1)
    try:
        # No more than IHDR promises is unpacked, whatever the stream holds.
        packer = zlib.decompressobj()
        data = packer.decompress(b"".join(parts), size)
        rest = packer.decompress(packer.unconsumed_tail, 1) if len(data) == size and not packer.eof else b""
    except zlib.error as e:
        raise ValueError(f"PNG data: {e}") from e
    if len(data) != size or rest or not packer.eof:
        raise ValueError("PNG data of a wrong length")
    rows = np.frombuffer(data, np.uint8).reshape(h, w * channels + 1)
    samples = unfilter(rows[:, 0], rows[:, 1:], channels)
    return samples if channels == 1 else samples.reshape(h, w, channels)


@cache
def _cosines() -> np.ndarray:
    k, x = np.arange(HASH_SIDE)[:, None], np.arange(HASH_GRID)[None, :]
    return np.cos(np.pi * (2 * x + 1) * k / (2 * HASH_GRID))


def cosine_hash(samples: np.ndarray) -> str:
    """16 hex digits: which of the 8 x 8 lowest frequencies of the picture, shrunk to 32 x 32 by
    area means, exceed their median (the constant term is left out of the median).  Of several channels
    the mean counts."""
    grid = samples if samples.ndim == 2 else samples.mean(axis=2)
    h, w = grid.shape
    for axis, n in ((0, h), (1, w)):
        if n >= HASH_GRID:
            edges = np.arange(HASH_GRID) * n // HASH_GRID
            grid = np.stack([part.mean(axis=axis, dtype=np.float64) for part in np.split(grid, edges[1:], axis=axis)], axis=axis)
        else:
            grid = np.take(grid, np.arange(HASH_GRID) * n // HASH_GRID, axis=axis).astype(np.float64)
    c = _cosines()
    low = np.round(c @ grid @ c.T, 6).ravel()
    bits = low > np.median(low[1:])
    return np.packbits(bits).tobytes().hex()


def payload_of(text: bytes | None) -> bytes:
    """UTF-8 bytes (null: none) with zero bytes up to a positive multiple of 64."""
    data = text or b""
    return data + bytes(WIDTH * max(1, -(-len(data) // WIDTH)) - len(data))


def _described(blob: bytes) -> tuple:
    samples = decode_png(blob)
    data = memoryview(np.ascontiguousarray(samples)).cast("B")
    return len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-WIDTH:]), len(blob), hashlib.sha256(blob).hexdigest(), cosine_hash(samples)


_FEATURES = [
    T.StructField("payload_bytes", T.LongType()),
    T.StructField("payload_sha256", T.StringType()),
    T.StructField("tail_crc32", T.LongType()),
    T.StructField("media_bytes", T.LongType()),
    T.StructField("media_sha256", T.StringType()),
    T.StructField("feature", T.StringType()),
]
#: Rows of a batch that are turned into Python objects at a time.
ROWS = 256


def media_columns(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", level: int = 1) -> DataFrame:
    """``id_col``, ``n_bytes`` (without padding) and the binary column ``media``, one picture a row.

    Null and empty texts become 64 zero bytes.  Rows are independent: repeated rows
    give repeated results, an empty table gives an empty one, other columns are not
    read.  No shuffle; a task holds one Arrow batch and a few MB of pictures at a time.
    """
    out = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])
    schema = to_arrow_schema(out)

    def rows(batches):
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                for i, t in zip(part.column(0).to_pylist(), utf8(part.column(1))):
                    yield i, len(t or b""), encode_png(payload_of(t), level)

    def run(batches):
        yield from record_batches(rows(batches), schema, most=ROWS, weight=lambda r: len(r[2]), most_weight=4 << 20)

    return df.select(F.col(id_col), F.col(text_col).cast("string").alias("text")).mapInArrow(lean(run), out)


def read_media(media: DataFrame, id_col: str = "doc_id", media_col: str = "media", keep: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, the columns ``keep``, and the features of a stored binary column of pictures, with all checksum tests.

    A damaged picture ends the job with a ValueError, as a stored payload that cannot be
    read back must not pass silently; a null one gives nulls.
    """
    first = [id_col, *keep]
    out = T.StructType([*(T.StructField(c, media.schema[c].dataType) for c in first), *_FEATURES])
    schema = to_arrow_schema(out)

    def rows(batches):
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                *values, blobs = (c.to_pylist() for c in b.slice(at, ROWS).columns)
                for *row, blob in zip(*values, blobs):
                    yield *row, *((None,) * len(_FEATURES) if blob is None else _described(blob))

    return media.select(*[F.col(c) for c in first], F.col(media_col).alias("media")).mapInArrow(lean(lambda batches: record_batches(rows(batches), schema)), out)


def op8_media_columns(spark, sf_dir) -> DataFrame:
    """The digests of what the stored column gives when it is read back; the pictures themselves are left out of the result."""
    stored, _ = write_shared(media_columns(documents(spark, sf_dir)), "media")
    return read_media(stored, keep=("n_bytes",))
