"""PNG images in binary columns: written and read through zlib chunks, with checksum tests and numpy unfiltering, and
low-frequency cosine-transform hashes of what was read.

A payload, padded to a multiple of BLOCK bytes, is an 8-bit greyscale image of WIDTH pixels a row. Nulls: a null text is an empty one, whose payload
is one padded block. A damaged image (signature, lengths, checksums, size of the pixel data, filter kinds) raises
ValueError in read(). Repeated rows give equal values. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm import text as tx

BLOCK, WIDTH = 576, 24
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: A side of the square that is transformed, and of its low-frequency corner.
SIDE, LOW = 32, 8
#: Compressed data is split into chunks of so many bytes.
CHUNK = 1 << 16
#: Samples a pixel by PNG colour type, at 8 bits a sample.
SAMPLES = {0: 1, 2: 3, 4: 2, 6: 4}


def pad(body: bytes) -> bytes:
    """Bytes 255 up to a positive multiple of BLOCK."""
    return body + b"\xff" * (-len(body) % BLOCK or (0 if body else BLOCK))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def write(payload: bytes, width: int = WIDTH) -> bytes:
    """A greyscale PNG of the payload (a positive multiple of width), without filter or with the Up filter, whichever has the smaller sum."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    above = np.vstack([np.zeros((1, width), np.uint8), rows[:-1]])
    up = rows - above
    use = np.minimum(up, -up).sum(dtype=np.int64) < np.minimum(rows, -rows).sum(dtype=np.int64)
    lines = np.empty((len(rows), width + 1), np.uint8)
    lines[:, 0] = 2 if use else 0
    lines[:, 1:] = up if use else rows
    packed = zlib.compress(lines.tobytes(), 1)
    header = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + b"".join(_chunk(b"IDAT", packed[k : k + CHUNK]) for k in range(0, len(packed), CHUNK)) + _chunk(b"IEND", b"")


def unfilter(lines: np.ndarray, step: int) -> np.ndarray:
    """Rows of samples from rows of a filter kind and filtered samples; step: bytes a pixel."""
    kinds, raw = lines[:, 0], lines[:, 1:]
    if (kinds > 4).any():
        raise ValueError("unknown filter")
    out = np.zeros((len(raw) + 1, raw.shape[1]), np.uint8)
    k = 0
    while k < len(raw):
        kind = kinds[k]
        end = k + 1
        while end < len(raw) and kinds[end] == kind and kind < 3:
            end += 1
        if kind == 0:
            out[k + 1 : end + 1] = raw[k:end]
        elif kind == 1:
            pixels = raw[k:end].reshape(end - k, -1, step)
            out[k + 1 : end + 1] = np.cumsum(pixels, axis=1, dtype=np.uint8).reshape(end - k, -1)
        elif kind == 2:
            out[k + 1 : end + 1] = np.cumsum(np.vstack([out[k : k + 1], raw[k:end]]), axis=0, dtype=np.uint8)[1:]
        else:
            above, row = out[k].astype(np.int16), out[k + 1]
            for x in range(0, raw.shape[1], step):  # each pixel needs the one before it
                left = row[x - step : x].astype(np.int16) if x else np.zeros(step, np.int16)
                b = above[x : x + step]
                if kind == 3:
                    guess = (left + b) >> 1
                else:
                    c = above[x - step : x] if x else np.zeros(step, np.int16)
                    near = np.abs(np.stack([b - c, left - c, left + b - 2 * c]))
                    guess = np.where((near[0] <= near[1]) & (near[0] <= near[2]), left, np.where(near[1] <= near[2], b, c))
                row[x : x + step] = (raw[k, x : x + step] + guess) & 0xFF
        k = end
    return out[1:]


def read(image: bytes) -> np.ndarray:
    """Samples of an 8-bit PNG without interlace: height x width x samples."""
    if image[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, packed, header, ended = 8, [], None, False
    while at < len(image) and not ended:
        if at + 12 > len(image):
            raise ValueError("a chunk is cut off")
        size, kind = struct.unpack(">I4s", image[at : at + 8])
        body, check = image[at + 8 : at + 8 + size], image[at + 8 + size : at + 12 + size]
        if len(body) < size or len(check) < 4 or struct.unpack(">I", check)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise ValueError(f"checksum of {kind!r}")
        if kind == b"IHDR":
            if size != 13:
                raise ValueError("size of the header")
            header = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        ended = kind == b"IEND"
        at += 12 + size
    if header is None or not ended:
        raise ValueError("header or end is missing")
    width, height, depth, colour, _, _, lace = header
    if depth != 8 or colour not in SAMPLES or lace:
        raise ValueError("only 8-bit samples without palette or interlace")
    step = SAMPLES[colour]
    size = height * (width * step + 1)
    stream = zlib.decompressobj()
    try:
        data = stream.decompress(b"".join(packed), size + 1)  # no more than the header says, whatever the stream holds
    except zlib.error as error:
        raise ValueError("pixel data can't be unpacked") from error
    if not size or len(data) != size or not stream.eof:
        raise ValueError("size of the pixel data")
    return unfilter(np.frombuffer(data, np.uint8).reshape(height, width * step + 1), step).reshape(height, width, step)


@lru_cache
def _basis() -> np.ndarray:
    k, x = np.arange(LOW)[:, None], np.arange(SIDE)[None, :]
    return np.cos(np.pi * k * (2 * x + 1) / (2 * SIDE))


@lru_cache(4096)
def _edges(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the samples that each of SIDE cells averages."""
    start = np.arange(SIDE) * n // SIDE
    return start, np.maximum(start + 1, (np.arange(SIDE) + 1) * n // SIDE)


def cosine_hash(samples: np.ndarray) -> bytes:
    """64 bits: which low-frequency coefficients of the image, averaged to SIDE x SIDE cells, exceed their median."""
    grey = samples.mean(axis=2)
    sums = np.zeros((grey.shape[0] + 1, grey.shape[1] + 1))
    np.cumsum(np.cumsum(grey, axis=0), axis=1, out=sums[1:, 1:])
    (y, y2), (x, x2) = _edges(grey.shape[0]), _edges(grey.shape[1])
    area = (y2 - y)[:, None] * (x2 - x)[None, :]
    cells = (sums[np.ix_(y2, x2)] - sums[np.ix_(y, x2)] - sums[np.ix_(y2, x)] + sums[np.ix_(y, x)]) / area
    low = (_basis() @ cells @ _basis().T).round(6).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes()


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high, data, offsets in tx.slabs(batch.column(1)):
            body = data.tobytes()
            media = [write(pad(body[a:b])) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(np.diff(offsets), pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        read_back, tails, hashes = [], [], []
        for image in batch.column(2):
            samples = read(image.as_py())
            payload = samples.tobytes()
            read_back.append((len(payload), hashlib.sha256(payload).hexdigest()))
            tails.append(zlib.crc32(payload[-32:]))
            hashes.append(cosine_hash(samples))
        sizes, digests = zip(*read_back, strict=True) if read_back else ((), ())
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), pa.array(tails, pa.int64()), pa.array(hashes, pa.binary())],
            names=["doc_id", "n_bytes", "media", "payload_bytes", "payload_sha256", "tail_crc32", "hash"],
        )


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each whole text as a PNG in a binary column."""
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(_encode, "doc_id bigint, n_bytes bigint, media binary")


def features(images: DataFrame) -> DataFrame:
    """Adds what is read back from the column media: size, digest and tail checksum of the payload, and hash (8 bytes, binary)."""
    return images.select("doc_id", "n_bytes", "media").mapInArrow(_features, "doc_id bigint, n_bytes bigint, media binary, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, hash binary")
