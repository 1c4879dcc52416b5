"""Media columns: PNG files in binary columns.

Bytes are stored as 8-bit RGB samples, 64 pixels (192 bytes) a line, in a PNG:
signature, IHDR, one zlib stream over IDAT chunks, IEND, each chunk with its
CRC. Lines are filtered by the least sum of absolute differences among None,
Sub and Up; reading tests every checksum and undoes all five filters with
numpy. A 64-bit hash of the low frequencies of a 32 x 32 cosine transform is
the feature.

One narrow pass, row by row, no shuffle. Edge cases: null and empty texts are
one line of spaces; equal texts, repeated rows among them, give equal values; a very long text is one tall picture, held whole by the task
that has its row; frequencies equal to the median count as not above it; a damaged file raises ValueError.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, utf8

WIDTH, CHANNELS = 64, 3
LINE = WIDTH * CHANNELS
SIGNATURE = b"\x89PNG\r\n\x1a\n"
IDAT_BYTES = 1 << 16
BATCH_BYTES = 4 << 20


def pad(data: bytes) -> bytes:
    """Spaces up to a positive multiple of a line."""
    return data + b" " * (-len(data) % LINE if data else LINE)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def write_png(payload: bytes, level: int = 1) -> bytes:
    """A PNG whose samples are ``payload``, a multiple of 192 bytes."""
    lines = np.frombuffer(payload, np.uint8).reshape(-1, LINE)
    sub = lines.copy()
    sub[:, CHANNELS:] -= lines[:, :-CHANNELS]
    up = lines.copy()
    up[1:] -= lines[:-1]
    cost = np.stack([np.abs(x.view(np.int8).astype(np.int16)).sum(1) for x in (lines, sub, up)])
    kind = cost.argmin(0)
    out = np.empty((len(lines), LINE + 1), np.uint8)
    out[:, 0] = kind
    out[:, 1:] = np.where((kind == 0)[:, None], lines, np.where((kind == 1)[:, None], sub, up))
    stream = zlib.compress(out.tobytes(), level)
    head = struct.pack(">IIBBBBB", WIDTH, len(lines), 8, 2, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + b"".join(_chunk(b"IDAT", stream[i : i + IDAT_BYTES]) for i in range(0, len(stream), IDAT_BYTES)) + _chunk(b"IEND", b"")


def _unfilter(raw: np.ndarray, bpp: int) -> np.ndarray:
    kinds, lines = raw[:, 0], raw[:, 1:].copy()
    n = len(lines)
    if n and kinds.max() > 4:
        raise ValueError("unknown PNG filter")
    edges = np.flatnonzero(np.diff(kinds)) + 1
    for lo, hi in zip(np.concatenate([[0], edges]), np.concatenate([edges, [n]])):
        kind = kinds[lo] if n else 0
        if kind == 1:
            block = lines[lo:hi].reshape(hi - lo, -1, bpp)
            lines[lo:hi] = np.cumsum(block, 1, dtype=np.uint8).reshape(hi - lo, -1)
        elif kind == 2:
            if lo:
                lines[lo] += lines[lo - 1]
            lines[lo:hi] = np.cumsum(lines[lo:hi], 0, dtype=np.uint8)
        elif kind > 2:
            for r in range(lo, hi):
                line, above = lines[r].reshape(-1, bpp).astype(int), (lines[r - 1] if r else np.zeros_like(lines[0])).reshape(-1, bpp).astype(int)
                left = corner = np.zeros(bpp, int)
                for x in range(len(line)):
                    if kind == 3:
                        guess = (left + above[x]) // 2
                    else:
                        base = left + above[x] - corner
                        a, b, c = abs(base - left), abs(base - above[x]), abs(base - corner)
                        guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, above[x], corner))
                    left, corner = (line[x] + guess) & 255, above[x]
                    line[x] = left
                lines[r] = line.reshape(-1)
    return lines


def read_png(data: bytes) -> np.ndarray:
    """Samples of an 8-bit, non-interlaced PNG as (height, width, channels); every chunk's CRC and the zlib checksum are tested."""
    if data[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, stream, head, ended = 8, [], None, False
    while at + 12 <= len(data) and not ended:
        size = struct.unpack(">I", data[at : at + 4])[0]
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if len(body) < size or struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0] != zlib.crc32(kind + body):
            raise ValueError(f"bad checksum in {kind!r}")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            stream.append(body)
        ended = kind == b"IEND"
        at += 12 + size
    if head is None or not ended:
        raise ValueError("PNG without IHDR or IEND")
    width, height, depth, color, _, _, interlaced = head
    channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(color)
    if depth != 8 or interlaced or channels is None:
        raise ValueError("only 8-bit PNG without palette or interlacing")
    try:
        raw = zlib.decompress(b"".join(stream))
    except zlib.error as e:
        raise ValueError(str(e)) from e
    if len(raw) != height * (width * channels + 1):
        raise ValueError("wrong size of the samples")
    return _unfilter(np.frombuffer(raw, np.uint8).reshape(height, -1), channels).reshape(height, width, channels)


def _cosines(n: int) -> np.ndarray:
    i = np.arange(n)
    return np.cos(np.pi * (2 * i[None, :] + 1) * i[:, None] / (2 * n))


_DCT = _cosines(32)[:8]


def _means(n: int) -> np.ndarray:
    """(32, n): weights that average n samples into 32 equal parts."""
    edges = np.arange(33) * n / 32
    lo = np.arange(n)
    return np.clip(np.minimum(edges[1:, None], lo + 1) - np.maximum(edges[:-1, None], lo), 0, None) * 32 / n


_ACROSS = _means(WIDTH)


def cosine_hash(samples: np.ndarray) -> str:
    """16 hex digits: which of the 8 x 8 lowest frequencies lie above their median."""
    gray = samples.astype(np.float64).mean(2)
    across = _ACROSS if gray.shape[1] == WIDTH else _means(gray.shape[1])
    small = _means(len(gray)) @ (gray @ across.T)
    low = np.round(_DCT @ small @ _DCT.T, 6).ravel()
    return f"{int(''.join('1' if x else '0' for x in low > np.median(low[1:])), 2):016x}"


def _stored():
    """A function of a text column: struct(n_bytes, media)."""

    @F.pandas_udf("n_bytes long, media binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            data = [utf8(t) for t in texts]
            for part in slices(texts, [len(t) for t in data], BATCH_BYTES):
                yield pd.DataFrame({"n_bytes": [len(t) for t in data[part]], "media": [write_png(pad(t)) for t in data[part]]})

    return run


def _described():
    """A function of a column of files: payload and feature digests."""

    @F.pandas_udf("payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for files in batches:
            rows = []
            for data in files:
                samples = read_png(bytes(data))
                payload = samples.tobytes()
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), cosine_hash(samples)))
            yield pd.DataFrame(rows, columns=["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return run


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_bytes and the binary column ``media`` of every row."""
    kept = docs.select(F.col(id_col).alias("k"), _stored()(F.col(text_col)).alias("r"))
    return kept.select(F.col("k").alias(id_col), "r.n_bytes", "r.media")


def describe(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Read each file of ``media`` back: payload and feature digests beside ``id_col`` and n_bytes."""
    kept = media.select(F.col(id_col).alias("k"), "n_bytes", _described()(F.col("media")).alias("r"))
    return kept.select(F.col("k").alias(id_col), "n_bytes", "r.*")


def op4_media_columns(spark, sf_dir):
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature for every document."""
    return describe(store(spark.read.parquet(f"{sf_dir}/documents.parquet")))
