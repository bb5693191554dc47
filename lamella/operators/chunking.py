"""Content-defined chunking of byte streams, and what follows from the cuts.

The rolling hash is h = 2h + gear[byte] mod 2^64, restarted at ``smallest`` bytes of
every chunk; a strict mask holds up to the average size, a loose one beyond. As a byte
is shifted out after 64 steps, hashes of a whole window come from six doubling steps
over numpy arrays; the first 63 places after a restart are hashed from the restart.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_M = (1 << 64) - 1
# Fixed values of chunk format 1.
STRICT_MASK = 0x14AA54AA54AA5000
LOOSE_MASK = 0x1294A5294A529000
SEED = 0x9E3779B97F4A7C15


@dataclass(frozen=True)
class Format:
    """Parameters under which equal bytes give equal cuts; another format is another store."""

    number: int
    smallest: int
    average: int
    largest: int
    strict: int
    loose: int


FORMAT_1 = Format(1, 1 << 20, 4 << 20, 16 << 20, STRICT_MASK, LOOSE_MASK)
#: The same scheme for texts of kilobytes: masks of 9 and 7 bits.
SMALL = Format(1001, 64, 256, 1024, 0x1FF << 40, 0x7F << 40)


def _splitmix() -> np.ndarray:
    out, x = [], SEED
    for _ in range(256):
        x = (x + SEED) & _M
        z = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _M
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & _M
        out.append(z ^ (z >> 31))
    return np.array(out, np.uint64)


GEAR = _splitmix()


def _window_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the up to 64 bytes that end at each place."""
    h = GEAR[data]
    moved = np.empty_like(h)
    size = 1
    while size < min(64, len(h)):
        np.left_shift(h[:-size], np.uint64(size), out=moved[size:])
        h[size:] += moved[size:]
        size *= 2
    return h


#: Bytes hashed at a time while looking for a cut.
_STRIDE = 1 << 16


def _first_hit(raw: np.ndarray, restart: int, begin: int, end: int, mask: int) -> int:
    """First place in begin .. end - 1 whose hash misses all bits of the mask, else -1.

    Bytes before ``restart`` never count; a place needs the 63 bytes before it.
    """
    for at in range(begin, end, _STRIDE):
        stop, back = min(at + _STRIDE, end), max(restart, at - 63)
        hit = np.flatnonzero((_window_hashes(raw[back:stop])[at - back :] & np.uint64(mask)) == 0)
        if len(hit):
            return at + int(hit[0])
    return -1


def cuts(data: bytes, fmt: Format = FORMAT_1) -> list[int]:
    """End offsets of the chunks of ``data``."""
    raw = np.frombuffer(data, np.uint8)
    out, at, n = [], 0, len(raw)
    while at < n:
        size = min(n - at, fmt.largest)
        end = at + size
        if size > fmt.smallest:
            restart, border = at + fmt.smallest, at + min(fmt.average, size)
            hit = _first_hit(raw, restart, restart, border, fmt.strict)
            if hit < 0:
                hit = _first_hit(raw, restart, border, end, fmt.loose)
            if hit >= 0:
                end = hit + 1
        at = end
        out.append(at)
    return out


def cuts_of_stream(read, fmt: Format = FORMAT_1) -> Iterator[bytes]:
    """Chunks of a stream; ``read(n)`` returns up to n bytes. One window is held."""
    window = b""
    while True:
        while len(window) < fmt.largest and (more := read(fmt.largest - len(window))):
            window += more
        if not window:
            return
        end = cuts(window, fmt)[0]
        yield window[:end]
        window = window[end:]


_SCHEMA = pa.schema([("id", pa.int64()), ("seq", pa.int64()), ("start", pa.int64()), ("size", pa.int64()), ("digest", pa.string())])


def split(blobs: DataFrame, blob_id: str, content: str, fmt: Format = FORMAT_1) -> DataFrame:
    """(id, seq, start, size, digest) of the chunks of every blob; null content has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in _SCHEMA]
            for key, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if data is None:
                    continue
                start = 0
                for seq, end in enumerate(cuts(data, fmt)):
                    for column, x in zip(columns, (key, seq, start, end - start, hashlib.sha256(data[start:end]).hexdigest()), strict=True):
                        column.append(x)
                    start = end
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA, strict=True)], schema=_SCHEMA)

    slim = blobs.select(F.col(blob_id).cast("bigint").alias("id"), F.col(content).cast("binary").alias("content"))
    return slim.mapInArrow(run, "id bigint, seq bigint, start bigint, size bigint, digest string")


def new_chunks(chunks: DataFrame, stored: DataFrame) -> DataFrame:
    """Distinct chunks (digest, size) that ``stored`` (digest) does not have."""
    return chunks.groupBy("digest").agg(F.max("size").alias("size")).join(stored.select("digest").distinct(), "digest", "left_anti")


def reassembled(chunks: DataFrame) -> DataFrame:
    """(id, n_chunks, bytes, gapless): do the chunks of a blob join without gap or overlap?"""
    return chunks.groupBy("id").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum("size").alias("bytes"), (F.max(F.col("start") + F.col("size")) == F.sum("size")).alias("gapless"))
