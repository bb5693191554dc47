"""Tar layers and zstd frames."""

from __future__ import annotations

import bisect
import collections
import concurrent.futures
import hashlib
import io
import itertools
import json
import tarfile
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from lamella.functions.paths import normal

ENTRY_SCHEMA = "id bigint, entry_pos bigint, path string, offset bigint, size bigint, link string, link_type string, state string"


def entries_of(data: bytes) -> list[tuple]:
    """(pos, path, offset, size, link, link_type) of the files and links of a tar.

    Raises ValueError for bytes that are no tar; an empty input has no entries.
    """
    return entries_of_file(io.BytesIO(data))


def entries_of_file(file: io.IOBase) -> list[tuple]:
    """The same of a file that can seek, of which only headers are read."""
    out = []
    if not file.read(1):
        return out
    file.seek(0)
    try:
        with tarfile.open(fileobj=file, mode="r:") as tar:
            for pos, m in enumerate(tar):
                if m.isfile():
                    out.append((pos, normal(m.name), m.offset_data, m.size, None, None))
                elif m.issym() or m.islnk():
                    # targets of hard links are paths from the root, of symbolic ones from the link
                    out.append((pos, normal(m.name), None, 0, m.linkname if m.issym() else "/" + normal(m.linkname), "symbolic" if m.issym() else "hard"))
    except tarfile.TarError as e:
        raise ValueError(str(e)) from e
    return out


class ChunkedFile(io.RawIOBase):
    """A layer read through its chunks: each is fetched when a read first touches it.

    ``chunks``: (digest, size) in order; ``fetch`` gives the stored frame of a digest.
    OSError for a chunk that is missing, damaged or of another size than listed.
    """

    def __init__(self, chunks: list[tuple[str, int]], fetch: Callable[[str], bytes]) -> None:
        self.chunks, self.fetch = chunks, fetch
        self.ends = list(itertools.accumulate(size for _, size in chunks))
        self.at, self.held, self.data = 0, -1, b""
        self.fetched: set[int] = set()

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        self.at = max(0, offset + (0, self.at, self.ends[-1] if self.ends else 0)[whence])
        return self.at

    def tell(self) -> int:
        return self.at

    def readinto(self, out) -> int:
        k = bisect.bisect_right(self.ends, self.at)
        if k == len(self.ends):
            return 0
        if k != self.held:
            digest, size = self.chunks[k]
            try:
                data = zstandard.ZstdDecompressor().stream_reader(self.fetch(digest), read_across_frames=True).read()
            except zstandard.ZstdError as e:
                raise OSError(f"chunk {digest}: {e}") from e
            if len(data) != size or hashlib.sha256(data).hexdigest() != digest:
                raise OSError(f"chunk {digest} is damaged")
            self.held, self.data = k, data
            self.fetched.add(k)
        begin = self.at - (self.ends[k] - self.chunks[k][1])
        part = self.data[begin : begin + len(out)]
        out[: len(part)] = part
        self.at += len(part)
        return len(part)


def layer_file(store, recipe: dict) -> io.BufferedReader:
    """The layer of a parsed recipe as a file over its stored chunks. ValueError if its parts do not add up."""
    chunks = [(str(c["digest"]), int(c["size"])) for c in recipe["chunks"]]
    if sum(size for _, size in chunks) != recipe["size"]:
        raise ValueError("the recipe does not add up")
    return io.BufferedReader(ChunkedFile(chunks, lambda digest: store.read(f"chunks/sha256/{digest}")))


#: Frames read ahead of the one handed on.
AHEAD = 4


def frames(store, chunks: list[dict]) -> Iterator[bytes]:
    """Stored frames of a recipe's chunks in order, a few read ahead. OSError for one of another length than listed."""
    with concurrent.futures.ThreadPoolExecutor(AHEAD) as pool:
        waiting: collections.deque = collections.deque()
        rest = iter(chunks)
        while True:
            while len(waiting) < AHEAD and (chunk := next(rest, None)) is not None:
                waiting.append((chunk, pool.submit(store.read, f"chunks/sha256/{chunk['digest']}")))
            if not waiting:
                return
            chunk, frame = waiting.popleft()
            data = frame.result()
            if chunk.get("compressedSize") is not None and len(data) != chunk["compressedSize"]:
                raise OSError(f"chunk {chunk['digest']} has {len(data)} bytes, not {chunk['compressedSize']}")
            yield data


def index_of(layer: io.IOBase, digest: str) -> bytes | None:
    """The stored form of a layer's file index; None for a layer that is no tar or has no files."""
    try:
        entries = entries_of_file(layer)
    except ValueError:
        return None
    # Fixed names of the stored form; zero and absent values are left out
    rows = [{"path": path, "offset": offset, "size": size, "link": link, "linkType": link_type} for _, path, offset, size, link, link_type in entries]
    held = [{k: v for k, v in row.items() if v or k == "path"} for row in rows]
    return zstandard.ZstdCompressor(level=3).compress(json.dumps({"layer": digest, "files": held}).encode()) if held else None


def indexed_entries(stored: bytes) -> tuple[str, list[tuple]]:
    """(layer, entries as ``entries_of`` gives them) of a stored file index. ValueError for bytes that are none."""
    try:
        found = json.loads(zstandard.ZstdDecompressor().stream_reader(io.BytesIO(stored), read_across_frames=True).read())
        out = []
        for pos, f in enumerate(found["files"]):
            link = f.get("link") or None
            out.append((pos, normal(f["path"]), None if link else int(f.get("offset") or 0), int(f.get("size") or 0), link, f.get("linkType", "symbolic") if link else None))
        return str(found["layer"]), out
    except (zstandard.ZstdError, KeyError, TypeError, AttributeError) as e:
        raise ValueError("not a file index") from e


def tar_entries(layers: DataFrame, layer_id: str, content: str) -> DataFrame:
    """Entries of every layer; ``state`` is ok, or says on one row why there are none.

    Compressed layers (gzip, zstd) are named as such: their paths are unknown, not absent.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if data is None:
                    rows.append((key, None, None, None, None, None, None, "no content"))
                    continue
                if data[:2] == b"\x1f\x8b" or data[:4] == b"\x28\xb5\x2f\xfd":
                    rows.append((key, None, None, None, None, None, None, "compressed"))
                    continue
                try:
                    rows += [(key, *entry, "ok") for entry in entries_of(data)]
                except ValueError:
                    rows.append((key, None, None, None, None, None, None, "not a tar"))
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            names = ["id", "entry_pos", "path", "offset", "size", "link", "link_type", "state"]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)

    slim = layers.select(F.col(layer_id).cast("bigint").alias("id"), F.col(content).cast("binary").alias("content"))
    return slim.mapInArrow(run, ENTRY_SCHEMA)


@F.pandas_udf(BinaryType())
def zstd_compress(data: pd.Series) -> pd.Series:
    enc = zstandard.ZstdCompressor(level=3)
    return data.map(lambda x: None if x is None else enc.compress(bytes(x)))


@F.pandas_udf(BinaryType())
def zstd_decompress(data: pd.Series) -> pd.Series:
    """Content of one or more frames; null for bytes that are none."""
    def one(x: bytes | None) -> bytes | None:
        if x is None:
            return None
        try:
            return zstandard.ZstdDecompressor().stream_reader(io.BytesIO(bytes(x)), read_across_frames=True).read()
        except zstandard.ZstdError:
            return None

    return data.map(one)
