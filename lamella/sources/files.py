"""Objects below a root, on any file system that Arrow reaches from an executor.

A root is a path, or a URI of ``file``, ``local``, ``s3``, ``s3a``, ``gs``, ``az``,
``abfs`` or ``hdfs``. Keys are paths below it with ``/`` between their parts. Every
process opens a root once.
"""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Iterator
from datetime import UTC, datetime

from pyspark.sql import SparkSession

#: Schemes that Arrow knows under another name.
ALIASES = {"s3a": "s3", "az": "abfs"}
#: Bytes copied at a time.
BLOCK = 8 << 20
#: Setting with local folders, by commas, that all machines of a cluster share.
SHARED_ROOTS = "spark.lamella.shared.roots"


def local_path(root: str) -> str | None:
    """Path of a root on the machine's own file system, None for any other."""
    m = re.match(r"([a-z][a-z0-9+.-]*):(?://)?", root)
    if not m:
        return root
    return root[m.end() :] or "/" if m[1] in ("file", "local") else None


def require_shared(spark: SparkSession, root: str) -> str:
    """The root as every process understands it: local paths from the driver's folder on.

    RuntimeError where executors on other machines would each see a folder of their own.
    """
    path = local_path(root)
    if path is None:
        return root
    path = os.path.abspath(path)
    if re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        return path
    conf = spark.sparkContext.getConf()
    named = [*spark.conf.get(SHARED_ROOTS, conf.get(SHARED_ROOTS, "")).split(","), conf.get("spark.checkpoint.dir", "")]
    shared = [os.path.abspath(local_path(n) or "") for n in named if n.strip() and local_path(n)]
    if not any((path + os.sep).startswith(s.rstrip(os.sep) + os.sep) for s in shared):
        raise RuntimeError(f"{root!r} is local to each machine; name it in {SHARED_ROOTS} if it is shared, or use an object store")
    return path


def checked_key(key: str) -> str:
    """The key, if all of its parts are names."""
    if not key or any(part in ("", ".", "..") for part in key.split("/")):
        raise ValueError(f"{key!r} leads outside its root")
    return key


class LocalFiles:
    """Objects of a folder. Each appears whole, by rename."""

    def __init__(self, root: str) -> None:
        self.root = os.path.realpath(root)

    def _path(self, key: str) -> str:
        path = os.path.realpath(os.path.join(self.root, key))
        if path != self.root and not path.startswith(self.root.rstrip(os.sep) + os.sep):
            raise ValueError(f"{key!r} leads outside {self.root!r}")
        return path

    def folders(self, prefix: str) -> list[str]:
        """Prefixes, each with a slash at its end, of the folders in that of ``prefix``."""
        at = self._path(prefix) if prefix else self.root
        if not os.path.isdir(at):
            return []
        return sorted(f"{prefix}{e.name}/" for e in os.scandir(at) if e.is_dir(follow_symlinks=False))

    def listed(self, prefix: str, deep: bool) -> Iterator[tuple]:
        """(key, size, time) of the objects below a folder's prefix."""
        for folder, folders, names in os.walk(self._path(prefix) if prefix else self.root):
            if not deep:
                folders.clear()
            for name in sorted(names):
                path = os.path.join(folder, name)
                info = os.stat(path)
                yield os.path.relpath(path, self.root).replace(os.sep, "/"), info.st_size, datetime.fromtimestamp(info.st_mtime, UTC)

    def reachable(self) -> bool:
        return os.path.isdir(self.root)

    def exists(self, key: str) -> bool:
        return os.path.isfile(self._path(key))

    def open(self, key: str):
        return open(self._path(key), "rb")

    def read(self, key: str) -> bytes:
        with self.open(key) as f:
            return f.read()

    def write(self, key: str, data) -> None:
        """``data``: bytes, or an iterator of bytes."""
        path = self._path(checked_key(key))
        os.makedirs(os.path.dirname(path), exist_ok=True)
        part = f"{path}.{os.getpid()}.part"
        try:
            with open(part, "wb") as f:
                for block in [data] if isinstance(data, bytes | bytearray | memoryview) else data:
                    f.write(block)
            os.replace(part, path)
        except BaseException:
            if os.path.exists(part):
                os.unlink(part)
            raise

    def delete(self, key: str) -> None:
        os.unlink(self._path(checked_key(key)))

    def touch(self, key: str) -> None:
        os.utime(self._path(key))


class ArrowFiles:
    """Objects of a store that Arrow has a file system for; an object appears when its stream is closed."""

    def __init__(self, root: str) -> None:
        from pyarrow import fs

        scheme, _, rest = root.partition("://")
        self.fs, self.root = fs.FileSystem.from_uri(f"{ALIASES.get(scheme, scheme)}://{rest}")
        self.root = self.root.rstrip("/")

    def _path(self, key: str) -> str:
        return f"{self.root}/{checked_key(key.rstrip('/'))}" if key else self.root

    def _infos(self, prefix: str, deep: bool) -> list:
        from pyarrow import fs

        return self.fs.get_file_info(fs.FileSelector(self._path(prefix), allow_not_found=True, recursive=deep))

    def folders(self, prefix: str) -> list[str]:
        from pyarrow import fs

        return sorted(f"{prefix}{i.base_name}/" for i in self._infos(prefix, False) if i.type == fs.FileType.Directory)

    def listed(self, prefix: str, deep: bool) -> Iterator[tuple]:
        from pyarrow import fs

        for i in self._infos(prefix, deep):
            if i.type == fs.FileType.File:
                yield i.path[len(self.root) + 1 :], i.size, i.mtime

    def reachable(self) -> bool:
        from pyarrow import fs

        return self.fs.get_file_info(self.root).type == fs.FileType.Directory

    def exists(self, key: str) -> bool:
        from pyarrow import fs

        return self.fs.get_file_info(self._path(key)).type == fs.FileType.File

    def open(self, key: str):
        return self.fs.open_input_file(self._path(key))

    def read(self, key: str) -> bytes:
        with self.open(key) as f:
            return f.read()

    def write(self, key: str, data) -> None:
        path = self._path(checked_key(key))
        if self.fs.type_name in ("local", "hdfs", "mock"):
            self.fs.create_dir(path.rpartition("/")[0], recursive=True)
        with self.fs.open_output_stream(path) as f:
            for block in [data] if isinstance(data, bytes | bytearray | memoryview) else data:
                f.write(block)

    def delete(self, key: str) -> None:
        self.fs.delete_file(self._path(checked_key(key)))

    def touch(self, key: str) -> None:
        self.write(key, self.read(key))


@functools.lru_cache(maxsize=64)
def files(root: str) -> LocalFiles | ArrowFiles:
    path = local_path(root)
    return ArrowFiles(root) if path is None else LocalFiles(path)


def blocks(file) -> Iterator[bytes]:
    """The rest of an open file, a block at a time."""
    while block := file.read(BLOCK):
        yield block


def copy(source: str, target: str, key: str, new_key: str | None = None) -> None:
    """Copy one object between roots, block by block."""
    with files(source).open(key) as f:
        files(target).write(new_key or key, blocks(f))
