"""Listing and reading a store's objects.

``objects`` is a Python data source that walks a root and yields every file, also names
that begin with ``_`` or ``.``: Spark's own recursive listing drops those without a word,
and a listing short of live objects would call them garbage. The walk is split by the
folders under the prefix, so it runs on executors.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lamella.sources.files import LocalFiles, files, local_path, require_shared

SCHEMA = "object_key string, size_bytes bigint, last_modified timestamp, storage_class string"


class _Folder(InputPartition):
    def __init__(self, prefix: str, deep: bool) -> None:
        self.prefix, self.deep = prefix, deep


class _Reader(DataSourceReader):
    def __init__(self, root: str, prefix: str, spread: int) -> None:
        self.root, self.prefix, self.spread = root, prefix, spread

    def partitions(self) -> Sequence[InputPartition]:
        # a prefix may end inside a name, so the walk starts at its last whole folder
        start = self.prefix[: self.prefix.rfind("/") + 1]
        level, shallow = [start], []
        for _ in range(3):
            below = [f for p in level for f in files(self.root).folders(p)]
            if len(level) >= self.spread or not below:
                break
            shallow += level
            level = [f for f in below if f.startswith(self.prefix) or self.prefix.startswith(f)]
        return [*(_Folder(p, False) for p in shallow), *(_Folder(p, True) for p in level)] or [_Folder(start, False)]

    def read(self, part: _Folder) -> Iterator[tuple]:
        for key, size, modified in files(self.root).listed(part.prefix, part.deep):
            if key.startswith(self.prefix):
                yield key, size, modified, "STANDARD"


class ObjectSource(DataSource):
    """``spark.read.format("objects").option("prefix", …).load(root)``; a missing root lists nothing."""

    @classmethod
    def name(cls) -> str:
        return "objects"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self.options.get("prefix", ""), int(self.options.get("spread", "64")))


def list_objects(spark: SparkSession, root: str, prefix: str = "") -> DataFrame:
    root = require_shared(spark, root)
    spark.dataSource.register(ObjectSource)
    return spark.read.format("objects").option("prefix", prefix).load(root)


def safe_path(root: str, key: str) -> str:
    """Path of a key under a local root; ValueError if the key leads outside."""
    return LocalFiles(local_path(root) or root)._path(key)


#: Most bytes of one value.
MOST = (1 << 31) - 1
#: Bytes of content after which a batch is handed on.
HELD = 64 << 20


def with_json(objects: DataFrame, root: str, schema: str) -> DataFrame:
    """(object_key, content, valid, parsed) of objects that refer to others.

    ``valid`` is false for what could not be read, is not one JSON object, names a key
    twice or has a field of another type than ``schema``; what such an object refers to
    is unknown, not nothing. Its ``parsed`` is null.
    """
    read = _read(objects, root)
    parsed = F.from_json(F.when(F.col("whole"), F.col("content").cast("string")), schema + ", _corrupt_record string").alias("p")
    valid = F.col("whole") & F.col("p._corrupt_record").isNull()
    rows = read.select("object_key", "content", "whole", parsed).select("object_key", "content", valid.alias("valid"), F.when(valid, F.col("p")).alias("parsed"))
    return rows.withColumn("parsed", F.col("parsed").dropFields("_corrupt_record"))


def is_object(data: bytes | None) -> bool:
    """One JSON object in UTF-8 without repeated keys?"""

    def once(pairs: list[tuple]) -> dict:
        if len({k for k, _ in pairs}) < len(pairs):
            raise ValueError("repeated key")
        return dict(pairs)

    def refuse(name: str) -> None:
        raise ValueError(f"{name} is not JSON")

    try:
        return data is not None and isinstance(json.loads(data.decode(), object_pairs_hook=once, parse_constant=refuse), dict)
    except (ValueError, RecursionError):
        return False


def _read(objects: DataFrame, root: str) -> DataFrame:
    """(object_key, content, whole): ``whole`` tells content that is a JSON object.

    An object that is gone, cannot be read or is too large for one value has null content.
    """

    def content(key: str) -> bytes | None:
        try:
            with files(root).open(key) as f:
                data = f.read(MOST + 1)
            return data if len(data) <= MOST else None
        except (OSError, ValueError):
            return None

    def run(batches):
        import pyarrow as pa

        def packed(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.bool_())], names=["object_key", "content", "whole"])

        for batch in batches:
            rows, held = [], 0
            for key in batch.column(0).to_pylist():
                data = content(key)
                if rows and held + len(data or b"") > HELD:
                    yield packed(rows)
                    rows, held = [], 0
                rows.append((key, data, is_object(data)))
                held += len(data or b"")
            yield packed(rows)

    return objects.select("object_key").mapInArrow(run, "object_key string, content binary, whole boolean")


MANIFEST_SCHEMA = """schemaVersion int, mediaType string, config struct<mediaType:string,digest:string,size:bigint>,
 layers array<struct<mediaType:string,digest:string,size:bigint>>,
 manifests array<struct<mediaType:string,digest:string,size:bigint,platform:struct<os:string,architecture:string,variant:string>>>"""
RECIPE_SCHEMA = "layer string, size bigint, compressedDigest string, compressedSize bigint, chunks array<struct<digest:string,size:bigint,compressedSize:bigint>>"


def manifests(spark: SparkSession, root: str, prefix: str = "") -> DataFrame:
    """Manifest rows of a bucket: image, tag, valid and the parsed fields.

    ``valid`` is false for what ``with_json`` cannot vouch for.
    """
    keys = list_objects(spark, root, f"manifests/{prefix}").where(F.col("object_key").endswith("/manifest.json"))
    from lamella.functions import names

    read = with_json(keys, root, MANIFEST_SCHEMA)
    digest = F.concat(F.lit("sha256:"), F.sha2("content", 256))
    return read.select(names.image_of_key(F.col("object_key")).alias("image"), names.tag_of_key(F.col("object_key")).alias("tag"), digest.alias("digest"), "valid", F.col("parsed").alias("m")).select("image", "tag", "digest", "valid", "m.*")


def recipes(spark: SparkSession, root: str, listed: DataFrame | None = None) -> DataFrame:
    """Recipe rows of a bucket with their key and whether they could be parsed.

    A layer is resolved by the recipe's key, so that is its compressed digest; a recipe
    without one of its own is that of a raw layer.
    """
    keyed = F.nullif(F.regexp_extract("object_key", r"^recipes/sha256/([0-9a-f]{64})\z", 1), F.lit(""))
    keys = list_objects(spark, root, "recipes/") if listed is None else listed.where(F.col("object_key").startswith("recipes/"))
    read = with_json(keys, root, RECIPE_SCHEMA).select("object_key", "valid", F.col("parsed").alias("r"))
    raw = F.col("r.compressedDigest").isNull()
    return read.select(F.coalesce(keyed, "r.compressedDigest").alias("compressed_digest"), "r.layer", F.col("r.size").alias("size_bytes"), F.when(raw, F.col("r.size")).otherwise(F.col("r.compressedSize")).alias("compressed_size"), F.transform("r.chunks", lambda c: F.struct(c["digest"].alias("digest"), c["size"].alias("size_bytes"), c["compressedSize"].alias("compressed_size"))).alias("chunks"), "object_key", "valid")


def bucket_config(root: str, name: str = "config.yaml") -> dict:
    """YAML configuration of a bucket; {} where there is none. ValueError if it is no mapping."""
    import yaml

    try:
        found = yaml.safe_load(files(root).read(name)) or {}
    except FileNotFoundError:
        return {}
    except yaml.YAMLError as e:
        raise ValueError(f"{name} cannot be parsed") from e
    if not isinstance(found, dict):
        raise ValueError(f"{name} is not a mapping")
    return found


def config_rules(spark: SparkSession, config: dict) -> DataFrame:
    """Rules (image_pattern, keep_last, max_age, keep_tags, immutable) of a configuration."""
    rows = []
    for pattern, held in [("default", config.get("default") or {}), *(config.get("images") or {}).items()]:
        life = held.get("lifecycle") or {}
        rows.append((pattern, life.get("keep_last"), life.get("max_age"), life.get("keep_tags"), held.get("immutable")))
    return spark.createDataFrame(rows, "image_pattern string, keep_last int, max_age string, keep_tags array<string>, immutable boolean")
