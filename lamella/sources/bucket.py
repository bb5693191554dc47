"""A bucket as the relations the operators take."""

from __future__ import annotations

import base64
import hashlib
import io
import json
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.functions import names
from lamella.operators import catalog, overlay, reach, recipes, signing
from lamella.session import written
from lamella.sources import archives, objects
from lamella.sources.files import blocks, files, require_shared

_PLATFORM = "struct<os:string,architecture:string,variant:string>"
_DESCRIPTOR = "struct<media_type:string,digest:string,size_bytes:bigint>"


def _refuse(bad: DataFrame, what: str) -> None:
    some = [r["object_key"] for r in bad.select("object_key").limit(5).collect()]
    if some:
        raise ValueError(f"{what}: {', '.join(some)}")


def layer_of(root: str, digest: str | None) -> tuple[io.BufferedIOBase, dict | None]:
    """A layer as a file, and its recipe if it is held as chunks.

    OSError for a layer that is neither blob nor recipe, or whose recipe or content is damaged.
    """
    if digest is None:
        raise OSError("no well-formed digest")
    store = files(root)
    try:
        body = store.read(f"recipes/sha256/{digest}")
    except FileNotFoundError:
        blob = store.open(f"blobs/sha256/{digest}")
        whole = hashlib.sha256()
        for block in blocks(blob):
            whole.update(block)
        if whole.hexdigest() != digest:
            blob.close()
            raise OSError(f"blob {digest} is damaged") from None
        blob.seek(0)
        return blob, None
    try:
        recipe = json.loads(body)
        return archives.layer_file(store, recipe), recipe
    except (ValueError, TypeError, KeyError) as e:
        raise OSError(f"recipe {digest} cannot be used: {e}") from e


def entries_of_layer(root: str, digest: str | None) -> tuple[str, list[tuple]]:
    """(state, entries) of a layer, from its file index if it has one: no chunk is read then."""
    try:
        try:
            stored = files(root).read(f"indexes/sha256/{digest}") if digest else None
        except FileNotFoundError:
            stored = None
        if stored is not None:
            files(root).open(f"recipes/sha256/{digest}").close()  # an index alone is no layer
            return "ok", archives.indexed_entries(stored)[1]
        layer, _ = layer_of(root, digest)
        with layer:
            head = layer.read(4)
            layer.seek(0)
            if head[:2] == b"\x1f\x8b" or head == b"\x28\xb5\x2f\xfd":
                return "compressed", []
            return "ok", archives.entries_of_file(layer) if head else []
    except OSError as e:
        return f"cannot be read: {e}", []
    except ValueError:
        return "not a tar", []


class Found(NamedTuple):
    """A file of an image: its bytes, the layer that shows it, and what reading it took."""

    data: bytes
    layer: str
    indexed: bool
    chunks_fetched: int
    chunks_total: int


class Bucket:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, require_shared(spark, root)

    def keys(self, prefix: str = "") -> DataFrame:
        return objects.list_objects(self.spark, self.root, prefix)

    def object_listing(self, listed: DataFrame | None = None) -> DataFrame:
        """Rows in the form of the ``object_listing`` table; everything listed is live."""
        return (self.keys() if listed is None else listed).select(F.xxhash64("object_key").alias("listing_id"), "*", F.lit(None).cast("timestamp").alias("deleted_at"))

    def _parsed(self, keys: DataFrame) -> DataFrame:
        read = objects.with_json(keys, self.root, objects.MANIFEST_SCHEMA)
        rows = read.select("object_key", F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("digest"), "valid", F.col("parsed").alias("m"))

        def one(x):
            return F.struct(x["mediaType"].alias("media_type"), x["digest"].alias("digest"), x["size"].alias("size_bytes"))

        return rows.select(
            F.xxhash64("object_key").alias("manifest_id"), F.nullif(names.image_of_key(F.col("object_key")), F.lit("")).alias("image"), F.nullif(names.tag_of_key(F.col("object_key")), F.lit("")).alias("tag"), "digest",
            F.col("m.schemaVersion").alias("schema_version"), F.col("m.mediaType").alias("media_type"), F.when(F.col("m.config").isNotNull(), one(F.col("m.config"))).cast(_DESCRIPTOR).alias("config"),
            F.transform("m.layers", one).alias("layers"), F.transform("m.manifests", lambda x: F.struct(x["mediaType"].alias("media_type"), x["digest"].alias("digest"), x["size"].alias("size_bytes"), x["platform"].cast(_PLATFORM).alias("platform"))).alias("manifests"),
            "object_key", "valid",
        )

    def manifest(self, strict: bool = False, scope: str = "", listed: DataFrame | None = None) -> DataFrame:
        """Manifests of tags under ``scope`` and, level by level, those that indexes list among the blobs.

        ``strict``: ValueError for one that is missing or cannot be read or parsed, as
        what it keeps alive is unknown. Else it is a row without references.
        """
        listed = written(self.keys(), "keys") if listed is None else listed
        times = listed.select("object_key", F.col("last_modified").alias("stored_at"))
        found = written(self._parsed(listed.where(F.col("object_key").rlike(r"^manifests/.+/[^/]+/manifest\.json\z") & F.col("object_key").startswith(f"manifests/{scope}"))), "manifests")
        every, front = found, found
        while True:
            if strict:
                _refuse(front.where("not valid"), "manifests that cannot be read or parsed")
            wanted = front.select(F.explode("manifests.digest").alias("d")).where("d <> ''").select(F.regexp_replace("d", "^sha256:", "blobs/sha256/").alias("object_key")).distinct()
            if strict:
                _refuse(wanted.join(listed, "object_key", "left_anti"), "manifests that indexes list and nothing stores")
            front = written(self._parsed(listed.join(wanted, "object_key", "left_semi").join(every.select("object_key"), "object_key", "left_anti")), "manifests")
            if front.isEmpty():
                return every.join(times, "object_key").drop("object_key", "valid")
            every = every.unionByName(front)

    def recipe(self, listed: DataFrame | None = None) -> DataFrame:
        return objects.recipes(self.spark, self.root, listed).withColumn("recipe_id", F.xxhash64("compressed_digest", "layer"))

    def check_recipes(self, recipe: DataFrame, live: DataFrame) -> None:
        """ValueError if a recipe of a layer in ``live`` (kind, digest) could not be read or parsed."""
        _refuse(recipe.where("not valid").join(live.select(F.col("digest").alias("compressed_digest")), "compressed_digest", "left_semi"), "recipes that cannot be read or parsed")

    def config(self, name: str = "config.yaml") -> dict:
        return objects.bucket_config(self.root, name)

    def rules(self, name: str = "config.yaml") -> DataFrame:
        return objects.config_rules(self.spark, self.config(name))

    def layer_entries(self, order: DataFrame) -> DataFrame:
        """Tar entries of the layers in ``order`` (layer_pos, digest), as ``archives.tar_entries``.

        A layer is held as recipe and chunks or as a blob of any size; a file index is
        taken instead where there is one. A layer that is missing, damaged, compressed or
        no tar has one row, whose ``state`` says so.
        """
        root = self.root

        def run(batches):
            import pyarrow as pa

            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            names = ["id", "entry_pos", "path", "offset", "size", "link", "link_type", "state"]
            for batch in batches:
                for pos, digest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    state, entries = entries_of_layer(root, digest)
                    rows = [(pos, *entry, state) for entry in entries] if state == "ok" else [(pos, *[None] * 6, state)]
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)

        return order.select(F.col("layer_pos").cast("bigint").alias("id"), "digest").mapInArrow(run, archives.ENTRY_SCHEMA)

    def file_index(self) -> DataFrame:
        """(compressed_digest, layer, path, offset, size, link, link_type, entry_pos, state) of all stored file indexes."""
        root = self.root

        def run(batches):
            import pyarrow as pa

            for batch in batches:
                for key in batch.column(0).to_pylist():
                    digest = key.rpartition("/")[2]
                    try:
                        layer, entries = archives.indexed_entries(files(root).read(key))
                        rows = [(digest, layer, path, offset, size, link, kind, pos, "ok") for pos, path, offset, size, link, kind in entries]
                    except (OSError, ValueError) as e:
                        rows = [(digest, *[None] * 7, f"cannot be read: {e}")]
                    columns = list(zip(*rows, strict=True)) or [[]] * 9
                    kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["compressed_digest", "layer", "path", "offset", "size", "link", "link_type", "entry_pos", "state"])

        schema = "compressed_digest string, layer string, path string, offset bigint, size bigint, link string, link_type string, entry_pos bigint, state string"
        return self.keys("indexes/sha256/").select("object_key").mapInArrow(run, schema)

    def find(self, layer_digests: list[str], path: str) -> Found:
        """One file of an image given by its layers, lowest first.

        FileNotFoundError if the image does not show the path; ValueError if a layer is
        missing, damaged, compressed or no tar, as the path may then be in it, or if an
        index places the file outside its layer. Of a layer held as chunks, only those
        of the file are read, and those of tar headers if it has no file index.
        """
        order = self.spark.createDataFrame([(k, d) for k, d in enumerate(layer_digests)], "layer_pos int, digest string")
        entries = written(self.layer_entries(order), "entries")
        bad = entries.where("state <> 'ok'").limit(1).collect()
        if bad:
            raise ValueError(f"layer {bad[0]['id']}: {bad[0]['state']}")
        seen = overlay.view(entries.select(F.lit("i").alias("image"), F.col("id").cast("int").alias("layer_pos"), "path", "link"))
        target = overlay.follow_links(seen, self.spark.createDataFrame([("i", path)], "image string, path string")).first()
        if target["state"] != "file":
            raise FileNotFoundError(f"{path}: {target['state']}")
        at = seen.where(F.col("path") == target["target"]).first()["layer_pos"]
        entry = entries.where((F.col("id") == at) & (F.col("path") == target["target"])).orderBy(F.desc("entry_pos")).first()
        digest = layer_digests[at]
        try:
            layer, recipe = layer_of(self.root, digest)
            with layer:
                if recipe is not None and not 0 <= entry["offset"] <= entry["offset"] + entry["size"] <= recipe["size"]:
                    raise ValueError(f"layer {at}: its index places {target['target']} outside of it")
                layer.seek(entry["offset"])
                data = layer.read(entry["size"])
                fetched = len(layer.raw.fetched) if recipe is not None else 0
        except OSError as e:
            raise ValueError(f"layer {at}: cannot be read: {e}") from e
        return Found(data, digest, files(self.root).exists(f"indexes/sha256/{digest}"), fetched, len(recipe["chunks"]) if recipe is not None else 0)

    def cat(self, layer_digests: list[str], path: str) -> bytes:
        """Content of one file of an image, as ``find`` finds it."""
        return self.find(layer_digests, path).data

    def signatures(self) -> DataFrame:
        """(image, tag, slug, valid, schema_version, digest, key_ref, key_id, algorithm, signature, signed_at) of all records."""
        at = r"^manifests/(.+)/([^/]+)/signatures/([^/]+)\.json\z"
        keys = self.keys("manifests/").where(F.col("object_key").rlike(at))
        read = objects.with_json(keys, self.root, "schemaVersion int, digest string, keyRef string, keyID string, algorithm string, signature string, signedAt string")
        place = [F.regexp_extract("object_key", at, k + 1).alias(n) for k, n in enumerate(("image", "tag", "slug"))]
        r = F.col("parsed")
        return read.select(*place, "valid", r["schemaVersion"].alias("schema_version"), r["digest"].alias("digest"), r["keyRef"].alias("key_ref"), r["keyID"].alias("key_id"), r["algorithm"].alias("algorithm"), r["signature"].alias("signature"), r["signedAt"].alias("signed_at"))

    def sign(self, image: str, tag: str, bucket: str, key_ref: str, der: bytes, algorithm: str, signer: Callable[[bytes], bytes], now: str) -> str:
        """Store a signature of a tag's manifest and its place; returns the record's key.

        ``signer`` signs bytes, ``der`` is the public key it belongs to, which names the record.
        """
        digest = "sha256:" + hashlib.sha256(files(self.root).read(f"manifests/{image}/{tag}/manifest.json")).hexdigest()
        slug = hashlib.sha256(der).hexdigest()[:16]
        payload = signing.payload_bytes(bucket, image, tag, digest)
        record = {"schemaVersion": signing.SCHEMA_VERSION, "digest": digest, "keyRef": key_ref, "keyID": slug, "algorithm": algorithm, "signature": base64.b64encode(signer(payload)).decode(), "signedAt": now}
        key = f"manifests/{image}/{tag}/signatures/{slug}.json"
        files(self.root).write(key, json.dumps(record).encode())
        return key

    def inspect(self, image: str, tag: str) -> DataFrame:
        """(platform, manifest, pos, digest, size_bytes, media_type) of a tag's layers, by platform in the index's order.

        ValueError if the tag, or a manifest it lists, is missing or cannot be read.
        """
        every = self.manifest(strict=True, scope=f"{image}/{tag}/")
        plain = catalog.plain_manifests(every)
        own = plain.where((F.col("image") == image) & (F.col("tag") == tag))
        if own.isEmpty():
            raise ValueError(f"no tag {image}:{tag}")
        listed = own.select(F.posexplode("manifests").alias("place", "x")).select("place", names.platform_text(F.col("x.platform")).alias("platform"), F.col("x.digest").alias("digest"))
        children = listed.join(catalog.newest_manifests(plain).select("digest", "manifest_id"), "digest")
        single = own.where(F.size("manifests") == 0).select(F.col("digest"), F.lit(0).alias("place"), F.lit(None).cast("string").alias("platform"), "manifest_id")
        chosen = single.unionByName(children)
        rows = catalog.layer_rows(plain).join(chosen.select("manifest_id", "place", "platform", F.col("digest").alias("manifest")), "manifest_id")
        return rows.orderBy("place", "pos").select("platform", "manifest", "pos", "digest", "size_bytes", "media_type")

    def unreadable(self, listed: DataFrame | None = None) -> DataFrame:
        """(object_key, image, tag): manifests of tags that cannot be read or parsed."""
        keys = (self.keys("manifests/") if listed is None else listed.where(F.col("object_key").startswith("manifests/"))).where(F.col("object_key").endswith("/manifest.json"))
        return objects.with_json(keys, self.root, objects.MANIFEST_SCHEMA).where("not valid").select("object_key", names.image_of_key(F.col("object_key")).alias("image"), names.tag_of_key(F.col("object_key")).alias("tag"))

    def doctor(self, scope: str = "", config: str = "config.yaml", deep: bool = False) -> DataFrame:
        """(check, image, tag, detail): everything wrong with the bucket; no row, no fault.

        Checks: layout (nothing stored), config (unusable), manifest (of a tag, cannot be
        read or parsed), missing (a digest a tag refers to, neither blob nor recipe),
        orphan (a blob or recipe no tag refers to). Manifests and missing things are those
        of images under ``scope``; orphans are the whole bucket's. ``deep`` (an extension)
        adds chunk (of a stored recipe, not stored) and recipe (unusable, or its parts do
        not add up). FileNotFoundError for a bucket that is not there.
        """
        spark = self.spark
        if not files(self.root).reachable():
            raise FileNotFoundError(self.root)
        listed = written(self.keys(), "keys")  # one listing serves all checks
        listing = self.object_listing(listed)
        manifest = self.manifest(listed=listed)
        first = []
        if listed.where("object_key like 'manifests/%' or object_key like 'blobs/%'").isEmpty():
            first.append(("layout", None, None, "no manifests and no blobs"))
        try:
            self.config(config)
        except (OSError, ValueError) as e:
            first.append(("config", None, None, str(e)))
        found = spark.createDataFrame(first, "check string, image string, tag string, detail string")
        scoped = F.col("image").startswith(scope)
        parts = [
            self.unreadable(listed).where(scoped).select(F.lit("manifest").alias("check"), "image", "tag", F.col("object_key").alias("detail")),
            reach.missing_references(manifest, listing).where(scoped).select(F.lit("missing").alias("check"), "image", "tag", F.col("digest").alias("detail")),
            reach.orphans(manifest, listing).select(F.lit("orphan").alias("check"), F.lit(None).cast("string").alias("image"), F.lit(None).cast("string").alias("tag"), F.concat_ws("/", "kind", F.lit("sha256"), "digest").alias("detail")),
        ]
        if deep:
            recipe = written(self.recipe(listed), "recipes")
            none = [F.lit(None).cast("string").alias("image"), F.lit(None).cast("string").alias("tag")]
            bad = recipe.join(recipes.consistency(recipe).select("recipe_id", "consistent"), "recipe_id").where("not (valid and consistent)")
            parts.append(reach.missing_chunks(recipe, listing).select(F.lit("chunk").alias("check"), *none, F.concat_ws(" of ", "digest", "layer").alias("detail")))
            parts.append(bad.select(F.lit("recipe").alias("check"), *none, F.col("object_key").alias("detail")))
        for p in parts:
            found = found.unionByName(p)
        return found
