"""Images moved as a whole: pushed into a bucket, copied between buckets, pulled out.

Everything a manifest refers to is written before it, chunks before the recipes that
list them, and the manifest of the tag last, by one atomic write: a reader sees the old
image or the new one. Objects that are there already are not written again, but touched,
so that garbage collection leaves them another grace period. Work is one task for each
object, and objects are streamed block by block.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.functions import digests, names
from lamella.operators import catalog, chunking, policy, reach, recipes
from lamella.session import written
from lamella.sources import sinks
from lamella.sources.bucket import Bucket, layer_of
from lamella.sources.files import blocks, copy, files, require_shared

TAR_LAYER = "application/vnd.oci.image.layer.v1.tar"
#: Objects in the order in which they may appear.
STEPS = ("chunks", "indexes", "recipes", "blobs")


def refuse_immutable(bucket: Bucket, image: str, tag: str, config: str = "config.yaml", force: bool = False, existing: bool = True) -> None:
    """PermissionError if the image's rules make its tags immutable and the tag exists.

    ``existing``: only a tag that is there is protected; a new one may always be written.
    """
    if force:
        return
    rule = policy.effective(bucket.spark.createDataFrame([(image,)], "image string"), bucket.rules(config)).first()
    if rule["immutable"] and (not existing or files(bucket.root).exists(f"manifests/{image}/{tag}/manifest.json")):
        raise PermissionError(f"{image} is immutable")


def _copied(plan: DataFrame, source: str, target: str) -> None:
    def run(rows) -> None:
        for row in rows:
            copy(source, target, row["object_key"])

    plan.select("object_key").foreachPartition(run)


def copy_image(spark: SparkSession, source: str, target: str, image: str, tag: str, new_image: str | None = None, new_tag: str | None = None, platform: str | None = None, force: bool = False) -> dict[str, int]:
    """Copy one tag between buckets; returns counts of objects and bytes copied and skipped, and of sidecars.

    ``platform``: publish only that platform's manifest of an index. ValueError for a
    source that is incomplete, PermissionError for an immutable tag at the target.
    """
    source = require_shared(spark, source)
    target = require_shared(spark, target)
    new_image, new_tag = new_image or image, new_tag or tag
    here, there = Bucket(spark, source), Bucket(spark, target)
    refuse_immutable(there, new_image, new_tag, force=force)
    place, new_place = f"manifests/{image}/{tag}/", f"manifests/{new_image}/{new_tag}/"
    held = written(here.keys(), "keys")
    manifest = here.manifest(strict=True, scope=f"{image}/{tag}/", listed=held)
    plain = catalog.plain_manifests(manifest)
    tags = catalog.current_tags(manifest)
    if tags.isEmpty():
        raise ValueError(f"no tag {image}:{tag}")
    body, rewritten = files(source).read(place + "manifest.json"), False
    if platform:
        picked = catalog.pick_platform(plain.join(tags.select("manifest_id"), "manifest_id", "left_semi"), platform).first()
        if picked is not None:
            body, rewritten = files(source).read(f"blobs/sha256/{picked['digest']}"), True
            child = catalog.newest_manifests(plain).where(F.col("digest") == picked["digest"]).select("manifest_id")
            tags = tags.select("image", "tag").crossJoin(F.broadcast(child))  # one tag, one manifest
        elif not plain.join(tags.select("manifest_id"), "manifest_id", "left_semi").where(F.size("manifests") > 0).isEmpty():
            raise ValueError(f"{image}:{tag} has no {platform}")
    walked = catalog.tag_manifests(tags, plain)
    wanted = written(walked.join(catalog.references(plain), "manifest_id").select(F.col("child").alias("digest")).distinct(), "wanted")
    keyed = held.select("object_key", "size_bytes", digests.object_class(F.col("object_key")).alias("kind"), digests.hex_text(digests.object_digest(F.col("object_key"))).alias("digest"))
    whole = keyed.where("kind in ('blobs', 'recipes', 'indexes')").join(wanted, "digest", "left_semi")
    lost = wanted.join(whole.where("kind in ('blobs', 'recipes')"), "digest", "left_anti").limit(5).collect()
    if lost:
        raise ValueError("not stored at the source: " + ", ".join(r["digest"] for r in lost))
    recipe = written(here.recipe(held), "recipes")
    here.check_recipes(recipe, wanted.select(F.lit("layer").alias("kind"), "digest"))
    chunks = reach.chunk_edges(recipe).join(wanted.withColumnRenamed("digest", "layer"), "layer", "left_semi").select(F.col("child").alias("digest")).distinct()
    gone = chunks.join(keyed.where("kind = 'chunks'"), "digest", "left_anti").limit(5).collect()
    if gone:
        raise ValueError("chunks not stored at the source: " + ", ".join(r["digest"] for r in gone))
    every = whole.unionByName(keyed.where("kind = 'chunks'").join(chunks, "digest", "left_semi"))
    plan = written(every.join(there.keys().select("object_key", F.lit(True).alias("there")), "object_key", "left").withColumn("action", F.when(F.col("there"), "skip").otherwise("copy")), "copy-plan")
    for kind in STEPS:
        _copied(plan.where((F.col("action") == "copy") & (F.col("kind") == kind)), source, target)
    beside = [r for r in reach.sidecar_plan(held, place, new_place, rewritten or source != target).collect()]
    for r in beside:
        if r["action"] == "copy":
            copy(source, target, r["object_key"], r["target_key"])
    files(target).write(new_place + "manifest.json", body)
    counts = {r["action"]: (r["objects"], r["bytes"]) for r in reach.copy_summary(plan).collect()}
    copied, skipped = counts.get("copy", (0, 0)), counts.get("skip", (0, 0))
    return {"copied": copied[0], "copied_bytes": copied[1], "skipped": skipped[0], "skipped_bytes": skipped[1], "sidecars": sum(r["action"] == "copy" for r in beside), "dropped": sum(r["action"] == "drop" for r in beside)}


def push_image(spark: SparkSession, source: str, root: str, image: str, tag: str, manifest_key: str = "manifest.json", config: str = "config.yaml", force: bool = False, fmt: chunking.Format | None = None) -> dict[str, int]:
    """Publish the image below ``source`` (a manifest and ``blobs/sha256/…``, as ``pull_image`` writes) as a tag.

    In a chunked bucket layers of at least one smallest chunk are chunked and the
    manifest names them by their compressed identity; everything else, the image config
    always, is stored whole. ValueError for a blob that is missing or damaged, or if the
    bucket holds chunks of another format; PermissionError for an immutable tag.
    """
    source = require_shared(spark, source)
    root = require_shared(spark, root)
    bucket = Bucket(spark, root)
    refuse_immutable(bucket, image, tag, config, force)
    held = bucket.config(config)
    fmt = fmt or chunking.FORMAT_1
    chunked = bool(held.get("chunked"))
    if chunked and held.get("chunk_format", fmt.number) != fmt.number:
        raise ValueError(f"the bucket holds chunks of format {held['chunk_format']}, not {fmt.number}")
    manifest = json.loads(files(source).read(manifest_key))
    layers = manifest.get("layers") or []
    rows = [(k, x["digest"].removeprefix("sha256:"), int(x.get("size") or 0), True) for k, x in enumerate(layers)]
    if manifest.get("config"):
        rows.append((-1, manifest["config"]["digest"].removeprefix("sha256:"), int(manifest["config"].get("size") or 0), False))
    parts = spark.createDataFrame(rows, "id bigint, digest string, size bigint, layer boolean").repartition(max(1, len(rows)), "id")
    parts = written(parts.withColumn("kept_as", recipes.kept_as(F.col("size"), F.col("layer") & F.lit(chunked), fmt.smallest)), "parts")

    def check_and_copy(batches):
        import pyarrow as pa

        for batch in batches:
            for key, digest, kept in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                state = "kept"
                try:
                    whole = hashlib.sha256()
                    with files(source).open(f"blobs/sha256/{digest}") as f:
                        for block in blocks(f):
                            whole.update(block)
                    if whole.hexdigest() != digest:
                        state = "damaged"
                    elif kept == "blob" and files(root).exists(f"blobs/sha256/{digest}"):
                        files(root).touch(f"blobs/sha256/{digest}")
                    elif kept == "blob":
                        copy(source, root, f"blobs/sha256/{digest}")
                        state = "new"
                except (OSError, ValueError) as e:
                    state = f"unreadable: {e}"
                yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([state], pa.string())], names=["id", "state"])

    done = written(parts.select("id", "digest", "kept_as").mapInArrow(check_and_copy, "id bigint, state string"), "pushed")
    bad = done.where("state not in ('kept', 'new')").limit(5).collect()
    if bad:
        raise ValueError("; ".join(f"blob {r['id']} is {r['state']}" for r in bad))
    big = parts.where("kept_as = 'chunks'").select("id", F.concat(F.lit("blobs/sha256/"), "digest").alias("object_key"))
    stored = {r["id"]: r for r in sinks.store_layer_files(big, root, source, fmt).collect()}  # a row for each layer of one image
    for k, r in stored.items():
        layers[k] = {**layers[k], "digest": f"sha256:{r['compressed_digest']}", "size": r["compressed_size"], "mediaType": names.ZSTD_LAYER}
    if chunked and "chunk_format" not in held:
        import yaml

        files(root).write(config, yaml.safe_dump({**held, "chunk_format": fmt.number}, sort_keys=True).encode())
    files(root).write(f"manifests/{image}/{tag}/manifest.json", json.dumps(manifest).encode())
    return {"layers": len(layers), "chunked": len(stored), "chunks": sum(r["n_chunks"] for r in stored.values()), "new_chunks": sum(r["new_chunks"] for r in stored.values()), "new_blobs": done.where("state = 'new'").count()}


def pull_image(spark: SparkSession, root: str, image: str, tag: str, into: str, platform: str = "linux/amd64") -> dict[str, int]:
    """Write a tag's image of one platform below ``into``: manifest, index and ``blobs/sha256/…``.

    Layers held as chunks are put together and named by their raw digest; every layer's
    digest is verified. ValueError for a layer that is missing or damaged, or without the platform.
    """
    root = require_shared(spark, root)
    into = require_shared(spark, into)
    bucket = Bucket(spark, root)
    every = bucket.manifest(strict=True, scope=f"{image}/{tag}/")
    plain = catalog.plain_manifests(every)
    own = plain.where((F.col("image") == image) & (F.col("tag") == tag))
    head = own.first()
    if head is None:
        raise ValueError(f"no tag {image}:{tag}")
    place = f"manifests/{image}/{tag}/manifest.json"
    if head["manifests"]:
        picked = catalog.pick_platform(own, platform).first()
        if picked is None or picked["digest"] is None:
            raise ValueError(f"{image}:{tag} has no {platform}")
        place = f"blobs/sha256/{picked['digest']}"
    manifest = json.loads(files(root).read(place))
    layers = manifest.get("layers") or []
    rows = [(k, x["digest"].removeprefix("sha256:")) for k, x in enumerate(layers)]
    if manifest.get("config"):
        rows.append((-1, manifest["config"]["digest"].removeprefix("sha256:")))

    def fetch(batches):
        import pyarrow as pa

        for batch in batches:
            for key, digest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                size, state = 0, "ok"
                try:
                    layer, recipe = layer_of(root, digest)
                    name = recipe["layer"] if recipe else digest
                    whole = hashlib.sha256()

                    def counted(layer=layer, whole=whole):
                        for block in blocks(layer):
                            whole.update(block)
                            yield block

                    with layer:
                        files(into).write(f"blobs/sha256/{name}", counted())
                        size = layer.tell()
                    if whole.hexdigest() != name:
                        files(into).delete(f"blobs/sha256/{name}")
                        state = "damaged"
                except (OSError, ValueError, KeyError) as e:
                    name, state = digest, f"unreadable: {e}"
                yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([name], pa.string()), pa.array([size], pa.int64()), pa.array([state], pa.string())], names=["id", "raw", "size", "state"])

    asked = spark.createDataFrame(rows, "id bigint, digest string").repartition(max(1, len(rows)), "id")
    done = {r["id"]: r for r in written(asked.mapInArrow(fetch, "id bigint, raw string, size bigint, state string"), "pulled").collect()}  # a row for each layer of one image
    bad = [f"layer {k} is {r['state']}" for k, r in sorted(done.items()) if r["state"] != "ok"]
    if bad:
        raise ValueError("; ".join(bad[:5]))
    for k, x in enumerate(layers):
        if done[k]["raw"] != rows[k][1]:
            layers[k] = {**x, "digest": f"sha256:{done[k]['raw']}", "size": done[k]["size"], "mediaType": TAR_LAYER}
    body = json.dumps({**manifest, "layers": layers}).encode()
    digest = hashlib.sha256(body).hexdigest()
    store = files(into)
    store.write(f"blobs/sha256/{digest}", body)
    store.write("manifest.json", body)
    store.write("oci-layout", b'{"imageLayoutVersion":"1.0.0"}')
    store.write("index.json", json.dumps({"schemaVersion": 2, "manifests": [{"mediaType": names.OCI_MANIFEST, "digest": f"sha256:{digest}", "size": len(body), "annotations": {"org.opencontainers.image.ref.name": tag}}]}).encode())
    return {"layers": len(layers), "bytes": sum(done[k]["size"] for k in range(len(layers)))}
