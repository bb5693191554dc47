"""What tags keep alive, what is garbage, what is missing.

The reference graph is expanded level by level: each round joins the newly found
manifests to their edges and drops those seen before, so shared sub-graphs are walked
once and a cycle ends. Rounds follow the depth of nesting (an index of manifests is
two), never the number of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.functions import digests, names
from lamella.operators import catalog
from lamella.session import splittable, written


def chunk_edges(recipe: DataFrame) -> DataFrame:
    """(layer, child): well-formed chunks of each recipe."""
    rows = recipe.select(digests.plain(F.col("compressed_digest")).alias("layer"), F.explode("chunks.digest").alias("child"))
    return rows.select("layer", digests.plain(F.col("child")).alias("child")).where("layer is not null and child is not null").distinct()


def reachable(manifest: DataFrame, recipe: DataFrame, tags: DataFrame | None = None) -> DataFrame:
    """(kind, digest) that the current tags reach: manifest, config, layer, chunk."""
    manifests = catalog.plain_manifests(manifest)
    edges = written(catalog.references(manifests).select("manifest_id", "kind", "child"), "edges")
    by_digest = splittable(catalog.newest_manifests(manifests.select("digest", "manifest_id", "stored_at")).select(F.col("digest").alias("child"), "manifest_id"))
    front = written((tags if tags is not None else catalog.current_tags(manifest)).select("manifest_id").distinct(), "front")
    seen = front
    for _ in range(catalog.MAX_DEPTH):
        found = front.join(edges.where("kind = 'manifest'"), "manifest_id").select("child").distinct().join(by_digest, "child").select("manifest_id").distinct()
        front = written(found.join(seen, "manifest_id", "left_anti"), "front")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    else:
        raise RuntimeError(f"manifests nest deeper than {catalog.MAX_DEPTH}")
    own = seen.join(manifests.select("manifest_id", "digest"), "manifest_id").where("digest is not null").select(F.lit("manifest").alias("kind"), "digest")
    direct = seen.join(edges, "manifest_id").select("kind", F.col("child").alias("digest"))
    chunks = direct.where("kind = 'layer'").select(F.col("digest").alias("layer")).distinct().join(chunk_edges(recipe), "layer").select(F.lit("chunk").alias("kind"), F.col("child").alias("digest"))
    return own.unionByName(direct).unionByName(chunks).distinct()


def garbage(object_listing: DataFrame, live: DataFrame, now: str, grace: str = "1 hour") -> DataFrame:
    """Stored objects nothing live refers to: (kind, digest, size_bytes, old_enough).

    Blobs and recipes are kept by manifests, configs and layers, chunks by recipes that
    are live themselves. Objects younger than ``grace`` are reported, not to be deleted.
    """
    whole = live.where("kind <> 'chunk'").select("digest").distinct()
    chunks = live.where("kind = 'chunk'").select("digest").distinct()
    objects = catalog.live_objects(object_listing)
    dead = objects.where("kind in ('blobs', 'recipes', 'indexes')").join(whole, "digest", "left_anti").unionByName(objects.where("kind = 'chunks'").join(chunks, "digest", "left_anti"))
    old = F.col("last_modified") <= F.to_timestamp(F.lit(now)) - F.expr(f"interval {grace}")
    return dead.select("kind", "digest", "size_bytes", F.coalesce(old, F.lit(False)).alias("old_enough"))


def garbage_summary(dead: DataFrame, object_listing: DataFrame) -> DataFrame:
    """Per class: objects looked at, to be deleted (with bytes) and too young to be."""
    scanned = catalog.live_objects(object_listing).where("kind in ('blobs', 'recipes', 'indexes', 'chunks')").groupBy("kind").agg(F.count(F.lit(1)).alias("scanned"))
    counts = dead.groupBy("kind").agg(F.count_if("old_enough").alias("deletable"), F.coalesce(F.sum(F.when(F.col("old_enough"), F.col("size_bytes"))), F.lit(0)).alias("deletable_bytes"), F.count_if(~F.col("old_enough")).alias("too_young"))
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("deletable", "deletable_bytes", "too_young")}
    return scanned.join(counts, "kind", "left").withColumns(zero)


def missing_references(manifest: DataFrame, object_listing: DataFrame) -> DataFrame:
    """(image, tag, digest): each thing a tag refers to that is not stored, as blob or recipe."""
    stored = catalog.live_objects(object_listing).where("kind in ('blobs', 'recipes')").select("digest").distinct()
    refs = catalog.tag_references(manifest).select("image", "tag", F.col("child").alias("digest")).distinct()
    return refs.join(splittable(stored), "digest", "left_anti").select("image", "tag", "digest")


def missing(manifest: DataFrame, object_listing: DataFrame) -> DataFrame:
    """(image, tag, n_missing, first_missing): tags with references to nothing stored.

    Whole blobs and recipes count as stored, as either restores a layer.
    """
    return missing_references(manifest, object_listing).groupBy("image", "tag").agg(F.count(F.lit(1)).alias("n_missing"), F.min("digest").alias("first_missing"))


def missing_chunks(recipe: DataFrame, object_listing: DataFrame) -> DataFrame:
    """(layer, digest): chunks of stored recipes that are not stored (an extension of the health check)."""
    held = catalog.live_objects(object_listing)
    live = held.where("kind = 'recipes'").select(F.col("digest").alias("layer"))
    chunks = held.where("kind = 'chunks'").select(F.col("digest").alias("child"))
    edges = chunk_edges(recipe).join(splittable(live), "layer", "left_semi")
    return edges.join(splittable(chunks), "child", "left_anti").select("layer", F.col("child").alias("digest"))


def orphans(manifest: DataFrame, object_listing: DataFrame) -> DataFrame:
    """(kind, digest, size_bytes) of stored blobs and recipes that no tag refers to."""
    refs = catalog.tag_references(manifest).select(F.col("child").alias("digest")).unionByName(catalog.current_tags(manifest).where("digest is not null").select("digest")).distinct()
    return catalog.live_objects(object_listing).where("kind in ('blobs', 'recipes')").join(refs, "digest", "left_anti").select("kind", "digest", "size_bytes")


def resolved_layers(manifests: DataFrame, object_listing: DataFrame, first: str = "blob") -> DataFrame:
    """(digest, held_as): how each referred layer is stored: blob, recipe or missing.

    Of a layer stored both ways, serving takes the whole ``blob``, pulling the ``recipe``.
    """
    held = catalog.live_objects(object_listing).where("kind in ('blobs', 'recipes')").groupBy("digest").agg(F.bool_or(F.col("kind") == "blobs").alias("blob"), F.bool_or(F.col("kind") == "recipes").alias("recipe"))
    layers = catalog.layer_rows(manifests).where("digest is not null").select("digest").distinct()
    other = "recipe" if first == "blob" else "blob"
    return layers.join(held, "digest", "left").select("digest", F.when(F.col(first), first).when(F.col(other), other).otherwise("missing").alias("held_as"))


def copy_plan(manifest: DataFrame, source_prefix: str, target_prefix: str) -> DataFrame:
    """(digest, size_bytes, action) to copy one scope's references to where another's are."""
    refs = catalog.tag_references(manifest)
    wanted = refs.where(F.col("image").startswith(source_prefix)).groupBy(F.col("child").alias("digest")).agg(F.max("size_bytes").alias("size_bytes"))
    there = refs.where(F.col("image").startswith(target_prefix)).select(F.col("child").alias("digest")).distinct().withColumn("there", F.lit(True))
    return wanted.join(there, "digest", "left").select("digest", "size_bytes", F.when(F.col("there"), "skip").otherwise("copy").alias("action"))


def copy_summary(plan: DataFrame) -> DataFrame:
    """(action, objects, bytes) of a copy plan."""
    return plan.groupBy("action").agg(F.count(F.lit(1)).alias("objects"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"))


def sidecar_plan(keys: DataFrame, source_prefix: str, target_prefix: str, rewritten: bool) -> DataFrame:
    """(object_key, target_key, action) for what lies beside a copied manifest.

    A signature covers the manifest and its place, so it is dropped when either changes.
    """
    beside = keys.where(F.col("object_key").startswith(source_prefix)).select("object_key", F.expr(f"substring(object_key, {len(source_prefix) + 1})").alias("rest")).where("rest <> 'manifest.json'")
    lost = F.col("rest").startswith("signatures/") & F.lit(rewritten or source_prefix != target_prefix)
    return beside.select("object_key", F.when(~lost, F.concat(F.lit(target_prefix), "rest")).alias("target_key"), F.when(lost, "drop").otherwise("copy").alias("action"))


def retargeted_layers(manifests: DataFrame, recipe: DataFrame) -> DataFrame:
    """Layers with digest, size and media type replaced by the recipe's compressed identity, if one exists."""
    raw, packed = digests.plain(F.col("layer")), digests.plain(F.col("compressed_digest"))
    by_layer = recipe.select(raw.alias("digest"), packed.alias("packed"), "compressed_size", "recipe_id").where("digest is not null and packed is not null").groupBy("digest").agg(F.min_by(F.struct("packed", "compressed_size"), "recipe_id").alias("r"))
    rows = catalog.layer_rows(manifests).join(splittable(by_layer), "digest", "left")
    return rows.select("manifest_id", "pos", F.coalesce("r.packed", "digest").alias("digest"), F.when(F.col("r").isNotNull(), F.col("r.compressed_size")).otherwise(F.col("size_bytes")).alias("size_bytes"), F.when(F.col("r").isNotNull(), names.ZSTD_LAYER).otherwise(F.col("media_type")).alias("media_type"), F.col("r").isNotNull().alias("retargeted"))
