"""Relations of a store: tags, references, stored objects, and what can be read off them.

Inputs are the store's tables (``manifest``, ``recipe``, ``object_listing``); digests are
compared in plain form. All shuffles are on a digest or on (image, tag).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamella.functions import digests, names, values
from lamella.session import splittable, written

#: Rounds after which nesting is taken for an error.
MAX_DEPTH = 64


def plain_manifests(manifest: DataFrame) -> DataFrame:
    """Manifest rows with digests in plain form; null lists become empty ones."""

    def descriptors(c: str, with_platform: bool = False) -> Column:
        def one(x: Column) -> Column:
            fields = [digests.plain(x["digest"]).alias("digest"), x["size_bytes"].alias("size_bytes"), x["media_type"].alias("media_type")]
            return F.struct(*fields, *([x["platform"].alias("platform")] if with_platform else []))

        return F.coalesce(F.transform(c, one), F.array().cast(f"array<struct<digest:string,size_bytes:bigint,media_type:string{',platform:struct<os:string,architecture:string,variant:string>' if with_platform else ''}>>"))

    return manifest.select(
        "manifest_id", "image", "tag", "stored_at", digests.plain(F.col("digest")).alias("digest"), "schema_version", "media_type",
        digests.plain(F.col("config.digest")).alias("config_digest"), F.col("config.size_bytes").alias("config_size"),
        descriptors("layers").alias("layers"), descriptors("manifests", True).alias("manifests"),
    )


def current_tags(manifest: DataFrame) -> DataFrame:
    """(image, tag, manifest_id, digest): the newest manifest row of each tag."""
    tagged = manifest.where(F.col("image").isNotNull() & F.col("tag").isNotNull())
    newest = tagged.groupBy("image", "tag").agg(F.max_by(F.struct("manifest_id", "digest"), F.struct("stored_at", "manifest_id")).alias("m"))
    return newest.select("image", "tag", "m.manifest_id", digests.plain(F.col("m.digest")).alias("digest"))


def list_images(manifest: DataFrame, prefix: str = "") -> DataFrame:
    """Images with their sorted tags; ``prefix`` scopes by name."""
    tags = manifest.where(F.col("image").isNotNull() & F.col("tag").isNotNull() & F.col("image").startswith(prefix)).select("image", "tag").distinct()
    return tags.groupBy("image").agg(F.array_sort(F.collect_list("tag")).alias("tags")).select("image", F.size("tags").cast("bigint").alias("n_tags"), "tags")


def images_of_keys(objects: DataFrame) -> DataFrame:
    """Images of a bucket listing: ``manifests/`` keys, and the older layout at the root
    for images that have none there."""
    found = objects.select(names.image_of_key(F.col("object_key")).alias("image"), names.tag_of_key(F.col("object_key")).alias("tag")).where("image <> ''")
    old = r"^(.+)/([^/]+)/manifest\.json\z"
    legacy = objects.where(~F.col("object_key").rlike(r"^(blobs|manifests)/")).select(F.regexp_extract("object_key", old, 1).alias("image"), F.regexp_extract("object_key", old, 2).alias("tag")).where("image <> ''")
    both = found.unionByName(legacy.join(found.select("image").distinct(), "image", "left_anti"))
    return both.groupBy("image").agg(F.array_sort(F.collect_set("tag")).alias("tags"))


def layer_rows(manifests: DataFrame) -> DataFrame:
    """(manifest_id, pos, digest, size_bytes, media_type) of every layer occurrence."""
    return manifests.select("manifest_id", F.posexplode("layers").alias("pos", "l")).select("manifest_id", "pos", "l.*")


def live_objects(object_listing: DataFrame) -> DataFrame:
    """(kind, digest, size_bytes, last_modified, storage_class): one row for each stored object.

    Of several live listings of a key the newest counts. Digests are hex text.
    """
    kind, digest = digests.object_class(F.col("object_key")), digests.object_digest(F.col("object_key"))
    live = object_listing.where(F.col("deleted_at").isNull()).select(kind.alias("kind"), digest.alias("digest"), "listing_id", "size_bytes", "last_modified", storage_class(F.col("storage_class")).alias("storage_class"))
    newest = live.where(F.col("digest").isNotNull()).groupBy("kind", "digest").agg(F.max_by(F.struct("size_bytes", "last_modified", "storage_class"), F.struct("last_modified", "listing_id")).alias("o"))
    return newest.select("kind", digests.hex_text(F.col("digest")).alias("digest"), "o.*")


def storage_class(c: Column) -> Column:
    """Upper case; null or blank is STANDARD."""
    trimmed = F.upper(F.btrim(c))
    return F.when(F.coalesce(trimmed, F.lit("")) == "", "STANDARD").otherwise(trimmed)


def newest_manifests(manifests: DataFrame) -> DataFrame:
    """One row for each manifest digest: the one stored last."""
    held = [c for c in manifests.columns if c != "digest"]
    best = manifests.where(F.col("digest").isNotNull()).groupBy("digest").agg(F.max_by(F.struct(*held), F.struct("stored_at", "manifest_id")).alias("m"))
    return best.select("digest", "m.*")


def references(manifests: DataFrame) -> DataFrame:
    """Edges (manifest_id, kind, child, size_bytes, platform_os) to configs, layers and manifests.

    One pass: the three lists of a row are joined into one and exploded.
    """

    def edge(kind: str, digest: Column, size: Column, platform: Column | None = None) -> Column:
        os = platform["os"] if platform is not None else F.lit(None).cast("string")
        has = platform.isNotNull() if platform is not None else F.lit(False)
        return F.struct(F.lit(kind).alias("kind"), digest.alias("child"), size.alias("size_bytes"), os.alias("platform_os"), has.alias("has_platform"))

    every = F.concat(
        F.array(edge("config", F.col("config_digest"), F.col("config_size"))),
        F.transform("layers", lambda x: edge("layer", x["digest"], x["size_bytes"])),
        F.transform("manifests", lambda x: edge("manifest", x["digest"], x["size_bytes"], x["platform"])),
    )
    return manifests.select("manifest_id", F.explode(every).alias("e")).select("manifest_id", "e.*").where(F.col("child").isNotNull())


def edge_table(manifests: DataFrame) -> DataFrame:
    """``references``, written once for all that walks them: the nested lists are read a single time."""
    return written(references(manifests), "edges")


def tag_manifests(tags: DataFrame, manifests: DataFrame, attestations: bool = True, edges: DataFrame | None = None) -> DataFrame:
    """(image, tag, manifest_id): every tag's manifest and, level by level, those below.

    Each manifest counts once for a tag however often it is listed, so shared ones are
    walked once and a cycle ends. ``attestations``: also walk such entries of an index.
    ``edges``: the references of ``manifests``, if they are at hand.
    """
    listed = (references(manifests) if edges is None else edges).where("kind = 'manifest'")
    if not attestations:
        listed = listed.where("not (has_platform and coalesce(platform_os, '') in ('', 'unknown'))")
    by_digest = splittable(newest_manifests(manifests.select("digest", "manifest_id", "stored_at")).select("digest", F.col("manifest_id").alias("child_id")))
    links = written(listed.select("manifest_id", F.col("child").alias("digest")).distinct().join(by_digest, "digest").select("manifest_id", "child_id").distinct(), "links")
    front = written(tags.select("image", "tag", "manifest_id"), "front")
    walked, below = front, None
    for _ in range(MAX_DEPTH):
        found = front.join(links, "manifest_id").select("image", "tag", F.col("child_id").alias("manifest_id")).distinct()
        front = written(found if below is None else found.join(below, ["image", "tag", "manifest_id"], "left_anti"), "front")
        if front.isEmpty():
            return walked
        walked, below = walked.unionByName(front), front if below is None else below.unionByName(front)
    raise RuntimeError(f"manifests nest deeper than {MAX_DEPTH}")


def tag_references(manifest: DataFrame) -> DataFrame:
    """(image, tag, kind, child, size_bytes): what each tag refers to, through indexes of any depth.

    Every distinct child manifest counts once for a tag; its configs, layers and
    manifests count at each occurrence.
    """
    manifests = plain_manifests(manifest)
    edges = edge_table(manifests)
    walked = tag_manifests(current_tags(manifest), manifests, edges=edges)
    return walked.join(edges, "manifest_id").drop("manifest_id")


def tag_sizes(manifest: DataFrame) -> DataFrame:
    """(image, tag, logical_bytes): config and layer occurrences of each tag; 0 without any."""
    sized = tag_references(manifest).where("kind <> 'manifest'").groupBy("image", "tag").agg(F.sum("size_bytes").alias("logical_bytes"))
    return current_tags(manifest).select("image", "tag").join(sized, ["image", "tag"], "left").select("image", "tag", F.coalesce("logical_bytes", F.lit(0)).alias("logical_bytes"))


def summary(manifest: DataFrame, object_listing: DataFrame) -> DataFrame:
    """One row: tags, images, logical bytes, stored blobs and chunks, their bytes, bytes saved."""
    sizes = tag_sizes(manifest).agg(F.count(F.lit(1)).alias("tags"), F.count_distinct("image").alias("images"), F.sum("logical_bytes").alias("logical_bytes"))
    stored = live_objects(object_listing).where(F.col("kind").isin("blobs", "chunks")).agg(F.count_if(F.col("kind") == "blobs").alias("blobs"), F.count_if(F.col("kind") == "chunks").alias("chunks"), F.sum("size_bytes").alias("stored_bytes"))
    both = sizes.unionByName(stored, allowMissingColumns=True)
    one = both.agg(*[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in both.columns])
    saved = F.greatest(F.col("logical_bytes") - F.col("stored_bytes"), F.lit(0))
    return one.withColumn("saved_bytes", saved).withColumn("saved_share", values.share(saved, F.col("logical_bytes")))


def by_storage_class(object_listing: DataFrame) -> DataFrame:
    """Objects and bytes per storage class with their share of all bytes."""
    grouped = live_objects(object_listing).where(F.col("kind").isin("blobs", "chunks")).groupBy("storage_class").agg(F.count(F.lit(1)).alias("objects"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"))
    total = F.sum("bytes").over(Window.partitionBy())  # a row for each class
    return grouped.withColumn("share", values.share(F.col("bytes"), total))


def _tag_layers(manifest: DataFrame, prefix: str) -> DataFrame:
    manifests = plain_manifests(manifest)
    edges = edge_table(manifests)
    walked = tag_manifests(current_tags(manifest).where(F.col("image").startswith(prefix)), manifests, attestations=False, edges=edges)
    layers = edges.where("kind = 'layer'").select("manifest_id", F.col("child").alias("digest"), "size_bytes")
    return walked.select(F.concat_ws(":", "image", "tag").alias("name"), "manifest_id").join(layers, "manifest_id").groupBy("digest", "name").agg(F.max("size_bytes").alias("size_bytes"))


def layer_tags(manifest: DataFrame, prefix: str = "") -> DataFrame:
    """(digest, name): every tag of every layer, one row each, so a layer in very many tags stays many rows."""
    return _tag_layers(manifest, prefix).select("digest", "name")


def layer_sharing(manifest: DataFrame, prefix: str = "") -> DataFrame:
    """(digest, size_bytes, n_tags, logical_bytes, first_tag, last_tag) of every layer.

    A layer counts once for a tag, at any depth; attestations of an index are skipped; of differing
    sizes the one of the first tag by name holds, within a tag the greatest.
    """
    shared = _tag_layers(manifest, prefix).groupBy("digest").agg(F.min_by("size_bytes", "name").alias("size_bytes"), F.count(F.lit(1)).alias("n_tags"), F.min("name").alias("first_tag"), F.max("name").alias("last_tag"))
    return shared.withColumn("logical_bytes", F.col("size_bytes") * F.col("n_tags"))


def layer_sharing_summary(sharing: DataFrame) -> DataFrame:
    total = sharing.agg(F.count(F.lit(1)).alias("layers"), F.sum("size_bytes").alias("stored_bytes"), F.sum("logical_bytes").alias("logical_bytes"))
    return total.withColumn("saved_share", values.share(F.col("logical_bytes") - F.col("stored_bytes"), F.col("logical_bytes")))


def manifest_totals(manifests: DataFrame) -> DataFrame:
    """Layers and layer bytes of each manifest row; the config is not counted."""
    total = F.aggregate("layers", F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x["size_bytes"], F.lit(0)))
    return manifests.select("manifest_id", F.size("layers").cast("bigint").alias("n_layers"), total.alias("layer_bytes"), names.is_index(F.col("media_type"), F.col("schema_version"), F.col("manifests")).alias("is_index"))


def pick_platform(manifests: DataFrame, wanted: str) -> DataFrame:
    """(manifest_id, pos, digest) of the first index entry that matches a platform.

    The choice is inside one row, so no shuffle is made.
    """
    found = F.filter(F.transform("manifests", lambda x, i: F.struct(i.alias("pos"), x["digest"].alias("digest"), x["platform"].alias("platform"))), lambda x: names.platform_matches(x["platform"], wanted))
    return manifests.select("manifest_id", F.get(found, F.lit(0)).alias("m")).where(F.col("m").isNotNull()).select("manifest_id", "m.pos", "m.digest")


def platforms(manifests: DataFrame) -> DataFrame:
    """(manifest_id, pos, platform, attestation) of every index entry."""
    rows = manifests.select("manifest_id", F.posexplode("manifests").alias("pos", "x")).where(F.col("x").isNotNull())
    return rows.select("manifest_id", "pos", names.platform_text(F.col("x.platform")).alias("platform"), names.is_attestation(F.col("x.platform")).alias("attestation"))


def platform_names(manifests: DataFrame) -> DataFrame:
    """(manifest_id, platforms): names of an index's platforms, sorted, attestations left out; none for other rows."""
    runs = F.filter(F.transform("manifests", lambda x: x["platform"]), lambda p: ~names.is_attestation(p))
    return manifests.where(F.size("manifests") > 0).select("manifest_id", F.array_sort(F.transform(runs, names.platform_text)).alias("platforms"))


def lookup_digest(manifests: DataFrame, wanted: DataFrame) -> DataFrame:
    """Answer for each digest of ``wanted``: its manifest row, else the index that lists it.

    (digest, found, manifest_id): found is manifest, index or none; the smallest id holds.
    """
    direct = manifests.where(F.col("digest").isNotNull()).select("digest", F.lit(0).alias("rank"), "manifest_id")
    listed = manifests.select(F.explode("manifests.digest").alias("digest"), F.lit(1).alias("rank"), "manifest_id").where(F.col("digest").isNotNull())
    asked = wanted.select("digest").distinct()
    best = direct.unionByName(listed).join(splittable(asked), "digest", "left_semi").groupBy("digest").agg(F.min(F.struct("rank", "manifest_id")).alias("m"))
    found = F.when(F.col("m.rank") == 0, "manifest").when(F.col("m.rank") == 1, "index").otherwise("none")
    return asked.join(best, "digest", "left").select("digest", found.alias("found"), "m.manifest_id")
