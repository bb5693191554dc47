"""Queries of the store's own operators over the data tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lamella.functions import digests, names, paths, values
from lamella.operators import cache, catalog, chunking, overlay, policy, reach, recipes, signing, temporal
from lamella.plans.general import COUNTED, plain_sql
from lamella.plans.tables import table

#: Fixed clock of the queries that compare ages.
NOW = "2026-01-01 00:00:00"


def _manifests(spark: SparkSession, d: str) -> DataFrame:
    return catalog.plain_manifests(table(spark, d, "manifest"))


def list_images(spark: SparkSession, d: str) -> DataFrame:
    return catalog.list_images(table(spark, d, "manifest")).withColumn("tags", F.array_join("tags", ","))


def inspect_layers(spark: SparkSession, d: str) -> DataFrame:
    return catalog.layer_rows(_manifests(spark, d)).select("manifest_id", F.col("pos").cast("bigint").alias("pos"), "digest", "size_bytes", names_media(F.col("media_type")).alias("media_type"))


def names_media(c):
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(names.OCI_MANIFEST))


def manifest_totals(spark: SparkSession, d: str) -> DataFrame:
    return catalog.manifest_totals(_manifests(spark, d))


def tag_logical_size(spark: SparkSession, d: str) -> DataFrame:
    return catalog.tag_sizes(table(spark, d, "manifest"))


def stats_summary(spark: SparkSession, d: str) -> DataFrame:
    return catalog.summary(table(spark, d, "manifest"), table(spark, d, "object_listing"))


def stats_by_class(spark: SparkSession, d: str) -> DataFrame:
    return catalog.by_storage_class(table(spark, d, "object_listing"))


def layer_sharing(spark: SparkSession, d: str) -> DataFrame:
    return catalog.layer_sharing(table(spark, d, "manifest"))


def layer_tags(spark: SparkSession, d: str) -> DataFrame:
    return catalog.layer_tags(table(spark, d, "manifest"))


def layer_sharing_summary(spark: SparkSession, d: str) -> DataFrame:
    return catalog.layer_sharing_summary(catalog.layer_sharing(table(spark, d, "manifest")))


def platform_pick(spark: SparkSession, d: str) -> DataFrame:
    return catalog.pick_platform(_manifests(spark, d), "linux/amd64").withColumn("pos", F.col("pos").cast("bigint"))


def index_platforms(spark: SparkSession, d: str) -> DataFrame:
    return catalog.platforms(_manifests(spark, d)).withColumn("pos", F.col("pos").cast("bigint"))


def platform_names(spark: SparkSession, d: str) -> DataFrame:
    return catalog.platform_names(_manifests(spark, d)).withColumn("platforms", F.array_join("platforms", ","))


def manifest_lookup(spark: SparkSession, d: str) -> DataFrame:
    pushed = table(spark, d, "history").select(digests.plain(F.col("digest")).alias("digest")).where("digest is not null")
    return catalog.lookup_digest(_manifests(spark, d), pushed)


def reachable_refs(spark: SparkSession, d: str) -> DataFrame:
    return reach.reachable(table(spark, d, "manifest"), table(spark, d, "recipe"))


def gc_candidates(spark: SparkSession, d: str) -> DataFrame:
    return reach.garbage(table(spark, d, "object_listing"), reachable_refs(spark, d), NOW)


def gc_summary(spark: SparkSession, d: str) -> DataFrame:
    return reach.garbage_summary(gc_candidates(spark, d), table(spark, d, "object_listing"))


def doctor_missing(spark: SparkSession, d: str) -> DataFrame:
    return reach.missing(table(spark, d, "manifest"), table(spark, d, "object_listing"))


def doctor_missing_list(spark: SparkSession, d: str) -> DataFrame:
    return reach.missing_references(table(spark, d, "manifest"), table(spark, d, "object_listing"))


def doctor_missing_chunks(spark: SparkSession, d: str) -> DataFrame:
    return reach.missing_chunks(table(spark, d, "recipe"), table(spark, d, "object_listing"))


def doctor_orphans(spark: SparkSession, d: str) -> DataFrame:
    return reach.orphans(table(spark, d, "manifest"), table(spark, d, "object_listing"))


def resolve_layers(spark: SparkSession, d: str) -> DataFrame:
    return reach.resolved_layers(_manifests(spark, d), table(spark, d, "object_listing"))


def copy_plan(spark: SparkSession, d: str) -> DataFrame:
    return reach.copy_plan(table(spark, d, "manifest"), "harbor/", "ledger/")


def copy_summary(spark: SparkSession, d: str) -> DataFrame:
    return reach.copy_summary(copy_plan(spark, d))


def retarget_layers(spark: SparkSession, d: str) -> DataFrame:
    return reach.retargeted_layers(_manifests(spark, d), table(spark, d, "recipe")).withColumn("pos", F.col("pos").cast("bigint"))


def _policies(spark: SparkSession, d: str) -> DataFrame:
    return policy.effective(table(spark, d, "history").select("image"), table(spark, d, "lifecycle_rule"))


def effective_policy(spark: SparkSession, d: str) -> DataFrame:
    return _policies(spark, d).select("image", "pattern", "keep_last", "max_age", F.array_join("keep_tags", ",").alias("keep_tags"), "immutable")


def policy_sources(spark: SparkSession, d: str) -> DataFrame:
    """Which pattern gave each field of each image's configuration."""
    return _policies(spark, d).select("image", "keep_last_from", "max_age_from", "keep_tags_from", "immutable_from")


#: Patterns with classes, and what they mean in SQL.
GLOBS = {"[a-g]*/*": "^[a-g][^/]*/[^/]*$", "[^a-g]*/*": "^[^a-g][^/]*/[^/]*$", "harbor/[pqs]*-[0-9][0-9]": "^harbor/[pqs][^/]*-[0-9][0-9]$", r"beacon/\[a]*": r"^beacon/\[a\][^/]*$", "?e*/[b-]*": None, "[]a]*": None, "*/*/[a-c]*": "^[^/]*/[^/]*/[a-c][^/]*$", "[": None}


def glob_matches(spark: SparkSession, d: str) -> DataFrame:
    """Images that each of a few patterns with classes matches; malformed patterns match none."""
    globs = spark.createDataFrame([(g,) for g in GLOBS], "pattern string").withColumn("regex", names.glob_pattern(F.col("pattern")))
    images = table(spark, d, "history").select("image").where("image is not null").distinct()
    return images.join(F.broadcast(globs), F.regexp_like("image", F.col("regex"))).select("image", "pattern")


def retention_ranks(spark: SparkSession, d: str) -> DataFrame:
    pushes = temporal.counted_pushes(table(spark, d, "history"))
    tags = pushes.groupBy("image", "tag").agg(F.max("at").alias("at"))
    return policy.retention_ranks(tags, _policies(spark, d), NOW)


def retention_summary(spark: SparkSession, d: str) -> DataFrame:
    return policy.retention_summary(retention_ranks(spark, d), _policies(spark, d))


def recipe_offsets(spark: SparkSession, d: str) -> DataFrame:
    return recipes.chunk_offsets(table(spark, d, "recipe"))


def recipe_consistency(spark: SparkSession, d: str) -> DataFrame:
    return recipes.consistency(table(spark, d, "recipe"))


def store_delta(spark: SparkSession, d: str) -> DataFrame:
    return recipes.store_delta(table(spark, d, "recipe"), table(spark, d, "object_listing")).withColumn("deduplicated", F.round("deduplicated", 9))


def _extents(spark: SparkSession, d: str) -> DataFrame:
    """Recipes with a file from a third of each layer on, of 5 MB."""
    sized = table(spark, d, "recipe").where("size_bytes is not null")
    return sized.select("recipe_id", "chunks", F.lit("third").alias("file"), F.expr("size_bytes div 3").alias("offset"), F.lit(5_000_000).cast("bigint").alias("length"))


def extract_overlap(spark: SparkSession, d: str) -> DataFrame:
    return recipes.overlapping(_extents(spark, d))


def chunks_needed(spark: SparkSession, d: str) -> DataFrame:
    return recipes.chunks_needed(_extents(spark, d)).withColumn("text", recipes.savings_text(F.col("needed"), F.col("total")))


def layer_storage(spark: SparkSession, d: str) -> DataFrame:
    """How a chunked bucket keeps each layer, and whether an extent of 5 MB at a third of it lies inside."""
    rows = table(spark, d, "recipe")
    return rows.select("recipe_id", recipes.kept_as(F.col("size_bytes"), F.lit(True), chunking.FORMAT_1.smallest).alias("kept_as"), recipes.within_layer(F.expr("size_bytes div 3"), F.lit(5_000_000), F.col("size_bytes")).alias("inside"))


def multiset_overlap(spark: SparkSession, d: str) -> DataFrame:
    layers = catalog.layer_rows(_manifests(spark, d))
    return recipes.shared_multiset(layers, table(spark, d, "recipe").select(digests.plain(F.col("compressed_digest")).alias("digest")))


def content_digests(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where(F.col("text").isNotNull())
    return docs.groupBy(digests.content_digest(F.col("text")).alias("digest")).agg(F.count(F.lit(1)).alias("times"), F.max(F.octet_length("text")).cast("bigint").alias("bytes"))


def chunk_invariants(spark: SparkSession, d: str) -> DataFrame:
    """The small chunk format over every text: chunks join without gap and give its bytes."""
    split = chunking.split(table(spark, d, "documents"), "doc_id", "text", chunking.SMALL)
    return chunking.reassembled(split).drop("n_chunks")


def chunk_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of all texts that occur more than once."""
    split = chunking.split(table(spark, d, "documents"), "doc_id", "text", chunking.SMALL)
    return split.groupBy("digest").agg(F.count(F.lit(1)).alias("times"), F.max("size").alias("size")).where("times > 1")


def overlay_top(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").where("user_id is not null and props is not null")
    return overlay.top_entries(events.select(F.col("user_id").alias("image"), F.col("props").alias("path"), F.col("event_id").alias("layer_pos"), F.coalesce(F.col("event_type") == "error", F.lit(False)).alias("deleted")))


def overlay_view(spark: SparkSession, d: str) -> DataFrame:
    """Tags as files of an image, days of the history as its layers; a removed tag is a deletion marker."""
    pushes = temporal.counted_pushes(table(spark, d, "history"))
    entries = pushes.select("image", F.unix_date(F.col("at").cast("date")).alias("layer_pos"), F.concat(F.lit("tags/"), F.when(F.col("removed"), ".wh.").otherwise(""), "tag").alias("path"), F.lit(None).cast("string").alias("link"))
    return overlay.view(entries).select("image", "path", F.col("layer_pos").cast("bigint").alias("layer_pos"))


def link_chase(spark: SparkSession, d: str) -> DataFrame:
    """Current tags as links to the tag before them, by name, that has the same digest; the first is a file."""
    tags = catalog.current_tags(table(spark, d, "manifest")).where("digest is not null")
    before = Window.partitionBy("digest").orderBy("image", "tag")
    name = F.concat_ws(":", "image", "tag")
    visible = tags.select(F.lit("store").alias("image"), name.alias("path"), F.concat(F.lit("/"), F.lag(name).over(before)).alias("link"))
    return overlay.follow_links(visible, visible.select("image", "path")).select("path", "target", F.col("hops").cast("bigint").alias("hops"), "state")


def path_normalise(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "object_listing").select("listing_id", paths.normal_path(F.col("object_key")).alias("path"), digests.object_class(F.col("object_key")).alias("kind"), values.human_bytes(F.col("size_bytes")).alias("size"))


def digest_forms(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "history")
    return h.select("history_id", digests.plain(F.col("digest")).alias("plain"), digests.strict(F.col("digest")).alias("strict"), digests.short(digests.plain(F.col("digest"))).alias("short"))


def name_checks(spark: SparkSession, d: str) -> DataFrame:
    pairs = table(spark, d, "history").select("image", "tag").distinct()
    return pairs.select("image", "tag", names.valid_name(F.col("image")).alias("name_ok"), names.valid_reference(F.col("tag")).alias("tag_ok"))


def verify_ladder(spark: SparkSession, d: str) -> DataFrame:
    """Current manifests against the newest push as the signed record of each tag.

    Pushes without a size stand for records of an older schema; records of tags that do
    not begin with v are not encoded, those of images with a folder lab not signed well.
    """
    tags = catalog.current_tags(table(spark, d, "manifest")).select("image", "tag", "digest")
    pushes = temporal.counted_pushes(table(spark, d, "history"), {"digest": digests.plain(F.col("digest")), "size": F.col("size_bytes")})
    newest = pushes.groupBy("image", "tag").agg(F.max_by(F.struct("digest", "size"), "at").alias("n")).select("image", "tag", "n.*")
    signature = F.when(~F.col("tag").startswith("v"), "***").when(F.col("image").contains("/lab/"), "YmFk").otherwise("c2ln")
    signed = newest.select("image", "tag", F.when(F.col("size").isNull(), 1).otherwise(signing.SCHEMA_VERSION).alias("schema_version"), "digest", F.lit("k").alias("key_id"), signature.alias("signature"))
    return signing.verify(tags, signed, "store", lambda payload, raw, key: raw == F.lit(b"sig"))


def cache_fifo(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "history").where("digest is not null and tag is not null")
    return cache.held(log, ["image"], "tag", "snapshot_at", "history_id", 3, 365 * 86400, F.lit(NOW).cast("timestamp")).select("image", "tag", "seq")


def class_counts(spark: SparkSession, d: str) -> DataFrame:
    return catalog.live_objects(table(spark, d, "object_listing")).groupBy("kind").agg(F.count(F.lit(1)).alias("objects"), F.sum("size_bytes").alias("bytes"))


def layer_reference_counts(spark: SparkSession, d: str) -> DataFrame:
    from lamella.streaming.refcounts import layer_references

    return layer_references(table(spark, d, "manifest")).withColumn("period", F.date_format("period", "yyyy-MM-dd"))


# -- SQL ----------------------------------------------------------------------------

_CURRENT = f"""current AS (SELECT image, tag, manifest_id, {plain_sql('digest')} AS digest FROM manifest WHERE image IS NOT NULL AND tag IS NOT NULL
 QUALIFY row_number() OVER (PARTITION BY image, tag ORDER BY stored_at DESC NULLS LAST, manifest_id DESC) = 1)"""
_EDGES = f"""edges AS (
 SELECT manifest_id, 'config' AS kind, {plain_sql('config.digest')} AS child, config.size_bytes AS size_bytes, NULL AS os, false AS has FROM manifest
 UNION ALL SELECT manifest_id, 'layer', {plain_sql('x.digest')}, x.size_bytes, NULL, false FROM (SELECT manifest_id, unnest(layers) AS x FROM manifest)
 UNION ALL SELECT manifest_id, 'manifest', {plain_sql('x.digest')}, x.size_bytes, x.platform.os, x.platform IS NOT NULL FROM (SELECT manifest_id, unnest(manifests) AS x FROM manifest)),
named AS (SELECT digest, manifest_id FROM (SELECT {plain_sql('digest')} AS digest, manifest_id, stored_at FROM manifest) WHERE digest IS NOT NULL
 QUALIFY row_number() OVER (PARTITION BY digest ORDER BY stored_at DESC NULLS LAST, manifest_id DESC) = 1)"""
_REFS = f"""{_CURRENT}, {_EDGES},
own AS (SELECT c.image, c.tag, e.kind, e.child, e.size_bytes FROM current c JOIN edges e USING (manifest_id) WHERE e.child IS NOT NULL),
refs AS (SELECT * FROM own UNION ALL
 SELECT o.image, o.tag, e.kind, e.child, e.size_bytes FROM (SELECT DISTINCT image, tag, child FROM own WHERE kind = 'manifest') o JOIN named n ON n.digest = o.child JOIN edges e ON e.manifest_id = n.manifest_id WHERE e.kind <> 'manifest' AND e.child IS NOT NULL)"""
_LIVE = """live AS (SELECT regexp_extract(object_key, '^/?([^/]+)/', 1) AS kind, lower(regexp_extract(object_key, '/sha256/([0-9a-fA-F]{64})$', 1)) AS digest, size_bytes, last_modified,
 CASE WHEN coalesce(trim(storage_class), '') = '' THEN 'STANDARD' ELSE upper(trim(storage_class)) END AS storage_class
 FROM object_listing WHERE deleted_at IS NULL AND regexp_matches(object_key, '^/?[^/]+/sha256/[0-9a-fA-F]{64}$')
 QUALIFY row_number() OVER (PARTITION BY kind, digest ORDER BY last_modified DESC NULLS LAST, listing_id DESC) = 1)"""
_SIZES = """sizes AS (SELECT c.image, c.tag, coalesce(s.logical_bytes, 0) AS logical_bytes FROM current c LEFT JOIN
 (SELECT image, tag, CAST(sum(size_bytes) AS BIGINT) AS logical_bytes FROM refs WHERE kind <> 'manifest' GROUP BY 1, 2) s ON s.image = c.image AND s.tag = c.tag)"""
_SHARING = f"""{_CURRENT}, {_EDGES},
held AS (SELECT image || ':' || tag AS name, manifest_id FROM current UNION ALL
 SELECT image || ':' || tag, n.manifest_id FROM (SELECT DISTINCT c.image, c.tag, e.child FROM current c JOIN edges e USING (manifest_id)
  WHERE e.kind = 'manifest' AND e.child IS NOT NULL AND NOT (e.has AND coalesce(e.os, '') IN ('', 'unknown'))) x JOIN named n ON n.digest = x.child),
per AS (SELECT e.child AS digest, h.name, max(e.size_bytes) AS size_bytes FROM held h JOIN edges e USING (manifest_id) WHERE e.kind = 'layer' AND e.child IS NOT NULL GROUP BY 1, 2),
sharing AS (SELECT digest, first(size_bytes ORDER BY name) AS size_bytes, count(*) AS n_tags, min(name) AS first_tag, max(name) AS last_tag FROM per GROUP BY 1)"""
_CHUNKS = f"""chunked AS (SELECT DISTINCT {plain_sql('compressed_digest')} AS layer, {plain_sql('c')} AS child FROM (SELECT compressed_digest, unnest(list_transform(chunks, lambda x: x.digest)) AS c FROM recipe))"""
_REACH = f"""WITH RECURSIVE {_CURRENT}, {_EDGES}, {_CHUNKS},
walk AS (SELECT DISTINCT manifest_id FROM current UNION
 SELECT n.manifest_id FROM walk w JOIN edges e USING (manifest_id) JOIN named n ON n.digest = e.child WHERE e.kind = 'manifest'),
direct AS (SELECT e.kind, e.child AS digest FROM walk JOIN edges e USING (manifest_id) WHERE e.child IS NOT NULL),
reached AS (SELECT 'manifest' AS kind, digest FROM (SELECT manifest_id, {plain_sql('digest')} AS digest FROM manifest) JOIN walk USING (manifest_id) WHERE digest IS NOT NULL
 UNION SELECT kind, digest FROM direct
 UNION SELECT 'chunk', c.child FROM direct d JOIN chunked c ON c.layer = d.digest WHERE d.kind = 'layer' AND c.child IS NOT NULL)"""
_DEAD = f"""{_REACH}, {_LIVE},
dead AS (SELECT kind, digest, size_bytes, coalesce(last_modified <= TIMESTAMP '{NOW}' - INTERVAL 1 HOUR, false) AS old_enough FROM live l
 WHERE (l.kind IN ('blobs', 'recipes', 'indexes') AND NOT EXISTS (SELECT 1 FROM reached r WHERE r.kind <> 'chunk' AND r.digest = l.digest))
 OR (l.kind = 'chunks' AND NOT EXISTS (SELECT 1 FROM reached r WHERE r.kind = 'chunk' AND r.digest = l.digest)))"""
_COPY = f"""WITH {_REFS}, plan AS (SELECT child AS digest, max(size_bytes) AS size_bytes, CASE WHEN child IN (SELECT child FROM refs WHERE starts_with(image, 'ledger/')) THEN 'skip' ELSE 'copy' END AS action
FROM refs WHERE starts_with(image, 'harbor/') GROUP BY child)"""
_POLICY = """base AS (SELECT keep_last, max_age, keep_tags, immutable FROM lifecycle_rule WHERE image_pattern = 'default'),
rules AS (SELECT *, '^' || replace(replace(regexp_replace(image_pattern, '([.+^$(){}|\\[\\]\\\\])', '\\\\\\1', 'g'), '*', '[^/]*'), '?', '[^/]') || '$' AS re FROM lifecycle_rule WHERE image_pattern <> 'default'),
best AS (SELECT i.image, r.* EXCLUDE (re) FROM (SELECT DISTINCT image FROM history WHERE image IS NOT NULL) i LEFT JOIN rules r ON regexp_matches(i.image, r.re)
 QUALIFY row_number() OVER (PARTITION BY i.image ORDER BY regexp_matches(r.image_pattern, '[*?]'), length(r.image_pattern) DESC, r.image_pattern) = 1),
policies AS (SELECT b.image, coalesce(b.image_pattern, 'default') AS pattern, coalesce(nullif(b.keep_last, 0), d.keep_last) AS keep_last, coalesce(nullif(b.max_age, ''), d.max_age) AS max_age,
 CASE WHEN len(b.keep_tags) > 0 THEN b.keep_tags ELSE CASE WHEN len(d.keep_tags) > 0 THEN d.keep_tags END END AS keep_tags, coalesce(b.immutable, d.immutable) AS immutable FROM best b LEFT JOIN base d ON true)"""
_RANKS = f"""WITH counted AS ({COUNTED}), {_POLICY},
tags AS (SELECT image, tag, max(pushed_at) AS last_at FROM counted GROUP BY 1, 2),
known AS (SELECT t.*, p.keep_last, coalesce(list_contains(p.keep_tags, t.tag), false) AS protected,
 CASE WHEN p.max_age LIKE '%d' THEN CAST(replace(p.max_age, 'd', '') AS BIGINT) * 86400 WHEN p.max_age LIKE '%h' THEN CAST(replace(p.max_age, 'h', '') AS BIGINT) * 3600 END AS secs FROM tags t JOIN policies p USING (image)),
ranked AS (SELECT *, CASE WHEN NOT protected THEN row_number() OVER (PARTITION BY image, protected ORDER BY last_at DESC, tag) END AS place FROM known),
ranks AS (SELECT image, tag, protected, place, coalesce(place > coalesce(keep_last, 0), false) AS beyond, CASE WHEN coalesce(secs, 0) > 0 THEN epoch(TIMESTAMP '{NOW}') - epoch(last_at) > secs ELSE true END AS aged FROM ranked)"""
_OFFSETS = f"""flat AS (SELECT recipe_id, unnest(chunks) AS c, unnest(range(len(chunks))) AS seq FROM recipe),
offsets AS (SELECT recipe_id, seq, {plain_sql('c.digest')} AS digest, coalesce(c.size_bytes, 0) AS size_bytes,
 CAST(coalesce(sum(coalesce(c.size_bytes, 0)) OVER (PARTITION BY recipe_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM flat)"""
_OVERLAP = f"""WITH {_OFFSETS},
extents AS (SELECT recipe_id, 'third' AS file, size_bytes // 3 AS off, 5000000 AS len FROM recipe WHERE size_bytes IS NOT NULL),
over AS (SELECT o.recipe_id, file, seq, digest, greatest(off - start, 0) AS take_from, least(off + len - start, size_bytes) AS take_to
 FROM offsets o JOIN extents e USING (recipe_id) WHERE start < off + len AND start + size_bytes > off)"""

QUERIES = {f.__name__: f for f in (
    layer_tags, platform_names, doctor_missing_list, doctor_missing_chunks, copy_summary, policy_sources, glob_matches, retention_summary, layer_storage, overlay_view, link_chase,
    list_images, inspect_layers, manifest_totals, tag_logical_size, stats_summary, stats_by_class, layer_sharing, layer_sharing_summary, platform_pick, index_platforms, manifest_lookup,
    reachable_refs, gc_candidates, gc_summary, doctor_missing, doctor_orphans, resolve_layers, copy_plan, retarget_layers, effective_policy, retention_ranks, recipe_offsets, recipe_consistency,
    store_delta, extract_overlap, chunks_needed, multiset_overlap, content_digests, chunk_invariants, chunk_dedup, overlay_top, path_normalise, digest_forms, name_checks, verify_ladder, cache_fifo, class_counts, layer_reference_counts,
)}

SQL = {
    "list_images": "SELECT image, count(DISTINCT tag) AS n_tags, string_agg(DISTINCT tag, ',' ORDER BY tag) AS tags FROM manifest WHERE image IS NOT NULL AND tag IS NOT NULL GROUP BY image",
    "inspect_layers": f"SELECT manifest_id, pos, {plain_sql('x.digest')} AS digest, x.size_bytes AS size_bytes, coalesce(nullif(x.media_type, ''), '{names.OCI_MANIFEST}') AS media_type FROM (SELECT manifest_id, unnest(layers) AS x, unnest(range(len(layers))) AS pos FROM manifest)",
    "manifest_totals": f"""SELECT manifest_id, coalesce(len(layers), 0) AS n_layers, CAST(coalesce(list_sum(list_transform(layers, lambda x: coalesce(x.size_bytes, 0))), 0) AS BIGINT) AS layer_bytes,
 coalesce(media_type IN ('{names.OCI_INDEX}', '{names.DOCKER_LIST}'), false) OR (coalesce(media_type, '') = '' AND coalesce(len(manifests), 0) > 0 AND coalesce(schema_version = 2, false) AND manifests[1].platform IS NOT NULL) AS is_index FROM manifest""",
    "tag_logical_size": f"WITH {_REFS}, {_SIZES} SELECT * FROM sizes",
    "stats_summary": f"""WITH {_REFS}, {_SIZES}, {_LIVE},
s AS (SELECT count(*) AS tags, count(DISTINCT image) AS images, CAST(sum(logical_bytes) AS BIGINT) AS logical_bytes FROM sizes),
o AS (SELECT count(*) FILTER (kind = 'blobs') AS blobs, count(*) FILTER (kind = 'chunks') AS chunks, CAST(sum(size_bytes) AS BIGINT) AS stored_bytes FROM live WHERE kind IN ('blobs', 'chunks'))
SELECT *, greatest(logical_bytes - stored_bytes, 0) AS saved_bytes, CASE WHEN logical_bytes > 0 THEN greatest(logical_bytes - stored_bytes, 0) / logical_bytes ELSE 0 END AS saved_share FROM s, o""",
    "stats_by_class": f"""WITH {_LIVE}, g AS (SELECT storage_class, count(*) AS objects, CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS bytes FROM live WHERE kind IN ('blobs', 'chunks') GROUP BY 1)
SELECT *, CASE WHEN sum(bytes) OVER () > 0 THEN bytes / CAST(sum(bytes) OVER () AS BIGINT) ELSE 0 END AS share FROM g""",
    "layer_sharing": f"WITH {_SHARING} SELECT *, size_bytes * n_tags AS logical_bytes FROM sharing",
    "layer_tags": f"WITH {_SHARING} SELECT digest, name FROM per",
    "layer_sharing_summary": f"""WITH {_SHARING}, t AS (SELECT count(*) AS layers, CAST(sum(size_bytes) AS BIGINT) AS stored_bytes, CAST(sum(size_bytes * n_tags) AS BIGINT) AS logical_bytes FROM sharing)
SELECT *, CASE WHEN logical_bytes > 0 THEN (logical_bytes - stored_bytes) / logical_bytes ELSE 0 END AS saved_share FROM t""",
    "platform_pick": f"""SELECT manifest_id, pos, {plain_sql('x.digest')} AS digest FROM (SELECT manifest_id, unnest(manifests) AS x, unnest(range(len(manifests))) AS pos FROM manifest)
WHERE x.platform.os = 'linux' AND x.platform.architecture = 'amd64' QUALIFY row_number() OVER (PARTITION BY manifest_id ORDER BY pos) = 1""",
    "index_platforms": """SELECT manifest_id, pos, CASE WHEN coalesce(x.platform.os, '') IN ('', 'unknown') THEN '(attestation)' ELSE x.platform.os || '/' || coalesce(x.platform.architecture, '') || CASE WHEN coalesce(x.platform.variant, '') <> '' THEN '/' || x.platform.variant ELSE '' END END AS platform,
 coalesce(x.platform.os, '') IN ('', 'unknown') AS attestation FROM (SELECT manifest_id, unnest(manifests) AS x, unnest(range(len(manifests))) AS pos FROM manifest)""",
    "platform_names": """SELECT manifest_id, coalesce(array_to_string(list_sort(list_transform(list_filter(manifests, lambda x: coalesce(x.platform.os, '') NOT IN ('', 'unknown')),
 lambda x: x.platform.os || '/' || coalesce(x.platform.architecture, '') || CASE WHEN coalesce(x.platform.variant, '') <> '' THEN '/' || x.platform.variant ELSE '' END)), ','), '') AS platforms FROM manifest WHERE len(manifests) > 0""",
    "manifest_lookup": f"""WITH {_EDGES}, asked AS (SELECT DISTINCT {plain_sql('digest')} AS digest FROM history),
ways AS (SELECT {plain_sql('digest')} AS digest, 0 AS rank, manifest_id FROM manifest UNION ALL SELECT child, 1, manifest_id FROM edges WHERE kind = 'manifest'),
best AS (SELECT digest, min(rank) AS rank, first(manifest_id ORDER BY rank, manifest_id) AS manifest_id FROM ways WHERE digest IS NOT NULL GROUP BY 1)
SELECT a.digest, CASE rank WHEN 0 THEN 'manifest' WHEN 1 THEN 'index' ELSE 'none' END AS found, manifest_id FROM asked a LEFT JOIN best b ON b.digest = a.digest WHERE a.digest IS NOT NULL""",
    "reachable_refs": f"{_REACH} SELECT * FROM reached",
    "gc_candidates": f"{_DEAD} SELECT * FROM dead",
    "gc_summary": f"{_DEAD} SELECT kind, count(*) FILTER (old_enough) AS deletable, CAST(coalesce(sum(size_bytes) FILTER (old_enough), 0) AS BIGINT) AS deletable_bytes, count(*) FILTER (NOT old_enough) AS too_young, any_value(scanned) AS scanned FROM (SELECT l.kind, l.scanned, d.old_enough, d.size_bytes FROM (SELECT kind, count(*) AS scanned FROM live WHERE kind IN ('blobs', 'recipes', 'indexes', 'chunks') GROUP BY 1) l LEFT JOIN dead d USING (kind)) GROUP BY kind",
    "doctor_missing": f"""WITH {_REFS}, {_LIVE} SELECT image, tag, count(DISTINCT child) AS n_missing, min(child) AS first_missing FROM refs
WHERE NOT EXISTS (SELECT 1 FROM live WHERE live.digest = refs.child AND live.kind IN ('blobs', 'recipes')) GROUP BY 1, 2""",
    "doctor_missing_list": f"WITH {_REFS}, {_LIVE} SELECT DISTINCT image, tag, child AS digest FROM refs WHERE NOT EXISTS (SELECT 1 FROM live WHERE live.digest = refs.child AND live.kind IN ('blobs', 'recipes'))",
    "doctor_missing_chunks": f"WITH {_CHUNKS}, {_LIVE} SELECT layer, child AS digest FROM chunked WHERE child IS NOT NULL AND layer IN (SELECT digest FROM live WHERE kind = 'recipes') AND child NOT IN (SELECT digest FROM live WHERE kind = 'chunks')",
    "doctor_orphans": f"""WITH {_REFS}, {_LIVE} SELECT kind, digest, size_bytes FROM live WHERE kind IN ('blobs', 'recipes') AND NOT EXISTS (SELECT 1 FROM refs WHERE refs.child = live.digest) AND NOT EXISTS (SELECT 1 FROM current WHERE current.digest = live.digest)""",
    "resolve_layers": f"""WITH {_EDGES}, {_LIVE}, held AS (SELECT digest, min(kind) AS kind FROM live WHERE kind IN ('blobs', 'recipes') GROUP BY 1)
SELECT DISTINCT e.child AS digest, CASE h.kind WHEN 'recipes' THEN 'recipe' WHEN 'blobs' THEN 'blob' ELSE 'missing' END AS held_as FROM edges e LEFT JOIN held h ON h.digest = e.child WHERE e.kind = 'layer' AND e.child IS NOT NULL""",
    "copy_plan": f"{_COPY} SELECT * FROM plan",
    "copy_summary": f"{_COPY} SELECT action, count(*) AS objects, CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS bytes FROM plan GROUP BY 1",
    "retarget_layers": f"""WITH r AS (SELECT layer, first(packed ORDER BY recipe_id) AS packed, first(compressed_size ORDER BY recipe_id) AS compressed_size FROM
 (SELECT {plain_sql('layer')} AS layer, {plain_sql('compressed_digest')} AS packed, compressed_size, recipe_id FROM recipe) WHERE layer IS NOT NULL AND packed IS NOT NULL GROUP BY 1),
l AS (SELECT manifest_id, pos, {plain_sql('x.digest')} AS digest, x.size_bytes AS size_bytes, x.media_type AS media_type FROM (SELECT manifest_id, unnest(layers) AS x, unnest(range(len(layers))) AS pos FROM manifest))
SELECT manifest_id, pos, coalesce(r.packed, l.digest) AS digest, CASE WHEN r.layer IS NOT NULL THEN r.compressed_size ELSE l.size_bytes END AS size_bytes, CASE WHEN r.layer IS NOT NULL THEN '{names.ZSTD_LAYER}' ELSE l.media_type END AS media_type, r.layer IS NOT NULL AS retargeted FROM l LEFT JOIN r ON r.layer = l.digest""",
    "effective_policy": f"WITH {_POLICY} SELECT image, pattern, keep_last, max_age, array_to_string(keep_tags, ',') AS keep_tags, immutable FROM policies",
    "retention_ranks": f"{_RANKS} SELECT * FROM ranks",
    "retention_summary": f"""{_RANKS}, s AS (SELECT image, CASE WHEN coalesce(immutable, false) THEN 'immutable' WHEN keep_last IS NULL AND max_age IS NULL AND keep_tags IS NULL THEN 'no rules' ELSE 'evaluated' END AS state, keep_last IS NOT NULL OR max_age IS NOT NULL AS deletes FROM policies)
SELECT image, any_value(state) AS state, count(*) FILTER (state = 'evaluated') AS evaluated, count(*) FILTER (state = 'evaluated' AND deletes AND beyond AND aged) AS deleted FROM ranks JOIN s USING (image) GROUP BY image""",
    "policy_sources": f"""WITH {_POLICY} SELECT b.image,
 CASE WHEN nullif(b.keep_last, 0) IS NOT NULL THEN b.image_pattern WHEN nullif(d.keep_last, 0) IS NOT NULL THEN 'default' END AS keep_last_from,
 CASE WHEN nullif(b.max_age, '') IS NOT NULL THEN b.image_pattern WHEN nullif(d.max_age, '') IS NOT NULL THEN 'default' END AS max_age_from,
 CASE WHEN len(b.keep_tags) > 0 THEN b.image_pattern WHEN len(d.keep_tags) > 0 THEN 'default' END AS keep_tags_from,
 CASE WHEN b.immutable IS NOT NULL THEN b.image_pattern WHEN d.immutable IS NOT NULL THEN 'default' END AS immutable_from FROM best b LEFT JOIN base d ON true""",
    "glob_matches": "SELECT DISTINCT image, pattern FROM history, (VALUES " + ", ".join(f"('{g}', '{r}')" for g, r in GLOBS.items() if r) + ") p(pattern, re) WHERE regexp_matches(image, re)",
    "recipe_offsets": f"WITH {_OFFSETS} SELECT * FROM offsets",
    "recipe_consistency": """SELECT recipe_id, coalesce(len(chunks), 0) AS n_chunks, CAST(coalesce(list_sum(list_transform(chunks, lambda x: coalesce(x.size_bytes, 0))), 0) AS BIGINT) AS chunk_bytes, size_bytes,
 coalesce(coalesce(list_sum(list_transform(chunks, lambda x: coalesce(x.size_bytes, 0))), 0) = size_bytes, false) AS consistent FROM recipe""",
    "store_delta": f"""WITH {_OFFSETS}, {_LIVE}, w AS (SELECT recipe_id, digest, max(size_bytes) AS size_bytes FROM offsets WHERE digest IS NOT NULL GROUP BY 1, 2),
m AS (SELECT w.*, NOT EXISTS (SELECT 1 FROM live WHERE live.kind = 'chunks' AND live.digest = w.digest) AS fresh FROM w)
SELECT recipe_id, count(*) AS n_chunks, count(*) FILTER (fresh) AS n_new, CAST(sum(size_bytes) AS BIGINT) AS bytes, CAST(coalesce(sum(size_bytes) FILTER (fresh), 0) AS BIGINT) AS new_bytes,
 round(CASE WHEN sum(size_bytes) = 0 THEN 0 ELSE 1 - coalesce(sum(size_bytes) FILTER (fresh), 0) / sum(size_bytes) END, 9) AS deduplicated FROM m GROUP BY 1""",
    "extract_overlap": f"{_OVERLAP} SELECT * FROM over",
    "chunks_needed": f"{_OVERLAP}, t AS (SELECT recipe_id, count(*) AS total FROM offsets GROUP BY 1), n AS (SELECT recipe_id, file, count(*) AS needed FROM over GROUP BY 1, 2) SELECT recipe_id, file, needed, total, needed || ' of ' || total || ' chunks' AS text FROM n JOIN t USING (recipe_id)",
    "multiset_overlap": f"""WITH l AS (SELECT {plain_sql('d')} AS digest, count(*) AS n FROM (SELECT unnest(list_transform(layers, lambda x: x.digest)) AS d FROM manifest) GROUP BY 1),
r AS (SELECT {plain_sql('compressed_digest')} AS digest, count(*) AS n FROM recipe GROUP BY 1) SELECT digest, least(l.n, r.n) AS times FROM l JOIN r USING (digest)""",
    "content_digests": "SELECT sha256(text) AS digest, count(*) AS times, max(strlen(text)) AS bytes FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "chunk_invariants": "SELECT doc_id AS id, strlen(text) AS bytes, true AS gapless FROM documents WHERE strlen(text) > 0",
    "overlay_top": "SELECT user_id AS image, props AS path, max(event_id) AS layer_pos, coalesce(arg_max(event_type, event_id) = 'error', false) AS deleted FROM events WHERE user_id IS NOT NULL AND props IS NOT NULL GROUP BY 1, 2",
    "overlay_view": f"""WITH counted AS ({COUNTED}), f AS (SELECT image, tag, max(pushed_at::DATE - DATE '1970-01-01') FILTER (NOT removed) AS shown, max(pushed_at::DATE - DATE '1970-01-01') FILTER (removed) AS gone FROM counted GROUP BY 1, 2)
SELECT image, 'tags/' || tag AS path, CAST(shown AS BIGINT) AS layer_pos FROM f WHERE shown IS NOT NULL AND coalesce(gone <= shown, true)""",
    "link_chase": f"""WITH {_CURRENT}, n AS (SELECT image || ':' || tag AS path, first(image || ':' || tag) OVER w AS target, row_number() OVER w - 1 AS hops FROM current WHERE digest IS NOT NULL WINDOW w AS (PARTITION BY digest ORDER BY image, tag))
SELECT path, CASE WHEN hops <= 16 THEN target END AS target, least(hops, 16) AS hops, CASE WHEN hops <= 16 THEN 'file' ELSE 'loop' END AS state FROM n""",
    "layer_storage": "SELECT recipe_id, CASE WHEN size_bytes >= 1048576 THEN 'chunks' ELSE 'blob' END AS kept_as, coalesce(size_bytes // 3 + 5000000 <= size_bytes, false) AS inside FROM recipe",
    "path_normalise": """SELECT listing_id, regexp_replace(object_key, '^(\\./|/)+', '') AS path, regexp_extract(object_key, '^/?([^/]+)/sha256/[0-9a-fA-F]{64}$', 1) AS kind,
 CASE WHEN size_bytes >= 1073741824 THEN format('{:.1f} GB', size_bytes / 1073741824) WHEN size_bytes >= 1048576 THEN format('{:.1f} MB', size_bytes / 1048576) WHEN size_bytes >= 1024 THEN format('{:.1f} KB', size_bytes / 1024) ELSE size_bytes || ' B' END AS size FROM object_listing""",
    "digest_forms": f"SELECT history_id, {plain_sql('digest')} AS plain, coalesce(regexp_matches(digest, '^sha256:[a-f0-9]{{64}}$'), false) AS strict, left({plain_sql('digest')}, 12) AS short FROM history",
    "name_checks": """SELECT DISTINCT image, tag, coalesce(length(image) <= 255 AND regexp_matches(image, '^[a-z0-9]+(?:(?:\\.|_|__|-+)[a-z0-9]+)*(?:/[a-z0-9]+(?:(?:\\.|_|__|-+)[a-z0-9]+)*)*$'), false) AS name_ok,
 coalesce(regexp_matches(tag, '^[a-zA-Z0-9_][a-zA-Z0-9._-]{0,127}$'), false) AS tag_ok FROM history""",
    "verify_ladder": f"""WITH counted AS ({COUNTED}), {_CURRENT}, s AS (SELECT image, tag, arg_max_null(digest, pushed_at) AS newest, arg_max_null(size_bytes, pushed_at) AS size FROM counted GROUP BY 1, 2),
r AS (SELECT c.image, c.tag, CASE WHEN s.image IS NULL THEN 'no signature' WHEN s.size IS NULL THEN 'unknown schema' WHEN s.newest IS DISTINCT FROM c.digest THEN 'digest changed'
 WHEN NOT starts_with(c.tag, 'v') THEN 'bad encoding' WHEN contains(c.image, '/lab/') THEN 'bad signature' ELSE 'ok' END AS reason FROM current c LEFT JOIN s ON s.image = c.image AND s.tag = c.tag)
SELECT image, tag, reason = 'ok' AS verified, reason FROM r""",
    "cache_fifo": f"""WITH e AS (SELECT image, tag, min(history_id) AS seq, max(snapshot_at) AS newest FROM history WHERE digest IS NOT NULL AND tag IS NOT NULL GROUP BY 1, 2),
k AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY image ORDER BY seq DESC) <= 3) SELECT image, tag, seq FROM k WHERE newest + INTERVAL 31536000 SECONDS > TIMESTAMP '{NOW}'""",
    "class_counts": f"WITH {_LIVE} SELECT kind, count(*) AS objects, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM live GROUP BY 1",
    "layer_reference_counts": f"""SELECT strftime(stored_at, '%Y-%m-%d') AS period, {plain_sql('d')} AS digest, count(*) AS refs FROM (SELECT stored_at, unnest(list_transform(layers, lambda x: x.digest)) AS d FROM manifest WHERE stored_at IS NOT NULL)
WHERE {plain_sql('d')} IS NOT NULL GROUP BY 1, 2""",
}
