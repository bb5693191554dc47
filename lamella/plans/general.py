"""Queries of the general data-pipeline operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.functions import digests
from lamella.operators import orphans, shred, temporal
from lamella.plans.tables import table

TIME = "yyyy-MM-dd HH:mm:ss"


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Every version of every (image, tag) with the time it held."""
    v = temporal.push_versions(table(spark, d, "history"))
    return v.select("image", "tag", "digest", F.date_format("valid_from", TIME).alias("valid_from"), F.coalesce(F.date_format("valid_to", TIME), F.lit("")).alias("valid_to"))


def p1_satellites(spark: SparkSession, d: str) -> DataFrame:
    """What the insert-only load appends: a row for each change of a satellite."""
    tables = temporal.history_satellites(table(spark, d, "history"))
    rows = tables["content"].select(F.lit("content").alias("satellite"), "image", "tag", "valid_from", "removed", "digest").unionByName(tables["extent"].select(F.lit("extent").alias("satellite"), "image", "tag", "valid_from", "size_bytes"), allowMissingColumns=True)
    return rows.withColumns({"valid_from": F.date_format("valid_from", TIME), "digest": digests.hex_text(F.col("digest"))})


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Every entry of every raw manifest, linked to its parent and record."""
    entries = shred.manifest_entries(shred.manifest_nodes(table(spark, d, "manifest_raw")))
    return entries.select("record_id", "entry_path", "parent_path", "media_type", "architecture", "revision")


def p2_nodes(spark: SparkSession, d: str) -> DataFrame:
    """The adjacency table: every node of every raw manifest, linked to its parent."""
    return shred.shred(table(spark, d, "manifest_raw"), "record_id", "body").drop("body_hash")


def p2_labels(spark: SparkSession, d: str) -> DataFrame:
    """Nodes of the adjacency table by record, label, kind and scalar of themselves and their parent's label."""
    nodes = shred.manifest_nodes(table(spark, d, "manifest_raw"))
    above = nodes.select(*shred.RECORD, F.col("node").alias("parent"), F.col("label").alias("parent_label"))
    both = nodes.join(above, [*shred.RECORD, "parent"], "left")
    return both.groupBy("record_id", "label", "parent_label", "kind").agg(F.count(F.lit(1)).alias("nodes"), F.min("scalar").alias("least"), F.max("scalar").alias("greatest"))


def p2_annotations(spark: SparkSession, d: str) -> DataFrame:
    """Every annotation of every entry: a child table."""
    return shred.entry_annotations(shred.manifest_nodes(table(spark, d, "manifest_raw"))).drop("node", "body_hash")


def p2_platforms(spark: SparkSession, d: str) -> DataFrame:
    """Every platform of every entry: a child table."""
    return shred.entry_platforms(shred.manifest_nodes(table(spark, d, "manifest_raw"))).drop("node", "body_hash")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Every reference of manifests and recipes that no usable object meets."""
    return orphans.orphan_references(table(spark, d, "manifest"), table(spark, d, "recipe"), table(spark, d, "object_listing"))


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    """Unmet references per table and month."""
    return orphans.orphan_report(p4_found(spark, d))


_PLAIN = """CASE WHEN regexp_matches(regexp_replace(lower(trim({c}, ' \t\r\n')), '^sha256:', ''), '^[0-9a-f]{{64}}$')
 THEN regexp_replace(lower(trim({c}, ' \t\r\n')), '^sha256:', '') END"""


def plain_sql(column: str) -> str:
    return _PLAIN.format(c=column)


COUNTED = f"""SELECT image, tag, pushed_at, coalesce(trim(digest, ' \t\r\n') = '', true) AS removed, {plain_sql('digest')} AS digest, size_bytes
 FROM history WHERE image IS NOT NULL AND tag IS NOT NULL AND pushed_at IS NOT NULL
 QUALIFY row_number() OVER (PARTITION BY image, tag, pushed_at ORDER BY snapshot_at DESC NULLS LAST, history_id DESC NULLS LAST) = 1"""

_P1 = f"""WITH counted AS ({COUNTED}),
marked AS (SELECT *, lag(removed) OVER w AS was_removed, lag(digest) OVER w AS was_digest, lag(size_bytes) OVER w AS was_size, row_number() OVER w AS n
 FROM counted WINDOW w AS (PARTITION BY image, tag ORDER BY pushed_at)),
changes AS (SELECT * FROM marked WHERE n = 1 OR removed <> was_removed OR (NOT removed AND (digest IS DISTINCT FROM was_digest OR size_bytes IS DISTINCT FROM was_size))),
ended AS (SELECT *, lead(pushed_at) OVER (PARTITION BY image, tag ORDER BY pushed_at) AS until FROM changes)
SELECT image, tag, digest, strftime(pushed_at, '%Y-%m-%d %H:%M:%S') AS valid_from, coalesce(strftime(until, '%Y-%m-%d %H:%M:%S'), '') AS valid_to
FROM ended WHERE NOT removed"""

_SATELLITES = f"""WITH counted AS ({COUNTED}),
known AS (SELECT image, tag, pushed_at, removed, digest, CASE WHEN NOT removed THEN size_bytes END AS size_bytes FROM counted),
marked AS (SELECT *, lag(removed) OVER w AS was_removed, lag(digest) OVER w AS was_digest, lag(size_bytes) OVER w AS was_size, row_number() OVER w AS n FROM known WINDOW w AS (PARTITION BY image, tag ORDER BY pushed_at))
SELECT 'content' AS satellite, image, tag, strftime(pushed_at, '%Y-%m-%d %H:%M:%S') AS valid_from, removed, digest, CAST(NULL AS BIGINT) AS size_bytes FROM marked WHERE n = 1 OR removed <> was_removed OR digest IS DISTINCT FROM was_digest
UNION ALL SELECT 'extent', image, tag, strftime(pushed_at, '%Y-%m-%d %H:%M:%S'), NULL, NULL, size_bytes FROM marked WHERE n = 1 OR size_bytes IS DISTINCT FROM was_size"""

_P4 = f"""WITH refs AS (
 SELECT DISTINCT 'manifest' AS ref_table, manifest_id AS ref_id, {plain_sql('d')} AS digest, stored_at
 FROM (SELECT manifest_id, stored_at, unnest(list_concat([config.digest], coalesce(list_transform(layers, lambda x: x.digest), []), coalesce(list_transform(manifests, lambda x: x.digest), []))) AS d FROM manifest)
 UNION ALL
 SELECT DISTINCT 'recipe', recipe_id, {plain_sql('d')}, stored_at
 FROM (SELECT recipe_id, stored_at, unnest(list_transform(chunks, lambda x: x.digest)) AS d FROM recipe)),
objects AS (SELECT CASE WHEN regexp_extract(object_key, '^/?([^/]+)/', 1) = 'chunks' THEN 'recipe' ELSE 'manifest' END AS ref_table, lower(regexp_extract(object_key, '/sha256/([0-9a-fA-F]{{64}})$', 1)) AS digest, min(last_modified) AS since
 FROM object_listing WHERE deleted_at IS NULL AND regexp_extract(object_key, '^/?([^/]+)/', 1) IN ('blobs', 'recipes', 'chunks') GROUP BY ALL),
unmet AS (SELECT r.ref_table, r.ref_id, r.digest, strftime(r.stored_at, '%Y-%m') AS period FROM refs r LEFT JOIN objects o ON o.ref_table = r.ref_table AND o.digest = r.digest
 WHERE r.digest IS NOT NULL AND coalesce(o.since > r.stored_at, true))
"""

_ENTRIES = """WITH RECURSIVE good AS (SELECT record_id, body::JSON AS node FROM manifest_raw WHERE json_valid(body) AND json_type(CASE WHEN json_valid(body) THEN body ELSE 'null' END) = 'OBJECT'),
entry AS (
 SELECT record_id, '' AS entry_path, '' AS parent_path, node, 0 AS depth FROM good
 UNION ALL
 SELECT record_id, CASE WHEN entry_path = '' THEN step ELSE entry_path || '/' || step END, entry_path, child, depth + 1
 FROM (
  SELECT record_id, entry_path, depth, unnest(list_concat(
   [{'step': 'config', 'child': json_extract(node, '$.config')}],
   CASE json_type(node, '$.manifests') WHEN 'OBJECT' THEN [{'step': 'manifests/0', 'child': json_extract(node, '$.manifests')}]
    WHEN 'ARRAY' THEN list_transform(json_extract(node, '$.manifests[*]'), lambda x, i: {'step': 'manifests/' || (i - 1), 'child': x}) ELSE [] END,
   CASE json_type(node, '$.layers') WHEN 'OBJECT' THEN [{'step': 'layers/0', 'child': json_extract(node, '$.layers')}]
    WHEN 'ARRAY' THEN list_transform(json_extract(node, '$.layers[*]'), lambda x, i: {'step': 'layers/' || (i - 1), 'child': x}) ELSE [] END), recursive := true)
  FROM entry) WHERE child IS NOT NULL AND json_type(child) = 'OBJECT')"""

_P2 = _ENTRIES + """
SELECT record_id, entry_path, parent_path, coalesce(json_extract_string(node, '$.mediaType'), '') AS media_type, coalesce(json_extract_string(node, '$.platform.architecture'), '') AS architecture,
 coalesce(json_extract_string(node, '$.annotations."org.opencontainers.image.revision"'), '') AS revision
FROM entry WHERE depth > 0"""

_LABELS = """WITH good AS (SELECT record_id, body::JSON AS node FROM manifest_raw WHERE json_valid(body) AND json_type(CASE WHEN json_valid(body) THEN body ELSE 'null' END) = 'OBJECT'),
t AS (SELECT g.record_id, x.id, x.parent, x.key, x.type, CASE WHEN x.type IN ('OBJECT', 'ARRAY', 'NULL') THEN NULL ELSE x.atom ->> '$' END AS scalar FROM good g, json_tree(g.node) x),
named AS (SELECT t.record_id, t.id, t.parent, t.type, t.scalar, CASE WHEN p.type = 'OBJECT' THEN t.key ELSE '' END AS label FROM t LEFT JOIN t p ON p.record_id = t.record_id AND p.id = t.parent),
typed AS (SELECT n.record_id, n.label, p.label AS parent_label, n.scalar,
 CASE n.type WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END AS kind
 FROM named n LEFT JOIN named p ON p.record_id = n.record_id AND p.id = n.parent)
SELECT record_id, label, parent_label, kind, count(*) AS nodes, min(scalar) AS least, max(scalar) AS greatest FROM typed GROUP BY 1, 2, 3, 4"""
_ANNOTATIONS = _ENTRIES + """
SELECT DISTINCT record_id, entry_path, key AS name, value ->> '$' AS value FROM (
 SELECT e.record_id, e.entry_path, unnest(json_keys(e.node, '$.annotations')) AS key, e.node FROM entry e WHERE depth > 0 AND json_type(e.node, '$.annotations') = 'OBJECT')
 CROSS JOIN LATERAL (SELECT json_extract(node, '$.annotations."' || key || '"') AS value) WHERE json_type(value) NOT IN ('OBJECT', 'ARRAY', 'NULL')"""
_PLATFORMS = _ENTRIES + """
SELECT record_id, entry_path, CASE WHEN json_type(node, '$.platform.os') NOT IN ('OBJECT', 'ARRAY') THEN json_extract_string(node, '$.platform.os') END AS os,
 CASE WHEN json_type(node, '$.platform.architecture') NOT IN ('OBJECT', 'ARRAY') THEN json_extract_string(node, '$.platform.architecture') END AS architecture,
 CASE WHEN json_type(node, '$.platform.variant') NOT IN ('OBJECT', 'ARRAY') THEN json_extract_string(node, '$.platform.variant') END AS variant FROM entry WHERE depth > 0 AND json_type(node, '$.platform') = 'OBJECT'"""

QUERIES = {"p1_found": p1_found, "p1_satellites": p1_satellites, "p2_found": p2_found, "p2_nodes": p2_nodes, "p2_labels": p2_labels, "p2_annotations": p2_annotations, "p2_platforms": p2_platforms, "p4_found": p4_found, "p4_report": p4_report}
SQL = {
    "p1_found": _P1,
    "p1_satellites": _SATELLITES,
    "p2_found": _P2,
    "p2_labels": _LABELS,
    "p2_annotations": _ANNOTATIONS,
    "p2_platforms": _PLATFORMS,
    "p4_found": _P4 + "SELECT * FROM unmet",
    "p4_report": _P4 + "SELECT ref_table, period, count(*) AS orphans, count(DISTINCT ref_id) AS rows_affected, count(DISTINCT digest) AS digests FROM unmet GROUP BY ALL",
}
