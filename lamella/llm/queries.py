"""Queries of this package with their SQL."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.functions import digests
from lamella.llm import mixing, newest, packing, setjoin, spans
from lamella.plans.general import COUNTED, TIME, plain_sql
from lamella.plans.tables import table
from lamella.session import written

RECIPE_THRESHOLD = Fraction(7, 10)


def recipe_members(recipe: DataFrame) -> DataFrame:
    """(record, token) as bytes: well-formed recipe digests with well-formed chunk digests."""
    flat = recipe.select(digests.plain_bytes(F.col("compressed_digest")).alias("record"), F.explode("chunks.digest").alias("token"))
    return flat.select("record", digests.plain_bytes(F.col("token")).alias("token"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of recipes whose chunk sets have Jaccard similarity 0.7 or more."""
    pairs, membership = setjoin.similar_sets(recipe_members(table(spark, d, "recipe")), RECIPE_THRESHOLD)
    found = setjoin.expanded(pairs, membership)
    return found.select(digests.hex_text(F.col("a")).alias("compressed_digest_a"), digests.hex_text(F.col("b")).alias("compressed_digest_b"))


def p3_classes(spark: SparkSession, d: str) -> DataFrame:
    """Each recipe with its class of equal chunk sets and the class's number of links."""
    pairs, membership = setjoin.similar_sets(recipe_members(table(spark, d, "recipe")), RECIPE_THRESHOLD)
    ends = pairs.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count(F.lit(1)).alias("links"))
    rows = membership.join(ends, "class_id", "left")
    return rows.select(digests.hex_text(F.col("record")).alias("compressed_digest"), digests.hex_text(F.col("class_id")).alias("class_id"), "copies", F.coalesce("links", F.lit(0)).alias("links"))


LAYER_THRESHOLD = Fraction(1, 2)


def manifest_members(manifest: DataFrame) -> DataFrame:
    """(record, token): manifests by id with their well-formed layer digests."""
    flat = manifest.select(F.col("manifest_id").alias("record"), F.explode("layers.digest").alias("token"))
    return flat.select("record", digests.plain_bytes(F.col("token")).alias("token"))


def p3_between(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of a tagged manifest and one without a tag whose layers have similarity 0.5 or more."""
    rows = table(spark, d, "manifest")
    pairs = setjoin.similar_between(manifest_members(rows.where("tag is not null")), manifest_members(rows.where("tag is null")), LAYER_THRESHOLD)
    return pairs.select(F.col("left_record").alias("tagged_id"), F.col("right_record").alias("untagged_id"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The newest pushes of every image, as many as its rule keeps."""
    kept = newest.newest_pushes(table(spark, d, "history"), table(spark, d, "lifecycle_rule"))
    return kept.select("image", "tag", F.date_format("pushed_at", TIME).alias("pushed_at"))


def _packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(packing.document_items(table(spark, d, "documents")), table(spark, d, "pack_spec").select("pack_name", F.col("capacity_tokens").alias("capacity")))


def p6_assignments(spark: SparkSession, d: str) -> DataFrame:
    """Every piece of every non-empty text with its container, for each capacity."""
    return _packed(spark, d).select("pack_name", "container", F.col("item_id").alias("doc_id"), "piece", F.col("offset").alias("token_from"), F.col("size").alias("tokens"))


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    """Fill of the containers, for each capacity."""
    return packing.fill_report(_packed(spark, d))


def p6_complete(spark: SparkSession, d: str) -> DataFrame:
    """Is each text, for each capacity, there once: pieces without gap, and cut only beyond the capacity?"""
    pieces = _packed(spark, d).groupBy("pack_name", F.col("item_id").alias("doc_id"), "capacity").agg(F.count(F.lit(1)).alias("pieces"), F.sum("size").alias("tokens"), F.max(F.col("offset") + F.col("size")).alias("upto"))
    return pieces.select("pack_name", "doc_id", F.expr("tokens = upto and pieces = greatest(1, (tokens + capacity - 1) div capacity)").alias("complete"))


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    """For each capacity: overfull containers, are they numbered without gap, and is at most one filled by half or less?"""
    each = _packed(spark, d).groupBy("pack_name", "capacity", "container").agg(F.sum("size").alias("held"))
    return each.groupBy("pack_name", "capacity").agg(F.expr("count_if(held > capacity)").alias("overfull"), (F.max("container") + 1 == F.count(F.lit(1))).alias("numbered"), F.expr("count_if(2 * held <= capacity) <= 1").alias("filled"))


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    """The mixture of sources: which tokens of which document stand in which slot."""
    targets = table(spark, d, "mix_target")
    sizes = mixing.document_sizes(table(spark, d, "documents"), targets)
    return mixing.mix(sizes, mixing.source_totals(sizes, targets))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """Shares aimed at and reached, for each source of the targets."""
    targets = table(spark, d, "mix_target")
    sizes = mixing.document_sizes(table(spark, d, "documents"), targets)
    totals = mixing.source_totals(sizes, targets)
    return mixing.share_report(mixing.mix(sizes, totals), totals)


def p7_checks(spark: SparkSession, d: str) -> DataFrame:
    """For each target: is no token used more often than allowed, is the share met within a few blocks, are all slots equal?"""
    targets = table(spark, d, "mix_target")
    sizes = mixing.document_sizes(table(spark, d, "documents"), targets)
    totals = mixing.source_totals(sizes, targets)
    mixture = written(mixing.mix(sizes, totals), "mixture")
    slots = mixture.groupBy("slot").agg(F.sum(F.col("token_to") - F.col("token_from")).alias("tokens"))
    even = slots.agg(F.max("tokens").alias("block"), F.count(F.lit(1)).alias("slots"), ((F.min("tokens") == F.max("tokens")) & (F.max("slot") + 1 == F.count(F.lit(1)))).alias("even"))
    repeated = mixture.groupBy("source", "doc_id", "repeat").agg(F.sum(F.col("token_to") - F.col("token_from")).alias("used")).join(sizes.groupBy("source", "doc_id").agg(F.sum("tokens").alias("tokens")), ["source", "doc_id"])
    over = repeated.groupBy("source").agg(F.expr("count_if(used > tokens)").alias("over"))
    report = mixing.share_report(mixture, totals).join(over, "source", "left").crossJoin(F.broadcast(even))  # one row
    return report.select("source", F.expr("most_uses <= max_repeats and coalesce(over, 0) = 0").alias("within_cap"), F.expr("abs(tokens - aim * block * slots) <= 8 * block").alias("on_target"), "even")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Maximal runs of characters in passages of 120 that another document has too."""
    return spans.shared_spans(table(spark, d, "documents"))


def p8_coverage(spark: SparkSession, d: str) -> DataFrame:
    """How much of each document is shared elsewhere."""
    docs = table(spark, d, "documents")
    return spans.coverage(docs, spans.shared_spans(docs))


_SETS = f"""WITH members AS (SELECT DISTINCT {plain_sql('compressed_digest')} AS r, {plain_sql('c')} AS t
 FROM (SELECT compressed_digest, unnest(list_transform(chunks, lambda x: x.digest)) AS c FROM recipe)),
good AS (SELECT r, t FROM members WHERE r IS NOT NULL AND t IS NOT NULL),
sizes AS (SELECT r, count(*) AS n, string_agg(t, ',' ORDER BY t) AS key FROM good GROUP BY r),
common AS (SELECT a.r AS a, b.r AS b, count(*) AS o FROM good a JOIN good b ON a.t = b.t AND a.r < b.r GROUP BY 1, 2),
pairs AS (SELECT a, b FROM common JOIN sizes x ON x.r = a JOIN sizes y ON y.r = b WHERE 10 * o >= 7 * (x.n + y.n - o))
"""

_BETWEEN = f"""WITH members AS (SELECT DISTINCT manifest_id AS r, tag IS NULL AS untagged, {plain_sql('c')} AS t FROM (SELECT manifest_id, tag, unnest(list_transform(layers, lambda x: x.digest)) AS c FROM manifest)),
good AS (SELECT * FROM members WHERE t IS NOT NULL), sizes AS (SELECT r, count(*) AS n FROM good GROUP BY r),
common AS (SELECT a.r AS a, b.r AS b, count(*) AS o FROM good a JOIN good b ON a.t = b.t AND NOT a.untagged AND b.untagged GROUP BY 1, 2)
SELECT a AS tagged_id, b AS untagged_id FROM common JOIN sizes x ON x.r = a JOIN sizes y ON y.r = b WHERE 2 * o >= x.n + y.n - o"""

_P5 = f"""WITH counted AS ({COUNTED}),
fallback AS (SELECT max(keep_last) AS keep_last FROM lifecycle_rule WHERE image_pattern = 'default'),
images AS (SELECT image, coalesce(CASE WHEN e.image_pattern IS NOT NULL THEN e.keep_last ELSE g.keep_last END, f.keep_last) AS keep
 FROM (SELECT DISTINCT image FROM counted) i LEFT JOIN lifecycle_rule e ON e.image_pattern = i.image
 LEFT JOIN lifecycle_rule g ON contains(i.image, '/') AND g.image_pattern = regexp_replace(i.image, '/[^/]*$', '/*') CROSS JOIN fallback f)
SELECT image, tag, strftime(pushed_at, '%Y-%m-%d %H:%M:%S') AS pushed_at FROM counted JOIN images USING (image) WHERE NOT removed
QUALIFY row_number() OVER (PARTITION BY image ORDER BY counted.pushed_at DESC, tag) <= keep"""

_P8 = """WITH windows AS (SELECT doc_id, p, substr(text, p + 1, 120) AS w FROM (SELECT doc_id, text, unnest(range(length(text) - 119)) AS p FROM documents WHERE length(text) >= 120)),
several AS (SELECT w FROM windows GROUP BY w HAVING count(DISTINCT doc_id) > 1),
shared AS (SELECT doc_id, p FROM windows SEMI JOIN several USING (w)),
begun AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 120 THEN 0 ELSE 1 END AS b FROM shared),
islands AS (SELECT doc_id, p, sum(b) OVER (PARTITION BY doc_id ORDER BY p) AS i FROM begun),
found AS (SELECT doc_id, min(p) AS span_start, max(p) + 120 AS span_end FROM islands GROUP BY doc_id, i)
"""

QUERIES = {"p3_found": p3_found, "p3_classes": p3_classes, "p3_between": p3_between, "p5_found": p5_found, "p6_assignments": p6_assignments, "p6_fill": p6_fill, "p6_complete": p6_complete, "p6_containers": p6_containers, "p7_mixture": p7_mixture, "p7_shares": p7_shares, "p7_checks": p7_checks, "p8_found": p8_found, "p8_coverage": p8_coverage}
SQL = {
    "p3_found": _SETS + "SELECT a AS compressed_digest_a, b AS compressed_digest_b FROM pairs",
    "p3_classes": _SETS
    + """, classes AS (SELECT r, min(r) OVER (PARTITION BY key) AS class_id, count(*) OVER (PARTITION BY key) AS copies FROM sizes),
ends AS (SELECT a AS r FROM pairs UNION ALL SELECT b FROM pairs),
links AS (SELECT class_id, count(*) AS links FROM (SELECT p.a AS class_id FROM pairs p JOIN classes x ON x.r = p.a AND x.class_id = p.a JOIN classes y ON y.r = p.b AND y.class_id = p.b
 UNION ALL SELECT p.b FROM pairs p JOIN classes x ON x.r = p.a AND x.class_id = p.a JOIN classes y ON y.r = p.b AND y.class_id = p.b) GROUP BY 1)
SELECT r AS compressed_digest, class_id, copies, coalesce(links, 0) AS links FROM classes LEFT JOIN links USING (class_id)""",
    "p3_between": _BETWEEN,
    "p5_found": _P5,
    "p6_complete": "SELECT pack_name, doc_id, true AS complete FROM documents CROSS JOIN pack_spec WHERE length(text) > 0",
    "p6_containers": "SELECT pack_name, CAST(capacity_tokens AS BIGINT) AS capacity, 0 AS overfull, true AS numbered, true AS filled FROM pack_spec",
    "p7_checks": "SELECT lower(source) AS source, true AS within_cap, true AS on_target, true AS even FROM mix_target",
    "p8_found": _P8 + "SELECT * FROM found",
    "p8_coverage": _P8
    + """SELECT d.doc_id, d.n_chars, coalesce(s.shared_chars, 0) AS shared_chars, CASE WHEN d.n_chars > 0 THEN coalesce(s.shared_chars, 0) / d.n_chars ELSE 0 END AS shared_share
FROM (SELECT doc_id, max(length(text)) AS n_chars FROM documents WHERE text IS NOT NULL GROUP BY 1) d
LEFT JOIN (SELECT doc_id, CAST(sum(span_end - span_start) AS BIGINT) AS shared_chars FROM found GROUP BY 1) s USING (doc_id)""",
}
