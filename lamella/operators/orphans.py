"""References to records that do not exist.

A Bloom filter of the parents' keys is broadcast; a reference it rejects is a proven
orphan and is not shuffled. The references it lets pass are verified by an exact
join that also compares times, so the filter's error rate changes the cost only.

Scale. References are read, exploded and tested once; what was tested is a written
table in two folders, of which only that of the positives is joined. A filter has at
most ``MAX_BITS`` (16 MiB); more keys are split by hash into up to ``MAX_CLASSES``
classes, each with a filter of its own, tested one after the other, so the bits grow
with the keys. Beyond some 860 million keys, more references pass to the join, none is
lost. Parents are pre-aggregated to one row a key; a hot reference key sits on the
join's streamed side, which adaptive execution splits.

Defined cases. References and parents that are no well-formed digest, null lists and
null elements refer to nothing. A null time of the parent or of the reference meets
nothing. Copies within one row are one reference; repeated rows each count. An empty
parent table leaves every reference unmet.

The filter is Spark's own, made and tested through JVM classes as it has no public SQL
form; that needs a classic session, not one over Connect.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamella.functions import digests
from lamella.session import written

MAX_BITS = 1 << 27
BITS_PER_KEY = 10
MAX_CLASSES = 64
#: Partial filters merged into one: bounds what the merge receives to PARTIALS x MAX_BITS.
PARTIALS = 16


def bloom_filter(keys: DataFrame, column: str, expected: int, max_bits: int = MAX_BITS) -> bytes:
    """Serialised Bloom filter over a bigint column; its size is bounded by ``max_bits``."""
    spark = keys.sparkSession
    bits = int(min(max(expected * BITS_PER_KEY, 1024), max_bits))
    items = int(max(expected, 1))
    made = keys.select(column).repartition(PARTIALS, column)._jdf.stat().bloomFilter(column, items, bits)
    out = spark._jvm.java.io.ByteArrayOutputStream()
    made.writeTo(out)
    return bytes(out.toByteArray())


def might_contain(keys: DataFrame, filter_bytes: bytes, key: Column) -> Column:
    """Codegen'd membership test of a bigint column against ``bloom_filter``'s bytes."""
    jvm = keys.sparkSession._jvm
    utils = jvm.org.apache.spark.sql.classic.ExpressionUtils
    test = jvm.org.apache.spark.sql.catalyst.expressions.BloomFilterMightContain(utils.expression(F.lit(bytearray(filter_bytes))._jc), utils.expression(key._jc))
    return Column(utils.column(test))


def _tested(references: DataFrame, parents: DataFrame, expected: int, max_bits: int) -> DataFrame:
    """``references`` (with ``h``, a hash of the key) and whether a parent may exist, as a written table."""
    bits = bloom_filter(parents, "h", expected, max_bits)
    return written(references.withColumn("known", might_contain(references, bits, F.col("h"))).drop("h"), "tested", ["known"])


def unmet(references: DataFrame, parents: DataFrame, max_bits: int = MAX_BITS, max_classes: int = MAX_CLASSES) -> DataFrame:
    """Rows of ``references`` (scope, digest, at, …) that no parent meets.

    ``parents`` has (scope, digest, since): usable from ``since`` on. A reference is met
    when a parent of its scope and digest has since <= at.
    """
    key = F.xxhash64("scope", "digest")
    live = parents.where(F.col("digest").isNotNull() & F.col("scope").isNotNull() & F.col("since").isNotNull())
    # written: counted, filtered on and joined, and a plain scan leaves hot references splittable
    first = written(live.groupBy("scope", "digest").agg(F.min("since").alias("since")), "parents")
    expected = first.count()
    if not expected:
        return references
    keys, hashed = first.select(key.alias("h")), references.withColumn("h", key)
    classes = min(max_classes, -(-expected * BITS_PER_KEY // max_bits))
    if classes == 1:
        tested = _tested(hashed, keys, expected, max_bits)
    else:
        of_class = F.pmod("h", F.lit(classes))
        split = written(hashed.withColumn("class", of_class), "references", ["class"])
        done = [_tested(split.where(F.col("class") == c).drop("class"), keys.where(of_class == c), -(-expected // classes), max_bits) for c in range(classes)]
        tested = done[0]
        for more in done[1:]:
            tested = tested.unionByName(more)
    orphans = tested.where(~F.col("known")).select(*references.columns)
    joined = tested.where("known").join(first, ["scope", "digest"], "left")
    verified = joined.where(F.coalesce(F.col("since") > F.col("at"), F.lit(True))).select(*references.columns)
    return orphans.unionByName(verified)


# -- bindings to the store ----------------------------------------------------------


def _exploded(rows: DataFrame, table: str, ref_id: str, all_digests: Column) -> DataFrame:
    plain = F.array_distinct(F.filter(F.transform(all_digests, digests.plain), lambda d: d.isNotNull()))
    flat = rows.select(F.lit(table).alias("scope"), F.col(ref_id).alias("ref_id"), F.explode(plain).alias("digest"), F.col("stored_at").alias("at"))
    return flat.withColumn("digest", F.unhex("digest"))


def digest_references(manifest: DataFrame, recipe: DataFrame) -> DataFrame:
    """(scope, ref_id, digest, at): the distinct well-formed digests each row refers to."""
    none = F.array().cast("array<string>")

    def field(c: str) -> Column:
        return F.coalesce(F.col(f"{c}.digest"), none)

    of_manifest = F.concat(F.array(F.col("config.digest")), field("layers"), field("manifests"))
    return _exploded(manifest, "manifest", "manifest_id", of_manifest).unionByName(_exploded(recipe, "recipe", "recipe_id", field("chunks")))


def usable_objects(object_listing: DataFrame) -> DataFrame:
    """(scope, digest, since) of live objects, by the table whose references they meet."""
    kind = digests.object_class(F.col("object_key"))
    scope = F.when(kind.isin("blobs", "recipes"), F.lit("manifest")).when(kind == "chunks", F.lit("recipe"))
    live = object_listing.where(F.col("deleted_at").isNull())
    return live.select(scope.alias("scope"), digests.object_digest(F.col("object_key")).alias("digest"), F.col("last_modified").alias("since")).where(F.col("scope").isNotNull())


def orphan_references(manifest: DataFrame, recipe: DataFrame, object_listing: DataFrame, max_bits: int = MAX_BITS, max_classes: int = MAX_CLASSES) -> DataFrame:
    """One row for each reference not met: ref_table, ref_id, digest, period."""
    found = unmet(digest_references(manifest, recipe), usable_objects(object_listing), max_bits, max_classes)
    return found.select(F.col("scope").alias("ref_table"), "ref_id", digests.hex_text(F.col("digest")).alias("digest"), F.date_format("at", "yyyy-MM").alias("period"))


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Counts per referring table and period."""
    return orphans.groupBy("ref_table", "period").agg(F.count(F.lit(1)).alias("orphans"), F.count_distinct("ref_id").alias("rows_affected"), F.count_distinct("digest").alias("digests"))
