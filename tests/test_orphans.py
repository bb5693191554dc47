from datetime import datetime

from pyspark.sql import functions as F

from lamella.operators import orphans

MANIFEST = "manifest_id bigint, config struct<digest:string>, layers array<struct<digest:string>>, manifests array<struct<digest:string>>, stored_at timestamp"
RECIPE = "recipe_id bigint, chunks array<struct<digest:string>>, stored_at timestamp"
LISTING = "object_key string, last_modified timestamp, deleted_at timestamp"
H = [c * 64 for c in "abcdef"]
T1, T2, T3 = (datetime(2024, m, 1) for m in (1, 2, 3))


def run(spark, manifest, recipe, listing, **kw):
    m, r, o = spark.createDataFrame(manifest, MANIFEST), spark.createDataFrame(recipe, RECIPE), spark.createDataFrame(listing, LISTING)
    for c in ("scope", "digest", "known", "at", "since"):
        m, r, o = m.withColumn(c, F.lit(1)), r.withColumn(c, F.lit(1)), o.withColumn(c, F.lit(1))
    return sorted((tuple(x) for x in orphans.orphan_references(m, r, o, **kw).collect()), key=repr)


def test_kinds_times_and_spellings(spark):
    manifest = [
        (1, (" SHA256:" + H[0].upper(),), [(H[1],), (H[1],), None, ("bad",)], None, T2),
        (2, None, None, [(H[2],)], T2),
        (3, None, [], [(H[0],)], None),
    ]
    recipe = [(1, [(H[0],), (H[3],)], T2), (1, [(H[3],)], T3), (2, None, T2)]
    listing = [
        (f"/blobs/sha256/{H[0]}", T1, None),
        (f"recipes/sha256/{H[1]}", T3, None),  # too late
        (f"chunks/sha256/{H[2]}", T1, None),  # of a class that meets no manifest
        (f"chunks/sha256/{H[3]}", T3, None),
        (f"chunks/sha256/{H[3]}", T1, T1),  # deleted
        ("notes/readme", T1, None),
    ]
    expected = [("manifest", 1, H[1], "2024-02"), ("manifest", 2, H[2], "2024-02"), ("manifest", 3, H[0], None), ("recipe", 1, H[0], "2024-02"), ("recipe", 1, H[3], "2024-02")]
    assert run(spark, manifest, recipe, listing) == expected
    # a filter that lets everything pass changes the cost, not the rows
    assert run(spark, manifest, recipe, listing, max_bits=64) == expected
    # and so do several filters, one for each class of keys
    assert run(spark, manifest, recipe, listing, max_bits=15) == expected
    assert run(spark, manifest, recipe, listing, max_bits=4, max_classes=3) == expected


def test_empty_tables(spark):
    assert run(spark, [], [], []) == []
    assert run(spark, [(1, (H[0],), None, None, T1)], [], []) == [("manifest", 1, H[0], "2024-01")]


def test_filter_proves_absence(spark):
    keys = spark.range(5000).select(F.xxhash64("id").alias("h"))
    bits = orphans.bloom_filter(keys, "h", 5000)
    probe = spark.range(10000).select("id", F.xxhash64("id").alias("h"))
    hits = probe.where(orphans.might_contain(probe, bits, F.col("h"))).agg(F.count_if(F.col("id") < 5000), F.count_if(F.col("id") >= 5000)).first()
    assert hits[0] == 5000 and hits[1] < 250
    assert len(orphans.bloom_filter(keys, "h", 10**12, max_bits=1 << 12)) < 1000
