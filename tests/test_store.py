import io
import os
import tarfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lamella.operators import cache, catalog, chunking, overlay, policy, reach, signing
from lamella.sources import archives, objects, sinks
from lamella.streaming.refcounts import layer_references

T = datetime(2024, 1, 1)
H = {c: c * 64 for c in "abcdef0123456789"}
MANIFEST = """manifest_id bigint, image string, tag string, digest string, schema_version int, media_type string, config struct<media_type:string,digest:string,size_bytes:bigint>,
 layers array<struct<media_type:string,digest:string,size_bytes:bigint>>, manifests array<struct<media_type:string,digest:string,size_bytes:bigint,platform:struct<os:string,architecture:string,variant:string>>>, stored_at timestamp"""
LISTING = "listing_id bigint, object_key string, size_bytes bigint, last_modified timestamp, storage_class string, deleted_at timestamp"
RECIPE = "recipe_id bigint, compressed_digest string, layer string, size_bytes bigint, compressed_size bigint, chunks array<struct<digest:string,size_bytes:bigint,compressed_size:bigint>>"


def manifest(spark, rows):
    full = []
    for k, (image, tag, digest, config, layers, children) in enumerate(rows):
        full.append((k, image, tag, digest and H[digest], 2, None, config and (None, H[config[0]], config[1]), [(None, H[d], n) for d, n in layers], [(None, H[d], 1, p) for d, p in children], T))
    return spark.createDataFrame(full, MANIFEST)


def listing(spark, keys, at=T):
    return spark.createDataFrame([(k, f"{kind}/sha256/{H[d]}", 10, at, None, None) for k, (kind, d) in enumerate(keys)], LISTING)


LINUX = ("linux", "amd64", None)


def test_sharing_across_an_index(spark):
    m = manifest(spark, [("team/app", "v1", None, None, [("a", 100), ("b", 200)], []), ("team/app", "v2", None, None, [], [("d", LINUX), ("e", ("unknown", "unknown", None))]), (None, None, "d", None, [("a", 100), ("b", 200)], []), ("team/other", "latest", None, None, [("a", 100), ("c", 50)], []), ("else/x", "v", None, None, [("f", 7)], [])])
    s = catalog.layer_sharing(m, "team/").orderBy(F.desc("n_tags"), F.desc("size_bytes"))
    assert [(r["digest"][0], r["size_bytes"], r["n_tags"]) for r in s.collect()] == [("a", 100, 3), ("b", 200, 2), ("c", 50, 1)]
    total = catalog.layer_sharing_summary(s).first()
    assert (total["layers"], total["stored_bytes"], total["logical_bytes"]) == (3, 350, 750) and abs(total["saved_share"] - 400 / 750) < 1e-12


def test_logical_size_counts_each_platform(spark):
    m = manifest(spark, [("i", "t", None, None, [], [("1", LINUX), ("2", LINUX), ("1", LINUX)]), (None, None, "1", ("3", 90), [("4", 60)], []), (None, None, "2", ("5", 90), [("6", 70)], [])])
    assert catalog.tag_sizes(m).first()["logical_bytes"] == 310


def test_garbage_follows_live_recipes_only(spark):
    m = manifest(spark, [("app", "latest", None, ("b", 1), [("a", 1)], [])])
    r = spark.createDataFrame([(1, H["a"], None, 1, 1, [(H["1"], 1, 1), (H["2"], 1, 1)]), (2, H["c"], None, 1, 1, [(H["4"], 1, 1)])], RECIPE)
    o = listing(spark, [("blobs", "b"), ("recipes", "a"), ("recipes", "c"), *(("chunks", c) for c in "1234")])
    dead = reach.garbage(o, reach.reachable(m, r), "2024-01-01 02:00:00")
    assert sorted((x["kind"], x["digest"][0], x["old_enough"]) for x in dead.collect()) == [("chunks", "3", True), ("chunks", "4", True), ("recipes", "c", True)]
    assert reach.garbage(o, reach.reachable(m, r), "2024-01-01 01:00:00").where("old_enough").count() == 3  # exactly the grace period
    assert reach.garbage(o, reach.reachable(m, r), "2024-01-01 00:59:59").where("old_enough").count() == 0


def test_cycles_and_nested_indexes_end(spark):
    m = manifest(spark, [("i", "t", "1", None, [], [("2", LINUX)]), (None, None, "2", None, [], [("1", LINUX), ("3", LINUX)]), (None, None, "3", ("4", 1), [("5", 1)], []), (None, None, "6", None, [("7", 1)], [])])
    got = {(r["kind"], r["digest"][0]) for r in reach.reachable(m, spark.createDataFrame([], RECIPE)).collect()}
    assert got == {("manifest", "1"), ("manifest", "2"), ("manifest", "3"), ("config", "4"), ("layer", "5")}


def test_doctor_both_ways(spark):
    m = manifest(spark, [("app", "latest", None, None, [], [("1", LINUX)]), (None, None, "1", ("2", 1), [("3", 1)], [])])
    full = listing(spark, [("blobs", "1"), ("blobs", "2"), ("recipes", "3"), ("blobs", "4")])
    assert reach.missing(m, full).count() == 0
    assert [r["digest"][0] for r in reach.orphans(m, full).collect()] == ["4"]
    less = listing(spark, [("blobs", "2"), ("recipes", "3")])
    assert [tuple(r) for r in reach.missing(m, less).collect()] == [("app", "latest", 1, H["1"])]


def test_indexes_inside_indexes_are_followed(spark):
    rows = [("harbor/a", "t", "0", None, [], [("1", LINUX), ("2", LINUX)]), (None, None, "1", None, [], [("2", LINUX), ("1", LINUX), ("8", ("unknown", "unknown", None))])]
    rows += [(None, None, "2", None, [], [("3", LINUX), ("3", LINUX)]), (None, None, "3", ("4", 90), [("5", 60), ("5", 60)], []), (None, None, "8", None, [("9", 7)], [])]
    m = manifest(spark, rows)
    o = listing(spark, [("blobs", c) for c in "01234589a"])
    assert [r["digest"][0] for r in reach.orphans(m, o).collect()] == ["a"]
    less = listing(spark, [("blobs", c) for c in "0123489"])
    assert [tuple(r) for r in reach.missing(m, less).collect()] == [("harbor/a", "t", 1, H["5"])]
    assert sorted(r["digest"][0] for r in reach.copy_plan(m, "harbor/", "ledger/").collect()) == list("1234589")
    assert catalog.tag_sizes(m).first()["logical_bytes"] == 90 + 60 + 60 + 7
    assert [(r["digest"][0], r["n_tags"], r["logical_bytes"]) for r in catalog.layer_sharing(m).collect()] == [("5", 1, 60)]


def test_malformed_manifests_do_not_crash(spark):
    m = spark.createDataFrame([(1, "i", "t", "", None, None, None, None, None, None), (2, "i", "u", "x:y", 2, "", (None, "", None), [None, (None, "nope", 3)], [None], T)], MANIFEST)
    assert catalog.tag_sizes(m).agg(F.sum("logical_bytes")).first()[0] == 0
    assert catalog.list_images(m).first()["tags"] == ["t", "u"]
    assert catalog.manifest_totals(catalog.plain_manifests(m)).count() == 2
    assert catalog.summary(m.limit(0), spark.createDataFrame([], LISTING)).first()["tags"] == 0


def test_images_of_keys_prefer_the_newer_layout(spark):
    keys = ["manifests/org/app/v2/manifest.json", "manifests/org/app/_v1/manifest.json", "org/app/old/manifest.json", "legacy/v1/manifest.json", "blobs/x/y/manifest.json", "manifests/x/manifest.json"]
    got = {r["image"]: r["tags"] for r in catalog.images_of_keys(spark.createDataFrame([(k,) for k in keys], "object_key string")).collect()}
    assert got == {"org/app": ["_v1", "v2"], "legacy": ["v1"]}


def test_policy_priority_and_merge(spark):
    rules = [("default", 10, "90d", ["latest"], False), ("a/*", 0, "", [], True), ("a/bb*", 3, None, None, None), ("a/bbb", None, "7d", None, None), (None, 1, None, None, None), ("[", 1, None, None, None)]
    images = spark.createDataFrame([("a/x",), ("a/bbc",), ("a/bbb",), ("z",), (None,)], "image string")
    found = policy.effective(images, spark.createDataFrame(rules, "image_pattern string, keep_last int, max_age string, keep_tags array<string>, immutable boolean")).collect()
    got = {r["image"]: tuple(r)[1:6] for r in found}
    assert {r["image"]: tuple(r)[6:] for r in found if r["image"] in ("a/x", "a/bbc")} == {"a/x": ("default", "default", "default", "a/*"), "a/bbc": ("a/bb*", "default", "default", "default")}
    assert got == {"a/x": ("a/*", 10, "90d", ["latest"], True), "a/bbc": ("a/bb*", 3, "90d", ["latest"], False), "a/bbb": ("a/bbb", 10, "7d", ["latest"], False), "z": ("default", 10, "90d", ["latest"], False)}


def test_retention_is_rank_and_age(spark):
    days = {"v5": 1, "v4": 100, "v3": 200, "v2": 300, "v1": 400}
    tags = spark.createDataFrame([("i", t, datetime.fromordinal(T.toordinal() - d)) for t, d in days.items()] + [("i", "latest", T)], "image string, tag string, at timestamp")

    def doomed(keep, age):
        pol = spark.createDataFrame([("i", keep, age, ["latest"])], "image string, keep_last int, max_age string, keep_tags array<string>")
        return sorted(r["tag"] for r in policy.retention_ranks(tags, pol, "2024-01-01 00:00:00").where("beyond and aged").collect())

    assert doomed(3, "90d") == ["v1", "v2"]
    assert doomed(2, None) == ["v1", "v2", "v3"]
    assert doomed(0, "150d") == ["v1", "v2", "v3"]


def test_overlay_markers_and_links(spark):
    rows = [(1, "etc/os", "../usr/os"), (1, "usr/os", None), (1, "data/a", None), (1, "data/sub/b", None), (2, ".wh.data", None), (2, "data/new", None), (3, "opq/.wh..wh..opq", None), (2, "opq/x", None), (3, "opq/y", None), (1, "loop1", "loop2"), (1, "loop2", "loop1"), (2, "./usr/os", None), (1, "usr/.wh.gone", None), (2, "usr/gone", None)]
    seen = overlay.view(spark.createDataFrame([("i", *r) for r in rows], "image string, layer_pos int, path string, link string"))
    got = {r["path"]: r["layer_pos"] for r in seen.collect()}
    assert got == {"etc/os": 1, "usr/os": 2, "data/new": 2, "opq/y": 3, "loop1": 1, "loop2": 1, "usr/gone": 2}
    asked = spark.createDataFrame([("i", p) for p in ["/etc/os", "usr/os", "nope", "loop1"]], "image string, path string")
    found = {r["path"]: (r["target"], r["state"]) for r in overlay.follow_links(seen, asked, hops=4).collect()}
    assert found == {"/etc/os": ("usr/os", "file"), "usr/os": ("usr/os", "file"), "nope": (None, "absent"), "loop1": (None, "loop")}


def test_verification_ladder(spark):
    tags = spark.createDataFrame([("i", t, "d1") for t in ("ok", "none", "schema", "moved", "coding", "bad", "two")], "image string, tag string, digest string")
    s = [("i", "ok", 2, "d1", "k", "Z29vZA=="), ("i", "schema", 1, "d1", "k", "Z29vZA=="), ("i", "moved", 2, "d0", "k", "Z29vZA=="), ("i", "coding", 2, "d1", "k", "***"), ("i", "bad", 2, "d1", "k", "YmFk"), ("i", "two", 2, "d1", "k", "YmFk"), ("i", "two", 2, "d1", "k", "Z29vZA==")]
    sig = spark.createDataFrame(s, "image string, tag string, schema_version int, digest string, key_id string, signature string")
    got = {r["tag"]: r["reason"] for r in signing.verify(tags, sig, "b", lambda p, raw, k: raw == F.lit(bytearray(b"good"))).collect()}
    assert got == {"ok": "ok", "none": "no signature", "schema": "unknown schema", "moved": "digest changed", "coding": "bad encoding", "bad": "bad signature", "two": "ok"}


def test_sidecars_travel_only_with_their_place(spark):
    keys = spark.createDataFrame([(f"manifests/a/v1/{k}",) for k in ("manifest.json", "signatures/k.json", "note.txt")] + [("manifests/a/v10/note.txt",)], "object_key string")

    def plan(*a):
        return {r["object_key"].rpartition("/v1/")[2]: (r["target_key"], r["action"]) for r in reach.sidecar_plan(keys, "manifests/a/v1/", *a).collect()}

    assert plan("manifests/a/v2/", False) == {"signatures/k.json": (None, "drop"), "note.txt": ("manifests/a/v2/note.txt", "copy")}
    assert plan("manifests/a/v1/", False)["signatures/k.json"][1] == "copy" and plan("manifests/a/v1/", True)["signatures/k.json"][1] == "drop"


def test_cache_evicts_the_oldest(spark):
    log = spark.createDataFrame([("s", k, T, n) for n, k in enumerate("abca")], "scope string, key string, at timestamp, seq int")
    now = F.lit("2024-01-01 00:00:10").cast("timestamp")
    assert sorted(r["key"] for r in cache.held(log, ["scope"], "key", "at", "seq", 2, 60, now).collect()) == ["b", "c"]
    assert cache.held(log, ["scope"], "key", "at", "seq", 2, 5, now).count() == 0


@pytest.fixture
def bucket(tmp_path):
    for key, text in {"manifests/app/v1/manifest.json": '{"schemaVersion":2,"layers":[{"digest":"x","size":3}]}', "manifests/app/_v2/manifest.json": "{broken", "manifests/.hid/.v3/manifest.json": "[]", "manifests/app2/v1/manifest.json": "{}", "blobs/sha256/x": "abc", "top.txt": ""}.items():
        p = tmp_path / key
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    return str(tmp_path)


def test_listing_sees_hidden_names(spark, bucket):
    assert sorted(r["object_key"] for r in objects.list_objects(spark, bucket).collect()) == ["blobs/sha256/x", "manifests/.hid/.v3/manifest.json", "manifests/app/_v2/manifest.json", "manifests/app/v1/manifest.json", "manifests/app2/v1/manifest.json", "top.txt"]
    assert objects.list_objects(spark, bucket, "manifests/app").count() == 3
    assert objects.list_objects(spark, bucket, "manifests/app/").count() == 2
    assert objects.list_objects(spark, bucket + "/absent").count() == 0
    row = objects.list_objects(spark, bucket, "blobs/").first()
    assert row["size_bytes"] == 3 and row["storage_class"] == "STANDARD"


def test_manifests_of_a_bucket(spark, bucket):
    rows = {(r["image"], r["tag"]): (r["valid"], r["layers"]) for r in objects.manifests(spark, bucket).collect()}
    assert rows[("app", "v1")][0] and rows[("app", "v1")][1][0]["size"] == 3
    assert not rows[("app", "_v2")][0] and not rows[(".hid", ".v3")][0] and rows[("app2", "v1")][0]


def test_sinks_stay_inside_and_need_confirmation(spark, bucket):
    sinks.put_objects(spark.createDataFrame([("new/a", bytearray(b"1"))], "object_key string, content binary"), bucket)
    assert open(f"{bucket}/new/a", "rb").read() == b"1"
    for key in ("../evil", "/etc/passwd", "new/../../evil"):
        with pytest.raises(ValueError):
            objects.safe_path(bucket, key)
    plan = spark.createDataFrame([("new/a",), ("absent",), (None,)], "object_key string")
    assert sinks.delete_objects(plan, bucket) == 2 and os.path.exists(f"{bucket}/new/a")
    assert sinks.delete_objects(plan, bucket, confirm=True) == 2 and not os.path.exists(f"{bucket}/new/a")


def test_store_and_fetch_round_trip(spark, tmp_path):
    import random

    rng = random.Random(1)
    blob = rng.randbytes(20_000)
    root = str(tmp_path)

    def layers(*data):
        return spark.createDataFrame([(k, bytearray(d)) for k, d in enumerate(data)], "id bigint, content binary")

    first = sinks.store_chunks(layers(blob), "id", "content", root, chunking.SMALL).first()
    assert first["bytes"] == 20_000 and first["deduplicated"] == 0
    again = sinks.store_chunks(layers(blob, blob[:9000] + b"x" + blob[9000:]), "id", "content", root, chunking.SMALL)
    rows = {r["id"]: r for r in again.collect()}
    assert rows[0]["deduplicated"] == 1.0 and rows[1]["deduplicated"] > 0.8
    assert [(r["size"], r["ok"]) for r in sinks.fetch_layers(spark, root).orderBy("size").collect()] == [(20_000, True), (20_001, True)]
    victim = next(os.path.join(f, n) for f, _, files in os.walk(f"{root}/chunks") for n in files)
    open(victim, "wb").write(b"damaged")
    assert not all(r["ok"] for r in sinks.fetch_layers(spark, root).collect())


def test_tar_and_zstd(spark):
    buf = io.BytesIO()
    with tarfile.open(fileobj=buf, mode="w") as tar:
        for name, data in (("./a/b.txt", b"hello"), ("c", b"")):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
        for name, kind, target in (("s", tarfile.SYMTYPE, "a/b.txt"), ("d/h", tarfile.LNKTYPE, "a/b.txt")):
            info = tarfile.TarInfo(name)
            info.type, info.linkname = kind, target
            tar.addfile(info)
    data = buf.getvalue()
    df = spark.createDataFrame([(1, bytearray(data)), (2, bytearray(b"no tar" * 200)), (3, bytearray(b"\x1f\x8b...")), (4, None), (5, bytearray(b""))], "id bigint, content binary")
    rows = archives.tar_entries(df, "id", "content").collect()
    assert [(r["path"], r["size"], r["link"], r["link_type"]) for r in rows if r["id"] == 1] == [("a/b.txt", 5, None, None), ("c", 0, None, None), ("s", 0, "a/b.txt", "symbolic"), ("d/h", 0, "/a/b.txt", "hard")]
    start = next(r["offset"] for r in rows if r["path"] == "a/b.txt")
    assert data[start : start + 5] == b"hello"
    assert {r["id"]: r["state"] for r in rows if r["id"] > 1} == {2: "not a tar", 3: "compressed", 4: "no content"}
    back = df.select("id", archives.zstd_decompress(F.concat(archives.zstd_compress("content"), archives.zstd_compress("content"))).alias("c"), archives.zstd_decompress("content").alias("bad"))
    got = {r["id"]: r for r in back.collect()}
    assert bytes(got[1]["c"]) == data * 2 and got[2]["bad"] is None and got[4]["c"] is None


def test_written_tables_can_be_dropped(spark):
    from lamella import session

    table = session.written(spark.range(3), "t")
    assert table.count() == 3
    session.drop_written(spark)
    assert not os.path.exists(session._tables_of(spark).removeprefix("file://"))


def test_rendering(spark):
    df = spark.createDataFrame([(1, "a")], "n int, s string")
    assert sinks.render(df) == '[{"n": 1, "s": "a"}]' and sinks.render(df.limit(0)) == "[]"
    assert sinks.render(df, "text") == "n  s\n1  a" and "n: 1" in sinks.render(df, "yaml")
    with pytest.raises(ValueError):
        sinks.render(df, "xml")


def test_config_rules(spark, tmp_path):
    p = tmp_path / "c.yaml"
    p.write_text("default:\n  lifecycle: {keep_last: 10, max_age: 90d}\nimages:\n  a/*:\n    immutable: true\n")
    rows = {r["image_pattern"]: tuple(r)[1:] for r in objects.config_rules(spark, objects.bucket_config(str(tmp_path), "c.yaml")).collect()}
    assert rows == {"default": (10, "90d", None, None), "a/*": (None, None, None, True)}
    assert objects.bucket_config(str(tmp_path), "none") == {}


def test_streamed_reference_counts(spark, tmp_path):
    rows = [("2024-01-01 10:00:00", [(H["a"],), (H["b"],)]), ("2024-01-01 11:00:00", [(H["a"],)]), ("2024-01-03 11:00:00", [(H["a"],), ("bad",)])]
    df = spark.createDataFrame(rows, "stored_at string, layers array<struct<digest:string>>").withColumn("stored_at", F.to_timestamp("stored_at"))
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = layer_references(stream).writeStream.outputMode("complete").format("memory").queryName("refs").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    got = sorted((str(r["period"])[:10], r["digest"][0], r["refs"]) for r in spark.table("refs").collect())
    assert got == sorted((str(r["period"])[:10], r["digest"][0], r["refs"]) for r in layer_references(df).collect()) == [("2024-01-01", "a", 2), ("2024-01-01", "b", 1), ("2024-01-03", "a", 1)]


def test_hot_keys_of_a_join_are_split(spark):
    """An aggregated lookup keeps adaptive execution from splitting, unless it is splittable."""
    from lamella.session import splittable

    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "50k"}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        rows = spark.range(0, 200_000, 1, 4).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 5000).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("x"))
        lookup = spark.range(20_000).groupBy((F.col("id") % 5000).alias("k")).agg(F.min("id").alias("v"))
        for side, split in ((lookup, False), (splittable(lookup), True)):
            df = rows.join(side, "k", "left").agg(F.max("x"), F.max("v"))
            df.collect()
            assert ("skew=true" in df._jdf.queryExecution().executedPlan().toString()) == split
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
