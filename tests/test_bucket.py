import hashlib
import io
import json
import os
import random
import tarfile
import time

import pytest

from lamella import cli
from lamella.operators import catalog, chunking, reach
from lamella.sources import settings, sinks
from lamella.sources.bucket import Bucket


def tar(**files):
    buf = io.BytesIO()
    with tarfile.open(fileobj=buf, mode="w") as t:
        for name, data in files.items():
            info = tarfile.TarInfo(name.replace("__", "/"))
            if isinstance(data, str):
                info.type, info.linkname = tarfile.SYMTYPE, data
                t.addfile(info)
            else:
                info.size = len(data)
                t.addfile(info, io.BytesIO(data))
    return buf.getvalue()


def put_manifest(root, tag, layers):
    os.makedirs(f"{root}/manifests/{tag}", exist_ok=True)
    with open(f"{root}/manifests/{tag}/manifest.json", "w") as f:
        json.dump({"schemaVersion": 2, "layers": layers}, f)


@pytest.fixture
def root(tmp_path):
    def put(key, data):
        p = tmp_path / key
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
        os.utime(p, (time.time() - 7200,) * 2)

    def blob(data):
        digest = hashlib.sha256(data).hexdigest()
        put(f"blobs/sha256/{digest}", data)
        return {"mediaType": "x", "digest": f"sha256:{digest}", "size": len(data)}

    low, high = blob(tar(etc__os=b"one", usr__os=b"file", link="usr/os")), blob(tar(etc__os=b"two", **{".wh.gone": b""}))
    child = blob(json.dumps({"schemaVersion": 2, "config": blob(b"{}"), "layers": [low, high]}).encode())
    put("manifests/org/app/v1/manifest.json", json.dumps({"schemaVersion": 2, "manifests": [{**child, "platform": {"os": "linux", "architecture": "amd64"}}]}).encode())
    put("manifests/org/app/_v2/manifest.json", json.dumps({"schemaVersion": 2, "layers": [low]}).encode())
    put("manifests/org/app/_v2/signatures/k.json", b"{}")
    put("config.yaml", b"default:\n  lifecycle: {keep_last: 1}\n")
    blob(b"orphan")
    return str(tmp_path)


def test_relations_of_a_bucket(spark, root):
    b = Bucket(spark, root)
    manifest = b.manifest()
    assert manifest.count() == 3
    assert {r["image"]: r["tags"] for r in catalog.list_images(manifest).collect()} == {"org/app": ["_v2", "v1"]}
    assert reach.missing(manifest, b.object_listing()).count() == 0
    assert reach.orphans(manifest, b.object_listing()).count() == 1
    assert b.recipe().count() == 0
    layers = [r["digest"] for r in catalog.layer_rows(catalog.plain_manifests(manifest).where("config_digest is not null")).orderBy("pos").collect()]
    assert b.cat(layers, "/etc/os") == b"two" and b.cat(layers, "link") == b"file"
    with pytest.raises(FileNotFoundError):
        b.cat(layers, "gone")


def test_clean_is_a_plan_first(spark, root, capsys):
    b = Bucket(spark, root)
    now = time.strftime("%Y-%m-%d %H:%M:%S", time.gmtime())
    # both tags are as old; the first by name stays
    plan = {(r["object_key"].split("/")[0], r["reason"]) for r in cli.clean_plan(b, now).collect()}
    assert plan == {("manifests", "expired"), ("blobs", "garbage")}
    before = sum(len(f) for _, _, f in os.walk(root))
    assert cli.clean_plan(b, now).count() == 2
    assert cli.clean_plan(b, now, cascade=True).count() > 2
    assert sum(len(f) for _, _, f in os.walk(root)) == before


def test_stored_layers_survive_clean(spark, tmp_path):
    root, data = str(tmp_path), random.Random(3).randbytes(20_000)
    sinks.store_chunks(spark.createDataFrame([(0, bytearray(data))], "id bigint, content binary"), "id", "content", root, chunking.SMALL)
    (key,) = os.listdir(f"{root}/recipes/sha256")
    recipe = json.load(open(f"{root}/recipes/sha256/{key}"))
    frames = [open(f"{root}/chunks/sha256/{c['digest']}", "rb").read() for c in recipe["chunks"]]
    assert key == recipe["compressedDigest"] == hashlib.sha256(b"".join(frames)).hexdigest()
    assert [c["compressedSize"] for c in recipe["chunks"]] == [len(f) for f in frames] and recipe["compressedSize"] == sum(map(len, frames))
    assert recipe["layer"] == hashlib.sha256(data).hexdigest() and recipe["size"] == 20_000
    put_manifest(root, "app/v1", [{"digest": f"sha256:{key}", "size": recipe["compressedSize"]}])
    later = time.strftime("%Y-%m-%d %H:%M:%S", time.gmtime(time.time() + 7200))
    b = Bucket(spark, root)
    assert cli.clean_plan(b, later).count() == 0
    put_manifest(root, "app/v1", [{"digest": f"sha256:{recipe['layer']}", "size": 20_000}])
    moved = reach.retargeted_layers(catalog.plain_manifests(b.manifest()), b.recipe()).first()
    assert (moved["digest"], moved["size_bytes"], moved["retargeted"]) == (key, recipe["compressedSize"], True)


def test_clean_refuses_what_it_cannot_read(spark, root):
    now = time.strftime("%Y-%m-%d %H:%M:%S", time.gmtime())
    b = Bucket(spark, root)
    path = f"{root}/manifests/org/app/v1/manifest.json"
    good = open(path, "rb").read()
    child = json.loads(good)["manifests"][0]["digest"].removeprefix("sha256:")
    for bad in (b"{broken", b"[]", good + b"x", good.replace(b'"manifests": [', b'"manifests": ["x", '), good.replace(child.encode(), b"0" * 64)):
        open(path, "wb").write(bad)
        with pytest.raises(ValueError, match="manifests that"):
            cli.clean_plan(b, now)
    open(path, "wb").write(good[:-1] + b" " * (65 << 20) + b"}")
    assert cli.clean_plan(b, now).where("reason = 'garbage'").count() == 1  # large is read, not garbage
    open(path, "wb").write(good)
    layer = json.load(open(f"{root}/manifests/org/app/_v2/manifest.json"))["layers"][0]["digest"].removeprefix("sha256:")
    os.makedirs(f"{root}/recipes/sha256")
    open(f"{root}/recipes/sha256/{'0' * 64}", "wb").write(b"{broken")
    assert cli.clean_plan(b, now).where("reason = 'garbage'").count() == 1  # nothing live needs it
    assert [tuple(r) for r in sinks.fetch_layers(spark, root).collect()] == [("0" * 64, 0, False)]
    open(f"{root}/recipes/sha256/{layer}", "wb").write(b'{"layer": "x", "chunks": "none"}')
    with pytest.raises(ValueError, match="recipes that"):
        cli.clean_plan(b, now)


def test_cat_reads_layers_held_as_chunks(spark, root):
    def held(data):
        sinks.store_chunks(spark.createDataFrame([(0, bytearray(data))], "id bigint, content binary"), "id", "content", root, chunking.SMALL)
        digest = hashlib.sha256(data).hexdigest()
        return next(n for n in os.listdir(f"{root}/recipes/sha256") if json.load(open(f"{root}/recipes/sha256/{n}"))["layer"] == digest)

    big = random.Random(5).randbytes(30_000)
    low = json.load(open(f"{root}/manifests/org/app/_v2/manifest.json"))["layers"][0]["digest"].removeprefix("sha256:")
    high = held(tar(**{"etc__os": b"new", "big": big, "usr__.wh.os": b""}))
    b = Bucket(spark, root)
    assert b.cat([low], "usr/os") == b"file"
    assert b.cat([low, high], "etc/os") == b"new" and b.cat([low, high], "big") == big
    with pytest.raises(FileNotFoundError):
        b.cat([low, high], "usr/os")
    for lost in ("f" * 64, None):
        with pytest.raises(ValueError, match="cannot be read"):
            b.cat([low, lost], "etc/os")
    first = json.load(open(f"{root}/recipes/sha256/{high}"))["chunks"][0]["digest"]
    open(f"{root}/chunks/sha256/{first}", "wb").write(b"damaged")
    with pytest.raises(ValueError, match="cannot be read"):
        b.cat([low, high], "etc/os")


def test_configuration_edits():
    c = settings.changed({}, "lifecycle.keep_last", "3", "a/*")
    c = settings.changed(c, "lifecycle.keep_tags", "x, y", "a/*")
    c = settings.changed(c, "immutable", "true")
    assert c == {"images": {"a/*": {"lifecycle": {"keep_last": 3, "keep_tags": ["x", "y"]}}}, "default": {"immutable": True}}
    c = settings.changed(settings.changed(c, "lifecycle", "", "a/*"), "immutable", "")
    assert c == {}
    for key, value in (("nope", "1"), ("immutable", "maybe"), ("lifecycle.keep_last", "-1"), ("lifecycle.max_age", "soon"), ("lifecycle", "x")):
        with pytest.raises(ValueError):
            settings.changed({}, key, value)
    with pytest.raises(ValueError):
        settings.changed({}, "chunked", "true", "a/*")
