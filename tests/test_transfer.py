import hashlib
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from lamella import cli
from lamella.functions import names
from lamella.operators import chunking, signing
from lamella.sources import archives, sinks, transfer
from lamella.sources.bucket import Bucket
from lamella.sources.files import ArrowFiles, files, local_path, require_shared
from test_bucket import put_manifest, root, tar  # noqa: F401


def sha(data):
    return hashlib.sha256(data).hexdigest()


def layout(folder, *layers, config=b"{}"):
    """An image as ``push_image`` reads it."""
    store = files(str(folder))
    for data in (config, *layers):
        store.write(f"blobs/sha256/{sha(data)}", data)
    body = {"schemaVersion": 2, "config": {"digest": f"sha256:{sha(config)}", "size": len(config)}, "layers": [{"mediaType": "t", "digest": f"sha256:{sha(x)}", "size": len(x)} for x in layers]}
    store.write("manifest.json", json.dumps(body).encode())
    return str(folder)


def listed(folder):
    return sorted(os.path.relpath(os.path.join(f, n), folder) for f, _, held in os.walk(folder) for n in held)


def test_push_index_cat_and_pull(spark, tmp_path):
    big = random.Random(2).randbytes(20_000)
    low, high = tar(etc__os=b"old", small=b"s" * 5), tar(etc__os=b"new", big=big, link="etc/os")
    source, store, into = layout(tmp_path / "src", low, high), str(tmp_path / "store"), str(tmp_path / "out")
    files(store).write("config.yaml", b"chunked: true\n")
    counts = transfer.push_image(spark, source, store, "team/app", "v1", fmt=chunking.SMALL)
    assert counts["layers"] == counts["chunked"] == 2 and counts["new_blobs"] == 1 and counts["new_chunks"] <= counts["chunks"]
    assert transfer.push_image(spark, source, store, "team/app", "v2", fmt=chunking.SMALL)["new_chunks"] == 0
    b = Bucket(spark, store)
    assert b.config()["chunk_format"] == chunking.SMALL.number
    with pytest.raises(ValueError, match="format"):
        transfer.push_image(spark, source, store, "team/app", "v3")
    layers = [x["digest"].removeprefix("sha256:") for x in json.load(open(f"{store}/manifests/team/app/v1/manifest.json"))["layers"]]
    assert {r["media_type"] for r in b.inspect("team/app", "v1").collect()} == {names.ZSTD_LAYER}
    # the index says where a file is, so only its chunks are read
    found = b.find(layers, "small")
    assert found.data == b"s" * 5 and found.indexed and found.layer == layers[0] and found.chunks_fetched == 1
    found = b.find(layers, "link")
    assert found.data == b"new" and found.layer == layers[1] and found.chunks_fetched == 1 < found.chunks_total
    assert b.cat(layers, "big") == big
    rows = {(r["layer"], r["path"]): r for r in b.file_index().collect()}
    assert rows[sha(high), "link"]["link"] == "etc/os" and rows[sha(high), "big"]["size"] == len(big) and {r["state"] for r in rows.values()} == {"ok"}
    at = rows[sha(high), "big"]["offset"]
    assert high[at : at + len(big)] == big
    assert all(r["ok"] for r in sinks.verify_compressed(spark, store).collect()) and all(r["ok"] for r in sinks.fetch_layers(spark, store).collect())
    assert transfer.pull_image(spark, store, "team/app", "v1", into) == {"layers": 2, "bytes": len(low) + len(high)}
    assert open(f"{into}/blobs/sha256/{sha(high)}", "rb").read() == high
    again = str(tmp_path / "again")
    assert transfer.push_image(spark, into, again, "x", "y")["new_blobs"] == 3  # not chunked: all blobs whole
    # an index that points outside is not believed; one that cannot be read is a state
    key = f"indexes/sha256/{layers[1]}"
    import zstandard

    lie = json.dumps({"layer": sha(high), "files": [{"path": "big", "offset": 10, "size": 10**9}]}).encode()
    files(store).write(key, zstandard.ZstdCompressor().compress(lie))
    with pytest.raises(ValueError, match="outside"):
        b.cat(layers, "big")
    files(store).write(key, b"junk")
    assert [r["state"][:14] for r in b.file_index().where(F.col("compressed_digest") == layers[1]).collect()] == ["cannot be read"]
    with pytest.raises(ValueError, match="layer 1"):
        b.cat(layers, "big")
    victim = json.load(open(f"{store}/recipes/sha256/{layers[1]}"))["chunks"][0]["digest"]
    files(store).write(f"chunks/sha256/{victim}", b"short")
    assert {r["compressed_digest"]: r["ok"] for r in sinks.verify_compressed(spark, store).collect()} == {layers[0]: True, layers[1]: False}
    with pytest.raises(ValueError, match="layer 1 is"):
        transfer.pull_image(spark, store, "team/app", "v1", into)
    files(source).write(f"blobs/sha256/{sha(low)}", b"other")
    with pytest.raises(ValueError, match="damaged"):
        transfer.push_image(spark, source, again, "x", "z")


def test_copy_between_buckets(spark, root, tmp_path):  # noqa: F811
    target = str(tmp_path / "target")
    counts = transfer.copy_image(spark, root, target, "org/app", "v1", "copy/app", "x")
    assert counts["skipped"] == 0 and counts["copied"] == 4 and Bucket(spark, target).doctor().count() == 0
    assert transfer.copy_image(spark, root, target, "org/app", "_v2")["dropped"] == 1  # a signature covers its place
    one = transfer.copy_image(spark, root, target, "org/app", "v1", "copy/app", "single", platform="linux/amd64")
    assert one["skipped"] == 3 and "layers" in json.load(open(f"{target}/manifests/copy/app/single/manifest.json"))
    with pytest.raises(ValueError, match="has no"):
        transfer.copy_image(spark, root, target, "org/app", "v1", platform="linux/s390x")
    with pytest.raises(ValueError, match="no tag"):
        transfer.copy_image(spark, root, target, "org/none", "v1")
    files(target).write("config.yaml", b"images:\n  copy/*: {immutable: true}\n")
    with pytest.raises(PermissionError):
        transfer.copy_image(spark, root, target, "org/app", "v1", "copy/app", "x")
    to = Bucket(spark, target)
    transfer.refuse_immutable(to, "copy/app", "new")
    transfer.refuse_immutable(to, "copy/app", "x", force=True)
    layer = json.load(open(f"{root}/manifests/org/app/_v2/manifest.json"))["layers"][0]["digest"].removeprefix("sha256:")
    os.unlink(f"{root}/blobs/sha256/{layer}")
    with pytest.raises(ValueError, match="not stored"):
        transfer.copy_image(spark, root, str(tmp_path / "other"), "org/app", "_v2")


def test_copy_of_chunked_layers(spark, tmp_path):
    store, target = str(tmp_path / "store"), str(tmp_path / "target")
    files(store).write("config.yaml", b"chunked: true\n")
    transfer.push_image(spark, layout(tmp_path / "src", tar(a=random.Random(1).randbytes(9000))), store, "a", "v1", fmt=chunking.SMALL)
    transfer.copy_image(spark, store, target, "a", "v1")
    assert [k for k in listed(target) if not k.startswith("manifests")] == [k for k in listed(store) if not k.startswith(("manifests", "config"))]
    assert Bucket(spark, target).doctor(deep=True).count() == 0
    chunk = next(k for k in listed(target) if k.startswith("chunks/"))
    os.unlink(f"{target}/{chunk}")
    assert [r["check"] for r in Bucket(spark, target).doctor(deep=True).collect()] == ["chunk"]
    with pytest.raises(ValueError, match="chunks not stored"):
        transfer.copy_image(spark, target, str(tmp_path / "third"), "a", "v1")


def test_doctor(spark, root):  # noqa: F811
    b = Bucket(spark, root)
    assert [(r["check"], r["image"]) for r in b.doctor().collect()] == [("orphan", None)]
    files(root).write("config.yaml", b"- a list\n")
    files(root).write("manifests/org/app/bad/manifest.json", b"{cut")
    put_manifest(root, "other/app/v1", [{"digest": "sha256:" + "e" * 64, "size": 1}])
    found = {(r["check"], r["image"], r["tag"]) for r in b.doctor().collect()}
    assert found == {("orphan", None, None), ("config", None, None), ("manifest", "org/app", "bad"), ("missing", "other/app", "v1")}
    files(root).write("recipes/sha256/" + "a" * 64, b"{}")
    assert ("recipe", "recipes/sha256/" + "a" * 64) in {(r["check"], r["detail"]) for r in b.doctor("other/", deep=True).collect()}
    empty = f"{root}/empty"
    with pytest.raises(FileNotFoundError):
        Bucket(spark, empty).doctor()
    os.makedirs(empty)
    assert [r["check"] for r in Bucket(spark, empty).doctor().collect()] == ["layout"]


def test_signatures_are_bound_to_a_place(spark, root):  # noqa: F811
    b = Bucket(spark, root)
    for name in ("org/app/_v2/signatures/k.json",):
        os.unlink(f"{root}/manifests/{name}")

    def signer(payload):
        return hashlib.sha256(b"secret" + payload).digest()

    key = b.sign("org/app", "v1", "store", "file:key", b"der", "X", signer, "2024-01-01T00:00:00Z")
    assert key.endswith(f"{sha(b'der')[:16]}.json")
    tags = b.manifest().where("tag is not null").select("image", "tag", "digest")
    check = lambda payload, raw, key_id: F.unhex(F.sha2(F.concat(F.lit(b"secret"), payload.cast("binary")), 256)) == raw
    assert {r["tag"]: r["reason"] for r in signing.verify(tags, b.signatures(), "store", check).collect()} == {"v1": "ok", "_v2": "no signature"}
    assert {r["tag"]: r["reason"] for r in signing.verify(tags, b.signatures(), "elsewhere", check).collect()}["v1"] == "bad signature"
    files(root).write("manifests/org/app/_v2/signatures/x.json", files(root).read(key))  # a record moved to another tag
    assert {r["tag"]: r["reason"] for r in signing.verify(tags, b.signatures(), "store", check).collect()}["_v2"] == "digest changed"


def test_deletions_tell_each_key(spark, tmp_path):
    store = files(str(tmp_path))
    store.write("a/x", b"1")
    os.makedirs(tmp_path / "a/folder")
    plan = spark.createDataFrame([("a/x",), ("a/none",), ("a/folder",), ("../out",), (None,)], "object_key string")
    states = {r["object_key"]: r["state"].split(":")[0] for r in sinks.deletions(plan, str(tmp_path)).collect()}
    assert states == {"a/x": "deleted", "a/none": "absent", "a/folder": "failed", "../out": "failed"}
    with pytest.raises(OSError, match="2 objects"):
        sinks.delete_objects(plan, str(tmp_path), confirm=True)


def test_only_new_objects_are_written(spark, tmp_path):
    store = files(str(tmp_path))
    store.write("a", b"old")
    os.utime(tmp_path / "a", (1, 1))
    sinks.put_objects(spark.createDataFrame([("a", bytearray(b"new")), ("b", bytearray(b"new"))], "object_key string, content binary"), str(tmp_path), only_new=True)
    assert store.read("a") == b"old" and os.path.getmtime(tmp_path / "a") > 1 and store.read("b") == b"new"


def test_frames_are_read_ahead_in_order():
    class Store:
        def read(self, key):
            return key[-1].encode()

    chunks = [{"digest": c, "compressedSize": 1} for c in "abcdefghij"]
    assert b"".join(archives.frames(Store(), chunks)) == b"abcdefghij"
    with pytest.raises(OSError):
        list(archives.frames(Store(), [*chunks, {"digest": "k", "compressedSize": 2}]))


def test_files_of_both_kinds(tmp_path):
    from pyarrow import fs

    arrow = ArrowFiles.__new__(ArrowFiles)
    arrow.fs, arrow.root = fs.LocalFileSystem(), str(tmp_path)
    for store in (files(str(tmp_path)), arrow):
        store.write("a/b/_x", iter([b"1", b"23"]))
        store.write("a/.y", b"")
        assert store.read("a/b/_x") == b"123" and store.exists("a/.y") and not store.exists("a/b") and store.reachable()
        assert sorted((k, n) for k, n, _ in store.listed("", True)) == [("a/.y", 0), ("a/b/_x", 3)]
        assert [k for k, _, _ in store.listed("a/", False)] == ["a/.y"] and store.folders("a/") == ["a/b/"] and store.folders("none/") == []
        store.touch("a/b/_x")
        store.delete("a/.y")
        with pytest.raises(FileNotFoundError):
            store.delete("a/.y")
        for bad in ("../x", "a//b", "/etc/x", "a/./b", ""):
            with pytest.raises(ValueError):
                store.write(bad, b"")
        store.delete("a/b/_x")
    assert local_path("file:///x/y") == "/x/y" and local_path("local://./s") == "./s" and local_path("/x") == "/x" and local_path("s3a://b/p") is None


def test_local_roots_need_to_be_shared_on_a_cluster():
    class Conf(dict):
        def get(self, key, default=None):
            return dict.get(self, key, default)

    class Spark:
        def __init__(self, master, **conf):
            self.conf = Conf(conf)
            self.sparkContext = type("Context", (), {"master": master, "getConf": lambda _: Conf(conf)})()

    require_shared(Spark("local[4]"), "/x")
    require_shared(Spark("spark://h"), "s3://b/x")
    require_shared(Spark("spark://h", **{"spark.lamella.shared.roots": "/a,/x"}), "file:/x/y")
    require_shared(Spark("spark://h", **{"spark.checkpoint.dir": "file:///cp"}), "/cp/z")
    for root in ("/x", "/cpx"):  # noqa: F402
        with pytest.raises(RuntimeError):
            require_shared(Spark("spark://h", **{"spark.checkpoint.dir": "file:///cp"}), root)


def test_command_line(spark, root, tmp_path, capsys, monkeypatch):  # noqa: F811
    monkeypatch.setattr(cli, "session", lambda name: spark)

    def run(*args):
        code = cli.main([args[0], root, *args[1:], "--output", "json"])
        text = capsys.readouterr().out
        return code, json.loads(text) if args[0] != "config" else text

    assert run("list") == (0, [{"image": "org/app", "n_tags": 2, "tags": ["_v2", "v1"]}])
    assert [r["pos"] for r in run("inspect", "org/app", "v1")[1]] == [0, 1]
    assert run("policy")[1][0]["keep_last"] == 1
    assert [r["check"] for r in run("doctor", "--deep")[1]] == ["orphan"] and run("signatures")[1][0]["slug"] == "k"
    monkeypatch.chdir(os.path.dirname(root))
    assert cli.main(["inspect", f"local://./{os.path.basename(root)}/org/app:v1", "--output", "json"]) == 0 and len(json.loads(capsys.readouterr().out)) == 2
    assert cli.main(["list", f"local://./{os.path.basename(root)}/none", "--output", "json"]) == 0 and capsys.readouterr().out == "[]\n"
    before = listed(root)
    assert {r["reason"] for r in run("clean")[1]} == {"expired", "garbage"} and listed(root) == before
    run("config", "immutable=true", "--image", "org/*")
    assert cli.main(["delete", root, "org/app", "v1", "--confirm"]) == 1
    assert "immutable" in capsys.readouterr().err and listed(root) == before
    assert run("pull", "org/app", "v1", str(tmp_path / "out"))[1][0]["layers"] == 2
    assert run("push", str(tmp_path / "out"), "org/back", "v1")[1][0]["new_blobs"] == 0
    assert [r["reason"] for r in run("clean", "--confirm")[1]] == ["garbage"]
    assert len(run("delete", "org/app", "_v2", "--force", "--confirm")[1]) == 2
    assert run("list")[1] == [{"image": "org/app", "n_tags": 1, "tags": ["v1"]}, {"image": "org/back", "n_tags": 1, "tags": ["v1"]}]
