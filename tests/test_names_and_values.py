import pytest
from pyspark.sql import functions as F

from lamella.functions import digests, names, paths, values


@pytest.mark.parametrize(
    ("raw", "expected"),
    [
        ("s3://b/app:v1", ("s3", "b", "app", "v1", "")),
        ("gs://b/org/app", ("gs", "b", "org/app", "latest", "")),
        ("az://b/app@sha256:" + "a" * 64, ("az", "b", "app", "", "sha256:" + "a" * 64)),
        ("local://./store/app:v1", ("local", "./store", "app", "v1", "")),
        ("local://../store/app:v1", ("local", "../store", "app", "v1", "")),
        ("local:///store/org/app:v1", ("local", "/store", "org/app", "v1", "")),
    ],
)
def test_references(raw, expected):
    assert tuple(names.parse_reference(raw)) == expected


@pytest.mark.parametrize("raw", ["", "app:v1", "http://b/a:v", "s3://", "s3:///a:v", "s3://b", "s3://b/", "s3://b/a:", "s3://b/a:..", "s3://b/../a:v", "s3://b/a//b:v", "s3://b/a@sha256:xyz", "s3://b/a\\b:v", "s3://b/a@" + "sha256:" + "a" * 64 + "\n"])
def test_bad_references(raw):
    with pytest.raises(ValueError):
        names.parse_reference(raw)


@pytest.mark.parametrize(("text", "seconds"), [("90d", 7776000), ("36h", 129600), ("1h30m", 5400), ("1.5h", 5400), ("250ms", 0.25), ("0", 0), ("-2d", -172800), ("-1m", -60)])
def test_durations(text, seconds):
    assert values.duration_seconds(text) == seconds


@pytest.mark.parametrize("text", ["", "d", "5", "1x", "1d2h", "h1", "1 h"])
def test_bad_durations(text):
    with pytest.raises(ValueError):
        values.duration_seconds(text)


def column(spark, items, expression, kind="string"):
    df = spark.createDataFrame([(k, x) for k, x in enumerate(items)], f"k int, c {kind}")
    return [r[0] for r in df.orderBy("k").select(expression(F.col("c"))).collect()]


def test_digest_forms(spark):
    a = "a" * 64
    given = [a, f" SHA256:{a.upper()}\t", f"sha256:{a}", "sha256:sha256:" + a, a[:63], a[:63] + "g", f"sha512:{a}", "", None, f"sha256: {a}"]
    expected = [a, a, a] + [None] * 7
    assert column(spark, given, digests.plain) == expected
    assert [x and x.hex() for x in column(spark, given, digests.plain_bytes)] == expected
    assert column(spark, given, digests.is_blank) == [x is None or x == "" for x in given]
    assert column(spark, given, digests.strict) == [x == f"sha256:{a}" for x in given]
    assert column(spark, [f"sha256:{a}"], digests.short) == ["a" * 12]
    assert column(spark, [f"/blobs/sha256/{a}", f"x/blobs/sha256/{a}", f"chunks/sha256/{a}\n", None], digests.object_class) == ["blobs", "", "", None]


def test_globs(spark):
    named = ["a/b", "a/bc", "a/b/c", "a.b", "axb", "a/[b]", "(a|b)", "a-b", "a^b", "a]b", "a*b"]
    matches = {
        "a/*": ["a/b", "a/bc", "a/[b]"], "a/?": ["a/b"], "a.b": ["a.b"], "*": ["a.b", "axb", "(a|b)", "a-b", "a^b", "a]b", "a*b"], "a/[b]": ["a/b"], "a/**/c": ["a/b/c"], "(a|b)": ["(a|b)"],
        "a/\\[b\\]": ["a/[b]"], "a[^a-z]b": ["a/b", "a.b", "a-b", "a^b", "a]b", "a*b"], "a[a-z]b": ["axb"], "a[x.]b": ["a.b", "axb"], "a[\\-\\]]b": ["a-b", "a]b"], "a[^]b": [], "a[]b": [], "a[b": [], "a\\": [], "a[-]b": [], "a[z-a]b": [], "a[^z-a]b": ["a/b", "a.b", "axb", "a-b", "a^b", "a]b", "a*b"],
        "a[x^]b": ["axb", "a^b"], "a\\*b": ["a*b"], "[a-]": [], "a[x-\\z]b": ["axb"],
    }
    rows = spark.createDataFrame([(g, n) for g in matches for n in named], "g string, n string").withColumn("re", names.glob_pattern(F.col("g")))
    got = {(r["g"], r["n"]) for r in rows.where(F.regexp_like("n", F.col("re"))).collect()}
    assert got == {(g, n) for g, held in matches.items() for n in held}
    assert names.glob_regex(None) is None and names.glob_regex("a[") is None


def test_references_of_buckets_patterns_and_registries():
    assert names.parse_bucket("s3://b") == ("s3", "b", "") and names.parse_bucket("gs://b/team") == ("gs", "b", "team/") and names.parse_bucket("local://./store/a/b/") == ("local", "./store", "a/b/")
    assert names.parse_bucket("local:///srv/x/") == ("local", "/srv", "x/")
    assert names.parse_pattern("s3://b/dev/*") == ("s3", "b", "dev/*") and names.parse_pattern("local://../s/app/") == ("local", "../s", "app")
    for bad in ("b/x", "http://b", "s3://", "s3:///x"):
        with pytest.raises(ValueError):
            names.parse_bucket(bad)
    for raw, expected in {
        "alpine": ("registry-1.docker.io", "library/alpine", "latest"), "nginx:1.2": ("registry-1.docker.io", "library/nginx", "1.2"), "user/app:v1": ("registry-1.docker.io", "user/app", "v1"),
        "https://ghcr.io/o/i:t": ("ghcr.io", "o/i", "t"), "localhost/x": ("localhost", "x", "latest"), "h:5000/a/b": ("h:5000", "a/b", "latest"),
    }.items():
        assert names.parse_registry(raw) == expected
    with pytest.raises(ValueError):
        names.parse_registry("ghcr.io/:x")


def test_platform_choice():
    three = ["linux/arm64/v8", "linux/amd64", "windows/amd64"]
    assert names.choose_platform([], "x/y", "h") == ("x/y", [])
    assert names.choose_platform(three, "linux/arm64", "linux/amd64") == ("linux/arm64", ["linux/amd64", "windows/amd64"])
    assert names.choose_platform(three, "", "linux/amd64") == ("linux/amd64", ["linux/arm64/v8", "windows/amd64"])
    assert names.choose_platform(["linux/s390x"], "", "linux/amd64") == ("linux/s390x", [])
    for wanted, host in (("linux/riscv64", "linux/amd64"), ("", "linux/riscv64")):
        with pytest.raises(ValueError):
            names.choose_platform(three, wanted, host)


def test_paths(spark):
    assert column(spark, ["usr/bin/tool", "./usr/bin/tool", "/usr/bin/tool", ".//./usr", ".hidden"], paths.normal_path) == ["usr/bin/tool"] * 3 + ["usr", ".hidden"]
    assert [sorted(x) for x in column(spark, ["keep.txt", "data/keep.txt", "a/b/c.txt"], paths.whiteouts)] == [
        [".wh.keep.txt"],
        [".wh.data", "data/.wh..wh..opq", "data/.wh.keep.txt"],
        sorted([".wh.a", "a/.wh.b", "a/b/.wh.c.txt", "a/.wh..wh..opq", "a/b/.wh..wh..opq"]),
    ]
    assert paths.resolve_link("etc/os-release", "../usr/lib/os-release") == "usr/lib/os-release"
    assert paths.resolve_link("etc/x", "/usr/y") == "usr/y"


def test_sizes_and_durations_in_columns(spark):
    assert column(spark, [0, 1023, 1024, 1536, 1 << 20, 3 << 30, None], values.human_bytes, "bigint") == ["0 B", "1023 B", "1.0 KB", "1.5 KB", "1.0 MB", "3.0 GB", None]
    assert column(spark, ["90d", "36h", "1h30m", "5s", "x", "", None], values.duration_column) == [7776000, 129600, 5400, 5, None, None, None]


def test_platforms(spark):
    df = spark.createDataFrame([(("linux", "arm64", "v8"),), (("linux", "amd64", None),), (("unknown", "x", None),), (None,)], "p struct<os:string,architecture:string,variant:string>")
    assert [r[0] for r in df.select(names.platform_text(F.col("p"))).collect()] == ["linux/arm64/v8", "linux/amd64", "(attestation)", "(attestation)"]
    assert [r[0] for r in df.select(names.platform_matches(F.col("p"), "linux/arm64")).collect()] == [True, False, False, False]
    assert [r[0] for r in df.select(names.platform_matches(F.col("p"), "linux/arm64/v7")).collect()] == [False] * 4


def test_grammars(spark):
    assert column(spark, ["a", "a/b-c", "A", "a//b", "a_", "", None], names.valid_name) == [True, True, False, False, False, False, False]
    assert column(spark, ["v1", "_x", ".x", "sha256:" + "a" * 64, "sha256:zz", "a" * 129], names.valid_reference) == [True, True, False, True, False, False]


def test_labels(spark):
    assert column(spark, ["a.json", "oci-layout", "x"], names.content_type) == ["application/json"] * 2 + ["application/octet-stream"]
    assert column(spark, ["s3", "gs", "az", "local"], names.cold_class) == ["INTELLIGENT_TIERING", "NEARLINE", "Cool", None]
    assert column(spark, ["ecdsa", "rsa", "x"], names.algorithm_label) == ["ECDSA_SHA_256", "RSA_PKCS1_SHA_256", "UNKNOWN"]
    assert column(spark, ["a/b c+d"], lambda c: names.copy_source(F.lit("bk"), c)) == ["bk/a/b%20c%2Bd"]
