import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lamella.operators import temporal

SCHEMA = "history_id bigint, image string, tag string, pushed_at timestamp, digest string, size_bytes bigint, snapshot_at timestamp"
T0 = datetime(2024, 1, 1)
A, B = "sha256:" + "a" * 64, "SHA256:" + "B" * 64


def t(n):
    return T0 + timedelta(hours=n)


def build(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def versions(df, **kw):
    return sorted(((r["image"], r["tag"], r["digest"], r["size_bytes"], r["valid_from"], r["valid_to"]) for r in temporal.push_versions(df, **kw).collect()), key=repr)


def brute(rows):
    best = {}
    for h, image, tag, at, digest, size, snap in rows:
        if None in (image, tag, at):
            continue
        order = (snap is not None, snap or T0, h)
        if (image, tag, at) not in best or order > best[image, tag, at][0]:
            best[image, tag, at] = (order, digest, size)
    out, keys = [], {}
    for (image, tag, at), (_, digest, size) in sorted(best.items()):
        keys.setdefault((image, tag), []).append((at, digest, size))
    for (image, tag), states in keys.items():
        open_ = None
        for at, digest, size in states:
            gone = digest is None or not digest.strip()
            state = None if gone else (digest.strip().lower().removeprefix("sha256:"), size)
            if state != (open_[0] if open_ else None):
                if open_:
                    out.append((image, tag, *open_[0], open_[1], at))
                open_ = (state, at) if state else None
        if open_:
            out.append((image, tag, *open_[0], open_[1], None))
    return sorted(out, key=repr)


def test_states_removals_nulls_and_repeats(spark):
    rows = [
        (1, "i", "t", t(0), A, 1, t(9)),
        (2, "i", "t", t(1), A.upper(), 1, t(9)),  # another spelling, no change
        (3, "i", "t", t(2), A, None, t(9)),  # null and a number differ
        (4, "i", "t", t(3), A, None, t(9)),
        (5, "i", "t", t(4), "  ", 7, t(9)),  # removes
        (6, "i", "t", t(5), None, None, t(9)),
        (7, "i", "t", t(6), A, None, t(9)),  # begins again
        (8, "i", "t", t(6), B, 5, t(8)),  # an earlier snapshot does not count
        (8, "i", "t", t(6), B, 5, t(8)),
        (9, None, "t", t(0), A, 1, t(9)),
        (10, "i", None, t(0), A, 1, t(9)),
        (11, "i", "t", None, A, 1, t(9)),
        (12, "j", "t", t(0), None, 1, t(9)),
    ]
    a = "a" * 64
    assert versions(build(spark, rows)) == sorted([("i", "t", a, 1, t(0), t(2)), ("i", "t", a, None, t(2), t(4)), ("i", "t", a, None, t(6), None)], key=repr)


def test_malformed_digest_is_no_digest_and_removes_nothing(spark):
    rows = [(1, "i", "t", t(0), A, 1, t(9)), (2, "i", "t", t(1), " md5:" + "0" * 32, 1, t(9)), (3, "i", "t", t(2), "c" * 32, 1, t(9)), (4, "i", "t", t(3), None, 1, t(9))]
    assert versions(build(spark, rows)) == [("i", "t", "a" * 64, 1, t(0), t(1)), ("i", "t", None, 1, t(1), t(3))]


def test_empty_table(spark):
    df = temporal.push_versions(build(spark, []))
    assert df.collect() == [] and "valid_to" in df.columns


def test_clashing_extra_columns(spark):
    df = build(spark, [(1, "i", "t", t(0), A, 1, t(9))])
    for c in ("value", "order", "at", "removed", "day", "until", "content_hash", "n"):
        df = df.withColumn(c, F.lit("x"))
    assert len(versions(df)) == 1


def test_random_and_hot_keys_agree_with_brute_force(spark):
    rng = random.Random(3)
    rows = [(k, rng.choice("ij"), rng.choice(["t", "u", None]), rng.choice([None, t(rng.randrange(200))]), rng.choice([A, A, B, "", None]), rng.choice([None, 1, 2]), rng.choice([None, t(300), t(301)])) for k in range(600)]
    df = build(spark, rows)
    expected = brute(rows)
    assert versions(df) == expected
    for slice_rows in (1, 3, 40):  # keys cut into slices, with edges carried
        assert versions(df, hot_rows=5, slice_rows=slice_rows) == expected


def test_satellites_append_only_changes(spark):
    rows = [(1, "i", "t", t(0), A, 1, t(9)), (2, "i", "t", t(1), A, 2, t(9)), (3, "i", "t", t(2), B, 2, t(9))]
    first = temporal.history_satellites(build(spark, rows))
    assert sorted(r["valid_from"] for r in first["content"].collect()) == [t(0), t(2)]
    assert sorted(r["valid_from"] for r in first["extent"].collect()) == [t(0), t(1)]
    later = [(4, "i", "t", t(3), B, 2, t(9)), (5, "i", "t", t(4), B, 3, t(9)), (6, "k", "t", t(4), B, 3, t(9))]
    for hot in (10**6, 1):
        added = temporal.history_satellites(build(spark, later), first, hot_rows=hot)
        assert sorted((r["image"], r["valid_from"], r["size_bytes"]) for r in added["extent"].collect()) == [("i", t(4), 3), ("k", t(4), 3)]
        assert [(r["image"], r["valid_from"]) for r in added["content"].collect()] == [("k", t(4))]
        both = {s: first[s].unionByName(added[s]) for s in first}
        seen = temporal.view(both, temporal.HISTORY_KEY, temporal.HISTORY_SATELLITES, "removed")
        assert sorted((r["image"], r["size_bytes"], r["valid_from"], r["valid_to"]) for r in seen.collect()) == [("i", 1, t(0), t(1)), ("i", 2, t(1), t(2)), ("i", 2, t(2), t(4)), ("i", 3, t(4), None), ("k", 3, t(4), None)]


def test_hot_keys_are_counted_through_buckets(spark):
    df = spark.createDataFrame([("a", k) for k in range(9)] + [("b", k) for k in range(3)], "k string, v int")
    assert temporal.hot_keys(df, ["k"], 9) is None
    assert [r["k"] for r in temporal.hot_keys(df, ["k"], 8).collect()] == ["a"]
