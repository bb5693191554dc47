import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lamella.llm import newest, ranking

HISTORY = "history_id bigint, image string, tag string, pushed_at timestamp, digest string, size_bytes bigint, snapshot_at timestamp"
RULES = "image_pattern string, keep_last int"
T0 = datetime(2024, 1, 1)


def pushes(spark, items):
    return spark.createDataFrame([(k, i, t, T0 + timedelta(hours=h), d, 1, T0) for k, (i, t, h, d) in enumerate(items)], HISTORY)


def kept(spark, items, rules, **kw):
    df = pushes(spark, items).withColumn("keep", F.lit("clash")).withColumn("_rank", F.lit(0)).withColumn("keep_last", F.lit(9))
    got = newest.newest_pushes(df, spark.createDataFrame(rules, RULES), **kw)
    return sorted((r["image"], r["tag"], (r["pushed_at"] - T0).seconds // 3600) for r in got.collect())


def test_rules_ties_and_removals(spark):
    items = [("a/b", "x", 1, "d"), ("a/b", "y", 1, "d"), ("a/b", "z", 0, "d"), ("a/b", "gone", 5, " "), ("a/c", "x", 1, "d"), ("a/c", "y", 2, "d"), ("solo", "x", 1, "d"), ("solo", "x", 2, "d"), ("a/b", None, 9, "d")]
    rules = [("default", 1), ("a/*", 2), ("a/c", None), (None, 9), ("*", 7)]
    assert kept(spark, items, rules) == [("a/b", "x", 1), ("a/b", "y", 1), ("a/c", "y", 2), ("solo", "x", 2)]


def test_no_rule_keeps_nothing_and_empty_tables(spark):
    assert kept(spark, [("a", "x", 1, "d")], [("default", None)]) == []
    assert kept(spark, [("a", "x", 1, "d")], []) == []
    assert kept(spark, [("a", "x", 1, "d")], [("a", -1)]) == []
    assert kept(spark, [], [("default", 3)]) == []


def test_top_n_of_a_hot_group(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.8 else f"g{rng.randrange(5)}", rng.choice([None, rng.randrange(50)]), k) for k in range(3000)]
    df = spark.createDataFrame(rows, "g string, score int, id int")
    order = [F.col("score").desc_nulls_last(), F.col("id").asc()]
    got = ranking.top_n(df, ["g"], order, ["id"], F.lit(7), 7, salts=8).collect()
    expected = []
    for g in {r[0] for r in rows}:
        expected += sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is None, -(r[1] or 0), r[2]))[:7]
    assert sorted(map(tuple, got), key=repr) == sorted(expected, key=repr)
