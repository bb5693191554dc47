import random
from fractions import Fraction
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from lamella.llm import setjoin

SCHEMA = "record string, token string"


def members(spark, sets):
    return spark.createDataFrame([(r, t) for r, tokens in sets.items() for t in (tokens or [None])], SCHEMA)


def brute(sets, threshold):
    out = set()
    for a, b in combinations(sorted(sets), 2):
        x, y = set(sets[a]) - {None}, set(sets[b]) - {None}
        if x | y and Fraction(len(x & y), len(x | y)) >= threshold:
            out.add((a, b))
    return out


def found(spark, df, threshold, **kw):
    pairs, membership = setjoin.similar_sets(df, threshold, **kw)
    rows = [(r["a"], r["b"]) for r in setjoin.expanded(pairs, membership).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("threshold", [Fraction(7, 10), Fraction(1, 2), Fraction(1, 1), Fraction(1, 10)])
def test_random_sets_agree_with_brute_force(spark, threshold):
    rng = random.Random(threshold.numerator)
    sets = {}
    for k in range(120):
        base = set(rng.choices("abcdefghijklmnopqrstuvwxyz", weights=range(1, 27), k=rng.randrange(0, 14)))
        sets[f"r{k}"] = base | ({"hot"} if rng.random() < 0.6 else set())
        if rng.random() < 0.3:
            sets[f"s{k}"] = set(list(base)[1:])
    assert found(spark, members(spark, sets), threshold) == brute(sets, threshold)
    assert found(spark, members(spark, sets), threshold, block=3) == brute(sets, threshold)  # long lists cut to blocks


def test_nulls_repeats_empty_sets_and_clashing_columns(spark):
    rows = [("a", "x"), ("a", "x"), ("b", "x"), (None, "x"), ("c", None), ("d", None), ("e", ""), ("f", "")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("rank", F.lit(1)).withColumn("n", F.lit("n")).withColumn("tokens", F.lit(0))
    assert found(spark, df, Fraction(7, 10)) == {("a", "b"), ("e", "f")}
    assert found(spark, spark.createDataFrame([], SCHEMA), Fraction(7, 10)) == set()


def test_copies_stay_classes(spark):
    sets = {f"c{k:03}": {"a", "b", "c", "d"} for k in range(200)} | {"z": {"a", "b", "c", "d", "e"}}
    pairs, membership = setjoin.similar_sets(members(spark, sets), Fraction(7, 10))
    assert [(r["a"], r["b"], r["overlap"]) for r in pairs.collect()] == [("c000", "z", 4)]
    assert membership.where("class_id = 'c000'").count() == 200


def test_between_two_tables(spark):
    left, right = members(spark, {"1": {"a", "b"}, "2": {"c"}}), members(spark, {"1": {"a", "b"}, "3": {"c", "d"}})
    got = {(r["left_record"], r["right_record"]) for r in setjoin.similar_between(left, right, Fraction(1, 2)).collect()}
    assert got == {("1", "1"), ("2", "3")}


def test_between_keeps_types_and_meets_no_pair_of_one_table(spark):
    rng = random.Random(1)
    left = {k: set(rng.choices("abcdefgh", k=rng.randrange(0, 7))) for k in range(40)}
    right = {bytes([k, 255]): set(rng.choices("abcdefgh", k=rng.randrange(0, 7))) for k in range(40)}
    lefts = spark.createDataFrame([(r, t) for r, s in left.items() for t in s] + [(None, "a")], "record bigint, token string")
    rights = spark.createDataFrame([(r, t) for r, s in right.items() for t in s], "record binary, token string")
    expected = {(a, b) for a, x in left.items() for b, y in right.items() if x | y and 2 * len(x & y) >= len(x | y)}
    for block in (2000, 2):
        rows = [(r["left_record"], bytes(r["right_record"])) for r in setjoin.similar_between(lefts, rights, Fraction(1, 2), block).collect()]
        assert len(rows) == len(set(rows)) and set(rows) == expected


def test_partners_are_in_neighbouring_length_classes():
    for t in (Fraction(7, 10), Fraction(1, 2), Fraction(99, 100), Fraction(1, 1), Fraction(1, 10)):
        borders = setjoin.length_borders(t, 400)
        place = [sum(b <= n for b in borders) for n in range(401)]
        assert all(0 <= place[b] - place[a] <= 1 for a in range(1, 401) for b in range(a, 401) if a >= t * b)
