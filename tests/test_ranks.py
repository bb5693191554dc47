from pyspark.sql import functions as F

from lamella.operators import ranks


def test_positions_number_every_row_once(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("g"), F.xxhash64(F.col("id") % 4000).alias("h"))
    rows = ranks.positions(df, ["g"], "h", 16).collect()
    for g in range(3):
        held = sorted((r["position"], r["h"]) for r in rows if r["g"] == g)
        assert [p for p, _ in held] == list(range(len(held)))
        assert [h for _, h in held] == sorted(h for _, h in held)


def test_totals_carry_over_slices(spark):
    df = spark.createDataFrame([("a", k, k * k) for k in range(50)] + [("b", k, 1) for k in range(7)] + [(None, 1, 1)], "g string, k int, v bigint")
    rows = ranks.running_total(df, ["g"], [F.col("k")], F.expr("k div 8"), F.col("v"), "before").collect()
    assert {(r["g"], r["k"]): r["before"] for r in rows} == {("a", k): sum(i * i for i in range(k)) for k in range(50)} | {("b", k): k for k in range(7)}
    assert ranks.running_total(df.where("false"), ["g"], [F.col("k")], F.lit(0), F.col("v"), "before").collect() == []
