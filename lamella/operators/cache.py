"""A bounded cache with expiry, replayed over a log of insertions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def held(log: DataFrame, scope: list[str], key: str, at: str, seq: str, most: int, seconds: int, now) -> DataFrame:
    """Entries a first-in first-out cache of ``most`` entries holds at ``now``, per scope.

    A refilled key keeps its place of first insertion and its newest time; entries older
    than ``seconds`` are gone. ``rn <= most`` is pushed below the shuffle by Spark.
    """
    entries = log.groupBy(*scope, key).agg(F.min(seq).alias("seq"), F.max(at).alias("at"))
    w = Window.partitionBy(*scope).orderBy(F.col("seq").desc())
    kept = entries.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most)
    return kept.where(F.col("at") + F.expr(f"interval {int(seconds)} seconds") > now).drop("rn")
