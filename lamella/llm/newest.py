"""The newest pushes of every image, as many as its retention rule keeps.

The rule table is configuration. It is broadcast only while its measured size is
at most ``MAX_RULES`` rows; beyond it is joined by shuffle.

Defined cases. An image without a rule of its own, of its folder or ``default`` keeps
nothing, as does a rule without keep_last when ``default`` has none either; null image
patterns match nothing; negative counts keep nothing. Of rules with the same pattern
(the pattern is unique) the greatest keep_last holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.llm.ranking import SALTS, top_n
from lamella.operators.temporal import counted_pushes

MAX_RULES = 50_000


def keep_counts(pushes: DataFrame, rules: DataFrame) -> tuple[DataFrame, int]:
    """``pushes`` with ``keep``, and the greatest keep_last of any rule."""
    slim = rules.where(F.col("image_pattern").isNotNull()).groupBy("image_pattern").agg(F.max("keep_last").alias("keep_last"))
    size, most, fallback = slim.agg(F.count(F.lit(1)), F.max("keep_last"), F.max(F.when(F.col("image_pattern") == "default", F.col("keep_last")))).first()
    folder = F.regexp_replace("image", r"/[^/]*\z", "/*")
    named = slim.select(F.col("image_pattern").alias("_exact"), F.col("keep_last").alias("_exact_keep"))
    globs = slim.select(F.col("image_pattern").alias("_folder"), F.col("keep_last").alias("_folder_keep"))
    if size <= MAX_RULES:
        named, globs = F.broadcast(named), F.broadcast(globs)
    found = pushes.join(named, pushes["image"] == F.col("_exact"), "left").join(globs, (folder == F.col("_folder")) & F.col("image").contains("/"), "left")
    own = F.when(F.col("_exact").isNotNull(), F.col("_exact_keep")).otherwise(F.col("_folder_keep"))
    kept = F.coalesce(own, F.lit(fallback).cast("int"))
    return found.withColumn("keep", kept).drop("_exact", "_exact_keep", "_folder", "_folder_keep"), most or 0


def newest_pushes(history: DataFrame, rules: DataFrame, salts: int = SALTS) -> DataFrame:
    """(image, tag, pushed_at, keep) of the pushes each image keeps."""
    pushes = counted_pushes(history).where(~F.col("removed")).select("image", "tag", F.col("at").alias("pushed_at"))
    counted, most = keep_counts(pushes, rules)
    order = [F.col("pushed_at").desc(), F.col("tag").asc()]
    return top_n(counted.where(F.col("keep") > 0), ["image"], order, ["tag", "pushed_at"], F.col("keep"), most, salts)
