"""Reference counts kept over a stream of manifest rows (an extension).

The grace period of garbage collection becomes the watermark: a reference that arrives
later than that may have been collected already and is dropped as late.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.functions import digests


def layer_references(manifests: DataFrame, grace: str = "1 hour", window: str = "1 day") -> DataFrame:
    """(period, digest, refs): references to each layer per window of stored_at.

    Works on a stream (append or update mode) and on a table alike.
    """
    times = manifests.withColumn("stored_at", F.col("stored_at").cast("timestamp"))
    if manifests.isStreaming:
        times = times.withWatermark("stored_at", grace)
    rows = times.select("stored_at", F.explode("layers.digest").alias("digest")).withColumn("digest", digests.plain(F.col("digest"))).where("digest is not null")
    counted = rows.groupBy(F.window("stored_at", window).alias("w"), "digest").agg(F.count(F.lit(1)).alias("refs"))
    return counted.select(F.col("w.start").alias("period"), "digest", "refs")
