"""Layers as ordered chunk lists: offsets, consistency, what is new, which chunks hold a file.

Offsets are a running sum inside a recipe's own list (Arrow, over whole batches), and the
chunks of a file are filtered there too, so neither shuffles. ``digest`` is null for
chunks that are no well-formed digest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from lamella.functions import digests
from lamella.operators import catalog
from lamella.session import splittable


@F.arrow_udf(ArrayType(LongType()))
def running_starts(sizes: pa.Array) -> pa.Array:
    """Where each element of each list begins, if they follow one another; null is 0 long."""
    borders = sizes.offsets.to_numpy().astype(np.int64)
    flat = sizes.values[borders[0] : borders[-1]].fill_null(0).to_numpy(zero_copy_only=False)
    borders -= borders[0]
    before = np.concatenate([[0], np.cumsum(flat)])
    starts = before[:-1] - np.repeat(before[borders[:-1]], np.diff(borders))
    return pa.ListArray.from_arrays(pa.array(borders, pa.int32()), pa.array(starts, pa.int64()), mask=sizes.is_null() if sizes.null_count else None)


def placed_chunks(recipe: DataFrame) -> DataFrame:
    """``recipe`` with ``placed``: its chunks as (seq, digest, size_bytes, start); null lists are empty."""
    started = recipe.withColumn("_starts", running_starts(F.transform("chunks", lambda c: c["size_bytes"].cast("bigint"))))
    one = F.transform("chunks", lambda c, i: F.struct(i.cast("bigint").alias("seq"), digests.plain(c["digest"]).alias("digest"), F.coalesce(c["size_bytes"], F.lit(0)).cast("bigint").alias("size_bytes"), F.get("_starts", i).alias("start")))
    return started.withColumn("placed", F.coalesce(one, F.array().cast("array<struct<seq:bigint,digest:string,size_bytes:bigint,start:bigint>>"))).drop("_starts")


def chunk_offsets(recipe: DataFrame) -> DataFrame:
    """(recipe_id, seq, digest, size_bytes, start) of every chunk; a null size is 0 bytes."""
    return placed_chunks(recipe.select("recipe_id", "chunks")).select("recipe_id", F.inline("placed"))


def consistency(recipe: DataFrame) -> DataFrame:
    """(recipe_id, n_chunks, chunk_bytes, size_bytes, consistent): do the parts add up?

    Null sizes count 0; a recipe without a size of its own is not consistent.
    """
    total = F.aggregate(F.coalesce("chunks.size_bytes", F.array().cast("array<bigint>")), F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x, F.lit(0)))
    return recipe.select("recipe_id", F.coalesce(F.size(F.coalesce("chunks", F.array().cast("array<struct<digest:string,size_bytes:bigint,compressed_size:bigint>>"))), F.lit(0)).cast("bigint").alias("n_chunks"), total.alias("chunk_bytes"), "size_bytes", F.coalesce(total == F.col("size_bytes"), F.lit(False)).alias("consistent"))


def store_delta(recipe: DataFrame, object_listing: DataFrame) -> DataFrame:
    """Per recipe: distinct chunks, how many are not stored yet, their bytes, share deduplicated."""
    offsets = chunk_offsets(recipe).where("digest is not null")
    wanted = offsets.groupBy("recipe_id", "digest").agg(F.max("size_bytes").alias("size_bytes"))
    stored = catalog.live_objects(object_listing).where("kind = 'chunks'").select("digest").distinct().withColumn("stored", F.lit(True))
    marked = wanted.join(splittable(stored), "digest", "left").withColumn("new", F.col("stored").isNull())
    grouped = marked.groupBy("recipe_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.count_if("new").alias("n_new"), F.sum("size_bytes").alias("bytes"), F.sum(F.when(F.col("new"), F.col("size_bytes")).otherwise(0)).alias("new_bytes"))
    return grouped.withColumn("deduplicated", F.when(F.col("bytes") == 0, F.lit(0.0)).otherwise(1 - F.col("new_bytes") / F.col("bytes")))


def _touched(recipe: DataFrame) -> DataFrame:
    end = F.col("offset") + F.col("length")
    return placed_chunks(recipe).withColumn("touched", F.filter("placed", lambda c: (c["start"] < end) & (c["start"] + c["size_bytes"] > F.col("offset"))))


def overlapping(recipe: DataFrame) -> DataFrame:
    """Chunks that hold a file extent, with the slice to take of each.

    ``recipe`` has (recipe_id, chunks, file, offset, length): a row for each extent, the
    chunk list beside it. Extents without bytes touch no chunk; those beyond the layer
    keep what overlaps.
    """
    rows = _touched(recipe).select("recipe_id", "file", "offset", "length", F.inline("touched"))
    take_from = F.greatest(F.col("offset") - F.col("start"), F.lit(0))
    take_to = F.least(F.col("offset") + F.col("length") - F.col("start"), F.col("size_bytes"))
    return rows.select("recipe_id", "file", "seq", "digest", take_from.alias("take_from"), take_to.alias("take_to"))


def chunks_needed(recipe: DataFrame) -> DataFrame:
    """(recipe_id, file, needed, total): chunks one read touches of those the layer has; none without any."""
    counted = _touched(recipe).select("recipe_id", "file", F.size("touched").cast("bigint").alias("needed"), F.size("placed").cast("bigint").alias("total"))
    return counted.where("needed > 0")


def within_layer(offset: Column, length: Column, layer_size: Column) -> Column:
    """Does an extent lie inside its layer? An index that says otherwise is not to be trusted."""
    return F.coalesce((offset >= 0) & (length >= 0) & (offset + length <= layer_size), F.lit(False))


def kept_as(size: Column, chunked: Column, smallest: int) -> Column:
    """``chunks`` for layers of a chunked bucket that have at least one smallest chunk, else ``blob``."""
    return F.when(F.coalesce(chunked, F.lit(False)) & (size >= smallest), "chunks").otherwise("blob")


def savings_text(needed: Column, total: Column) -> Column:
    return F.format_string("%d of %d chunks", needed, total)


def shared_multiset(left: DataFrame, right: DataFrame) -> DataFrame:
    """Digests both sides have, as often as both have them."""
    return left.select("digest").where("digest is not null").intersectAll(right.select("digest").where("digest is not null")).groupBy("digest").agg(F.count(F.lit(1)).alias("times"))
