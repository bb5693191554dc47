"""What a layered image shows: top layer wins, deletion markers, links.

Rows of a layer are (image, layer_pos, path, link, …). The visible entry of a path is
an argmax over layer positions, so one aggregation replaces walking the layers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.functions import paths
from lamella.session import splittable, written


def top_entries(entries: DataFrame) -> DataFrame:
    """(image, path, layer_pos, deleted): the uppermost mention of each path.

    ``entries``: (image, path, layer_pos, deleted). An entry and a marker in one layer
    show the entry.
    """
    return entries.groupBy("image", "path").agg(F.max(F.struct("layer_pos", (~F.col("deleted")).alias("shown"))).alias("m")).select("image", "path", "m.layer_pos", (~F.col("m.shown")).alias("deleted"))


def view(entries: DataFrame) -> DataFrame:
    """(image, path, layer_pos, link): the files an image shows.

    ``entries``: (image, layer_pos, path, link); markers are entries named ``.wh.*``.
    A marker of layer L hides the path, or everything under its directory, in layers
    below L; an opaque marker hides what its directory holds in layers below.
    """
    normal = entries.select("image", "layer_pos", paths.normal_path(F.col("path")).alias("path"), "link")
    marker = F.regexp_extract("path", r"([^/]*)\z", 1).startswith(paths.WHITEOUT)
    marks = normal.where(marker).groupBy("image", F.col("path").alias("mark")).agg(F.max("layer_pos").alias("mark_pos"))
    files = normal.where(~marker).groupBy("image", "path").agg(F.max_by(F.struct("layer_pos", "link"), "layer_pos").alias("m")).select("image", "path", "m.*")
    probes = files.withColumn("mark", F.explode(paths.whiteouts(F.col("path"))))
    hidden = probes.join(splittable(marks), ["image", "mark"]).where("mark_pos > layer_pos").select("image", "path").distinct()
    return files.join(hidden, ["image", "path"], "left_anti")


def follow_links(visible: DataFrame, wanted: DataFrame, hops: int = paths.MAX_HOPS) -> DataFrame:
    """(image, path, target, hops, state) for each wanted (image, path).

    state: file, absent, or loop after ``hops`` links. A batch of lookups takes one join
    a hop, over the lookups still open.
    """

    @F.pandas_udf("string")
    def resolved(link, target):
        import pandas as pd

        return pd.Series([paths.resolve_link(a, b) for a, b in zip(link, target, strict=True)])

    asked = wanted.select("image", "path").distinct()
    open_ = asked.withColumn("at", paths.normal_path(F.col("path")))
    links = visible.select("image", F.col("path").alias("at"), "link", F.lit(True).alias("exists"))
    done = None
    for hop in range(hops + 1):
        step = written(open_.join(links, ["image", "at"], "left"), "hops")
        ends = step.where("link is null or link = ''").select("image", "path", F.when(F.col("exists"), F.col("at")).alias("target"), F.lit(hop).alias("hops"), F.when(F.col("exists"), "file").otherwise("absent").alias("state"))
        done = ends if done is None else done.unionByName(ends)
        more = step.where("link is not null and link <> ''")
        if hop == hops or more.isEmpty():
            break
        open_ = more.select("image", "path", resolved(F.col("at"), F.col("link")).alias("at"))
    looped = more.select("image", "path", F.lit(None).cast("string").alias("target"), F.lit(hops).alias("hops"), F.lit("loop").alias("state"))
    return done.unionByName(looped)
