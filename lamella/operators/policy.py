"""Which configuration applies to a name, and what ranks fall behind a kept number.

Patterns are configuration: the glob join is broadcast only up to ``MAX_RULES`` rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.functions import names, values
from lamella.operators.ranks import running_total

MAX_RULES = 10_000


def effective(images: DataFrame, rules: DataFrame, default: str = "default") -> DataFrame:
    """(image, pattern, keep_last, max_age, keep_tags, immutable) for each image, and for
    each field F the pattern that gave it as F_from, null where none did.

    The one best pattern (literal before wildcard, longer before shorter, then by name)
    overlays the default field by field; a keep_last of 0, an empty max_age and empty
    keep_tags do not override. A rule with a null or malformed pattern applies to nothing.
    """
    held = rules.where(F.col("image_pattern").isNotNull()).select("image_pattern", "keep_last", "max_age", "keep_tags", "immutable")
    if held.limit(MAX_RULES + 1).count() > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    fallback = held.where(F.col("image_pattern") == default).limit(1).collect()
    base = fallback[0] if fallback else {"keep_last": None, "max_age": None, "keep_tags": None, "immutable": None}
    patterns = held.where(F.col("image_pattern") != default).withColumn("regex", names.glob_pattern(F.col("image_pattern")))
    wild = F.col("image_pattern").rlike(r"[*?]")
    order = F.struct(wild.cast("int"), -F.length("image_pattern"), F.col("image_pattern"))
    asked = images.select("image").where(F.col("image").isNotNull()).distinct()
    matched = asked.join(F.broadcast(patterns), F.regexp_like("image", F.col("regex")), "left")
    best = matched.groupBy("image").agg(F.min_by(F.struct("image_pattern", "keep_last", "max_age", "keep_tags", "immutable"), order).alias("r"))
    tags = F.lit(list(base["keep_tags"])) if base["keep_tags"] else F.lit(None).cast("array<string>")
    own = {"keep_last": F.nullif("r.keep_last", F.lit(0)), "max_age": F.nullif("r.max_age", F.lit("")), "keep_tags": F.when(F.size("r.keep_tags") > 0, F.col("r.keep_tags")), "immutable": F.col("r.immutable")}
    others = {"keep_last": F.nullif(F.lit(base["keep_last"]).cast("int"), F.lit(0)), "max_age": F.nullif(F.lit(base["max_age"]).cast("string"), F.lit("")), "keep_tags": tags, "immutable": F.lit(base["immutable"]).cast("boolean")}
    return best.select(
        "image",
        F.coalesce("r.image_pattern", F.lit(default)).alias("pattern"),
        *[F.coalesce(own[f], others[f]).alias(f) for f in own],
        *[F.when(own[f].isNotNull(), F.col("r.image_pattern")).when(others[f].isNotNull(), default).alias(f"{f}_from") for f in own],
    )


def retention_summary(ranks: DataFrame, policy: DataFrame) -> DataFrame:
    """(image, state, evaluated, deleted): what a run over ``retention_ranks`` does to each image.

    state: immutable (left alone, whatever its rules), no rules (neither a number, an
    age nor tags to keep), or evaluated. Protected tags count as evaluated.
    """
    ruled = F.col("keep_last").isNotNull() | F.col("max_age").isNotNull() | F.col("keep_tags").isNotNull()
    # tags to keep alone delete nothing
    deletes = F.col("keep_last").isNotNull() | F.col("max_age").isNotNull()
    state = F.when(F.coalesce("immutable", F.lit(False)), "immutable").when(~ruled, "no rules").otherwise("evaluated")
    counted = ranks.groupBy("image").agg(F.count(F.lit(1)).alias("tags"), F.expr("count_if(beyond and aged)").alias("expired"))
    rows = counted.join(policy.select("image", state.alias("state"), deletes.alias("deletes")), "image")
    return rows.select("image", "state", F.when(F.col("state") == "evaluated", F.col("tags")).otherwise(0).alias("evaluated"), F.when((F.col("state") == "evaluated") & F.col("deletes"), F.col("expired")).otherwise(0).alias("deleted"))


def retention_ranks(tags: DataFrame, policy: DataFrame, now: str) -> DataFrame:
    """(image, tag, protected, place, beyond, aged): rank of each tag and what it exceeds.

    ``tags`` has (image, tag, at). Protected tags have no rank. ``beyond``: placed behind
    keep_last (0 or null keeps none by rank); ``aged``: strictly older than max_age, true
    where there is none (or none above 0).
    """
    known = tags.join(policy, "image")
    protected = F.coalesce(F.array_contains("keep_tags", F.col("tag")), F.lit(False))
    # newest first, by days, so that an image with many tags is many tasks; no time comes last
    day = F.coalesce(-F.unix_date(F.col("at").cast("date")), F.lit(1 << 30))
    placed = running_total(known.withColumn("protected", protected), ["image", "protected"], [F.col("at").desc(), F.col("tag").asc()], day, F.lit(1), "before")
    ranked = placed.withColumn("place", F.when(~F.col("protected"), F.col("before") + 1))
    limit = values.duration_column(F.col("max_age"))
    age = F.unix_timestamp(F.to_timestamp(F.lit(now))) - F.unix_timestamp("at")
    aged = F.when(F.coalesce(limit, F.lit(0)) > 0, F.coalesce(age > limit, F.lit(False))).otherwise(True)
    beyond = F.coalesce(F.col("place") > F.coalesce("keep_last", F.lit(0)), F.lit(False))
    return ranked.select("image", "tag", "protected", "place", beyond.alias("beyond"), aged.alias("aged"))
