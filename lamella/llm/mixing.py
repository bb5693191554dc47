"""Mixing sources to target weights by a low-discrepancy schedule.

Each source is a stream of its documents in hashed order, repeated up to its cap and
cut into blocks of equal tokens. The mixture is a row of slots; slot i takes the
source in whose share the golden-ratio point frac(i phi) falls, and the k-th slot of a
source takes its k-th block, by a join. The length is the greatest at which no source
runs out, so shares are met exactly up to one block and the schedule's discrepancy.

Points are integers mod 2^62, so the schedule stays even at any length; a table of
equal cells of that range leads from a point to the few borders near it. Blocks grow
with the mixture, so that there are at most ``MAX_SLOTS`` of them.

Scale. Running totals are two-level (slices of the hashed order), so a source with a
third of all rows is many tasks. Only per-source totals reach the driver, at most
``MAX_SOURCES`` rows, checked: targets are configuration.

Defined cases. Sources compare in lower case; a target given twice adds up its shares
with the greater cap. Targets without documents (or without a share or a repeat) take
no part: the others' shares are scaled to one, and the report shows the target and the
zero reached. Documents of other sources, null sources, null, empty and token-less
texts are not used. A null cap counts as 1.
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamella.llm.tokens import VOCABULARY, with_tokens
from lamella.operators.ranks import running_total
from lamella.session import written

MAX_SOURCES = 100_000
#: Tokens of a block; a mixture too short for MIN_SLOTS of them gets shorter ones, one of
#: more than MAX_SLOTS longer ones.
BLOCK = 128
MIN_SLOTS = 1000
MAX_SLOTS = 1 << 28
SLICE_BITS = 10
SLOTS_A_SLICE = 1 << 16
#: Points are multiples of 2^-62.
BITS = 62
#: The golden ratio less 1, in that unit.
PHI = (math.isqrt(5 << (2 * BITS)) - (1 << BITS)) >> 1
#: Cells of the range for each source, at least.
CELLS = 4

SCHEMA = "slot bigint, source string, doc_id bigint, repeat bigint, token_from bigint, token_to bigint"


def source_key(c: Column) -> Column:
    return F.lower(c)


def document_sizes(documents: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, hashed, tokens) of the documents of a target; written once."""
    wanted = targets.where(F.col("source").isNotNull()).select(source_key(F.col("source")).alias("source")).distinct()
    texts = documents.where(F.length("text") > 0).select(F.col("doc_id").cast("bigint").alias("doc_id"), source_key(F.col("source")).alias("source"), "text").join(wanted, "source", "left_semi")
    sized = with_tokens(texts, vocabulary=vocabulary)
    return written(sized.where("tokens > 0").select("doc_id", "source", F.xxhash64("doc_id", "text").alias("hashed"), "tokens"), "sized")


def source_totals(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, available): one row for each target."""
    named = targets.where(F.col("source").isNotNull())
    goal = named.groupBy(source_key(F.col("source")).alias("source")).agg(F.sum(F.greatest(F.coalesce(F.col("target_share"), F.lit(0.0)), F.lit(0.0))).alias("target_share"), F.max(F.coalesce(F.col("max_repeats"), F.lit(1))).alias("max_repeats"))
    have = sizes.groupBy("source").agg(F.sum("tokens").alias("available"))
    return goal.join(have, "source", "left").withColumn("available", F.coalesce("available", F.lit(0)))


def golden_point(i: Column) -> Column:
    """i x PHI mod 2^BITS for 0 <= i < 2^BITS, by halves of the factors, as a product would overflow."""
    half = BITS // 2
    mask = (1 << half) - 1
    low, high = i.bitwiseAND(mask), F.shiftright(i, half)
    cross = (low * (PHI >> half) + high * (PHI & mask)).bitwiseAND(mask)
    return (F.shiftleft(cross, half) + low * (PHI & mask)).bitwiseAND((1 << BITS) - 1)


def borders(weights: list[float]) -> list[int]:
    """Ends of the sources' parts of 0 .. 2^BITS; the last is 2^BITS."""
    exact = [Fraction(w) for w in weights]
    total, reached, out = sum(exact), Fraction(0), []
    for w in exact:
        reached += w
        out.append(int(reached * (1 << BITS) / total))
    return out


def _cells(names: list[str], ends: list[int]) -> tuple[int, list[tuple[int, list[int], list[str]]]]:
    """(shift, rows): the cell of a point is point >> shift; a row has the borders inside the
    cell and the sources before, between and after them."""
    bits = min(BITS, (CELLS * len(names)).bit_length())
    shift, rows, k = BITS - bits, [], 0
    for cell in range(1 << bits):
        while ends[k] <= cell << shift:
            k += 1
        first = k
        while ends[k] < (cell + 1) << shift:
            k += 1
        rows.append((cell, ends[first:k], names[first : k + 1]))
    return shift, rows


def schedule(spark, weights: list[tuple[str, float, int]], slots: int) -> DataFrame:
    """(slot, source, rank): the k-th slot of its source, cut where a source's blocks end.

    ``weights``: (source, weight, blocks it has).
    """
    shift, rows = _cells([n for n, _, _ in weights], borders([w for _, w, _ in weights]))
    cells = F.broadcast(spark.createDataFrame(rows, "cell bigint, ends array<bigint>, names array<string>"))
    points = spark.range(slots).select(F.col("id").alias("slot"), golden_point(F.col("id")).alias("point")).withColumn("cell", F.shiftright("point", shift))
    drawn = points.join(cells, "cell").select("slot", F.get("names", F.size(F.filter("ends", lambda e: e <= F.col("point")))).alias("source"))
    ranked = running_total(drawn, ["source"], [F.col("slot")], F.expr(f"slot div {SLOTS_A_SLICE}"), F.lit(1), "rank")
    ranked = written(ranked.select("slot", "source", "rank"), "schedule")
    blocks = F.broadcast(spark.createDataFrame([(n, b) for n, _, b in weights], "source string, blocks bigint"))
    end = ranked.join(blocks, "source").where("rank >= blocks").agg(F.min("slot")).first()[0]
    return ranked if end is None else ranked.where(F.col("slot") < end)


def mix(sizes: DataFrame, totals: DataFrame, block: int | None = None, total_tokens: int | None = None) -> DataFrame:
    """The mixture: slot, source, doc_id, repeat, token_from, token_to.

    Every slot holds exactly ``block`` tokens, by default as many as BLOCK and MIN_SLOTS
    say. ``total_tokens`` may ask for less than the most that the caps allow.
    """
    spark = sizes.sparkSession
    rows = totals.limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    usable = sorted((r["source"], float(r["target_share"]), int(r["max_repeats"]), int(r["available"])) for r in rows if r["target_share"] > 0 and r["max_repeats"] >= 1 and r["available"] > 0)
    share = sum(s for _, s, _, _ in usable)
    longest = min((have * times * share / s for _, s, times, have in usable), default=0)
    if total_tokens is not None:
        longest = min(longest, total_tokens)
    block = block or max(1, min(BLOCK, int(longest) // MIN_SLOTS), int(longest) // MAX_SLOTS)
    weights = [(n, s / share, have * times // block) for n, s, times, have in usable]
    slots = min((int(b / w) for _, w, b in weights), default=0)
    if total_tokens is not None:
        slots = min(slots, total_tokens // block)
    if slots < 1:
        return spark.createDataFrame([], SCHEMA)
    slot_rows = schedule(spark, weights, slots)
    used = {r["source"]: r["n"] for r in slot_rows.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
    have = {n: a for n, _, _, a in usable}
    per_source = spark.createDataFrame([(n, have[n], k * block) for n, k in used.items()], "source string, available bigint, quota bigint")

    streams = running_total(sizes, ["source"], [F.col("hashed"), F.col("doc_id"), F.col("tokens")], F.shiftright("hashed", 64 - SLICE_BITS), F.col("tokens"), "offset")
    streams = streams.join(F.broadcast(per_source), "source")  # a row for each source
    # occurrence r begins at r * available + offset of the repeated stream
    turns = streams.where("offset < quota").withColumn("repeat", F.explode(F.expr("sequence(0L, (quota - 1 - offset) div available)")))
    placed = turns.withColumn("begin", F.expr("repeat * available + offset")).withColumn("end", F.expr("least(quota, begin + tokens)"))
    parts = placed.withColumn("rank", F.explode(F.expr(f"sequence(begin div {block}, (end - 1) div {block})")))
    cut = parts.select("source", "rank", "doc_id", "repeat", F.expr(f"greatest(begin, rank * {block}) - begin").alias("token_from"), F.expr(f"least(end, (rank + 1) * {block}) - begin").alias("token_to"))
    return cut.join(slot_rows, ["source", "rank"]).select("slot", "source", "doc_id", "repeat", "token_from", "token_to")


def share_report(mixture: DataFrame, totals: DataFrame) -> DataFrame:
    """Per target: its share, the share aimed at (scaled to the sources that have documents),
    tokens and share reached, most uses of one document."""
    got = mixture.groupBy("source").agg(F.sum(F.col("token_to") - F.col("token_from")).alias("tokens"), (F.max("repeat") + 1).alias("most_uses"))
    everything = Window.partitionBy()  # one row for each target
    joined = totals.join(got, "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    mixed = F.sum("tokens").over(everything)
    aim = F.when((F.col("available") > 0) & (F.col("max_repeats") >= 1), F.col("target_share")).otherwise(F.lit(0.0))
    scaled = F.when(F.sum(aim).over(everything) > 0, aim / F.sum(aim).over(everything)).otherwise(F.lit(0.0))
    return joined.select("source", "target_share", scaled.alias("aim"), "max_repeats", "available", "tokens", F.coalesce("most_uses", F.lit(0)).alias("most_uses"), F.when(mixed > 0, F.col("tokens") / mixed).otherwise(F.lit(0.0)).alias("share"))
