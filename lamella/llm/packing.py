"""Filling containers of fixed capacity with items, planned on the length histogram.

Best-fit decreasing runs on the driver over (length, count), not over items: equal
items fill equal containers, so a step places whole ranges of them. The plan maps
ranks within a length to containers; items get their rank and join the plan.

Scale. The histogram has at most capacity rows and the plan a small multiple of that,
so both are bounded by ``MAX_CAPACITY``, and the plan is broadcast; specs whose
capacities add up to more are planned in groups, one after the other. Items are shuffled
once, in slices of a length, so a length that a third of all items share is many tasks.

Defined cases. Null and empty texts are no items. An item beyond the capacity is cut
into full pieces and a rest, any other is whole. Items of size 0 go to container 0.
Specs without a name or with a capacity below 1 are dropped, repeated specs collapse.
Null ids are kept: their items are packed like any other. No items, no containers.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.llm.tokens import VOCABULARY, with_tokens
from lamella.operators.ranks import positions
from lamella.session import written

#: Largest capacity, and sum of those planned together: bounds the histogram on the driver.
MAX_CAPACITY = 500_000
#: Specs are configuration; more than this many are an error.
MAX_PACKS = 1000
#: Rows aimed at for one slice of a length.
SLICE = 200_000


def best_fit(capacity: int, histogram: dict[int, int]) -> list[tuple[int, int, int, int, int]]:
    """Plan rows (length, first_rank, last_rank, container, per_container).

    Items first_rank .. last_rank of a length go ``per_container`` each to ``container``
    and those after it. Equals best-fit decreasing over the items one by one: the
    container with the least sufficient room stays that until the length no longer fits.
    """
    room: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []
    plan = []
    opened = 0

    def put(left: int, first: int, count: int) -> None:
        if not count:
            return
        if left not in room:
            room[left] = []
            insort(rooms, left)
        room[left].append((first, count))

    for length in sorted((k for k, n in histogram.items() if k > 0 and n > 0), reverse=True):
        if length > capacity:
            raise ValueError(f"length {length} exceeds the capacity {capacity}")
        rest, rank = histogram[length], 0
        while rest:
            k = bisect_left(rooms, length)
            if k < len(rooms):
                left = rooms[k]
                first, count = room[left].pop()
                if not room[left]:
                    del room[left]
                    rooms.pop(k)
            else:
                left, first, count = capacity, opened, -(-rest // (capacity // length))
                opened += count
            fits = left // length
            full = min(count, rest // fits)
            if full:
                plan.append((length, rank, rank + full * fits - 1, first, fits))
                put(left - fits * length, first, full)
                rank, rest = rank + full * fits, rest - full * fits
            if rest and full < count:
                plan.append((length, rank, rank + rest - 1, first + full, rest))
                put(left - rest * length, first + full, 1)
                full, rank, rest = full + 1, rank + rest, 0
            put(left, first + full, count - full)
    if histogram.get(0):
        plan.append((0, 0, histogram[0] - 1, 0, histogram[0]))
    return plan


def pack(items: DataFrame, specs: DataFrame, together: int = MAX_CAPACITY) -> DataFrame:
    """Assign (item_id, hashed, size) to containers of every spec (pack_name, capacity).

    Returns pack_name, capacity, container, item_id, piece, offset, size. ``hashed`` is
    a bigint hash that tells items apart; items equal in it may swap places. Capacities
    that add up to at most ``together`` are planned together.
    """
    spark = items.sparkSession
    found = specs.where("pack_name is not null and capacity >= 1").select("pack_name", "capacity").distinct().limit(MAX_PACKS + 1).collect()
    if len(found) > MAX_PACKS:
        raise ValueError(f"more than {MAX_PACKS} specs")
    packs = sorted((r[0], int(r[1])) for r in found)
    if not packs:
        return spark.createDataFrame([], "pack_name string, capacity bigint, container bigint, item_id bigint, piece bigint, offset bigint, size bigint")
    if max(c for _, c in packs) > MAX_CAPACITY:
        raise ValueError(f"a capacity is greater than {MAX_CAPACITY}")
    groups: list[list[tuple[str, int]]] = []
    for p in packs:
        if not groups or sum(c for _, c in groups[-1]) + p[1] > together:
            groups.append([])
        groups[-1].append(p)
    if len(groups) == 1:
        return _pack(items, packs)
    done = [written(_pack(items, g), "packed") for g in groups]  # a plan is gone before the next is made
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _pack(items: DataFrame, packs: list[tuple[str, int]]) -> DataFrame:
    spark = items.sparkSession
    ids = F.array(*[F.struct(F.lit(k).alias("pack"), F.lit(c).cast("bigint").alias("capacity")) for k, (_, c) in enumerate(packs)])
    spread = items.withColumn("spec", F.explode(ids)).select("item_id", "hashed", F.col("size").alias("whole"), "spec.*")
    cut = spread.withColumn("piece", F.explode(F.expr("sequence(0L, greatest(0L, (whole - 1) div capacity))")))
    pieces = cut.select("pack", "item_id", "piece", F.expr("piece * capacity").alias("offset"), F.expr("least(capacity, whole - piece * capacity)").alias("size"), F.xxhash64("hashed", "piece").alias("hashed"))
    pieces = written(pieces, "pieces")
    counts = pieces.groupBy("pack", "size").agg(F.count(F.lit(1)).alias("n")).collect()
    histograms: dict[int, dict[int, int]] = {}
    for r in counts:
        histograms.setdefault(r["pack"], {})[r["size"]] = r["n"]
    plan, widths = [], []
    for k, histogram in histograms.items():
        rows = best_fit(packs[k][1], histogram)
        by_length: dict[int, list] = {}
        for row in rows:
            by_length.setdefault(row[0], []).append(row)
        for length, ranges in by_length.items():
            width = -(-histogram[length] // len(ranges))  # about as many rank buckets as ranges
            widths.append((k, length, width))
            plan += [(k, length, b, first, last, container, per) for _, first, last, container, per in ranges for b in range(first // width, last // width + 1)]
    slices = max(1, sum(r["n"] for r in counts) // SLICE)
    placed = positions(pieces, ["pack", "size"], "hashed", slices, "rank", ["item_id", "piece"])
    wide = spark.createDataFrame(widths, "pack int, size bigint, width bigint")
    planned = spark.createDataFrame(plan, "pack int, size bigint, bucket bigint, first bigint, last bigint, start bigint, per bigint")
    bucketed = placed.join(F.broadcast(wide), ["pack", "size"]).withColumn("bucket", F.expr("rank div width"))
    found = bucketed.join(F.broadcast(planned), ["pack", "size", "bucket"]).where("rank between first and last")
    names, sizes = F.array(*[F.lit(n) for n, _ in packs]), F.array(*[F.lit(c).cast("bigint") for _, c in packs])
    return found.select(names[F.col("pack")].alias("pack_name"), sizes[F.col("pack")].alias("capacity"), F.expr("start + (rank - first) div per").alias("container"), "item_id", "piece", "offset", "size")


def document_items(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(item_id, hashed, size) of every non-empty text, sized in tokens; written once."""
    texts = documents.where(F.length("text") > 0).select(F.col("doc_id").cast("bigint").alias("item_id"), "text")
    sized = with_tokens(texts, vocabulary=vocabulary)
    return written(sized.select("item_id", F.xxhash64("item_id", "text").alias("hashed"), F.col("tokens").alias("size")), "items")


def fill_report(packed: DataFrame) -> DataFrame:
    """Containers, tokens and the share of room used, per pack; ``least`` is the lower bound."""
    each = packed.groupBy("pack_name", "capacity", "container").agg(F.sum("size").alias("held"), F.count(F.lit(1)).alias("items"))
    total = each.groupBy("pack_name", "capacity").agg(F.count(F.lit(1)).alias("containers"), F.sum("held").alias("tokens"), F.sum("items").alias("items"), F.max("held").alias("fullest"))
    return total.select("*", F.expr("(tokens + capacity - 1) div capacity").alias("least"), (F.col("tokens") / (F.col("containers") * F.col("capacity"))).alias("fill"))
