"""History of changing attributes: insert-only satellites and a lead-based view over them.

``staged`` picks the row that counts for each (key, time). ``load`` appends it to one
table for each satellite (a group of attributes that change together): a row is
appended where the group's hash-diff differs from the row before it. ``view`` reads the
stored satellites: at each time at which any of them changes, every attribute has its
last stored value, and a version ends where the next one begins (``lead``).

Scale. Staging and change detection share one shuffle on the key, the view has another,
of changed rows only. A key with more than ``hot_rows`` rows is staged with map-side
combine and cut into slices of about ``SLICE_ROWS`` rows by range of time, so no task
ever sorts one key whole: inside a slice plain windows, between slices the edges (one
row for each key and slice) are carried.

Defined cases. A null in a key column or in the time drops the row (it names no
state); null attributes are values: two nulls are equal, a null and a value differ.
Ties on (key, time) go to the greatest ``latest`` columns, nulls lowest; repeated
rows collapse; an empty table gives an empty result with the same columns; columns
beside those named are ignored, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamella.functions import digests
from lamella.session import written

#: Keys above this many rows are cut into slices.
HOT_ROWS = 1_000_000
#: Rows aimed at for one slice of such a key.
SLICE_ROWS = 500_000
#: Hash buckets in which keys are counted before any key is counted by itself.
BUCKETS = 1 << 16
#: A list of hot keys longer than this is joined by shuffle instead of broadcast.
MAX_BROADCAST_KEYS = 100_000


def _slim(rows: DataFrame, key: Sequence[str], at: str, latest: Sequence[str], values: dict[str, Column]) -> DataFrame:
    return rows.dropna(subset=[*key, at]).select(
        *[F.col(k) for k in key],
        F.col(at).alias("at"),
        F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(latest)]).alias("order"),
        F.struct(*[v.alias(n) for n, v in values.items()]).alias("value"),
    )


def _counted(slim: DataFrame, key: Sequence[str]) -> DataFrame:
    return slim.groupBy(*key, "at").agg(F.max_by("value", "order").alias("value")).select(*key, "at", "value.*")


def staged(rows: DataFrame, key: Sequence[str], at: str, latest: Sequence[str], values: dict[str, Column]) -> DataFrame:
    """One row for each (key, at): ``values`` of the row greatest by ``latest``."""
    return _counted(_slim(rows, key, at, latest, values), key)


def hash_diff(rows: DataFrame, attributes: Sequence[str]) -> Column:
    """16 bytes over the attributes; each is tagged, so a null differs from every value."""
    binary = {f.name for f in rows.schema if f.dataType.typeName() == "binary"}
    parts = []
    for a in attributes:
        text = F.hex(a) if a in binary else F.col(a).cast("string")
        parts.append(F.when(F.col(a).isNull(), F.lit("0;")).otherwise(F.concat(F.lit("1"), F.length(text).cast("string"), F.lit(":"), text, F.lit(";"))))
    return F.unhex(F.md5(F.concat(*parts)))


def hot_keys(rows: DataFrame, key: Sequence[str], hot_rows: int) -> DataFrame | None:
    """Keys of more than ``hot_rows`` rows, or None.

    Hash buckets are counted first, which shuffles a row for each bucket and task; keys
    are counted one by one only in buckets that exceed the number.
    """
    keyed = rows.select(*key, F.pmod(F.xxhash64(*key), F.lit(BUCKETS)).alias("bucket"))
    full = keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_rows).select("bucket")
    buckets = full.collect()
    if not buckets:
        return None
    full = F.broadcast(rows.sparkSession.createDataFrame(buckets, full.schema))
    hot = keyed.join(full, "bucket", "left_semi").groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_rows).select(*key)
    found = hot.limit(MAX_BROADCAST_KEYS + 1).collect()
    if not found:
        return None
    if len(found) > MAX_BROADCAST_KEYS:
        return hot
    return F.broadcast(rows.sparkSession.createDataFrame(found, hot.schema))


def _sliced(rows: DataFrame, key: Sequence[str], at: str, slice_rows: int) -> DataFrame:
    """Adds ``slice``: each is a range of (key, time), in order; written, so it stays."""
    kept = written(rows, "hot-rows")
    slices = max(1, -(-kept.count() // slice_rows))
    return written(kept.repartitionByRange(slices, *key, at).withColumn("slice", F.spark_partition_id()), "slices")


def _context(rows: DataFrame, key: Sequence[str], at: str, names: Sequence[str], upto: int) -> DataFrame:
    """Adds ``<name>_seen``, the last value that is not null up to ``upto`` rows from here
    (0: this row, -1: the row before), and ``next``, the time of the row after.

    A column ``slice``, if there, cuts keys; values and times are carried across.
    """
    hot = "slice" in rows.columns
    w = Window.partitionBy(*key, *(["slice"] if hot else [])).orderBy(at)
    seen = {f"{n}_seen": F.last(n, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, upto)) for n in names}
    own = rows.select("*", *[c.alias(n) for n, c in seen.items()], F.lead(at).over(w).alias("next"))
    if not hot:
        return own
    by_key = Window.partitionBy(*key).orderBy("slice")
    earlier = by_key.rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy(*key, "slice").agg(F.min(at).alias("head"), *[F.max_by(n, F.when(F.col(n).isNotNull(), F.col(at))).alias(n) for n in names])
    edges = ends.select(*key, "slice", F.lead("head").over(by_key).alias("follow"), *[F.last(n, ignorenulls=True).over(earlier).alias(f"{n}_carried") for n in names])
    joined = own.join(edges, [*key, "slice"])
    filled = joined.withColumns({f"{n}_seen": F.coalesce(f"{n}_seen", f"{n}_carried") for n in names} | {"next": F.coalesce("next", "follow")})
    return filled.drop("slice", "follow", *[f"{n}_carried" for n in names])


def _changes(stage: DataFrame, key: Sequence[str], satellites: dict[str, Sequence[str]], stored: dict[str, DataFrame] | None) -> DataFrame:
    """Rows of ``stage`` at which any satellite changes, with ``S_hash`` and ``S_changed``."""
    hashed = stage.select("*", *[hash_diff(stage, a).alias(f"{s}_hash") for s, a in satellites.items()])
    known = _context(hashed, key, "at", [f"{s}_hash" for s in satellites], -1)
    for s, table in (stored or {}).items():
        newest = table.join(stage.select(*key).distinct(), list(key), "left_semi").groupBy(*key).agg(F.max_by("hash_diff", "valid_from").alias(f"{s}_stored"))
        known = known.join(newest, list(key), "left").withColumn(f"{s}_hash_seen", F.coalesce(f"{s}_hash_seen", f"{s}_stored"))
    marked = known.withColumns({f"{s}_changed": ~F.col(f"{s}_hash").eqNullSafe(F.col(f"{s}_hash_seen")) for s in satellites})
    anyone = F.lit(False)
    for s in satellites:
        anyone = anyone | F.col(f"{s}_changed")
    return marked.where(anyone)


def load(
    rows: DataFrame, key: Sequence[str], at: str, latest: Sequence[str], values: dict[str, Column], satellites: dict[str, Sequence[str]],
    stored: dict[str, DataFrame] | None = None, hot_rows: int = HOT_ROWS, slice_rows: int = SLICE_ROWS,
) -> dict[str, DataFrame]:
    """Tables of the rows that an insert-only load of ``rows`` appends to each satellite.

    A table has key, valid_from, hash_diff and the satellite's attributes. ``stored``:
    what earlier loads appended; a first row of a key is then compared with the newest
    stored one. Exact for batches later than what is stored for their keys; older
    arrivals need a new load of the whole history, as rows never appended (no change
    then) cannot be recalled.

    All satellites come from one pass and are written as folders of one table.
    """
    hot = hot_keys(rows.dropna(subset=list(key)), key, hot_rows)

    def by_key(some: DataFrame) -> DataFrame:
        # one shuffle on the key serves staging and the windows behind it
        return _changes(_counted(_slim(some, key, at, latest, values).repartition(*key), key), key, satellites, stored)

    if hot is None:
        found = by_key(rows)
    else:
        crowded = _sliced(staged(rows.join(hot, list(key), "left_semi"), key, at, latest, values), key, "at", slice_rows)
        found = by_key(rows.join(hot, list(key), "left_anti")).unionByName(_changes(crowded, key, satellites, stored))
    types = {f.name: f.dataType for f in found.schema}

    def row(s: str) -> Column:
        held = {a: F.col(a) if a in satellites[s] else F.lit(None).cast(types[a]) for attrs in satellites.values() for a in attrs}
        return F.when(F.col(f"{s}_changed"), F.struct(F.lit(s).alias("satellite"), F.col(f"{s}_hash").alias("hash_diff"), *[c.alias(a) for a, c in held.items()]))

    appended = found.select(*key, F.col("at").alias("valid_from"), F.explode(F.array_compact(F.array(*[row(s) for s in satellites]))).alias("r")).select(*key, "valid_from", "r.*")
    tables = written(appended, "satellites", ["satellite"])
    return {s: tables.where(F.col("satellite") == s).select(*key, "valid_from", "hash_diff", *a) for s, a in satellites.items()}


def view(tables: dict[str, DataFrame], key: Sequence[str], satellites: dict[str, Sequence[str]], removed: str | None = None, hot_rows: int = HOT_ROWS, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Versions with ``valid_from`` and ``valid_to`` (null while one holds), from stored satellites.

    ``removed`` names a boolean attribute; such a state ends the version before it and
    is none itself.
    """
    parts = []
    for s in satellites:
        groups = {n: F.struct(*satellites[n]) if n == s else F.lit(None).cast(tables[n].select(F.struct(*satellites[n]).alias("g")).schema["g"].dataType) for n in satellites}
        parts.append(tables[s].select(*key, "valid_from", *[g.alias(f"{n}_state") for n, g in groups.items()]))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    names = [f"{s}_state" for s in satellites]
    hot = hot_keys(rows, key, hot_rows)
    if hot is None:
        filled = _context(rows, key, "valid_from", names, 0)
    else:
        crowded = _sliced(rows.join(hot, list(key), "left_semi"), key, "valid_from", slice_rows)
        filled = _context(rows.join(hot, list(key), "left_anti"), key, "valid_from", names, 0).unionByName(_context(crowded, key, "valid_from", names, 0))
    # satellites that change at one time are rows in a row; the last of them has seen all
    states = filled.where(F.col("next").isNull() | (F.col("next") > F.col("valid_from")))
    if removed:
        holder = next(s for s, a in satellites.items() if removed in a)
        states = states.where(~F.col(f"{holder}_state_seen.{removed}"))
    attributes = [F.col(f"{s}_state_seen.{a}").alias(a) for s, attrs in satellites.items() for a in attrs if a != removed]
    return states.select(*key, *attributes, "valid_from", F.col("next").alias("valid_to"))


# -- bindings to the store's history ------------------------------------------------

HISTORY_KEY = ("image", "tag")
#: Digest changes with every push, the size only with amended entries.
HISTORY_SATELLITES = {"content": ("removed", "digest"), "extent": ("size_bytes",)}
_LATEST = ("snapshot_at", "history_id")


def counted_pushes(history: DataFrame, values: dict[str, Column] | None = None) -> DataFrame:
    """The rows of ``history`` that count: one for each (image, tag, pushed_at).

    Adds ``removed``: the entry has no digest, so the tag went away.
    """
    values = {"removed": digests.is_blank(F.col("digest"))} | (values or {})
    return staged(history, HISTORY_KEY, "pushed_at", _LATEST, values)


def history_satellites(history: DataFrame, stored: dict[str, DataFrame] | None = None, hot_rows: int = HOT_ROWS, slice_rows: int = SLICE_ROWS) -> dict[str, DataFrame]:
    """The satellites ``content`` and ``extent`` of pushes; digests as 32 bytes.

    A digest that is neither blank nor well formed removes nothing, refers to nothing
    and is null.
    """
    gone = digests.is_blank(F.col("digest"))
    values = {"removed": gone, "digest": digests.plain_bytes(F.col("digest")), "size_bytes": F.when(~gone, F.col("size_bytes"))}
    return load(history, HISTORY_KEY, "pushed_at", _LATEST, values, HISTORY_SATELLITES, stored, hot_rows, slice_rows)


def push_versions(history: DataFrame, hot_rows: int = HOT_ROWS, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Digest and size states of every (image, tag) with their validity, by way of the satellites."""
    tables = history_satellites(history, hot_rows=hot_rows, slice_rows=slice_rows)
    found = view(tables, HISTORY_KEY, HISTORY_SATELLITES, "removed", hot_rows, slice_rows)
    return found.withColumn("digest", digests.hex_text(F.col("digest")))
