"""Long exact spans that records share, through FM-indexes of shards.

1. Copies of one text are a class, told by digest; a class of two documents or more is
   shared throughout. Every other span comes from the index.
2. Every window of ``length`` characters gets an anchor: the least hash of the k-grams
   inside it. Equal windows have equal anchors, so an anchor of one text only proves that
   its windows are shared by nobody, and anchors say which shard a window belongs to.
   Hash collisions cost work, never rows.
3. The regions left (runs of windows with one anchor) are spread over shards by anchor.
   Each shard is a compressed FM-index of its regions under their owners (a region of
   several documents is held under two of them, which is all a second owner takes).
   The regions are streamed through it by backward search; its matching statistics give
   the longest match under another owner at each place, and those of ``length``
   characters or more are the shared windows.
4. An anchor whose different regions exceed a shard is split by finer anchors: its
   regions are cut again by longer k-grams, up to whole windows, and indexed as before.
5. Windows of each document are merged into maximal spans.

Scale. Texts are never shuffled whole: digests, anchors and the texts that share one are.
Bloom filters of bounded size keep most anchors, and texts without a shared one, out of
the exact joins that follow them. Work follows the text plus the part that survives step
2; each shard holds about ``SHARD`` characters.

Defined cases. Null, empty and short texts share nothing. Rows with a null doc_id are
ignored, as nothing could name them. Rows of one doc_id are one document: passages it
repeats itself do not count. Characters are code points.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamella.llm.fmindex import intervals, matching_statistics
from lamella.operators.orphans import bloom_filter, might_contain
from lamella.session import parallelism, splittable, written

LENGTH = 120
#: Characters of the k-grams whose least hash is a window's anchor: first, and for anchors too hot for a shard.
GRAMS = (64, 96, 120)
#: Characters aimed at for one shard.
SHARD = 1_000_000
#: Windows of one region at most.
RUN = 512
#: Characters hashed at a time.
PIECE = 1 << 20
#: Characters of a text that are cut into regions at a time.
STRETCH = 1 << 16
#: Two parts of a text's sha256 that together tell texts apart.
TEXT = ("t1", "t2")

_BASE = np.uint64(0x9E3779B97F4A7C15)


def _gram_hashes(codes: np.ndarray, gram: int) -> np.ndarray:
    """Mixed 64-bit hash of the ``gram`` characters from each place on, by doubling."""
    power, size, have = _BASE, 1, codes.astype(np.uint64) + np.uint64(1)
    total, done, scale = None, 0, np.uint64(1)
    rest = gram
    with np.errstate(over="ignore"):
        while rest:
            if rest & 1:
                moved = np.zeros_like(have)
                moved[: len(have) - done] = have[done:]
                total = moved * scale if total is None else total + moved * scale
                scale, done = scale * power, done + size
            rest >>= 1
            if rest:
                longer = have.copy()
                longer[: max(len(have) - size, 0)] += have[size:] * power
                have, power, size = longer, power * power, size * 2
        total ^= total >> np.uint64(31)
        total *= np.uint64(0xBF58476D1CE4E5B9)
        total ^= total >> np.uint64(29)
        total *= np.uint64(0x94D049BB133111EB)
        total ^= total >> np.uint64(32)
    return total


def _least_ahead(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of the ``width`` values from each place on."""
    size = 1
    while size * 2 <= width:
        values[:-size] = np.minimum(values[:-size], values[size:])
        size *= 2
    if width > size:
        values[: size - width] = np.minimum(values[: size - width], values[width - size :])
    return values


def anchor_runs(texts: list[str], length: int, gram: int, run: int = RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, first window, windows, anchor) of every run of windows with one anchor."""
    sizes = np.array([len(t) for t in texts], np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    begin = np.cumsum(sizes) - sizes
    anchors = _least_ahead(_gram_hashes(codes, gram), length - gram + 1)
    owner = np.repeat(np.arange(len(texts)), sizes)
    place = np.arange(len(codes)) - begin[owner]
    valid = place + length <= sizes[owner]
    new = np.ones(len(codes), bool)
    new[1:] = (anchors[1:] != anchors[:-1]) | (owner[1:] != owner[:-1])
    new |= ~valid
    start = np.flatnonzero(new)
    since = np.arange(len(codes)) - start[np.cumsum(new) - 1]
    start = np.flatnonzero((since % run == 0) & valid)
    ends = np.flatnonzero(new | (since % run == 0))
    stop = np.append(ends, len(codes))[np.searchsorted(ends, start, side="right")]
    return owner[start], place[start], stop - start, anchors[start].view(np.int64)


def _pieces(docs: list[int], texts: list[str], length: int) -> Iterator[tuple[list[int], list[int], list[str]]]:
    """Batches of about PIECE characters; longer texts are cut with the windows overlapping."""
    ids: list[int] = []
    offsets: list[int] = []
    parts: list[str] = []
    held = 0
    for doc, text in zip(docs, texts, strict=True):
        for offset in range(0, max(1, len(text) - length + 1), PIECE):
            part = text[offset : offset + PIECE + length - 1]
            ids.append(doc)
            offsets.append(offset)
            parts.append(part)
            held += len(part)
            if held >= PIECE:
                yield ids, offsets, parts
                ids, offsets, parts, held = [], [], [], 0
    if ids:
        yield ids, offsets, parts


_DOCS = pa.schema([("doc_id", pa.int64()), ("t1", pa.int64()), ("t2", pa.int64()), ("first", pa.bool_()), ("n_chars", pa.int64()), ("anchor", pa.list_(pa.int64())), ("start", pa.list_(pa.int64())), ("windows", pa.list_(pa.int64()))])
_CUT = pa.schema([("anchor", pa.int64()), ("t1", pa.int64()), ("t2", pa.int64()), ("rep", pa.int64()), ("last", pa.int64()), ("start", pa.int64()), ("windows", pa.int64()), ("region", pa.string())])
_FINER = pa.schema([("anchor", pa.int64()), ("of_anchor", pa.int64()), ("of_digest", pa.binary()), ("rep", pa.int64()), ("last", pa.int64()), ("start", pa.int64()), ("windows", pa.int64()), ("region", pa.string())])


def _ddl(schema: pa.Schema) -> str:
    kinds = {pa.int64(): "bigint", pa.bool_(): "boolean", pa.string(): "string", pa.binary(): "binary", pa.list_(pa.int64()): "array<bigint>"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def _lists(values: np.ndarray, borders: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(borders, pa.int32()), pa.array(values, pa.int64()))


def _anchored(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(doc_id, t1, t2, first, n_chars, anchor[], start[], windows[]): a row for each text or piece of one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_id, t1, t2 = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            texts = batch.column(3).to_pylist()
            for rows, offsets, parts in _pieces(range(len(texts)), texts, length):
                which, start, windows, anchor = anchor_runs(parts, length, gram)
                at, offset = np.array(rows, np.int64), np.array(offsets, np.int64)
                borders = np.searchsorted(which, np.arange(len(rows) + 1))
                sizes = np.array([len(texts[r]) for r in rows], np.int64)
                columns = [doc_id[at], t1[at], t2[at], offset == 0, sizes, _lists(anchor, borders), _lists(offset[which] + start, borders), _lists(windows, borders)]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, _DOCS, strict=True)], schema=_DOCS)

    return docs.select("doc_id", *TEXT, "text").mapInArrow(run, _ddl(_DOCS))


def _stretches(docs: DataFrame, length: int) -> DataFrame:
    """(doc_id, t1, t2, stretch, part): texts in stretches, each with what the runs that begin in it need beyond."""
    schema = pa.schema([("doc_id", pa.int64()), ("t1", pa.int64()), ("t2", pa.int64()), ("stretch", pa.int64()), ("part", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            for doc_id, t1, t2, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for k in range(0, len(text) - length + 1, STRETCH):
                    part = text[k : k + STRETCH + RUN + length - 1]
                    rows.append((doc_id, t1, t2, k // STRETCH, part))
                    held += len(part)
                    if held >= PIECE:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return docs.select("doc_id", *TEXT, "text").mapInArrow(run, _ddl(schema))


def _cut(rows: DataFrame, length: int) -> DataFrame:
    """Regions of (t1, t2, rep, last, stretch, part, runs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t1, t2, rep, last, stretch, part, runs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                base = stretch * STRETCH
                for at in range(0, len(runs), 20_000):
                    some = runs[at : at + 20_000]
                    n = len(some)
                    columns = [[r["anchor"] for r in some], [t1] * n, [t2] * n, [rep] * n, [last] * n, [r["start"] for r in some], [r["windows"] for r in some], [part[r["start"] - base : r["start"] - base + r["windows"] + length - 1] for r in some]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _CUT, strict=True)], schema=_CUT)

    return rows.select(*TEXT, "rep", "last", "stretch", "part", "runs").mapInArrow(run, _ddl(_CUT))


def _recut(classes: DataFrame, length: int, gram: int) -> DataFrame:
    """Regions of the regions of ``classes``, by the anchors of longer k-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of_anchor, of_digest, rep, last, texts = (c.to_pylist() for c in batch.columns)
            for rows, offsets, parts in _pieces(range(len(texts)), texts, length):
                which, start, windows, anchor = anchor_runs(parts, length, gram)
                for at in range(0, len(which), 20_000):
                    some = range(at, min(at + 20_000, len(which)))
                    of = [rows[which[k]] for k in some]
                    first = [offsets[which[k]] + int(start[k]) for k in some]
                    columns = [anchor[at : at + 20_000], [of_anchor[r] for r in of], [of_digest[r] for r in of], [rep[r] for r in of], [last[r] for r in of], first, windows[at : at + 20_000], [parts[which[k]][start[k] : start[k] + windows[k] + length - 1] for k in some]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _FINER, strict=True)], schema=_FINER)

    return classes.select("anchor", "digest", "rep", "last", "region").mapInArrow(run, _ddl(_FINER))


def _filtered(rows: DataFrame, key: Column, wanted: DataFrame, wanted_key: Column, size: int) -> DataFrame:
    """``rows`` less most of those whose key is not in ``wanted``; an exact join has to follow."""
    return rows.where(might_contain(rows, bloom_filter(wanted.select(wanted_key.alias("h")), "h", size), key))


def _sharded(regions: DataFrame, shard: int) -> DataFrame:
    """Adds ``shard``: anchors are spread so that a shard has about ``shard`` characters."""
    total = regions.agg(F.sum(F.length("region"))).first()[0] or 0
    shards = max(-(-total // shard), min(parallelism(regions.sparkSession), -(-total // 10_000)), 1)
    return regions.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))


def _search(sharded: DataFrame, length: int) -> DataFrame:
    """(anchor, digest, first, last, longest): runs of windows that another owner's region has."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        # a region of several owners stands in the index under two of them
        twice = np.flatnonzero((rows["rep"] < rows["last"]).to_numpy(bool))
        regions = rows["region"].tolist()
        owners = np.concatenate([rows["rep"].to_numpy(), rows["last"].to_numpy()[twice]])
        found = []
        if len(np.unique(owners)) > 1:
            lengths = matching_statistics([*regions, *(regions[k] for k in twice)], owners, np.arange(len(regions)))
            found = [(k, *x) for k, of in enumerate(lengths) for x in intervals(of, length)]
        which = [x[0] for x in found]
        return pd.DataFrame({"anchor": rows["anchor"].to_numpy()[which], "digest": rows["digest"].to_numpy()[which], "first": [x[1] for x in found], "last": [x[2] for x in found], "longest": [x[3] for x in found]})

    slim = sharded.select("shard", "anchor", "digest", "rep", "last", "region")
    return slim.groupBy("shard").applyInPandas(run, "anchor bigint, digest binary, first bigint, last bigint, longest bigint")


def _shared_windows(regions: DataFrame, length: int, grams: Sequence[int], shard: int) -> DataFrame:
    """(anchor, digest, first, last, longest): shared windows of ``regions`` (anchor, digest, region, windows, rep, last)."""
    # equal regions are streamed once
    classes = written(regions.groupBy("anchor", "digest", "region", "windows").agg(F.min("rep").alias("rep"), F.max("last").alias("last")), "region-classes")
    loads = classes.groupBy("anchor").agg(F.min("rep").alias("lo"), F.max("last").alias("hi"), F.sum(F.length("region")).alias("chars")).where("lo < hi")
    loads = written(loads.select("anchor", (F.col("chars") > 1.5 * shard).alias("hot")), "anchor-loads")
    if not grams or loads.where("hot").isEmpty():
        return _search(_sharded(classes.join(splittable(loads.select("anchor")), "anchor", "left_semi"), shard), length)
    rest = classes.join(splittable(loads.where("not hot").select("anchor")), "anchor", "left_semi")
    hot = classes.join(splittable(loads.where("hot").select("anchor")), "anchor", "left_semi")
    finer = written(_recut(hot, length, grams[0]).withColumn("digest", F.unhex(F.md5("region"))), "finer-regions")
    found = _shared_windows(finer, length, grams[1:], shard)
    placed = finer.select("anchor", "digest", "of_anchor", "of_digest", "start").join(splittable(found), ["anchor", "digest"])
    back = placed.select(F.col("of_anchor").alias("anchor"), F.col("of_digest").alias("digest"), (F.col("start") + F.col("first")).alias("first"), (F.col("start") + F.col("last")).alias("last"), "longest")
    return back.unionByName(_search(_sharded(rest, shard), length))


def merged(spans: DataFrame) -> DataFrame:
    """Maximal runs of (doc_id, span_start, span_end); touching spans are one."""
    w = Window.partitionBy("doc_id").orderBy("span_start", "span_end")
    reach = F.max("span_end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    begun = spans.withColumn("begins", F.coalesce(F.col("span_start") > reach, F.lit(True)))
    numbered = begun.withColumn("island", F.sum(F.col("begins").cast("bigint")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("doc_id", "island").agg(F.min("span_start").alias("span_start"), F.max("span_end").alias("span_end")).drop("island")


def _text_keys(texts: DataFrame) -> list[str]:
    """Hash columns that tell all texts apart: one, unless two texts share it."""
    clash = texts.groupBy(TEXT[0]).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return [TEXT[0]] if clash.isEmpty() else list(TEXT)


def _regions(docs: DataFrame, anchored: DataFrame, texts: DataFrame, length: int) -> DataFrame | None:
    """Regions of the texts whose anchors other texts have as well; None if there are none."""
    keys = _text_keys(texts)
    runs = anchored.select("anchor", *keys).select(F.explode("anchor").alias("anchor"), *keys)
    seen = runs.groupBy("anchor").agg(*[f(k).alias(f"{n}_{k}") for k in keys for n, f in (("least", F.min), ("most", F.max))])
    several = written(seen.where(" or ".join(f"least_{k} < most_{k}" for k in keys)).select("anchor"), "anchors")
    n_several = several.count()
    if not n_several:
        return None
    own = F.xxhash64(*TEXT, "doc_id")
    # one document speaks for all copies of a text
    speakers = anchored
    n_texts = texts.count()
    if n_texts < anchored.where("first").count():
        speakers = _filtered(anchored, own, texts, F.xxhash64(*TEXT, "rep"), n_texts)
    flat = speakers.select(*TEXT, F.inline(F.arrays_zip("anchor", "start", "windows")))
    kept = _filtered(flat, F.xxhash64("anchor"), several, F.xxhash64("anchor"), n_several).join(splittable(several), "anchor", "left_semi")
    run = F.struct("anchor", "start", "windows")
    per_stretch = kept.groupBy(*TEXT, F.expr(f"start div {STRETCH}").alias("stretch")).agg(F.collect_set(run).alias("runs"))
    wanted = written(per_stretch.join(splittable(texts.select(*TEXT, "rep", "last")), list(TEXT)), "stretches")
    some = _filtered(docs, own, wanted, F.xxhash64(*TEXT, "rep"), n_texts)
    place = ["doc_id", *TEXT, "stretch"]
    parts = _stretches(some, length).dropDuplicates(place)
    regions = _cut(parts.join(wanted.withColumn("doc_id", F.col("rep")), place), length)
    return written(regions.withColumn("digest", F.unhex(F.md5("region"))), "regions")


def shared_spans(documents: DataFrame, length: int = LENGTH, grams: Sequence[int] | None = None, shard: int = SHARD) -> DataFrame:
    """(doc_id, span_start, span_end) of all maximal runs of shared characters."""
    grams = grams or tuple(max(1, length * g // LENGTH) for g in GRAMS)
    docs = documents.where((F.length("text") >= length) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.sha2("text", 256).alias("sha"), "text")
    docs = docs.select("doc_id", *[F.conv(F.substring("sha", 16 * k + 1, 16), 16, -10).cast("bigint").alias(t) for k, t in enumerate(TEXT)], "text")
    anchored = written(_anchored(docs, length, grams[0]), "anchored")
    copies = anchored.where("first").select("doc_id", *TEXT, "n_chars")
    texts = written(copies.groupBy(*TEXT).agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")), "texts")
    spans = copies.join(splittable(texts.where("rep < last").select(*TEXT)), list(TEXT), "left_semi").select("doc_id", F.lit(0).cast("bigint").alias("span_start"), F.col("n_chars").alias("span_end"))
    regions = _regions(docs, anchored, texts, length)
    if regions is not None:
        windows = _shared_windows(regions, length, grams[1:], shard)
        # a text of several documents is shared throughout already
        placed = regions.where("rep = last").select("anchor", "digest", "rep", "start").join(splittable(windows.withColumnRenamed("last", "upto")), ["anchor", "digest"])
        spans = spans.unionByName(placed.select(F.col("rep").alias("doc_id"), (F.col("start") + F.col("first")).alias("span_start"), (F.col("start") + F.col("upto") + length).alias("span_end")))
    return merged(spans)


def coverage(documents: DataFrame, spans: DataFrame) -> DataFrame:
    """How much of each non-null text is shared: doc_id, n_chars, shared_chars, shared_share."""
    per_doc = spans.groupBy("doc_id").agg(F.sum(F.col("span_end") - F.col("span_start")).alias("shared_chars"))
    sizes = documents.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.length("text")).cast("bigint").alias("n_chars"))
    return sizes.join(per_doc, "doc_id", "left").select("doc_id", "n_chars", F.coalesce("shared_chars", F.lit(0)).alias("shared_chars"), F.when(F.col("n_chars") > 0, F.coalesce("shared_chars", F.lit(0)) / F.col("n_chars")).otherwise(F.lit(0.0)).alias("shared_share"))
