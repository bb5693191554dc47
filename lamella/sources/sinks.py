"""Writing objects and results. Deleting is a plan first and needs ``confirm``."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.sources.files import files, require_shared


def put_objects(objects: DataFrame, root: str, only_new: bool = False) -> None:
    """Write (object_key, content) below a root. Each object appears whole, so a task that
    is run twice writes the same again.

    ``only_new``: an object that is there already is touched instead, which keeps garbage
    collection away from it for another grace period.
    """
    root = require_shared(objects.sparkSession, root)

    def write(rows) -> None:
        store = files(root)
        for row in rows:
            if only_new and store.exists(row["object_key"]):
                store.touch(row["object_key"])
            else:
                store.write(row["object_key"], bytes(row["content"]))

    objects.where(F.col("content").isNotNull()).select("object_key", "content").foreachPartition(write)


def deletions(plan: DataFrame, root: str) -> DataFrame:
    """Delete the keys of ``plan``; (object_key, state) of each: deleted, absent, or why it is still there.

    The result is written, so the plan runs once. The plan should be a written table
    too, lest it be computed anew while objects vanish.
    """
    from lamella.session import written

    root = require_shared(plan.sparkSession, root)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            keys = batch.column(0).to_pylist()
            states = []
            for key in keys:
                try:
                    files(root).delete(key)
                    states.append("deleted")
                except FileNotFoundError:
                    states.append("absent")
                except (OSError, ValueError) as e:
                    states.append(f"failed: {e}")
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(states, pa.string())], names=["object_key", "state"])

    keys = plan.select("object_key").where(F.col("object_key").isNotNull()).distinct()
    return written(keys.mapInArrow(run, "object_key string, state string"), "deletions")


def delete_objects(plan: DataFrame, root: str, confirm: bool = False) -> int:
    """Delete the keys of ``plan`` and return how many are gone; without ``confirm`` only count.

    OSError, after all keys were tried, if some could not be deleted.
    """
    if not confirm:
        return plan.select("object_key").where(F.col("object_key").isNotNull()).distinct().count()
    done = deletions(plan, root)
    failed = done.where("state not in ('deleted', 'absent')")
    some = failed.limit(5).collect()
    if some:
        raise OSError(f"{failed.count()} objects could not be deleted: " + "; ".join(f"{r['object_key']}: {r['state']}" for r in some))
    return done.count()


def store_chunks(layers: DataFrame, layer_id: str, content: str, root: str, fmt=None) -> DataFrame:
    """Chunk layers and store what is missing: chunk objects first, then file indexes and recipes.

    Frames are compressed once for each new digest. A recipe is keyed by the digest of
    its frames in order, which is what manifests refer to; its layer, if a tar, has a file
    index under the same digest. Returns (id, n_chunks, bytes,
    new_chunks, new_bytes, deduplicated) per layer.
    """
    from lamella.operators import chunking
    from lamella.session import written
    from lamella.sources.archives import zstd_compress
    from lamella.sources.objects import list_objects

    spark = layers.sparkSession
    root = require_shared(spark, root)
    chunks = written(chunking.split(layers, layer_id, content, fmt or chunking.FORMAT_1), "chunks")
    stored = written(list_objects(spark, root, "chunks/sha256/").select(F.regexp_extract("object_key", r"([0-9a-f]{64})\z", 1).alias("digest")), "stored")
    fresh = chunking.new_chunks(chunks, stored)
    where = chunks.join(fresh.select("digest"), "digest").groupBy("digest").agg(F.min(F.struct("id", "start", "size")).alias("at")).select("digest", "at.*")
    data = layers.select(F.col(layer_id).cast("bigint").alias("id"), F.col(content).cast("binary").alias("data")).join(where, "id")
    frames = data.select(F.concat(F.lit("chunks/sha256/"), "digest").alias("object_key"), zstd_compress(F.expr("substring(data, cast(start + 1 as int), cast(size as int))")).alias("content"))
    put_objects(frames, root)
    parts = chunks.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("seq", "digest", "size"))).alias("chunks"))
    layer = layers.select(F.col(layer_id).cast("bigint").alias("id"), F.sha2(F.col(content).cast("binary"), 256).alias("layer"))
    put_objects(_recipes(parts.join(layer, "id"), root), root)  # in one partition, an index comes before its recipe
    known = stored.distinct().withColumn("known", F.lit(True))
    per = chunks.join(known, "digest", "left").groupBy("id").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum("size").alias("bytes"), F.count_if(F.col("known").isNull()).alias("new_chunks"), F.coalesce(F.sum(F.when(F.col("known").isNull(), F.col("size"))), F.lit(0)).alias("new_bytes"))
    return per.withColumn("deduplicated", F.when(F.col("bytes") == 0, F.lit(0.0)).otherwise(1 - F.col("new_bytes") / F.col("bytes")))


def _recipes(parts: DataFrame, root: str) -> DataFrame:
    """(object_key, content) of the file indexes and recipes of (layer, chunks).

    Digest and sizes are those of the frames as stored, as another writer may have
    compressed a chunk otherwise; one frame is held at a time.
    """
    import hashlib

    from lamella.sources import archives

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for layer, chunks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                whole, held = hashlib.sha256(), []
                for chunk in chunks:
                    frame = files(root).read(f"chunks/sha256/{chunk['digest']}")
                    whole.update(frame)
                    held.append({"digest": chunk["digest"], "size": chunk["size"], "compressedSize": len(frame)})
                recipe = {"layer": layer, "size": sum(c["size"] for c in held), "compressedDigest": whole.hexdigest(), "compressedSize": sum(c["compressedSize"] for c in held), "chunks": held}
                index = archives.index_of(archives.layer_file(files(root), recipe), layer)
                rows = [(f"indexes/sha256/{whole.hexdigest()}", index)] if index else []
                rows.append((f"recipes/sha256/{whole.hexdigest()}", json.dumps(recipe).encode()))
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.string()), pa.array([c for _, c in rows], pa.binary())], names=["object_key", "content"])

    return parts.select("layer", "chunks").mapInArrow(run, "object_key string, content binary")


def store_layer_files(layers: DataFrame, root: str, source_root: str, fmt=None) -> DataFrame:
    """As ``store_chunks`` for layers of any size, (id, object_key), streamed from files below ``source_root``.

    A task holds one window of one layer; chunks that are stored already are not written
    again. Returns (id, layer, size, compressed_digest, compressed_size, n_chunks, new_chunks),
    written, so it runs once.
    """
    import hashlib

    from lamella.operators import chunking
    from lamella.session import written
    from lamella.sources import archives

    root = require_shared(layers.sparkSession, root)
    source_root = require_shared(layers.sparkSession, source_root)
    fmt = fmt or chunking.FORMAT_1

    def run(batches):
        import pyarrow as pa
        import zstandard

        enc = zstandard.ZstdCompressor(level=3)
        store = files(root)
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        names = ["id", "layer", "size", "compressed_digest", "compressed_size", "n_chunks", "new_chunks"]
        for batch in batches:
            for key, path in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw, whole, chunks, new = hashlib.sha256(), hashlib.sha256(), [], 0
                with files(source_root).open(path) as f:
                    for data in chunking.cuts_of_stream(f.read, fmt):
                        raw.update(data)
                        digest = hashlib.sha256(data).hexdigest()
                        place = f"chunks/sha256/{digest}"
                        if store.exists(place):
                            frame = store.read(place)
                        else:
                            frame = enc.compress(data)
                            store.write(place, frame)
                            new += 1
                        whole.update(frame)
                        chunks.append({"digest": digest, "size": len(data), "compressedSize": len(frame)})
                recipe = {"layer": raw.hexdigest(), "size": sum(c["size"] for c in chunks), "compressedDigest": whole.hexdigest(), "compressedSize": sum(c["compressedSize"] for c in chunks), "chunks": chunks}
                index = archives.index_of(archives.layer_file(store, recipe), recipe["layer"])
                if index:
                    store.write(f"indexes/sha256/{whole.hexdigest()}", index)
                store.write(f"recipes/sha256/{whole.hexdigest()}", json.dumps(recipe).encode())
                row = (key, recipe["layer"], recipe["size"], recipe["compressedDigest"], recipe["compressedSize"], len(chunks), new)
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], names=names)

    rows = layers.select(F.col("id").cast("bigint").alias("id"), "object_key").repartition(max(1, min(layers.count(), 1000)), "id")
    return written(rows.mapInArrow(run, "id bigint, layer string, size bigint, compressed_digest string, compressed_size bigint, n_chunks bigint, new_chunks bigint"), "stored-layers")


def verify_compressed(spark, root: str) -> DataFrame:
    """(compressed_digest, compressed_size, ok): do the frames of each recipe, in order, have its key and size?

    What a reader of the compressed stream gets; frames are not unpacked.
    """
    import hashlib

    from lamella.sources import archives
    from lamella.sources.objects import RECIPE_SCHEMA, list_objects, with_json

    root = require_shared(spark, root)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for key, recipe in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                digest, whole, size, ok = key.rpartition("/")[2], hashlib.sha256(), 0, recipe is not None
                try:
                    for frame in archives.frames(files(root), (recipe or {}).get("chunks") or []):
                        whole.update(frame)
                        size += len(frame)
                except (OSError, KeyError, TypeError):
                    ok = False
                out.append((digest, size, ok and whole.hexdigest() == digest and size == recipe["compressedSize"]))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.bool_())], names=["compressed_digest", "compressed_size", "ok"])

    found = with_json(list_objects(spark, root, "recipes/sha256/"), root, RECIPE_SCHEMA).select("object_key", "parsed")
    return found.mapInArrow(run, "compressed_digest string, compressed_size bigint, ok boolean")


def fetch_layers(spark, root: str) -> DataFrame:
    """(layer, size, ok): every recipe's layer put together from its chunks and verified.

    Layers stream through one hash, chunk by chunk; ``ok`` is false for a missing or
    damaged chunk, a wrong size or a wrong digest of the whole, and for a recipe that
    cannot be read or parsed, which is named by its key.
    """
    import hashlib

    import zstandard

    from lamella.sources.objects import RECIPE_SCHEMA, list_objects, with_json

    root = require_shared(spark, root)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for key, recipe in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if recipe is None or recipe["layer"] is None or any(c is None for c in recipe["chunks"] or []):
                    out.append((key.rpartition("/")[2], 0, False))
                    continue
                whole, size, ok = hashlib.sha256(), 0, True
                for chunk in recipe["chunks"] or []:
                    try:
                        with files(root).open(f"chunks/sha256/{chunk['digest']}") as f:
                            data = zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read()
                    except (OSError, zstandard.ZstdError):
                        ok = False
                        break
                    ok = ok and len(data) == chunk["size"] and hashlib.sha256(data).hexdigest() == chunk["digest"]
                    whole.update(data)
                    size += len(data)
                out.append((recipe["layer"], size, ok and size == recipe["size"] and whole.hexdigest() == recipe["layer"]))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.bool_())], names=["layer", "size", "ok"])

    found = with_json(list_objects(spark, root, "recipes/sha256/"), root, RECIPE_SCHEMA).select("object_key", "parsed")
    return found.mapInArrow(run, "layer string, size bigint, ok boolean")


def render(df: DataFrame, form: str = "json", most: int = 100_000) -> str:
    """A small result as json, yaml or text; an empty one is ``[]`` or its header.

    ValueError beyond ``most`` rows: such a result belongs in a table, not in a text.
    """
    if form not in ("json", "yaml", "text"):
        raise ValueError(f"unknown form {form!r}")
    rows = [r.asDict(recursive=True) for r in df.limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError(f"more than {most} rows; write them as a table")
    if form == "json":
        return json.dumps(rows, default=str, ensure_ascii=False)
    if form == "yaml":
        import yaml

        return yaml.safe_dump(json.loads(json.dumps(rows, default=str)), sort_keys=False, allow_unicode=True)
    cells = [df.columns, *[["" if r[c] is None else str(r[c]) for c in df.columns] for r in rows]]
    widths = [max(len(line[k]) for line in cells) for k in range(len(df.columns))]
    return "\n".join("  ".join(x.ljust(w) for x, w in zip(line, widths, strict=True)).rstrip() for line in cells)
