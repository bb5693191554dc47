"""Shredding nested JSON into an adjacency table, and entity tables pivoted from it.

One row for each node of a document: node, parent, label, ordinal, kind, scalar and
path. Entity tables are made of that table alone: object nodes are joined with their
scalar children on (record, node = parent), and those of the objects they hold, and
pivoted. ``path`` only names a node for people: labels are joined by ``/`` and array
places written ``#i``; ``~``, ``/`` and ``#`` inside a label are written ``~0``, ``~1``
and ``~2``, so a path has one meaning only.

Scale. Parsing is per record inside the scan's tasks (Arrow batches, no shuffle). The
adjacency table is written once; entity tables read the columns and labels they need
and shuffle those by (record, node), combined on the map side.

Defined cases. A body that is null, empty, broken, followed by more text or not an
object has no nodes; numbers keep their spelling; a name given twice keeps its last
value; lone surrogates become U+FFFD; depth is not limited. Rows with equal record
id and equal body are one record. Other columns of the table are ignored.
"""

from __future__ import annotations

import itertools
import json
import re
from collections.abc import Iterable, Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamella.session import written

#: Characters after which nodes are handed on.
HELD = 8 << 20
NODE_SCHEMA = "record_id bigint, body_hash bigint, node bigint, parent bigint, label string, ordinal bigint, kind string, scalar string, path string"


class Number(str):
    """A JSON number as it was spelt."""


def _no_constant(name: str) -> Any:
    raise ValueError(f"{name} is not JSON")


_DECODER = json.JSONDecoder(parse_int=Number, parse_float=Number, parse_constant=_no_constant)
_TOKEN = re.compile(r'[ \t\n\r]*(?:([{}\[\],:])|("(?:[^"\\\x00-\x1f]|\\.)*")|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)|(true|false|null))')
_WORDS = {"true": True, "false": False, "null": None}
_BLANK = " \t\n\r"


def _parse_deep(text: str) -> Any:
    """Parser with its own stack, for nesting beyond Python's recursion."""
    at, end = 0, len(text.rstrip(_BLANK))
    stack: list[Any] = []
    names: list[str | None] = []
    root: list[Any] = []
    want = "value"
    while at < end:
        m = _TOKEN.match(text, at)
        if not m or m.end() == at:
            raise ValueError("no JSON token")
        at = m.end()
        mark, string, number, word = m.groups()
        if mark == ":" and want == "colon":
            want = "value"
            continue
        if mark == "," and want == "more":
            want = "name" if isinstance(stack[-1], dict) else "value"
            continue
        if mark in ("}", "]"):
            kind = dict if mark == "}" else list
            if not stack or not isinstance(stack[-1], kind) or want not in ("more", "first"):
                raise ValueError("stray close")
            stack.pop()
            names.pop()
            want = "more" if stack else "end"
            continue
        if string is not None and (want == "name" or (want == "first" and isinstance(stack[-1], dict))):
            names[-1] = json.loads(string)
            want = "colon"
            continue
        if want not in ("value", "first") or (want == "first" and isinstance(stack[-1], dict)) or mark in (",", ":"):
            raise ValueError("unexpected token")
        value = {} if mark == "{" else [] if mark == "[" else json.loads(string) if string is not None else Number(number) if number is not None else _WORDS[word]
        if not stack:
            root.append(value)
        elif isinstance(stack[-1], dict):
            stack[-1][names[-1]] = value
        else:
            stack[-1].append(value)
        if mark:
            stack.append(value)
            names.append(None)
            want = "first"
        else:
            want = "more" if stack else "end"
    if want != "end":
        raise ValueError("unfinished")
    return root[0]


def parse_object(text: str | None) -> dict | None:
    """The one complete JSON object that ``text`` is, else None."""
    if not text:
        return None
    stripped = text.strip(_BLANK)
    if not stripped.startswith("{"):
        return None
    try:
        value, end = _DECODER.raw_decode(stripped)
        return value if end == len(stripped) and isinstance(value, dict) else None
    except RecursionError:
        pass
    except ValueError:
        return None
    try:
        value = _parse_deep(stripped)
    except ValueError:
        return None
    return value if isinstance(value, dict) else None


def _escape(label: str) -> str:
    if "~" in label or "/" in label or "#" in label:
        return label.replace("~", "~0").replace("/", "~1").replace("#", "~2")
    return label


def _clean(text: str) -> str:
    try:
        text.encode("utf-8")
        return text
    except UnicodeEncodeError:
        return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def nodes_of(value: dict) -> Iterator[tuple]:
    """(node, parent, label, ordinal, kind, scalar, path) of every node, root first."""
    yield 0, -1, "", 0, "object", None, ""
    stack: list[tuple[Any, int, str]] = [(value, 0, "")]
    number = 0
    while stack:
        holder, parent, path = stack.pop()
        entered = []
        inside = isinstance(holder, dict)
        items: Iterable[tuple[str, Any]] = holder.items() if inside else (("", x) for x in holder)
        for ordinal, (label, x) in enumerate(items):
            number += 1
            label = _clean(label) if inside else ""
            below = (f"{path}/{_escape(label)}" if path else _escape(label)) if inside else f"{path}#{ordinal}"
            if isinstance(x, (dict, list)):
                yield number, parent, label, ordinal, "object" if isinstance(x, dict) else "array", None, below
                entered.append((x, number, below))
            elif x is None:
                yield number, parent, label, ordinal, "null", None, below
            elif isinstance(x, bool):
                yield number, parent, label, ordinal, "boolean", "true" if x else "false", below
            else:
                yield number, parent, label, ordinal, "number" if isinstance(x, Number) else "string", _clean(str(x)), below
        stack.extend(reversed(entered))


def shred(records: DataFrame, record_id: str, body: str) -> DataFrame:
    """Adjacency table of the documents in ``body``; see the module's head."""
    schema = pa.schema([(n, pa.string() if n in ("label", "kind", "scalar", "path") else pa.int64()) for n in ("record_id", "body_hash", "node", "parent", "label", "ordinal", "kind", "scalar", "path")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(records: list[tuple], rows: list[tuple]) -> pa.RecordBatch:
            times = np.array([n for _, _, n in records], np.int64)
            owners = [pa.array([r[k] for r in records], pa.int64()).take(pa.array(np.repeat(np.arange(len(records)), times))) for k in range(2)]
            columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), list(schema)[2:], strict=True)]
            return pa.RecordBatch.from_arrays([*owners, *columns], schema=schema)

        for batch in batches:
            records: list[tuple] = []
            rows: list[tuple] = []
            held = 0
            for rid, hashed, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                value = parse_object(text)
                nodes = nodes_of(value) if value is not None else iter(())
                while some := list(itertools.islice(nodes, 512)):
                    records.append((rid, hashed, len(some)))
                    rows += some
                    # paths of deep documents are long, so characters count as well as rows
                    held += 64 * len(some) + sum(len(node[-1]) for node in some)
                    if held >= HELD:
                        yield packed(records, rows)
                        records, rows, held = [], [], 0
            if rows:
                yield packed(records, rows)

    slim = records.where(F.col(body).isNotNull()).select(F.col(record_id).cast("bigint").alias("record_id"), F.xxhash64(body).alias("body_hash"), F.col(body).alias("body"))
    return slim.mapInArrow(run, NODE_SCHEMA)


#: What tells a document, and a node in it.
RECORD = ("record_id", "body_hash")
NODE = (*RECORD, "node")
SCALARS = ("string", "number", "boolean")


def properties(nodes: DataFrame, fields: dict[str, Sequence[str]]) -> DataFrame:
    """(record, node, fields …): scalars below object nodes, pivoted to one row for each node.

    A field is the list of labels that lead from the node to its scalar, through
    objects only. Scalars name their holder by ``parent``; for longer fields the holder
    is joined, by its number, to get its own holder, and so on up. Of a name given to
    several scalars the greatest is kept; nodes without any of the fields have no row.
    """
    ends = {labels[-1] for labels in fields.values()}
    inner = {label for labels in fields.values() for label in labels[:-1]}
    found = nodes.where(F.col("kind").isin(*SCALARS) & F.col("label").isin(*ends)).select(*RECORD, F.col("parent").alias("node"), F.concat(F.lit("/"), "label").alias("below"), "scalar")
    holders = nodes.where((F.col("kind") == "object") & F.col("label").isin(*inner)).select(*NODE, "parent", "label")
    done = {}
    for depth in range(1, max(map(len, fields.values())) + 1):
        if depth > 1:
            found = holders.join(found, list(NODE)).select(*RECORD, F.col("parent").alias("node"), F.concat(F.lit("/"), "label", "below").alias("below"), "scalar")
        here = {"".join(f"/{x}" for x in labels): name for name, labels in fields.items() if len(labels) == depth}
        if here:
            done[depth] = found.where(F.col("below").isin(*here)).select(*NODE, F.create_map(*[F.lit(x) for pair in here.items() for x in pair])[F.col("below")].alias("field"), "scalar")
    rows = None
    for part in done.values():
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy(*NODE).agg(*[F.max(F.when(F.col("field") == name, F.col("scalar"))).alias(name) for name in fields])


def entities(nodes: DataFrame, is_entity: Column, fields: dict[str, Sequence[str]]) -> DataFrame:
    """The object nodes that ``is_entity`` selects, joined with their properties; absent ones are null."""
    chosen = nodes.where((F.col("kind") == "object") & is_entity).dropDuplicates(list(NODE))
    return chosen.select(*NODE, "parent", "label", "ordinal", "path").join(properties(nodes, fields), list(NODE), "left")


# -- bindings to raw manifests ------------------------------------------------------

REVISION = "org.opencontainers.image.revision"
ENTRY_FIELDS = ("config", "manifests", "layers")
_STEP = r"^(?:config|(?:manifests|layers)(?:#\d+)?)\z"


def is_entry(path: Column) -> Column:
    """Every step is an entry's. Step by step: one pattern over a deep path would recurse."""
    return F.forall(F.split(path, "/"), lambda step: step.rlike(_STEP))


def manifest_nodes(raw: DataFrame) -> DataFrame:
    """The adjacency table of ``raw.body``, written once."""
    return written(shred(raw, "record_id", "body"), "nodes")


def _entry_path(path: Column) -> Column:
    # a lone object in place of an array is its element 0
    return F.regexp_replace(F.regexp_replace(path, r"(manifests|layers)(?=/|$)", "$1#0"), "#", "/")


def manifest_entries(nodes: DataFrame) -> DataFrame:
    """All entries (index entries, configs, layers): the table of ``nodes`` with its links.

    ``parent`` is the number of the object or array that holds an entry's node.
    """
    found = entities(nodes, is_entry(F.col("path")), {"media_type": ["mediaType"], "architecture": ["platform", "architecture"], "revision": ["annotations", REVISION]})
    full = _entry_path(F.col("path"))
    parent = F.regexp_replace(full, r"/?(?:config|(?:manifests|layers)/\d+)$", "")
    kind = F.regexp_extract("path", r"(config|manifests|layers)(?:#\d+)?$", 1)
    return found.select(*NODE, "parent", full.alias("entry_path"), parent.alias("parent_path"), kind.alias("kind"), *[F.coalesce(c, F.lit("")).alias(c) for c in ("media_type", "architecture", "revision")])


def entry_annotations(nodes: DataFrame) -> DataFrame:
    """(record_id, body_hash, node, entry_path, name, value): child table of the entries, a row for each annotation.

    The scalars of an object ``annotations`` belong to the entry that holds it.
    """
    holders = nodes.where("kind = 'object' and label = 'annotations'").select(*NODE, F.col("parent").alias("entry"))
    values = nodes.where(F.col("kind").isin(*SCALARS)).select(*RECORD, F.col("parent").alias("node"), F.col("label").alias("name"), F.col("scalar").alias("value"))
    held = holders.join(values, list(NODE)).select(*RECORD, F.col("entry").alias("node"), "name", "value")
    owners = nodes.where((F.col("kind") == "object") & is_entry(F.col("path"))).select(*NODE, _entry_path(F.col("path")).alias("entry_path"))
    return owners.join(held, list(NODE)).select(*NODE, "entry_path", "name", "value").dropDuplicates()


def entry_platforms(nodes: DataFrame) -> DataFrame:
    """(record_id, body_hash, node, entry_path, os, architecture, variant): child table of the entries, a row for each platform object."""
    owners = nodes.where((F.col("kind") == "object") & is_entry(F.col("path"))).select(*RECORD, F.col("node").alias("parent"), _entry_path(F.col("path")).alias("entry_path"))
    held = entities(nodes, F.col("label") == "platform", {"os": ["os"], "architecture": ["architecture"], "variant": ["variant"]})
    return owners.join(held, [*RECORD, "parent"]).select(*RECORD, F.col("parent").alias("node"), "entry_path", "os", "architecture", "variant").dropDuplicates()
