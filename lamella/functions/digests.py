"""Digest spelling, short forms and object keys as JVM-side column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\r\n"
ALGORITHM_PREFIX = "sha256:"


def _bare(c: Column) -> Column:
    low = F.lower(F.btrim(c, F.lit(BLANKS)))
    return F.when(low.startswith(ALGORITHM_PREFIX), F.substring(low, len(ALGORITHM_PREFIX) + 1, 2**31 - 1)).otherwise(low)


def is_blank(c: Column) -> Column:
    """Null, empty or only blanks."""
    return F.coalesce(F.btrim(c, F.lit(BLANKS)) == "", F.lit(True))


def plain(c: Column) -> Column:
    """Lower-case 64-hex form, or null when the value is no well-formed digest."""
    bare = _bare(c)
    return F.when((F.octet_length(bare) == 64) & F.unhex(bare).isNotNull(), bare)


def plain_bytes(c: Column) -> Column:
    """The same as 32 bytes: half the shuffle of the hex text."""
    bare = _bare(c)
    return F.when(F.octet_length(bare) == 64, F.unhex(bare))


def hex_text(c: Column) -> Column:
    return F.lower(F.hex(c))


def short(c: Column, n: int = 12) -> Column:
    return F.substring(F.regexp_replace(c, "^sha256:", ""), 1, n)


def content_digest(c: Column) -> Column:
    """sha256 hex of text or bytes."""
    return F.sha2(c.cast("binary"), 256)


def strict(c: Column) -> Column:
    """True for the store's own spelling only: ``sha256:`` and 64 lower-case hex digits."""
    return F.coalesce(c.rlike(r"^sha256:[a-f0-9]{64}\z"), F.lit(False))


def object_class(key: Column) -> Column:
    """``blobs`` of ``/blobs/sha256/<hex>``; one leading slash does not count."""
    return F.regexp_extract(key, r"^/?([^/]+)/sha256/[0-9a-fA-F]{64}\z", 1)


def object_digest(key: Column) -> Column:
    """Digest of a content-addressed key as 32 bytes, null for any other key."""
    hexed = F.regexp_extract(key, r"^/?[^/]+/sha256/([0-9a-fA-F]{64})\z", 1)
    return F.when(hexed != "", F.unhex(hexed))


def object_key(kind: str, c: Column) -> Column:
    return F.concat(F.lit(f"{kind}/sha256/"), c)
