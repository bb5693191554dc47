"""Paths inside layered images."""

from __future__ import annotations

import posixpath
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITEOUT, OPAQUE = ".wh.", ".wh..wh..opq"
MAX_HOPS = 16


def normal_path(c: Column) -> Column:
    """Without any leading ``./`` and ``/``."""
    return F.regexp_replace(c, r"^(\./|/)+", "")


def normal(path: str) -> str:
    return re.sub(r"^(\./|/)+", "", path)


def resolve_link(link: str, target: str) -> str:
    """Path a link leads to: relative targets start at the link's directory."""
    joined = target if target.startswith("/") else posixpath.join(posixpath.dirname(link), target)
    return normal(posixpath.normpath(joined))


def whiteouts(path: Column) -> Column:
    """Markers that say the path is gone from the layers below: its own, and for each
    directory above it that directory's own and its opaque marker."""
    parts = F.split(path, "/")

    def cut(upto: Column) -> Column:
        return F.array_join(F.slice(parts, F.lit(1), upto), "/")

    def marker(i: Column) -> Column:
        above = F.when(i > 1, F.concat(cut(i - 1), F.lit("/"))).otherwise("")
        return F.concat(above, F.lit(WHITEOUT), F.element_at(parts, i))

    names = F.transform(F.sequence(F.lit(1), F.size(parts)), marker)
    inner = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.concat(cut(i), F.lit("/" + OPAQUE)))).otherwise(F.array())
    return F.concat(names, inner)
