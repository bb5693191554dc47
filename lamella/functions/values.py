"""Small values: durations, sizes, shares."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNITS = {"h": 3600.0, "m": 60.0, "s": 1.0, "ms": 1e-3, "us": 1e-6, "µs": 1e-6, "ns": 1e-9}


def duration_seconds(text: str) -> float:
    """``90d`` or a Go duration such as ``1h30m``; ValueError for anything else."""
    if m := re.fullmatch(r"(-?\d+)d", text):
        return int(m[1]) * 86400.0
    if text in ("0", "+0", "-0"):
        return 0.0
    if not re.fullmatch(r"[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:ms|us|µs|ns|h|m|s))+", text):
        raise ValueError(f"no duration: {text!r}")
    total = sum(float(n) * _UNITS[u] for n, u in re.findall(r"(\d+\.?\d*|\.\d+)(ms|us|µs|ns|h|m|s)", text))
    return -total if text.startswith("-") else total


def duration_column(c: Column) -> Column:
    """Seconds of ``Nd`` or whole ``NhNmNs``; null for anything else."""
    days = F.regexp_extract(c, r"^(-?\d+)d\z", 1)

    def part(unit: str) -> Column:
        return F.coalesce(F.nullif(F.regexp_extract(c, rf"(\d+){unit}(?![a-z])", 1), F.lit("")).cast("bigint"), F.lit(0))

    clock = F.when(c.rlike(r"^(\d+h)?(\d+m)?(\d+s)?\z") & (F.length(c) > 0), part("h") * 3600 + part("m") * 60 + part("s"))
    return F.when(days != "", days.cast("bigint") * 86400).otherwise(clock)


def human_bytes(c: Column) -> Column:
    """Binary units under their common names, one decimal."""
    steps = ((1 << 30, "GB"), (1 << 20, "MB"), (1 << 10, "KB"))
    out = F.concat(c.cast("string"), F.lit(" B"))
    for size, unit in reversed(steps):
        out = F.when(c >= size, F.format_string(f"%.1f {unit}", c / F.lit(float(size)))).otherwise(out)
    return out


def share(part: Column, whole: Column) -> Column:
    """part / whole, 0 when there is no whole."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))
