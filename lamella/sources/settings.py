"""Editing a bucket's configuration as a plain dict; the caller writes it back."""

from __future__ import annotations

import copy

from lamella.functions.values import duration_seconds

KEYS = ("chunked", "immutable", "lifecycle", "lifecycle.keep_last", "lifecycle.max_age", "lifecycle.keep_tags")


def _boolean(key: str, text: str) -> bool:
    if text.lower() not in ("true", "false"):
        raise ValueError(f"{key} is true or false, not {text!r}")
    return text.lower() == "true"


def _value(key: str, text: str):
    if key in ("chunked", "immutable"):
        return _boolean(key, text)
    if key == "lifecycle.keep_last":
        if not text.isdecimal():
            raise ValueError(f"{key} is a whole number from 0 on, not {text!r}")
        return int(text)
    if key == "lifecycle.max_age":
        duration_seconds(text)
        return text
    if key == "lifecycle.keep_tags":
        return [t.strip() for t in text.split(",")]
    raise ValueError(f"{key} is a block; set one of its fields, or nothing to drop it")


def changed(config: dict, key: str, text: str, image: str | None = None) -> dict:
    """A copy of ``config`` with one key set, for an image pattern or the default.

    An empty text unsets. Blocks left empty disappear, and so does an image left empty.
    """
    if key not in KEYS or (image and key == "chunked"):
        raise ValueError(f"no such key {key!r}")
    out = copy.deepcopy(config)
    if key == "chunked":
        out.pop(key, None)
        if text:
            out[key] = _value(key, text)
        return out
    holder = out.setdefault("images", {}).setdefault(image, {}) if image else out.setdefault("default", {})
    block, _, field = key.partition(".")
    spot, name = (holder.setdefault(block, {}), field) if field else (holder, block)
    spot.pop(name, None)
    if text:
        spot[name] = _value(key, text)
    for held, k in ((holder, "lifecycle"), (out.get("images", {}), image), (out, "images"), (out, "default")):
        if k in held and held[k] == {}:
            del held[k]
    return out
