"""Sizes of texts in tokens of a public byte-level tokenizer.

The vocabulary file is a parameter. It is read on the driver, its size checked, and
broadcast, so executors need no copy of it. A null text has no size; an empty one 0.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Default place of the rank file.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
MAX_VOCABULARY_BYTES = 64 << 20
#: Fixed value: the pattern that splits text before the merges of the public rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_encoders: dict[int, object] = {}


def encoder(vocabulary: bytes):
    """Encoder of a rank file's bytes, made once a process."""
    key = hash(vocabulary)
    if key not in _encoders:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines()) if a}
        _encoders[key] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[key]


#: Characters given to the encoder at once. Longer texts are cut where the pattern cuts
#: as well, before a space that follows a letter or digit, so the count stays exact.
CHUNK = 1 << 16


def count(enc, text: str) -> int:
    total, at = 0, 0
    while len(text) - at > CHUNK:
        cut = text.rfind(" ", at + 1, at + CHUNK)
        while cut > at and not (text[cut - 1].isalpha() and text[cut - 1 : cut + 2][-1].isalpha()):
            cut = text.rfind(" ", at + 1, cut)
        if cut <= at:
            break
        total += len(enc.encode_ordinary(text[at:cut]))
        at = cut
    return total + len(enc.encode_ordinary(text[at:]))


def with_tokens(rows: DataFrame, column: str = "text", name: str = "tokens", vocabulary: str = VOCABULARY) -> DataFrame:
    """``rows`` with the number of tokens of ``column``."""
    with open(vocabulary, "rb") as f:
        data = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(data) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{vocabulary} is larger than {MAX_VOCABULARY_BYTES} bytes")
    shared = rows.sparkSession.sparkContext.broadcast(data)

    @F.pandas_udf("bigint")
    def tokens(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoder(shared.value)
        for batch in texts:
            yield pd.Series([None if t is None else count(enc, t) for t in batch], dtype="Int64")

    return rows.withColumn(name, tokens(F.col(column)))
