"""Signatures bound to a location: payloads and the order in which verification fails.

The cryptography is a parameter: ``check(payload, signature, key_id) -> Column``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamella.functions import names

SCHEMA_VERSION = 2
DOMAIN = "lamella-signature-v2"


def payload_bytes(bucket: str, image: str, tag: str, digest: str, domain: str = DOMAIN) -> bytes:
    """What a signature covers, as ``names.signing_payload`` puts it in a column."""
    return f"{domain}\n{bucket}/{image}:{tag}\n{digest}\n".encode()


def verify(tags: DataFrame, signatures: DataFrame, bucket: str, check: Callable[[Column, Column, Column], Column], domain: str = DOMAIN) -> DataFrame:
    """(image, tag, verified, reason); the first failure is the reason.

    ``tags``: (image, tag, digest). ``signatures``: (image, tag, schema_version, digest,
    key_id, signature) with signature in base64; of several for a tag any good one does.
    """
    joined = tags.select("image", "tag", F.col("digest").alias("now")).join(signatures, ["image", "tag"], "left")
    raw = F.try_to_binary("signature", F.lit("base64"))
    payload = names.signing_payload(F.lit(bucket), F.col("image"), F.col("tag"), F.col("digest"), domain)
    reason = (
        F.when(F.col("signature").isNull() & F.col("schema_version").isNull(), "no signature")
        .when(F.coalesce(F.col("schema_version") != SCHEMA_VERSION, F.lit(True)), "unknown schema")
        .when(~F.col("digest").eqNullSafe(F.col("now")), "digest changed")
        .when(raw.isNull(), "bad encoding")
        .when(~F.coalesce(check(payload, raw, F.col("key_id")), F.lit(False)), "bad signature")
        .otherwise("ok")
    )
    rank = F.array_position(F.array(*[F.lit(x) for x in ("ok", "bad signature", "bad encoding", "digest changed", "unknown schema", "no signature")]), F.col("reason"))
    return joined.withColumn("reason", reason).groupBy("image", "tag").agg(F.min_by("reason", rank).alias("reason")).select("image", "tag", (F.col("reason") == "ok").alias("verified"), "reason")
