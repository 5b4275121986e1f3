"""Stable keys, deterministic ids and provenance records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the RFC 4122 namespace for URLs.
URL_NAMESPACE_HEX = "6ba7b8119dad11d180b400c04fd430c8"


def content_key(identifier: Column) -> Column:
    """First 16 hex digits of the SHA-256 of an identifier."""
    return F.substring(F.sha2(identifier, 256), 1, 16)


def name_uuid(name: Column) -> Column:
    """Version 5 UUID of a name in the URL namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE_HEX)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws(
        "-",
        F.substring(h, 1, 8),
        F.substring(h, 9, 4),
        F.concat(F.lit("5"), F.substring(h, 14, 3)),
        F.concat(variant, F.substring(h, 18, 3)),
        F.substring(h, 21, 12),
    )


def provenance(source: str, source_id: Column, notes: Column, stage: str | None = None) -> Column:
    """Record of where a row came from."""
    return F.struct(
        F.lit(source).alias("source"),
        source_id.alias("source_id"),
        F.lit(stage).cast("string").alias("stage"),
        F.array().cast("array<string>").alias("parents"),
        F.current_timestamp().alias("created_at"),
        notes.alias("notes"),
    )
