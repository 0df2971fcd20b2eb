"""Content hashes, row ids and mergeable set digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_hash(value: Column) -> Column:
    return F.sha2(value, 256)


def row_id(columns, length=24) -> Column:
    """Truncated SHA-256 of the canonical text of ordered fields."""
    parts = [F.coalesce(c.cast("string"), F.lit("\\N")) for c in columns]
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, length)


def json_id(columns, length=24) -> Column:
    """Truncated SHA-256 of a JSON object with sorted keys."""
    return F.substring(F.sha2(F.to_json(F.struct(*sorted(columns))), 256), 1, length)


def set_digest(columns) -> list[Column]:
    """Order-free digest of a row set as mergeable aggregates.

    Two 60-bit lanes of each row's hash are XOR-ed, so partial aggregation
    works and no group is gathered. Rows must be distinct inside a group.
    """
    digest = F.sha2(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("\\N")) for c in columns]), 256)
    lane = lambda start: F.bit_xor(F.conv(F.substring(digest, start, 15), 16, 10).cast("bigint"))
    return [lane(1).alias("digest_a"), lane(16).alias("digest_b")]
