"""Hash-based keys and routing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def shard_of(source: Column, shards: int) -> Column:
    """md5 of the source, read as a number, modulo the shard count.

    The 128-bit number is folded digit by digit, so any shard count works without
    arithmetic beyond a long.
    """
    digits = F.split(F.md5(source.cast("binary")), "")
    total = F.aggregate(
        digits,
        F.lit(0).cast("long"),
        lambda acc, d: F.when(d == "", acc).otherwise(
            (acc * 16 + F.conv(d, 16, 10).cast("long")) % shards
        ),
    )
    return total.cast("int")


def chunk_key(*parts: Column) -> Column:
    """Deterministic id: the same input gives the same id when a task is run again."""
    return F.sha2(F.concat_ws("\u001f", *[p.cast("string") for p in parts]), 256)


def cache_key(query: Column, context_hash: Column | None = None) -> Column:
    from docloom.functions.text import strip

    base = strip(F.lower(query))
    if context_hash is not None:
        extended = F.concat(base, F.lit("_"), context_hash)
        has_context = context_hash.isNotNull() & (context_hash != "")
        base = F.when(has_context, extended).otherwise(base)
    return F.md5(base.cast("binary"))
