"""Answer cache as a keyed table: newest entry per key, levels, expiry, capacity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.config import Settings
from docloom.functions.hashing import cache_key


def entries(answers: DataFrame, ttl_seconds: int = Settings.ttl_seconds) -> DataFrame:
    """``query, value, created_at`` (and ``context_hash``) as cache rows with key and expiry."""
    context = F.col("context_hash") if "context_hash" in answers.columns else None
    return answers.select(
        cache_key(F.col("query"), context).alias("key"),
        "value",
        "created_at",
        (F.col("created_at") + F.make_dt_interval(secs=F.lit(ttl_seconds))).alias("expires_at"),
    )


def newest(rows: DataFrame) -> DataFrame:
    """One row per key, the newest one: an insert replaces what was there.

    ``max_by`` keeps one row per key in each task, so a hot key is no burden.
    """
    order = F.struct("created_at", "value")
    return rows.groupBy("key").agg(
        F.max_by(F.struct("value", "created_at", "expires_at"), order).alias("e")
    ).select("key", "e.*")


def valid(rows: DataFrame, now: Column) -> DataFrame:
    return rows.where((F.col("created_at") <= now) & (F.col("expires_at").isNull() | (F.col("expires_at") > now)))


def lookup(queries: DataFrame, levels: list[DataFrame], now: Column) -> DataFrame:
    """Each query with the value of the first level that holds a live entry.

    Adds ``key, value, level, cached``. Keys are reduced to one row before the join.
    """
    parts = [valid(rows, now).select("key", "value", F.lit(i + 1).alias("level")) for i, rows in enumerate(levels)]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    first = found.groupBy("key").agg(F.min_by(F.struct("value", "level"), "level").alias("hit"))
    context = F.col("context_hash") if "context_hash" in queries.columns else None
    asked = queries.withColumn("key", cache_key(F.col("query"), context))
    return (
        asked.join(first, "key", "left")
        .select(*asked.columns, F.col("hit.value").alias("value"), F.col("hit.level").alias("level"))
        .withColumn("cached", F.col("level").isNotNull())
    )
