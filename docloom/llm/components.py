"""Connected components of a graph that is a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import work_folder
from docloom.session import removed
from docloom.session import stored as stored_at


def _sum(edges: DataFrame) -> tuple:
    """Number and checksum of the edges."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _both(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (u, v): the smallest node it is connected to.

    Large and small stars in turn: each node points its larger, then its smaller neighbours to the
    smallest one it sees, until every component is a star. A round is a few shuffles of edges whose
    number never grows; the edges of each round are stored, so nothing is recomputed, and those of the
    round before are deleted.
    """
    spark = edges.sparkSession
    path = work_folder(spark, "edges")
    edges = stored_at(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), path)
    state = _sum(edges)
    while state[0]:
        sym = _both(edges)
        least = sym.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = sym.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Now u > v throughout: every node points all smaller neighbours to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, old, path = state, path, work_folder(spark, "edges")
        edges = stored_at(small.union(least.select("u", F.col("m").alias("v"))).distinct(), path)
        removed(spark, old)
        state = _sum(edges)
        if state == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
