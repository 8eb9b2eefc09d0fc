"""Small chunks for search, their parent text for context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.config import Settings
from docloom.functions import text as t
from docloom.functions.classify import document_type
from docloom.operators.chunking import word_windows


def parents(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return docs.select(
        F.col(id_col).cast("string").alias("parent_id"),
        F.col("text"),
        F.col("source"),
        t.word_count(F.col("text")).alias("word_count"),
        document_type(F.col("text")).alias("document_type"),
    )


def children(parent_rows: DataFrame, size: int = Settings.child_words) -> DataFrame:
    """Word windows of the parents with ``chunk_id`` = parent id and index."""
    rows = word_windows(parent_rows.select("parent_id", "source", "text"), size=size)
    return rows.withColumn(
        "chunk_id", F.concat_ws("_chunk_", F.col("parent_id"), F.col("chunk_index").cast("string"))
    )


def context_window(text: Column, index: Column, window: int = Settings.context_words, size: int = 250,
                   start_word: Column | None = None) -> Column:
    """Words around a chunk: half the window before it, half behind it.

    By default the chunk is taken to begin at index x size, although windows overlap;
    give ``start_word`` to use its real position.
    """
    begin = index * size if start_word is None else start_word
    words = t.words(text)
    first = F.greatest(begin - window // 2, F.lit(0))
    last = begin + size + window // 2
    return F.array_join(F.slice(words, first + 1, last - first), " ")


def with_parent_context(
    hits: DataFrame, child_rows: DataFrame, parent_rows: DataFrame, most: int,
    window: int = Settings.context_words, aligned: bool = False,
) -> DataFrame:
    """Search hits with the parent's words around them; hits without a parent pass through.

    ``hits`` has ``query_id, id, score, rank`` where id is the chunk id; at most ``most`` rows.
    """
    small = most <= Settings.broadcast_rows
    one = hits.withColumnRenamed("id", "chunk_id")
    # The wanted ids go to the tables, not the tables to the hits: the inner joins read
    # the tables without a shuffle, the left joins work on hit-sized rows.
    ids = one.select("chunk_id").distinct()
    wanted = child_rows.select("chunk_id", "parent_id", "chunk_index", "start_word", "text").join(
        F.broadcast(ids) if small else ids, "chunk_id"
    )
    parent_ids = wanted.select("parent_id").distinct()
    texts = parent_rows.select("parent_id", F.col("text").alias("parent_text")).join(
        F.broadcast(parent_ids) if small else parent_ids, "parent_id"
    )
    rows = one.join(wanted, "chunk_id", "left").join(texts, "parent_id", "left")
    context = context_window(
        F.col("parent_text"), F.col("chunk_index"), window,
        start_word=F.col("start_word") if aligned else None,
    )
    return rows.withColumn("parent_context", context).select(
        "query_id",
        "rank",
        "chunk_id",
        "score",
        "text",
        "parent_id",
        "chunk_index",
        "parent_context",
        F.when(F.col("parent_context").isNotNull(), t.word_count(F.col("parent_context"))).alias("context_words"),
    )


def hierarchy_stats(parent_rows: DataFrame, child_rows: DataFrame) -> DataFrame:
    """Counts by document type, with a total row (``document_type`` null)."""
    counted = child_rows.groupBy("parent_id").agg(F.count("*").alias("n"))
    return (
        parent_rows.select("parent_id", "document_type", "word_count")
        .join(counted, "parent_id", "left")
        .rollup("document_type")
        .agg(
            F.count("*").alias("parent_documents"),
            F.coalesce(F.sum("n"), F.lit(0)).alias("child_chunks"),
            F.round(F.coalesce(F.sum("n"), F.lit(0)) / F.count("*"), 6).alias("average_chunks"),
            F.max("word_count").alias("largest_document"),
        )
    )
