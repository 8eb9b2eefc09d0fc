"""Fusing and re-ranking the hits of several search methods."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom import rules
from docloom.config import Settings
from docloom.functions.text import relevance
from docloom.operators.topk import SCORE_DIGITS, top_k

Reranker = Callable[[Column, Column], Column]


def attach(hits: DataFrame, corpus: DataFrame, most: int, on: str = "id") -> DataFrame:
    """Corpus columns for the hits.

    ``most`` is the proven number of hit rows (queries x hits kept). Up to the limit the
    hits are broadcast and the corpus is read without a shuffle; beyond it both sides
    are shuffled on the id.
    """
    side = F.broadcast(hits) if most <= Settings.broadcast_rows else hits
    return corpus.join(side, on)


def tagged(hits: DataFrame, method: str) -> DataFrame:
    return hits.select("query_id", "id", "score", F.lit(method).alias("method"))


def _by_text(hits: DataFrame, methods: list[str]) -> DataFrame:
    """One row per query and text with the best score of each method.

    Copies of a text are one result; the smallest id stands for them.
    """
    best = [F.max(F.when(F.col("method") == m, F.col("score"))).alias(f"{m}_score") for m in methods]
    return hits.groupBy("query_id", "text").agg(
        F.min("id").alias("id"),
        *best,
        F.sort_array(F.collect_set("method")).alias("methods_used"),
    )


def fuse_two(hits: DataFrame, alpha: float = Settings.alpha) -> DataFrame:
    """alpha x dense + (1 - alpha) x bm25 / 10 over the union of both hit lists."""
    rows = _by_text(hits, ["dense", "bm25"]).fillna(0.0, ["dense_score", "bm25_score"])
    keyword = F.when(F.col("bm25_score") > 0, F.col("bm25_score") / rules.HYBRID_BM25_SCALE).otherwise(0.0)
    return rows.withColumn(
        "score", F.round(alpha * F.col("dense_score") + (1 - alpha) * keyword, SCORE_DIGITS)
    )


def fuse_three(hits: DataFrame, weights: dict[str, float] = rules.METHOD_WEIGHTS) -> DataFrame:
    """Scores as shares of each method's best, weighted, plus 0.1 per method that agrees.

    Where a method's best score is not positive its share is 0.
    """
    top = F.max("score").over(Window.partitionBy("query_id", "method"))
    shares = hits.withColumn("_top", top).withColumn(
        "score", F.when(F.col("_top") > 0, F.col("score") / F.col("_top")).otherwise(0.0)
    )
    names = list(weights)
    rows = _by_text(shares, names).fillna(0.0, [f"{m}_score" for m in names])
    total = F.lit(0.0)
    for m in names:
        total = total + F.lit(weights[m]) * F.col(f"{m}_score")
    bonus = F.size("methods_used") * F.lit(rules.METHOD_BONUS)
    return rows.withColumn("score", F.round(total + bonus, SCORE_DIGITS))


def lexical_reranker(query: Column, text: Column) -> Column:
    """Offline stand-in for a cross-encoder: word overlap of query and text."""
    return relevance(text, query)


def rerank(rows: DataFrame, queries: DataFrame, scorer: Reranker = lexical_reranker) -> DataFrame:
    """0.7 x score + 0.3 x pair score, for queries with more than one row.

    ``scorer`` is any column expression over (query, text): a pandas UDF around a
    cross-encoder fits in here. Adds ``pair_score`` and ``final_score``.
    """
    own, pair = rules.RERANK_WEIGHTS
    asked = queries.select("query_id", F.col("text").alias("_query"))
    many = F.count("*").over(Window.partitionBy("query_id")) > 1
    return (
        rows.withColumn("_many", many)
        .join(asked, "query_id")
        .withColumn("pair_score", F.when(F.col("_many"), scorer(F.col("_query"), F.col("text"))))
        .withColumn(
            "final_score",
            F.round(
                F.coalesce(own * F.col("score") + pair * F.col("pair_score"), F.col("score")), SCORE_DIGITS
            ),
        )
        .drop("_many", "_query")
    )


def best(rows: DataFrame, k: int, score: str = "score") -> DataFrame:
    return top_k(rows, ["query_id"], [F.col(score).desc(), F.col("id")], k)
