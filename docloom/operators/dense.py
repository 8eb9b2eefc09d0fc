"""Exact nearest neighbours for blocks of query vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.config import Settings
from docloom.operators.topk import query_blocks, scan_top_k, top_k, union_all


_SCORES_PER_STEP = 4_000_000


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if flat.size != len(column) * width:
        raise ValueError(f"vectors must have {width} elements")
    return flat.reshape(-1, width).astype(np.float64)


def _distance_scorer(queries: np.ndarray):
    q2 = (queries * queries).sum(axis=1)

    def score(batch: pa.RecordBatch):
        column = batch.column(1)
        filled = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
        vectors = _matrix(column.drop_null(), queries.shape[1])
        step = max(_SCORES_PER_STEP // len(queries), 1)
        for a in range(0, len(vectors), step):
            some = vectors[a : a + step]
            v2 = (some * some).sum(axis=1)
            yield filled[a : a + step], 1.0 - (v2[:, None] + q2[None, :] - 2.0 * (some @ queries.T))

    return score


def dense_search(
    corpus: DataFrame,
    queries: DataFrame,
    k: int,
    id_col: str = "id",
    vector_col: str = "embedding",
    group: Column | None = None,
    group_k: int | None = None,
    block: int = Settings.vector_block,
) -> DataFrame:
    """``query_id, id, score, rank`` of the k nearest vectors; score = 1 - squared distance.

    ``queries`` has ``query_id`` and ``embedding``. Scores are rounded before ranking, so
    copies tie and the smaller id comes first. With ``group`` each group gives its best
    ``group_k`` and the result the best k of those, with the group in ``group_id``.
    """
    columns = [F.col(id_col).alias("id"), F.col(vector_col).alias("vector")]
    if group is not None:
        columns.append(group.cast("int").alias("group_id"))
    # Rows without a vector are dropped by the scorer: a filter here would compute an
    # embedding made on the fly twice.
    rows = corpus.select(*columns)
    id_type, query_type = rows.schema["id"].dataType, queries.schema["query_id"].dataType
    parts = []
    for some in query_blocks(queries.select("query_id", "embedding"), block):
        matrix = np.array([r["embedding"] for r in some], dtype=np.float64)
        parts.append(
            scan_top_k(
                rows, id_type, query_type, [r["query_id"] for r in some], _distance_scorer(matrix),
                group_k or k, grouped=group is not None,
            )
        )
    if not parts:
        return _no_hits(rows, queries, group is not None)
    hits = union_all(parts)
    order = [F.col("score").desc(), F.col("id")]
    if group is not None:
        hits = top_k(hits, ["query_id", "group_id"], order, group_k or k, "group_rank").drop("group_rank")
    return top_k(hits, ["query_id"], order, k)


def _no_hits(rows: DataFrame, queries: DataFrame, grouped: bool) -> DataFrame:
    empty = rows.limit(0).select(
        F.lit(None).cast(queries.schema["query_id"].dataType).alias("query_id"),
        "id",
        F.lit(0.0).alias("score"),
        *(["group_id"] if grouped else []),
        F.lit(1).alias("rank"),
    )
    return empty


def sharded_dense_search(
    corpus: DataFrame, queries: DataFrame, k: int, shard: Column, id_col: str = "id", vector_col: str = "embedding"
) -> DataFrame:
    """Each shard gives its k nearest, the best k of all shards are kept: exact for every k."""
    found = dense_search(corpus, queries, k, id_col, vector_col, group=shard, group_k=k)
    return found.withColumnRenamed("group_id", "shard_id")
