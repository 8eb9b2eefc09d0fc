"""Top-k per group, and top-k of query blocks inside scan tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

SCORE_DIGITS = 6


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group.

    A bound on ``row_number`` lets Spark keep only k rows per group in each task before
    the shuffle, so a group with most of the rows stays cheap.
    """
    window = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


class _Best:
    """The best k ids of every (group, query) seen by one task."""

    def __init__(self, n_queries: int, k: int, floor: float | None):
        self.n_queries, self.k, self.floor = n_queries, k, floor
        self.kept: dict = {}
        self.least: dict = {}

    def add(self, ids: np.ndarray, scores: np.ndarray, groups: np.ndarray | None) -> None:
        scores = np.round(scores, SCORE_DIGITS)
        for group in [None] if groups is None else np.unique(groups):
            rows = slice(None) if group is None else np.flatnonzero(groups == group)
            some_ids, some = ids[rows], scores[rows]
            # Only queries that some row can still enter are looked at one by one.
            least = self.least.setdefault(group, np.full(self.n_queries, -np.inf))
            tops = some.max(axis=0, initial=-np.inf)
            for q in np.flatnonzero(tops >= least).tolist():
                if self.floor is None or tops[q] > self.floor:
                    self._merge((group, q), some_ids, some[:, q])
                    if len(self.kept[group, q][0]) == self.k:
                        least[q] = self.kept[group, q][1].min()

    def _merge(self, key, ids: np.ndarray, scores: np.ndarray) -> None:
        if self.floor is not None:
            above = scores > self.floor
            ids, scores = ids[above], scores[above]
        if key in self.kept:
            old_ids, old_scores = self.kept[key]
            if len(old_ids) == self.k:
                chance = scores >= old_scores.min()
                ids, scores = ids[chance], scores[chance]
            ids, scores = np.concatenate([old_ids, ids]), np.concatenate([old_scores, scores])
        if len(ids) > self.k:
            edge = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            sure = np.flatnonzero(scores > edge)
            tied = np.flatnonzero(scores == edge)
            tied = tied[np.argsort(ids[tied], kind="stable")[: self.k - len(sure)]]
            chosen = np.concatenate([sure, tied])
            ids, scores = ids[chosen], scores[chosen]
        self.kept[key] = (ids, scores)

    def batch(self, query_ids: list, schema: pa.Schema) -> pa.RecordBatch:
        columns: list[list] = [[] for _ in schema]
        for (group, q), (ids, scores) in self.kept.items():
            n = len(ids)
            values = [[query_ids[q]] * n, ids.tolist(), scores.tolist()]
            if len(schema) == 4:
                values.append([int(group)] * n)
            for column, new in zip(columns, values):
                column.extend(new)
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema
        )


Scorer = Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, np.ndarray]]]


def scan_top_k(
    df: DataFrame,
    id_type: T.DataType,
    query_type: T.DataType,
    query_ids: list,
    scorer: Scorer,
    k: int,
    floor: float | None = None,
    grouped: bool = False,
) -> DataFrame:
    """Score every row against one block of queries where the row is read.

    The first column of ``df`` is the id; with ``grouped`` the last one is an int group.
    ``scorer`` gives (row positions, scores of these rows for all queries). A task
    returns at most k rows per query (and group), so scores of pairs are never shuffled.
    """
    fields = [
        T.StructField("query_id", query_type),
        T.StructField("id", id_type),
        T.StructField("score", T.DoubleType()),
    ]
    if grouped:
        fields.append(T.StructField("group_id", T.IntegerType()))
    out = T.StructType(fields)
    arrow = pa.schema([pa.field(f.name, to_arrow_type(f.dataType)) for f in fields])
    n_queries = len(query_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(n_queries, k, floor)
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            groups = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False) if grouped else None
            for rows, scores in scorer(batch):
                best.add(ids[rows], scores, None if groups is None else groups[rows])
        yield best.batch(query_ids, arrow)

    return df.mapInArrow(run, out)


def query_blocks(queries: DataFrame, size: int) -> Iterator[list]:
    """The rows of ``queries`` in blocks of at most ``size``.

    Any number of queries is served: each block is one pass over the corpus, and the
    driver holds one block at a time.
    """
    block = []
    for row in queries.toLocalIterator():
        block.append(row)
        if len(block) == size:
            yield block
            block = []
    if block:
        yield block


def union_all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
