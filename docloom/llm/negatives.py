"""Hard negatives: for each anchor and positive the highest-scoring rows of other labels.

Exact search by shared lists. Anchors are clustered around directions learned on a bounded sample. A
row at angle t to a cluster's direction is at an angle of at least t - w to every anchor of the
cluster, if none of these is further than w from the direction, so the row's score with an anchor is
at most |anchor| |row| cos(max(0, t - w)). Rows are sorted by |row| cos(max(0, t - w)) once per
cluster, and every anchor of the cluster walks down this list until what it has found cannot be
beaten by any row behind: then its result is certain.

Rows are dealt into shards by a hash of their ids, with all rows of the same label side by side.
Anchors go to every shard, sorted by cluster, and are read there batch by batch, so a task holds one
shard, one list and one batch. The first pass finds each anchor's positives: it walks the rows of the
anchor's label. The second takes the scores of these positives along and walks all rows: for each
positive, rows of other labels with a score between ``low`` / ``high`` of the positive's and the
positive's itself. A shard returns no more rows than asked for, the rows of all shards are merged.

Scores are inner products of whole numbers and exact. The order is (score down, id up) throughout.

Edge cases: rows with a null id, label or vector, or with a null or non-finite part take no part, nor
do vectors of another length than most rows have; of rows that repeat an id the one with the
smallest label, then vector, takes part; an anchor without positives or a positive without negatives
gives no rows; ties go to the smaller id, however many rows tie; an empty table gives an empty
result. Other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import stored, unit_hash

POSITIVES = 5
NEGATIVES = 5
LOW, HIGH = 80, 100
CLUSTERS = 16
SAMPLE = 4_096
TURNS = 10
SHARD = 1 << 17
MEMBERS = 128
STEP = 512
EXACT = 1 << 53


def usable(vectors: DataFrame, vector: Column, label: Column) -> DataFrame:
    """(vec_id, label, v) rows that take part; ``vector`` is an expression for an array of whole numbers
    as long, made from the column ``embedding`` of finite numbers."""
    parts = F.col("embedding")
    finite = F.forall(parts, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & parts.isNotNull() & finite)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), vector.alias("v"))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.filter(F.size("v") == (sizes["d"] if sizes else 0))


def learned_directions(sample: np.ndarray, clusters: int) -> np.ndarray:
    """Unit vectors: spherical k-means."""
    rng = np.random.default_rng(5)
    unit = _unit(sample)
    centres = unit[rng.permutation(len(unit))[:clusters]]
    for _ in range(TURNS if len(unit) else 0):
        near = (unit @ centres.T).argmax(axis=1)
        for c in range(len(centres)):
            if (near == c).any():
                centres[c] = unit[near == c].sum(axis=0)
        centres = _unit(centres)
    return centres


def _unit(v: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(size > 0, size, 1)


def _angles(unit: np.ndarray, direction: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(unit @ direction, -1, 1))


class Shard:
    """Rows that are searched together, by label and id."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        order = np.lexsort((ids, labels))
        self.ids, self.labels, self.whole = ids[order], labels[order], vectors[order]
        # Whole numbers up to 2^53 are exact as doubles, whatever the order of the sum.
        self.most = int(np.abs(self.whole).max(initial=0))
        self.wide = self.whole.astype(float)
        self.size = np.linalg.norm(self.wide, axis=1)
        self.unit = _unit(self.wide)
        self.rank = np.empty(len(ids), np.int64)
        self.rank[np.argsort(self.ids, kind="stable")] = np.arange(len(ids))
        self.by_rank = np.argsort(self.ids, kind="stable")
        self.lists: tuple[object, np.ndarray, np.ndarray] | None = None

    def listed(self, cluster: int, direction: np.ndarray, wide: float) -> tuple[np.ndarray, np.ndarray]:
        """Rows by descending bound for a cluster, and the bounds; kept until the next cluster comes."""
        if self.lists is None or self.lists[0] != cluster:
            bound = self.size * np.cos(np.maximum(0, _angles(self.unit, direction) - wide - 1e-7))
            order = np.argsort(-bound, kind="stable")
            self.lists = (cluster, order, bound[order])
        return self.lists[1:]

    def of_label(self, order: np.ndarray, bound: np.ndarray, label: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = np.searchsorted(self.labels, [label, label + 1])
        chosen = (order >= a) & (order < b)
        return order[chosen], bound[chosen]

    def scores(self, rows: np.ndarray, anchors: np.ndarray) -> np.ndarray:
        """(rows x anchors) whole numbers."""
        if self.most * max(1, int(np.abs(anchors).max(initial=0))) * anchors.shape[1] < EXACT:
            return (self.wide[rows] @ anchors.T.astype(float)).astype(np.int64)
        return self.whole[rows].astype(object) @ anchors.T.astype(object)

    def walk(self, order: np.ndarray, bound: np.ndarray, ids: np.ndarray, labels: np.ndarray | None, anchors: np.ndarray, high: np.ndarray | None, low: np.ndarray | None, k: int):
        """The k best rows of each anchor and limit: (found, score), each (k x anchors x limits); -1: none.

        ``labels``: rows of these are no answers; ``high`` and ``low``: (anchors x limits) bounds of the
        scores that count (None: one limit, all scores).
        """
        count = len(anchors)
        limits = 1 if high is None else high.shape[1]
        # Score and place in the order of ids as one number; equal scores: the smaller id is the higher.
        base = len(self.ids) + 1
        exact = self.most * max(1, int(np.abs(anchors).max(initial=0))) * anchors.shape[1] < (1 << 62) // base
        kind = np.int64 if exact else object
        none = -(1 << 62) if exact else -(1 << 200)
        best = np.full((k, count, limits), none, kind)
        length = np.linalg.norm(anchors.astype(float), axis=1)
        active, at = np.arange(count), 0
        while len(active) and at < len(order):
            rows = order[at : at + STEP]
            found = self.scores(rows, anchors[active]).astype(kind)
            packed = found * base + (base - 1 - self.rank[rows])[:, None]
            out = self.ids[rows][:, None] == ids[active][None, :]
            if labels is not None:
                out |= self.labels[rows][:, None] == labels[active][None, :]
            wide = np.repeat(packed[:, :, None], limits, axis=2)
            wide[np.repeat(out[:, :, None], limits, axis=2)] = none
            if high is not None:
                wide[found[:, :, None] > high[active][None]] = none
                wide[found[:, :, None] < low[active][None]] = none
            both = np.concatenate([best[:, active], wide])
            best[:, active] = np.sort(both, axis=0)[::-1][:k]
            at += STEP
            if at < len(order):
                # What can still come is at most this; a tie could be a smaller id, so it must be lower.
                ahead = bound[at] * length[active] * (1 + 1e-9) + 1e-6
                last = best[k - 1][active]
                needed = np.where(last == none, np.inf * -1, (last // base).astype(float))
                if low is not None:
                    needed = np.maximum(needed, low[active].astype(float))
                    needed[low[active] > high[active]] = np.inf
                active = active[ahead >= needed.min(axis=1)]
        rank = base - 1 - best % base
        has = best != none
        place = np.where(has, rank, 0).astype(np.int64)
        return has, self.ids[self.by_rank[place]], best // base


def _groups(clusters: np.ndarray, labels: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows alike in both, at most MEMBERS long."""
    change = np.flatnonzero((np.diff(clusters) != 0) | (np.diff(labels) != 0)) + 1
    for a, b in zip(np.concatenate(([0], change)), np.append(change, len(clusters))):
        for i in range(a, b, MEMBERS):
            yield i, min(b, i + MEMBERS)


def _matrix(column: pa.ChunkedArray | pa.Array, size: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size) if size else np.zeros((len(column), 0), np.int64)


def _search(directions: np.ndarray, size: int, k: int, limits: bool, out: list[str]):
    """Answers of each shard from batches sorted by (shard, is anchor, cluster, label)."""

    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, shard = None, [], None

        def answered(part: pa.RecordBatch) -> pa.RecordBatch:
            ids, labels, clusters = (part.column(c).to_numpy() for c in ("vec_id", "label", "cluster"))
            vectors, wide = _matrix(part.column("v"), size), part.column("wide").to_numpy(zero_copy_only=False)
            columns = [[] for _ in out]
            for a, b in _groups(clusters, labels * (not limits)):
                order, bound = shard.listed(clusters[a], directions[clusters[a]], wide[a])
                if not limits:
                    order, bound = shard.of_label(order, bound, labels[a])
                    has, found, score = shard.walk(order, bound, ids[a:b], None, vectors[a:b], None, None, k)
                    for j, i, _ in np.argwhere(has.transpose(1, 0, 2)):
                        for column, x in zip(columns, (ids[a + j], found[i, j, 0], score[i, j, 0])):
                            column.append(int(x))
                    continue
                goals = part.column("positives").slice(a, b - a).to_pylist()
                most = max(map(len, goals))
                high, low = np.full((b - a, most), -1, np.int64), np.full((b - a, most), 0, np.int64)
                for j, g in enumerate(goals):
                    for n, x in enumerate(g):
                        high[j, n], low[j, n] = x["score"], x["low"]
                has, found, score = shard.walk(order, bound, ids[a:b], labels[a:b], vectors[a:b], high, low, k)
                for j, n, i in np.argwhere(has.transpose(1, 2, 0)):
                    row = (ids[a + j], goals[j][n]["id"], high[j, n], found[i, j, n], score[i, j, n])
                    for column, x in zip(columns, row):
                        column.append(int(x))
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=out)

        for batch in batches:
            shards = batch.column("shard").to_numpy()
            change = np.flatnonzero(np.diff(shards)) + 1
            for a, b in zip(np.concatenate(([0], change)), np.append(change, len(shards))):
                if b == a:
                    continue
                part = batch.slice(a, b - a)
                if shards[a] != key:
                    key, parts, shard = shards[a], [], None
                asks = part.column("asks").to_numpy(zero_copy_only=False)
                rows = int(np.searchsorted(asks, True))
                if rows:
                    parts.append(part.slice(0, rows))
                if rows < len(asks) and parts:
                    if shard is None:
                        made = pa.Table.from_batches(parts)
                        shard = Shard(made.column("vec_id").to_numpy(), made.column("label").to_numpy(), _matrix(made.column("v"), size))
                        parts = [parts[0].slice(0, 0)]
                    yield answered(part.slice(rows))

    return answers


def _first(found: DataFrame, group: list[str], score: str, row: str, k: int) -> DataFrame:
    """The k first rows of each group, with ``rank``."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(score), row))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def mine(
    rows: DataFrame,
    is_anchor: Column,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    clusters: int = CLUSTERS,
    shard: int = SHARD,
    sample: int = SAMPLE,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows of
    ``usable`` that are anchors: of the negatives with ``low`` * positive <= ``high`` * negative <=
    ``high`` * positive, the first ``negatives`` of each anchor and positive."""
    spark = rows.sparkSession
    one = rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("row")).select("vec_id", "row.label", "row.v")
    rows = stored(one, "rows")
    total, size = rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    size = size or 0
    anchors = rows.filter(is_anchor)
    asked = anchors.count()
    chosen = anchors if asked <= sample else anchors.filter(unit_hash(F.col("vec_id"), seed=11) < sample / asked)
    learned = _matrix(chosen.orderBy("vec_id").select("v").toArrow().column(0), size) if size else np.zeros((asked, 0))
    directions = learned_directions(learned.astype(float), clusters)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = _unit(_matrix(batch.column("v"), size).astype(float))
            cluster = (unit @ directions.T).argmax(axis=1) if len(unit) else np.zeros(0, np.int64)
            angle = np.arccos(np.clip((unit * directions[cluster]).sum(axis=1), -1, 1)) if len(unit) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cluster, pa.int64()), pa.array(angle)], names=[*batch.schema.names, "cluster", "angle"])

    near = stored(anchors.mapInArrow(placed, "vec_id long, label long, v array<long>, cluster long, angle double"), "anchors")
    # The widest angle of each of at most ``clusters`` clusters.
    widest = near.groupBy("cluster").agg(F.max("angle").alias("wide"))
    near = near.join(widest, "cluster").select("vec_id", "label", "v", "cluster", "wide")

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = max(1, min(parts, -(-total // 1024)), -(-total // shard))
    goal = "array<struct<id:long,score:long,low:long>>"

    def searched(asking: DataFrame, k: int, limits: bool, out: list[str]) -> DataFrame:
        names = ["shard", "asks", "vec_id", "label", "v", "cluster", "wide", "positives"]
        none = F.array().cast(goal)
        held = rows.select(
            F.pmod(F.xxhash64("vec_id"), F.lit(shards)).alias("shard"), F.lit(False).alias("asks"), "vec_id", "label", "v",
            F.lit(0).cast("long").alias("cluster"), F.lit(0.0).alias("wide"), none.alias("positives"),
        )
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard")
        asking = asking.select(every, F.lit(True).alias("asks"), "vec_id", "label", "v", "cluster", "wide", (F.col("positives") if limits else none).alias("positives"))
        dealt = held.select(*names).union(asking.select(*names)).repartition(shards, "shard").sortWithinPartitions("shard", "asks", "cluster", "label")
        return dealt.mapInArrow(_search(directions, size, k, limits, out), ", ".join(f"{c} long" for c in out))

    found = searched(near, positives, False, ["anchor_id", "positive_id", "positive_score"])
    best = _first(found, ["anchor_id"], "positive_score", "positive_id", positives)
    # The smallest whole score s with low * positive <= high * s.
    least = F.expr(f"-((-{low} * positive_score - pmod(-{low} * positive_score, {high})) div {high})")
    goals = best.groupBy("anchor_id").agg(
        F.collect_list(F.struct(F.col("positive_id").alias("id"), F.col("positive_score").alias("score"), least.alias("low"))).alias("positives")
    )
    asking = stored(near.join(goals, F.col("vec_id") == F.col("anchor_id")).drop("anchor_id"), "asking")
    out = ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]
    answers = _first(searched(asking, negatives, True, out), ["anchor_id", "positive_id"], "negative_score", "negative_id", negatives)
    return answers.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
