"""Nearest neighbours by multi-index hashing.

A rotation is learned on a bounded sample: from the sample's principal axes it is turned, step by
step, so that the signs of the rotated vectors lose as little as possible. The signs are a code of
64 bits (with fewer dimensions the axes are repeated by random directions), cut into four
substrings of 16 bits. Every vector is in the index: each task keeps its part of the different
vectors with four tables from substring value to vectors.

A query whose code is within Hamming radius r = 4 p + e of a vector's code is within p in one of the
first e + 1 substrings or within p - 1 in one of the others (pigeonhole), so the table entries that
are so near hold every code within r. Only their vectors are looked at: whole codes are compared, and
inner products of the original vectors in double precision are computed for codes within r alone. The
radius is learned too: on the sample, it covers ``REACH`` of the true nearest neighbours. In a larger
table neighbours are nearer, so the radius that is enough for the sample is enough there. A task that
finds fewer than k vectors within the radius widens it until it has k or all of its vectors.

Equal vectors are one entry with their smallest k + 1 ids, which are all that an answer can name.
Vectors are dealt into shards of at most ``SHARD_VALUES`` numbers and queries into groups; every
group meets every shard in one cell. A task builds a cell's index from its vectors, which come first,
and streams the queries past it, so its memory is bounded and nothing but the sample and the counts
reaches the driver. Vectors move once a group and queries once a shard, with the number of groups
chosen so that both move about as much. Each cell answers a query with at most k + 1 rows.

Edge cases: vectors that are null, empty, zero, of another length than most, or hold null or
non-finite parts take no part, nor do rows with a null id; rows that repeat id and vector count
once; a row that repeats a query's id is the query's own; ties go to the smaller id; with fewer
candidates than k all are returned; an empty table gives an empty result. Other columns are
left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import stored, unit_hash

K = 20
BITS = 64
PARTS = 4
PART_BITS = BITS // PARTS
SAMPLE = 4_096
REACH = 0.985
SHARD_VALUES = 1 << 23
TURNS = 30


class Coder:
    """Mean and rotation that turn vectors into codes, and the radius to search."""

    def __init__(self, sample: np.ndarray, k: int):
        rng = np.random.default_rng(17)
        size = sample.shape[1]
        self.mean = sample.mean(axis=0) if len(sample) else np.zeros(size)
        centered = sample - self.mean
        axes = np.linalg.svd(centered, full_matrices=True)[2] if len(sample) else np.eye(size)
        blocks = [axes[: min(BITS, size)].T]
        while sum(b.shape[1] for b in blocks) < BITS:
            blocks.append(np.linalg.qr(rng.normal(size=(size, size)))[0][:, : BITS - sum(b.shape[1] for b in blocks)])
        self.axes = np.hstack(blocks)[:, :BITS]
        projected = centered @ self.axes
        turn = np.linalg.qr(rng.normal(size=(BITS, BITS)))[0]
        for _ in range(TURNS if len(sample) else 0):
            left, _, right = np.linalg.svd(np.sign(projected @ turn).T @ projected)
            turn = (left @ right).T
        self.axes = self.axes @ turn
        self.radius = self._radius(sample, k)

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        signs = (vectors - self.mean) @ self.axes > 0
        return np.packbits(signs, axis=1, bitorder="little").view("<u8").ravel()

    def _radius(self, sample: np.ndarray, k: int) -> int:
        if len(sample) < 2:
            return BITS
        asked, codes = sample[: max(1, len(sample) // 8)], self.codes(sample)
        apart = []
        for i, (vector, code) in enumerate(zip(asked, codes)):
            near = sample @ vector
            near[i] = -np.inf
            best = np.argpartition(-near, min(k, len(near) - 1) - 1)[:k]
            apart.append(np.bitwise_count(codes[best] ^ code))
        return int(np.quantile(np.concatenate(apart), REACH, method="higher"))


class Index:
    """Tables from the values of each substring to the vectors that have them."""

    def __init__(self, coder: Coder, vectors: np.ndarray):
        self.coder, self.vectors, self.tables = coder, vectors, []
        self.codes = coder.codes(vectors) if len(vectors) else np.zeros(0, np.uint64)
        self.products = 0  # inner products computed so far
        for part in substrings(self.codes).T:
            order = np.argsort(part, kind="stable")
            self.tables.append((order, *np.unique(part[order], return_index=True, return_counts=True)))

    def within(self, code: np.uint64, radius: int) -> np.ndarray:
        """Positions of the vectors whose codes differ in at most ``radius`` bits, ascending."""
        whole, extra = divmod(radius, PARTS)
        near = np.zeros(len(self.codes), bool)
        for j, (part, (order, values, starts, counts)) in enumerate(zip(substrings(np.array([code]))[0], self.tables)):
            # Of all values within the substring's radius, only those that occur are visited.
            probed = np.flatnonzero(np.bitwise_count(values ^ part) <= (whole if j <= extra else whole - 1))
            n = counts[probed]
            entries = order[np.repeat(starts[probed] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            near[entries[np.bitwise_count(self.codes[entries] ^ code) <= radius]] = True
        return np.flatnonzero(near)

    def nearest(self, query: np.ndarray, code: np.uint64, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(positions, inner products) of about the k nearest found, the k nearest among them."""
        k, radius = min(k, len(self.codes)), self.coder.radius
        near = self.within(code, radius)
        while len(near) < k:
            radius += PARTS
            near = self.within(code, radius)
        self.products += len(near)
        about = self.vectors[near] @ query
        # Those tied with the k-th but for rounding are in; then each product is summed by itself,
        # so that a score does not depend on what is ranked beside it.
        least = np.partition(about, len(about) - k)[len(about) - k]
        best = near[about >= least - 1e-9 * max(1.0, abs(least))]
        return best, (self.vectors[best] * query).sum(axis=1)


def substrings(codes: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(codes.astype("<u8")).view("<u2").reshape(-1, PARTS)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) rows that can take part, embedding as doubles."""
    v = F.col("embedding")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.cast("array<double>").alias("embedding")).filter(
        F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0)
    )
    return kept


def search(vectors: DataFrame, is_query: Column, k: int = K, sample: int = SAMPLE, shard_values: int = SHARD_VALUES) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows of ``vectors`` (vec_id, embedding) that are queries."""
    spark, rows = vectors.sparkSession, usable(vectors)
    sizes = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    size = sizes["d"] if sizes else 1
    rows = rows.filter(F.size("embedding") == size)
    ranked = rows.distinct().withColumn("_n", F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))).filter(F.col("_n") <= k + 1)
    classes = stored(ranked.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "ann-vectors")
    total = classes.count()
    asked = rows.filter(is_query).groupBy("embedding").agg(F.min("vec_id").alias("class_id"))
    asked = stored(asked, "ann-queries")

    chosen = classes if total <= sample else classes.filter(unit_hash(F.col("embedding"), seed=23) < sample / total)
    learned = np.array(chosen.orderBy(F.element_at("ids", 1)).select("embedding").toArrow().column(0).to_pylist(), float).reshape(-1, size)
    coder = spark.sparkContext.broadcast(Coder(learned, k))
    near = _cells(classes, asked, total, asked.count(), max(1, shard_values // size)).mapInArrow(
        _answers(coder, size, k), "class_id long, minus double, id long"
    )
    # k + 1 ids of the best answers: one of them may be the query itself.
    place = F.row_number().over(Window.partitionBy("class_id").orderBy("minus", "id"))
    near = near.withColumn("_n", place).filter(F.col("_n") <= k + 1)
    merged = near.groupBy("class_id").agg(F.sort_array(F.collect_list(F.struct("minus", "id"))).alias("near"))
    ids = rows.filter(is_query).distinct().join(asked, "embedding").select(F.col("vec_id").alias("query_id"), "class_id")
    others = F.slice(F.filter("near", lambda x: x["id"] != F.col("query_id")), 1, k)
    return (
        ids.join(merged, "class_id")
        .select("query_id", F.posexplode(others).alias("rank", "n"))
        .select("query_id", (F.col("rank") + 1).alias("rank"), F.col("n.id").alias("vec_id"), (-F.col("n.minus")).alias("score"))
    )


def _cells(classes: DataFrame, asked: DataFrame, total: int, queries: int, shard_rows: int) -> DataFrame:
    """(cell, asks, class_id, ids, embedding): every vector meets every query in one cell, vectors first."""
    least = -(-total // shard_rows)
    tasks = max(least, 2 * classes.sparkSession.sparkContext.defaultParallelism)
    # Vectors move ``groups`` times and queries ``shards`` times: about equal if groups / shards = queries / vectors.
    shards = max(1, least, min(tasks, round((tasks * total / max(1, queries)) ** 0.5)))
    groups = -(-tasks // shards)
    shard, group = F.pmod(F.xxhash64("embedding"), F.lit(shards)), F.pmod(F.xxhash64("class_id"), F.lit(groups))
    held = classes.select(
        F.explode(F.transform(F.sequence(F.lit(0), F.lit(groups - 1)), lambda g: shard * groups + g)).alias("cell"),
        F.lit(False).alias("asks"), F.lit(None).cast("long").alias("class_id"), "ids", "embedding",
    )
    sent = asked.select(
        F.explode(F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: s * groups + group)).alias("cell"),
        F.lit(True).alias("asks"), "class_id", F.lit(None).cast("array<long>").alias("ids"), "embedding",
    )
    return held.union(sent).repartition(shards * groups, "cell").sortWithinPartitions("cell", "asks")


def _answers(coder, size: int, k: int):
    """Per cell, from batches sorted by (cell, asks): the best k + 1 (class_id, minus score, id) of each query."""

    def matrix(parts: list[pa.RecordBatch]) -> np.ndarray:
        return np.concatenate([p.column("embedding").flatten().to_numpy() for p in parts]).reshape(-1, size)

    def answered(index: Index, ids: list[list[int]], part: pa.RecordBatch) -> pa.RecordBatch:
        names, minus, found = [], [], []
        asked = matrix([part])
        for name, query, code in zip(part.column("class_id").to_pylist(), asked, index.coder.codes(asked)):
            near, score = index.nearest(query, code, k + 1)
            best = sorted((-s, i) for v, s in zip(near.tolist(), score.tolist()) for i in ids[v])[: k + 1]
            names += [name] * len(best)
            minus += [s for s, _ in best]
            found += [i for _, i in best]
        return pa.RecordBatch.from_arrays(
            [pa.array(names, pa.int64()), pa.array(minus, pa.float64()), pa.array(found, pa.int64())], names=["class_id", "minus", "id"]
        )

    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, parts, index, ids = None, [], None, []
        for batch in batches:
            cells = batch.column("cell").to_numpy()
            edges = np.flatnonzero(np.diff(cells)) + 1
            for a, b in zip(np.concatenate(([0], edges)), np.append(edges, len(cells))):
                if a == b:
                    continue
                if cells[a] != cell:
                    cell, parts, index, ids = cells[a], [], None, []
                part = batch.slice(a, b - a)
                held = int(np.searchsorted(part.column("asks").to_numpy(zero_copy_only=False), True))
                if held:
                    parts.append(part.slice(0, held))
                if held < b - a and parts:
                    if index is None:
                        index = Index(coder.value, matrix(parts))
                        ids = [x for p in parts for x in p.column("ids").to_pylist()]
                    yield answered(index, ids, part.slice(held))

    return answers
