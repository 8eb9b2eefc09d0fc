"""A stored vector index in cells: a search reads the cells near its queries.

Centres are learned on a sample of at most ``SAMPLE`` vectors, whatever the table's size; every vector is
stored in blocks in the folder of its nearest centre. Queries go to their nearest cells, are packed in
blocks too, and meet the vectors in a join on the cell, so pairs of blocks move and no pairs of rows, no
query passes the driver, and the plan is the same for any number of queries. Both sides of a cell are
dealt into parts by a hash, so that a cell with a large share of all vectors is many blocks of many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from docloom.operators.dense import _matrix
from docloom.operators.topk import SCORE_DIGITS, _Best, top_k

SAMPLE = 20_000  # vectors that centres are learned from
TRIED = 500  # of them that the number of probed cells is learned from
ROUNDS = 8
VECTOR_BLOCK = 256
QUERY_BLOCK = 128
PARTS = 8
REACHED = 0.95  # share of a tried vector's neighbours in the cells that are probed


def _distances(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances up to a constant of each vector."""
    return (centres * centres).sum(axis=1)[None, :] - 2.0 * (vectors @ centres.T)


def _centres(sample: np.ndarray, cells: int) -> np.ndarray:
    """Centres by rounds of k-means from evenly taken starts; empty cells keep theirs."""
    made = sample[np.linspace(0, len(sample) - 1, cells).astype(int)].copy()
    for _ in range(ROUNDS):
        nearest = _distances(sample, made).argmin(axis=1)
        sums = np.zeros_like(made)
        np.add.at(sums, nearest, sample)
        n = np.bincount(nearest, minlength=cells)
        made[n > 0] = sums[n > 0] / n[n > 0, None]
    return made


def _probes(sample: np.ndarray, centres: np.ndarray, k: int = 10) -> int:
    """How many of its nearest cells hold ``REACHED`` of a vector's k nearest in the sample."""
    tried = np.linspace(0, len(sample) - 1, min(TRIED, len(sample))).astype(int)
    near = _distances(sample[tried], sample)
    near[np.arange(len(tried)), tried] = np.inf
    k = min(k, len(sample) - 1)
    if k < 1:
        return 1
    found = np.argpartition(near, k - 1, axis=1)[:, :k]
    place = _distances(sample[tried], centres).argsort(axis=1).argsort(axis=1)
    cells = _distances(sample, centres).argmin(axis=1)
    ranks = np.take_along_axis(place, cells[found], axis=1)
    return int(np.quantile(ranks, REACHED, method="higher")) + 1


class CellIndex:
    """Blocks of vectors below ``root``, with the centres and the learned number of probed cells."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def build(self, corpus: DataFrame, id_col: str = "id", vector_col: str = "embedding", cells: int = 64) -> None:
        """Learn the centres and store all vectors; rows without a vector are left out."""
        rows = corpus.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector")).where("vector is not null")
        taken = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vector").toArrow().column(0).combine_chunks()
        if len(taken):
            sample = _matrix(taken, len(taken[0]))
            centres = _centres(sample, min(cells, len(sample)))
            probes = _probes(sample, centres)
        else:
            centres, probes = np.zeros((1, 1)), 1
        made = self.spark.createDataFrame([(probes, centres.tolist())], "probes int, centres array<array<double>>")
        made.coalesce(1).write.parquet(f"{self.root}/centres")
        self.add(rows)

    def _learned(self) -> tuple[np.ndarray, int]:
        row = self.spark.read.parquet(f"{self.root}/centres").first()
        return np.array(row["centres"]), row["probes"]

    def add(self, rows: DataFrame, id_col: str = "id", vector_col: str = "vector") -> None:
        """Append vectors to the cells of the centres as they are."""
        rows = rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector")).where("vector is not null")
        placed = _in_cells(rows, self._learned()[0], 1)
        _packed(placed, VECTOR_BLOCK).write.mode("append").partitionBy("cell").parquet(f"{self.root}/blocks")

    def search(self, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
        """``query_id, id, score, rank`` of the k nearest vectors in the ``probes`` nearest cells.

        Score is 1 - squared distance, rounded; ties go to the smaller id. With as many probes as cells
        the result is exact. Queries without a vector have no hits.
        """
        centres, learned = self._learned()
        asked = queries.select(F.col("query_id").alias("id"), F.col("embedding").alias("vector")).where("vector is not null")
        blocks = self.spark.read.parquet(f"{self.root}/blocks") if self._filled() else None
        id_type = blocks.schema["ids"].dataType.elementType if blocks else T.LongType()
        query_type = queries.schema["query_id"].dataType
        fields = [T.StructField("query_id", query_type), T.StructField("id", id_type), T.StructField("score", T.DoubleType())]
        if blocks is None:
            return self.spark.createDataFrame([], T.StructType([*fields, T.StructField("rank", T.IntegerType())]))
        packed = _packed(_in_cells(asked, centres, min(probes or learned, len(centres))), QUERY_BLOCK)
        met = blocks.join(packed.select("cell", F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors")), "cell")
        schema = pa.schema([pa.field(f.name, to_arrow_type(f.dataType)) for f in fields])

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    ids, vectors, q_ids, asked = (batch.column(c)[i].values for c in range(4))
                    a, b = (x.to_numpy().reshape(len(n), -1).astype(np.float64) for x, n in ((vectors, ids), (asked, q_ids)))
                    if a.shape[1] != b.shape[1]:
                        raise ValueError(f"vectors must have {a.shape[1]} elements")
                    best = _Best(len(b), k, None)
                    scores = 1.0 - ((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2.0 * (a @ b.T))
                    best.add(ids.to_numpy(zero_copy_only=False), np.round(scores, SCORE_DIGITS), None)
                    yield best.batch(q_ids.to_pylist(), schema)

        hits = met.select("ids", "vectors", "q_ids", "q_vectors").mapInArrow(score, T.StructType(fields))
        return top_k(hits, ["query_id"], [F.col("score").desc(), F.col("id")], k)

    def _filled(self) -> bool:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/blocks")
        files = place.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return files.exists(place) and any(s.isDirectory() for s in files.listStatus(place))


def _in_cells(rows: DataFrame, centres: np.ndarray, n: int) -> DataFrame:
    """(cell, id, vector) for the n nearest cells of each row."""
    ids = rows.schema["id"].dataType
    kind = to_arrow_type(ids)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, 4_000_000 // len(centres))
            for a in range(0, batch.num_rows, step):
                some = batch.slice(a, step)
                matrix = _matrix(some.column(1), centres.shape[1])
                near = _distances(matrix, centres)
                chosen = np.argpartition(near, n - 1, axis=1)[:, :n] if n < len(centres) else np.tile(np.arange(n), (len(near), 1))
                at = pa.array(np.repeat(np.arange(some.num_rows), n))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(chosen.ravel().astype(np.int32)),
                        some.column(0).take(at).cast(kind),
                        some.column(1).take(at).cast(pa.list_(pa.float64())),
                    ],
                    names=["cell", "id", "vector"],
                )

    schema = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("id", ids), T.StructField("vector", T.ArrayType(T.DoubleType()))])
    return rows.mapInArrow(place, schema)


def _packed(placed: DataFrame, size: int) -> DataFrame:
    """(cell, ids, vectors): blocks of at most ``size`` rows of a cell, vectors one after the other."""
    ids = placed.schema["id"].dataType
    schema = T.StructType(
        [
            T.StructField("cell", T.IntegerType()),
            T.StructField("ids", T.ArrayType(ids)),
            T.StructField("vectors", T.ArrayType(T.DoubleType())),
        ]
    )
    kinds = [to_arrow_type(f.dataType) for f in schema]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = batch.column(0).to_numpy()
            ends = [*(np.flatnonzero(np.diff(cells)) + 1).tolist(), len(cells)] if len(cells) else []
            start = 0
            for end in ends:
                for a in range(start, end, size):
                    some = batch.slice(a, min(size, end - a))
                    values = [int(cells[a])], [some.column(1).to_pylist()], [some.column(2).flatten().to_numpy()]
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kinds)], names=["cell", "ids", "vectors"])
                start = end

    dealt = placed.withColumn("_part", F.pmod(F.xxhash64("id"), F.lit(PARTS)))
    ordered = dealt.repartition("cell", "_part").sortWithinPartitions("cell").drop("_part")
    return ordered.mapInArrow(pack, schema)
