"""The vector index in cells: exact with all cells, recall at the learned number, batches, edges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.operators.cell_index import CellIndex
from docloom.operators.dense import dense_search


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(40, 16))
    # A third of all vectors are in one cluster; a few rows are repeated or have no vector.
    which = np.where(rng.random(4000) < 0.33, 0, rng.integers(0, 40, 4000))
    made = (middles[which] + rng.normal(size=(4000, 16)) * 0.4).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(made)] + [(5000 + i, made[i].tolist()) for i in range(20)] + [(6000, None)]
    return spark.createDataFrame(rows, "id long, embedding array<float>").repartition(5)


def collected(df):
    return sorted(map(tuple, df.select("query_id", "rank", "id", "score").collect()))


def test_cells(spark, vectors, tmp_path):
    index = CellIndex(spark, f"file://{tmp_path}/cells")
    index.build(vectors.where("id % 4 < 3"), cells=32)
    index.add(vectors.where("id % 4 = 3"), vector_col="embedding")
    queries = vectors.where("id % 20 = 0").select(F.concat(F.lit("q"), "id").alias("query_id"), "embedding")
    want = collected(dense_search(vectors, queries.where("embedding is not null"), 10))
    assert len(want) == 201 * 10
    assert collected(index.search(queries, 10, probes=32)) == want
    probes = index._learned()[1]
    got = index.search(queries, 10)
    assert 1 <= probes < 32
    pairs = {(q, i) for q, _, i, _ in want}
    assert len(pairs & {(q, i) for q, _, i, _ in collected(got)}) / len(pairs) >= 0.9
    # The plan does not grow with the queries.
    plans = [index.search(queries.where(f"query_id like '{x}%'"), 10)._jdf.queryExecution().optimizedPlan().toString() for x in ("q", "q20")]
    assert len(plans[0].splitlines()) == len(plans[1].splitlines())
    blocks = spark.read.parquet(f"file://{tmp_path}/cells/blocks")
    assert blocks.agg(F.sum(F.size("ids"))).first()[0] == vectors.where("embedding is not null").count()


def test_few_and_no_vectors(spark, vectors, tmp_path):
    index = CellIndex(spark, f"file://{tmp_path}/few")
    index.build(vectors.where("id in (1, 2, 6000)"))
    queries = vectors.where("id in (1, 6000)").select(F.col("id").alias("query_id"), "embedding")
    assert [r[:3] for r in collected(index.search(queries, 5, probes=9))] == [(1, 1, 1), (1, 2, 2)]
    assert index.search(queries.limit(0), 5).count() == 0
    empty = CellIndex(spark, f"file://{tmp_path}/none")
    empty.build(vectors.where("id = 6000"))
    assert empty.search(queries, 5).count() == 0
