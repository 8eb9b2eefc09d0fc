"""The stored index by term: batches, bounds, pruning, failed batches."""

import os
import random

import pytest
from pyspark.sql import functions as F

from docloom.operators.sparse import Bm25Model
from docloom.operators.term_index import TermIndex


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(3)
    vocabulary = [f"word{i}" for i in range(300)]
    rows = []
    for i in range(600):
        n = rng.randrange(3, 60)
        words = [vocabulary[min(int(rng.expovariate(0.03)), 299)] for _ in range(n)]
        if i % 3 == 0:
            words += ["common"] * rng.randrange(1, 4)
        rows.append((i, " ".join(words)))
    rows += [(600, ""), (601, None), (602, "common"), (603, "common common")]
    return spark.createDataFrame(rows, "id long, text string").repartition(4)


@pytest.fixture(scope="module")
def asked(spark):
    rows = [(0, "common word3"), (1, "word250 word251 word290"), (2, "word0 word1 word0"), (3, "nowhere"), (4, ""), (5, "common")]
    return spark.createDataFrame(rows, "query_id int, text string")


@pytest.fixture(scope="module")
def index(spark, texts, tmp_path_factory):
    made = TermIndex(spark, f"file://{tmp_path_factory.mktemp('index')}/bm25", buckets=16, block=8, part_rows=100)
    for turn in range(3):
        made.add(texts.where(F.col("id") % 3 == turn))
    made.add(texts)  # all of them are there
    return made


def collected(df):
    return sorted(map(tuple, df.select("query_id", "id", "score", "rank").collect()))


def test_batches_equal_one_pass(index, texts, asked):
    want = collected(Bm25Model.fit(texts).search(asked, 7))
    assert want and collected(index.search(asked, 7)) == want
    assert collected(index.search(asked, 7, bounds=False)) == want
    assert collected(index.model().search(asked, 7, positive_only=False)) == collected(Bm25Model.fit(texts).search(asked, 7, positive_only=False))


def test_bounds_leave_out_rows_of_frequent_terms(index, asked):
    some = asked.where("query_id in (0, 2, 5)")
    assert collected(index.search(some, 3)) == collected(index.search(some, 3, bounds=False))
    read, every = ({r.query_id: r["count"] for r in index.contributions(some, 3, b).groupBy("query_id").count().collect()} for b in (True, False))
    assert read[5] < every[5] / 2 and all(read[i] < every[i] for i in (0, 2))


def test_negative_weights_read_all_blocks(spark, tmp_path):
    rows = [(i, "same words here" + " x" * (i % 5)) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, text string")
    queries = spark.createDataFrame([(0, "same x"), (1, "x here other")], "query_id int, text string")
    made = TermIndex(spark, f"file://{tmp_path}/i", block=4)
    made.add(df)
    assert made.totals()["avg_idf"] < 0
    assert collected(made.search(queries, 5)) == collected(Bm25Model.fit(df).search(queries, 5))
    want = collected(Bm25Model.fit(df).search(queries, 5, positive_only=False))
    assert collected(made.model().search(queries, 5, positive_only=False)) == want and len(want) == 10


def test_search_reads_asked_buckets_and_writes_nothing(index, asked, tmp_path):
    found = index.search(asked.where("query_id = 3 or query_id = 5"), 3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    pruned = [x[:60] for x in plan.split("PartitionFilters: ")[1:] if x.startswith("[") and "bucket" in x[:60]]
    assert len(pruned) >= 3
    root = index.root.removeprefix("file://")

    def files():
        return sorted(os.path.join(d, f) for d, _, fs in os.walk(root) for f in fs)

    before = files()
    found.collect()
    assert files() == before


def test_a_batch_that_failed_half_way_counts_once(spark, texts, asked, tmp_path):
    made = TermIndex(spark, f"file://{tmp_path}/i", buckets=8, block=8)
    made.add(texts.where("id < 300"))
    plain, made._total = made._total, lambda *a: (_ for _ in ()).throw(RuntimeError("lost"))
    with pytest.raises(RuntimeError):
        made.add(texts.where("id >= 300"))
    made._total = plain
    assert collected(made.search(asked, 5)) == collected(Bm25Model.fit(texts.where("id < 300")).search(asked, 5))
    made.add(texts.where("id >= 300"))
    assert collected(made.search(asked, 5)) == collected(Bm25Model.fit(texts).search(asked, 5))


def test_blocks_stay_where_they_are_read(spark, index, asked):
    """Weights are sent to the blocks; entries are not shuffled to meet them."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = index.contributions(asked, 5)._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    depths = [len(x) - len(x.lstrip(" :+-")) for x in lines]
    for i, line in enumerate(lines):
        if "SortMergeJoin [term" in line:
            end = next((j for j in range(i + 1, len(lines)) if depths[j] <= depths[i]), len(lines))
            assert not any("entries" in x for x in lines[i:end])
