import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.operators import expansion, fusion
from docloom.operators.dense import dense_search, sharded_dense_search
from docloom.operators.sparse import Bm25Model, TfidfModel
from docloom.operators.topk import top_k
from tests.conftest import SF


def okapi(texts, query):
    docs = [x.lower().split() for x in texts]
    df = Counter(w for d in docs for w in set(d))
    n, mean = len(docs), sum(map(len, docs)) / len(docs)
    raw = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    floor = 0.25 * sum(raw.values()) / len(raw)
    out = []
    for d in docs:
        tf = Counter(d)
        out.append(
            sum(
                (raw[w] if raw[w] >= 0 else floor) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(d) / mean))
                for w in query.lower().split()
                if w in raw
            )
        )
    return out


def best(scores, k, floor=0.0):
    order = sorted(range(len(scores)), key=lambda i: (-round(scores[i], 6), i))[:k]
    return [(i, round(scores[i], 6)) for i in order if scores[i] > floor]


@pytest.fixture(scope="module")
def corpus(spark, documents):
    return documents.select(F.col("doc_id").alias("id"), "text").repartition(5)


def test_bm25_equals_plain_python(spark, documents, corpus):
    texts = [r.text for r in documents.orderBy("doc_id").select("text").collect()]
    asked = {0: "the of on", 1: "the the thing", 2: "nothing-here", 3: ""}
    queries = spark.createDataFrame(list(asked.items()), "query_id int, text string")
    model = Bm25Model.fit(corpus)
    found = {}
    for r in model.search(queries, 7).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.id, r.score))
    for q, text in asked.items():
        got = [(i, s) for _, i, s in sorted(found.get(q, []))]
        want = best(okapi(texts, text), 7)
        assert [i for i, _ in got] == [i for i, _ in want]
        assert np.allclose([s for _, s in got], [s for _, s in want], atol=2e-6)


def test_a_search_is_one_plan_for_any_number_of_queries(spark, corpus):
    sizes = []
    models = Bm25Model.fit(corpus), TfidfModel.fit(corpus)
    for n in (10, 2000):
        queries = spark.range(n).select(F.col("id").alias("query_id"), F.lit("the thing").alias("text"))
        sizes.append([len(m.search(queries, 3)._jdf.queryExecution().analyzed().toString().splitlines()) for m in models])
    assert sizes[0] == sizes[1]


def test_bm25_keeps_zero_scores_on_request(spark, corpus):
    queries = spark.createDataFrame([(0, "nothing-here")], "query_id int, text string")
    model = Bm25Model.fit(corpus)
    rows = model.search(queries, 3, positive_only=False).orderBy("rank").collect()
    assert [(r.id, r.score) for r in rows] == [(0, 0.0), (1, 0.0), (2, 0.0)]


def test_term_table_can_be_stored(spark, corpus, tmp_path):
    model = Bm25Model.fit(corpus, table=str(tmp_path / "terms"))
    assert model.n_docs == 200 and model.terms.where("term = 'the'").count() == 1
    again = Bm25Model.of_postings(spark.read.parquet(str(tmp_path / "terms" / "postings")), str(tmp_path / "again"))
    assert (again.n_docs, again.n_terms, again.avg_len) == (model.n_docs, model.n_terms, model.avg_len)


def test_empty_query_table(spark, corpus):
    none = spark.createDataFrame([], "query_id int, text string")
    assert Bm25Model.fit(corpus).search(none, 3).count() == 0
    assert TfidfModel.fit(corpus).search(none, 3).count() == 0


def test_tfidf_finds_the_text_itself(spark, corpus):
    text = corpus.where("id = 1").first().text
    queries = spark.createDataFrame([(5, text)], "query_id int, text string")
    top = TfidfModel.fit(corpus).search(queries, 3).where("rank = 1").first()
    assert top.id == 1 and abs(top.score - 1.0) < 1e-6


def test_dense_ties_and_shards(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    copies = vectors.unionByName(vectors.withColumn("vec_id", F.col("vec_id") + 10_000)).repartition(6)
    queries = vectors.where("vec_id < 3").select(F.col("vec_id").alias("query_id"), "embedding")
    plain = dense_search(copies, queries, 6, id_col="vec_id").orderBy("query_id", "rank").collect()
    assert [(r.id, r.score) for r in plain[:2]] == [(0, 1.0), (10_000, 1.0)]
    for shards in (1, 3, 8):
        split = sharded_dense_search(copies, queries, 6, F.col("vec_id") % shards, id_col="vec_id")
        assert [(r.query_id, r.id, r.score) for r in split.orderBy("query_id", "rank").collect()] == [
            (r.query_id, r.id, r.score) for r in plain
        ]
    small = dense_search(copies, queries, 6, id_col="vec_id", block=2).orderBy("query_id", "rank").collect()
    assert [(r.id, r.score) for r in small] == [(r.id, r.score) for r in plain]


def test_string_ids(spark):
    rows = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.0]), ("c", [0.0, 1.0])], "id string, embedding array<float>")
    queries = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, embedding array<float>")
    assert [r.id for r in dense_search(rows, queries, 2).orderBy("rank").collect()] == ["a", "b"]


def test_top_k_is_limited_before_the_shuffle(spark):
    rows = spark.range(1000).select((F.col("id") % 2).alias("g"), F.rand(1).alias("s"), "id")
    plan = top_k(rows, ["g"], [F.desc("s"), F.col("id")], 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_fusion_of_negative_scores_and_copies(spark):
    hits = spark.createDataFrame(
        [(0, 1, -0.5, "dense", "t1"), (0, 2, -0.9, "dense", "t2"), (0, 3, 4.0, "bm25", "t1"), (0, 4, 2.0, "bm25", "t4")],
        "query_id int, id int, score double, method string, text string",
    )
    found = {r.text: r for r in fusion.fuse_three(hits).collect()}
    assert found["t1"].score == round(0.3 + 0.2, 6) and found["t1"].id == 1
    assert found["t1"].methods_used == ["bm25", "dense"]
    assert found["t2"].score == 0.1 and found["t4"].score == round(0.15 + 0.1, 6)


def test_expansion_by_hand(spark):
    queries = spark.createDataFrame([(0, "find the fast car now"), (1, "on the"), (2, "fast fast")], "query_id int, text string")
    synonyms = spark.createDataFrame(
        [("fast", "quick", 1), ("fast", "rapid", 2), ("fast", "speedy", 3), ("car", "auto", 1), ("car", "xx", 0)],
        "term string, synonym string, rank int",
    )
    found = {}
    for r in expansion.expand_queries(queries, synonyms).collect():
        found.setdefault(r.query_id, {})[r.variant] = r.text
    assert found[0] == {
        0: "find the fast car now", 1: "find the quick car now", 2: "find the rapid car now", 3: "find the fast auto now"
    }
    assert found[1] == {0: "on the"}
    assert found[2][1] == "quick quick"
