"""Texts that are scored where they are read give what joins of their postings give."""

from pyspark.sql import functions as F

from docloom.operators import term_scan
from docloom.operators.sparse import Bm25Model, TfidfModel, postings, tfidf_terms


def _rows(df):
    return sorted(map(tuple, df.select("query_id", "id", "score", "rank").collect()))


def test_scans_equal_joins(spark, documents):
    corpus = documents.select(F.col("doc_id").alias("id"), "text").limit(60)
    corpus = corpus.unionByName(spark.createDataFrame([(9001, None), (9002, ""), (9003, "the\x1cthe the")], "id int, text string"))
    asked = documents.select((F.col("doc_id") * 3).alias("query_id"), F.substring("text", 1, 90).alias("text")).limit(12)
    asked = asked.unionByName(spark.createDataFrame([(-1, ""), (-2, "nothing-here"), (-3, "the the")], "query_id int, text string"))
    for kind, options in ((Bm25Model, {}), (TfidfModel, {"max_features": 400})):
        model = kind.fit(corpus, **options)
        found = model.search(asked, 6)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "Join" not in plan
        model.texts = None  # by the postings
        assert _rows(found) == _rows(model.search(asked, 6)) != []


def test_long_batches_are_counted_in_steps(spark, monkeypatch):
    batch = spark.createDataFrame([("a b a",), (None,), ("b",), ("c a",)], "text string").toArrow()["text"].combine_chunks()
    whole = [(first, w.rows.tolist(), w.names.take(w.codes).to_pylist()) for first, w in term_scan.steps(batch)]
    monkeypatch.setattr(term_scan, "STEP_WORDS", 1)
    parts = [(first + r, x) for first, w in term_scan.steps(batch) for r, x in zip(w.rows.tolist(), w.names.take(w.codes).to_pylist())]
    assert len(whole) == 1 and parts == list(zip(*whole[0][1:])) and len(list(term_scan.steps(batch, most_rows=1))) == 4


def test_rare_pairs_are_left_out_before_they_are_counted(spark, documents, monkeypatch):
    corpus = documents.select(F.col("doc_id").alias("id"), "text").limit(60)
    seen = []
    whole = term_scan.pair_counts
    monkeypatch.setattr(term_scan, "pair_counts", lambda *a: seen.append(whole(*a)) or seen[0])
    stop = ["the"]
    some = TfidfModel.fit(corpus, stop_words=stop, max_features=300)
    rows = postings(corpus, tfidf_terms(F.col("text"), stop))
    every = TfidfModel.of_postings(rows, stop, 300)
    assert sorted(map(tuple, some.vocabulary.collect())) == sorted(map(tuple, every.vocabulary.collect()))
    assert 0 < seen[0].count() < rows.where("term like '% %'").select("term").distinct().count() / 2
