"""Classifiers: accuracy on rows that were held out, and edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import langid, quality, toxicity
from docloom.llm.calibrate import calibrated, isotonic
from docloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def held_out(spark, name, label):
    """(label, score, predicted) of labelled rows that were not learned from."""
    found = QUERIES[name][0](spark, SF)
    assert found.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", F.col(label).alias("label"))
    rows = found.filter("held_out").join(labels, "doc_id").select("label", "score", "predicted").collect()
    return np.array([tuple(r) for r in rows], float).T


def area(label, score):
    """Area under the curve; equal scores count half."""
    yes, no = score[label == 1], score[label == 0]
    return np.mean([(y > no).mean() + (y == no).mean() / 2 for y in yes])


def test_quality(spark):
    label, score, predicted = held_out(spark, "op3_quality", "quality")
    assert area(label, score) > 0.95 and (predicted == label).mean() > 0.9
    assert score.min() >= 0 and score.max() <= 1


def test_toxicity(spark):
    label, score, predicted = held_out(spark, "op1_toxicity", "toxic")
    # Some forty toxic documents are too few to learn much from; larger tables do better.
    assert area(label, score) > 0.6
    assert score.min() >= 0 and score.max() <= 1


def test_toxicity_learns_words_that_set_texts_apart():
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("etaoinshr"), rng.integers(2, 8))) for _ in range(3000)]
    bad = ["worthless", "pathetic", "disgusting"]

    def text(toxic):
        said = list(rng.choice(words, 150))
        return " ".join(said + (list(rng.choice(bad, 4)) if toxic else [])).encode()

    rows = [(text(i % 4 == 0), int(i % 4 == 0), float(rng.random())) for i in range(1200)]
    model = toxicity.learned(rows)
    tests = [text(i % 2 == 0) for i in range(200)]
    score = model.score(np.array([model.gains(t) for t in tests]))
    assert area(np.arange(200) % 2 == 0, score) > 0.95


def test_language(spark):
    found = QUERIES["op5_language"][0](spark, SF).filter("held_out")
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = found.join(truth, "doc_id").select("lang", "lang_pred", "score").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_edges(spark, edges, edge_rows, no_documents):
    model = langid.fit(edges)
    assert model.languages == ["de", "en", "es"]  # the only text in fr has no letter
    got = langid.identify(edges, model).collect()
    assert len(got) == len(edge_rows)
    assert {r.doc_id for r in got if r.lang_pred == "und"} >= {1, 2, 3, 4}
    assert all(r.score == 0 for r in got if r.lang_pred == "und")
    assert all(r.lang_pred == "und" for r in langid.identify(edges, langid.fit(no_documents)).collect())
    assert langid.identify(no_documents, model).count() == 0


def test_rare_language_is_learned_from_a_large_table(spark):
    rows = spark.range(6_000).selectExpr(
        "id AS doc_id", "CASE WHEN id < 2 THEN 'zq zq xq' ELSE concat('word ', id) END AS text", "CASE WHEN id < 2 THEN 'xx' WHEN id % 2 = 0 THEN 'de' ELSE 'en' END AS lang"
    )
    assert langid.fit(rows, sample=100).languages == ["de", "en", "xx"]


def test_many_languages_share_a_bounded_matrix(spark):
    rows = spark.range(600).selectExpr("id AS doc_id", "repeat(concat(chr(97 + id % 26), chr(97 + id div 26 % 26), ' '), 9) AS text", "concat('l', id) AS lang")
    model = langid.fit(rows, cells=1 << 20)
    assert len(model.languages) == 600 and model.logs.size <= 1 << 20
    got = langid.identify(rows, model).join(rows.select("doc_id", "lang"), "doc_id").filter("lang_pred = lang").count()
    assert got > 590


def test_long_texts_score_like_their_parts():
    model = langid.Model(["a", "b"], np.random.default_rng(1).integers(0, 9, (langid.BUCKETS, 2)))
    text = "some words in a row " * 100_000
    assert model.score([text])[0][0] == model.score([text[: len(text) // 2]])[0][0]


@pytest.mark.parametrize("fitted", ["quality", "toxic"])
def test_classifier_edges(spark, edges, edge_rows, no_documents, fitted):
    labels = spark.createDataFrame(
        [(i, i % 2, i % 2) for i in range(20, 50)] + [(5, None, None), (None, 1, 1), (21, 0, 0), (999, 1, 1)], "doc_id long, quality int, toxic int"
    )
    if fitted == "quality":
        fit = lambda d, x: quality.fit(quality.labelled_sample(d, x, "quality"))
        add = quality.with_score
    else:
        fit, add = toxicity.fit, toxicity.with_toxicity
    model = fit(edges, labels)
    scored = add(edges, model)
    assert sorted(scored.columns) == sorted(edges.columns)  # score clashes and is replaced
    rows = scored.select("doc_id", "text", "score").collect()
    assert len(rows) == len(edge_rows) and all(0 <= r.score <= 1 for r in rows)
    by_text = {}
    for r in rows:
        assert by_text.setdefault(r.text or "", r.score) == r.score
    assert add(no_documents, model).count() == 0
    untrained = add(edges, fit(no_documents, labels.limit(0))).select("score").distinct().collect()
    assert [r.score for r in untrained] == [0.5]


def test_isotonic_is_the_best_monotone_fit():
    rng = np.random.default_rng(3)
    raw = rng.integers(0, 30, 500).astype(float)
    labels = (rng.random(500) < raw / 30).astype(float)
    fit = calibrated(raw, isotonic(raw, labels))
    assert (np.diff(fit[np.argsort(raw, kind="stable")]) >= -1e-12).all()
    assert fit.mean() == pytest.approx(labels.mean())
    means = np.array([labels[raw == x].mean() for x in raw])
    assert ((fit - labels) ** 2).sum() >= ((means - labels) ** 2).sum() - 1e-9
