import pytest
from pyspark.sql import functions as F

from docloom.functions.classify import classify_query, document_type, query_type, technical_variants
from docloom.functions.validate import validate_answer
from docloom.operators import entities, relations


def one(spark, text, *columns):
    return spark.createDataFrame([(text,)], "q string").select(*columns).first()


@pytest.mark.parametrize(
    "query, kind, subtype, language, methods, route",
    [
        ("yield() vs join() in Java?", "technical", "method_comparison", "java", ["join", "yield"], "multi_method_retrieval"),
        ("Explain wait() please", "technical", "method_explanation", None, ["wait"], "method_focused_retrieval"),
        ("deadlock and mutex", "technical", "synchronization_concepts", None, [], "concept_hierarchical_retrieval"),
        ("tell me a tale", "general", None, None, [], "standard"),
    ],
)
def test_classification(spark, query, kind, subtype, language, methods, route):
    c = one(spark, query, classify_query(F.col("q")).alias("c")).c
    assert (c.type, c.subtype, c.programming_language, c.methods_mentioned, c.routing_strategy) == (kind, subtype, language, methods, route)


def test_variants(spark):
    v = one(spark, "yield() vs join() in java", technical_variants(F.col("q"), classify_query(F.col("q"))).alias("v")).v
    q = "yield() vs join() in java"
    assert v == [q, f"{q} thread synchronization", f"{q} blocking wait", f"{q} cooperative scheduling"]


def test_query_and_document_types(spark):
    assert one(spark, "show me the summary", query_type(F.col("q")).alias("t")).t == "question"
    assert one(spark, "a summary, please", query_type(F.col("q")).alias("t")).t == "summary"
    assert one(spark, "Pursuant to the market", document_type(F.col("q")).alias("t")).t == "legal"


def verdict(spark, query, answer, context=()):
    df = spark.createDataFrame([(query, answer, list(context))], "q string, a string, c array<string>")
    return df.select(validate_answer(F.col("a"), classify_query(F.col("q")), F.col("c")).alias("v")).first().v


def test_wrong_statement_is_found(spark):
    v = verdict(spark, "explain yield()", "It blocks until completion.")
    assert not v.is_accurate and v.technical_score == 1.0 and v.confidence_score == 0.6
    assert [i.issue for i in v.issues_found] == [
        "Incorrect statement about yield: contains 'blocks until completion'",
        "Missing accurate description of yield behavior",
    ]


def test_right_answer_passes(spark):
    v = verdict(spark, "explain yield()", "A cooperative scheduling hint.")
    assert v.is_accurate and v.confidence_score == 1.0 and v.corrections_suggested == []


def test_contradiction_lowers_the_score(spark):
    answer = "A yield call is blocking the thread unlike join in every way. Fine."
    v = verdict(spark, "difference between yield() and join()", answer, ["cooperative, not blocking"])
    assert v.technical_score == 0.8
    assert verdict(spark, "a tale", answer, ["cooperative, not blocking"]).technical_score == 1.0


def test_dictionary_entities_at_word_edges(spark):
    text = "Java and C++ beat JavaScript; javac no. c# Google Cloud"
    docs = spark.createDataFrame([(1, text)], "doc_id int, text string")
    found = {(r.entity, r.label, r.start) for r in entities.entities(docs).collect()}
    assert found == {
        ("Java", "CUSTOM_TECH_PROGRAMMING_LANGUAGES", 0), ("C++", "CUSTOM_TECH_PROGRAMMING_LANGUAGES", 9),
        ("JavaScript", "CUSTOM_TECH_PROGRAMMING_LANGUAGES", 18), ("c#", "CUSTOM_TECH_PROGRAMMING_LANGUAGES", 40),
        ("Google Cloud", "CUSTOM_TECH_CLOUD_PLATFORMS", 43),
    }
    terms = spark.createDataFrame([("google cloud", "TECH", "cloud_platforms")], "term string, domain string, category string")
    assert [r.start for r in entities.table_entities(docs, terms, "doc_id").collect()] == [43]
    # A dictionary over the broadcast limit takes the shuffled way to the same result.
    assert [r.start for r in entities.table_entities(docs, terms, "doc_id", limit=0).collect()] == [43]


def test_dictionary_table_is_the_same_at_any_size(spark):
    rows = [(1, "java and java"), (1, "a ++ b, rust"), (2, "Rust"), (2, "Rust"), (None, "java"), (3, None), (4, "c++")]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    words = [("java", "T", "x"), ("rust", "T", "x"), ("rust", "T", "x"), ("++", "T", "x"), ("", "T", "x"), (None, "T", "x")]
    terms = spark.createDataFrame(words, "term string, domain string, category string")
    want = [(None, "java", 0), (1, "java", 0), (1, "java", 9), (1, "++", 2)] + [(1, "rust", 8)] * 2 + [(2, "Rust", 0)] * 4
    for limit in (200_000, 0):
        got = [(r.doc_id, r.entity, r.start) for r in entities.table_entities(docs, terms, "doc_id", limit=limit).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)


def test_pattern_entities_and_lookup(spark):
    text = "Mail a.b@c.org or see https://x.y/z?q=1 on 2024-01-31, 3/4/2020 or 555-123-4567"
    docs = spark.createDataFrame([(1, "s", text)], "doc_id int, source string, text string")
    rows = entities.entities(docs)
    assert {(r.label, r.entity) for r in rows.collect()} == {
        ("EMAIL", "a.b@c.org"), ("URL", "https://x.y/z?q=1"), ("DATE", "2024-01-31"), ("DATE", "3/4/2020"), ("PHONE", "555-123-4567")
    }
    index = entities.entity_index(rows, "doc_id")
    assert entities.search_entities(index, "DATE").count() == 2
    assert entities.search_entities(index, "NO_LABEL", "A.B@C.ORG").count() == 1
    assert entities.search_entities(index).count() == 0


def test_relations_by_hand(spark):
    text = "The cat is a small animal. Bob works  for Acme, and Acme is a firm in Rome.\nox is a b; The CAT is a small Animal"
    docs = spark.createDataFrame([(1, text)], "doc_id int, text string")
    found = [(r.subject, r.relation, r.object, r.start_pos) for r in relations.pattern_relations(docs).collect()]
    assert found == [
        ("The cat", "IS_A", "small animal", 0),
        ("and Acme", "IS_A", "firm in Rome", 48),
        ("and Acme is a firm", "LOCATED_IN", "Rome", 48),
        ("Bob", "WORKS_FOR", "Acme", 27),
    ]


def test_long_run_does_not_overflow(spark):
    docs = spark.createDataFrame([(1, "word " * 20000 + "is a thing")], "doc_id int, text string")
    assert relations.pattern_relations(docs).count() == 1


def test_graph(spark):
    rows = spark.createDataFrame(
        [("a", "R", "b", 0.8, "pattern"), ("a", "R", "c", 0.8, "pattern")],
        "subject string, relation string, object string, confidence double, method string",
    )
    nodes = relations.graph_nodes(relations.graph_edges(rows))
    assert {(r.id, r.connections, r["size"]) for r in nodes.collect()} == {("a", 2, 9), ("b", 1, 7), ("c", 1, 7)}
