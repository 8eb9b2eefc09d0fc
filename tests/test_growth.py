"""What kept queries from growing in proportion to their input."""

import random
import re
import sys
import unicodedata
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from docloom import rules
from docloom.functions import text as t
from docloom.operators import compress, entities, relations, stats, summarize
from docloom.plans import nlp_queries
from docloom.plans.registry import Tables
from tests.conftest import SF


def test_sentences_are_cut_once_per_text(spark):
    """Not once for each sentence, which made long texts quadratic."""
    scored = summarize.sentence_scores(t.sentences(F.col("text")), rules.SUMMARY_STOP_WORDS)
    assert str(scored).count("split(") == 1


def test_summaries_fold_no_arrays(documents):
    """A fold copies its state at each sentence; words are counted and sentences chosen in Arrow batches."""
    plan = summarize.summarize(documents, method="frequency").select("doc_id", "summary")._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" not in plan and "sort_array(" not in plan
    assert plan.count("choose(") == 1  # the other summary is not made


def test_summaries_by_frequency_are_those_of_a_plain_count(spark):
    """Texts of any length in batches of two rows, with ties, sentences that do not fit and without words."""
    texts = [None, "", "Few words.", "the a. " * 40, "One two. Two three! ... One one? " * 20, "x " * 301 + "x. y. " * 30]
    texts += [" ".join(f"Word{i % k} word{i % 3} and {'more ' * (i % 4)}end{i}." for i in range(9 * k)) for k in (3, 7, 40)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        got = [r.summary for r in summarize.summarize(df, method="frequency", max_words=60).orderBy("id").collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")

    def plain(text):
        if text is None or len(text.split()) < 50:
            return text
        sentences = re.split(r"(?<=[.!?])\s+", text.strip())
        words = [[w for w in re.findall(r"[^\W_]+", s.lower()) if w not in rules.SUMMARY_STOP_WORDS] for s in sentences]
        counts = Counter(w for ws in words for w in ws)
        score = [sum(counts[w] for w in ws) / len(ws) if ws else 0 for ws in words]
        used, kept = 0, []
        for i in sorted(range(len(sentences)), key=lambda i: (-score[i], i)):
            n = len(sentences[i].split())
            if used + n <= 60:
                used, kept = used + n, [*kept, i]
        return " ".join(sentences[i] for i in sorted(kept))

    assert got == [plain(x) for x in texts]


def test_a_query_is_cut_once_per_text(spark):
    cut = str(compress.compress_sentences(F.col("text"), F.col("asked")))
    assert cut.count("asked") == 2  # its text and its words, bound ahead of the sentences


def test_statistics_cut_no_contexts(documents):
    """They only count; the text around entities and relations was cut out for each of them."""
    for made in (stats.ingest_statistics, stats.collection_analysis):
        assert "context" not in made(documents, "doc_id")._jdf.queryExecution().optimizedPlan().toString()


def test_summaries_of_counts_read_texts_once(documents):
    found = entities.entity_summary(entities.entities(documents)), relations.relation_statistics(relations.pattern_relations(documents))
    assert all("text" not in x._jdf.queryExecution().optimizedPlan().toString() for x in found)


def test_contexts_of_relations_are_cut_from_pieces(spark):
    text = "x " * 700 + "Ann Lee works for Acme Corp. " + "y " * 700
    rows = relations.pattern_relations(spark.createDataFrame([(1, text)], "id int, text string")).collect()
    size = rules.CONTEXT_CHARS
    assert rows and all(r.context == text[max(r.start_pos - size, 0) : r.end_pos + size] for r in rows)


def test_parts_are_spread_like_other_texts(spark):
    assert Tables(spark, SF).part.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def _parsed(spark):
    words = [("a", "Ann sees Bob"), ("b", "Cy likes red Dora and Eve"), ("c", "x")]
    tags = ["NOUN", "VERB", "NOUN", "ADP"]
    deps = ["nsubj", "ROOT", "dobj", "compound"]
    rows = [
        (doc, i, i + (1, 0, -1, -2)[i % 4], w, w.lower(), tags[i % 4], deps[i % 4])
        for doc, text in words for i, w in enumerate(text.split())
    ]
    return rows, spark.createDataFrame(rows, "doc_id string, i int, head int, text string, lemma string, pos string, dep string")


def _marked(tokens):
    i = F.col("i").cast("long")
    span = F.struct(i.alias("ord"), "text", F.col("dep").alias("label"), i.alias("first"), (i + 1).alias("last"))
    return tokens.select("doc_id", i.alias("i"), F.when(relations.linking(), F.col("text")).alias("word"), F.when(F.col("text").rlike("^[A-Z]"), span).alias("span"))


def test_tokens_meet_their_heads_without_a_shuffle(spark):
    """Texts that cross batches and rows in any order give the same relations."""
    rows, tokens = _parsed(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        one = relations.dependency_relations(tokens.coalesce(1), together=True)
        assert "Exchange hash" not in one._jdf.queryExecution().toString()
        got = sorted(map(tuple, one.collect()))
        mixed = relations.dependency_relations(tokens.orderBy(F.xxhash64("text")))
        assert sorted(map(tuple, mixed.collect())) == got
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    by_place = {(r[0], r[1]): r for r in rows}
    want = [
        (s[0], s[3], by_place[s[0], s[2]][4], o[3]) for s in rows for o in rows
        if s[0] == o[0] and s[6] == "nsubj" and o[6] == "dobj" and s[2] == o[2] and by_place.get((s[0], s[2]), [None] * 6)[5] == "VERB"
    ]
    assert want and sorted(r[:4] for r in got if r[6] == "nsubj-verb-dobj") == sorted(want)


def test_pairs_of_entities_and_words_between_them(spark):
    _, tokens = _parsed(spark)
    marked = _marked(tokens)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        got = relations.marked_pair_relations(marked.coalesce(1), reach=2).select("doc_id", "subject", "relation", "object", "distance")
        got = sorted(map(tuple, got.collect()))
        spans = marked.where("span is not null").select("doc_id", "span.*").orderBy(F.xxhash64("text"))
        apart = relations.entity_pair_relations(spans, tokens, reach=2).select("doc_id", "subject", "relation", "object", "distance")
        assert sorted(map(tuple, apart.collect())) == got
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == [
        ("a", "Ann", "sees", "Bob", 1), ("b", "Cy", "likes", "Dora", 2), ("b", "Dora", "RELATED_TO_compound_ROOT", "Eve", 1),
    ]


def _routes_apart(db):
    """Triples by route, made by the operators on tables and matched in Spark."""
    tokens = nlp_queries._tokens(db)
    apart = [
        relations.pattern_relations(db.documents.select("doc_id", "text")), relations.dependency_relations(tokens, together=True),
        relations.marked_pair_relations(nlp_queries._marked(tokens)),
    ]
    return relations.extract_relations(apart)


def test_routes_read_texts_once_and_count_triples_where_they_lie(spark, tmp_path):
    """Each route read the texts, and all triples were shuffled. Ids may be missing or come twice."""
    long = "Ann uses Bob in Rome and ΟΔΟΣ has Cy in Oslo, İda sees Eve at home. " * 3
    rows = [(1, long), (2, "ann is in rome and bob is in rome"), (3, None), (2, "ann is in oslo and the bob is in rome")]
    rows += [(None, "the sea has salt in it"), (None, "the sea has salt in it"), (5, ""), (6, "Zoe_a HAS\u00a0Zoe_b. zoe_a has zoe_b")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    db = Tables(spark, str(tmp_path))
    found = nlp_queries.relation_routes(db)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"\(\d+\) MapInArrow|MapInArrow run", plan)) == 1 and plan.count("ReadSchema: struct<doc_id:bigint,text:string>") == 1
    want = _routes_apart(db).groupBy("doc_id", "method").agg(F.count("*").alias("relations"))
    assert sorted(map(str, found.collect())) == sorted(map(str, want.collect()))
    assert {r.method for r in want.collect()} == set(relations.ROUTES)


def test_arrow_tokens_are_those_of_the_table(spark, documents):
    some = documents.limit(30).unionByName(spark.createDataFrame([(-1, "Éa ŒB\u00a0ǅz Σ_ΑΣ\n7 İx"), (-2, None)], "doc_id long, text string"), True)
    some = spark.createDataFrame(some.select("doc_id", "text").collect(), "doc_id long, text string")
    rows = some.select("doc_id", relations.runs(F.col("text")).alias("runs")).toArrow().combine_chunks()
    tokens = nlp_queries._token_rows(relations.with_words(rows))
    marked = nlp_queries._marked_rows(tokens)
    db = type("Db", (), {"documents": some})
    table = nlp_queries._tokens(db)

    def plain(found):
        return [{k: {**v.asDict()} if hasattr(v, "asDict") else v for k, v in r.asDict().items()} for r in found.collect()]

    assert sorted(map(str, tokens.to_pylist())) == sorted(map(str, plain(table)))
    assert sorted(map(str, marked.to_pylist())) == sorted(map(str, plain(nlp_queries._marked(table))))


def test_counts_of_routes_do_not_depend_on_steps(documents, monkeypatch):
    """Texts that are counted and texts whose triples are given, which those of many are, agree."""
    rows = documents.limit(40).select("doc_id", F.lit(True).alias("alone"), relations.runs(F.col("text")).alias("runs")).toArrow()

    def routes(texts):
        texts = relations.with_words(texts)
        tokens = nlp_queries._token_rows(texts)
        marked = nlp_queries._marked_rows(tokens)
        return [relations.pattern_relations(texts), relations.dependency_relations(tokens), relations.marked_pair_relations(marked)]

    def found(triples, size=1 << 12):
        monkeypatch.setattr(relations, "_STEP_TRIPLES", triples)
        monkeypatch.setattr(relations, "_STEP_BYTES", size)
        steps = (x for some in relations._whole_texts(iter(rows.to_batches(7))) for x in relations._text_steps(some))
        return [row for step in steps for columns in relations._step_counts(step, routes) for row in zip(*[c.to_pylist() for c in columns])]

    whole = {(r[0], r[4]): r[5] for r in found(1 << 30, 1 << 30)}
    assert {(r[0], r[4]): r[5] for r in found(1 << 30)} == whole
    some = {(r[0], r[4]): r[5] for r in found(600) if r[1] is None}
    assert 0 < len(some) < len(whole) and some.items() <= whole.items()
    triples = {}
    for doc, *key, route, _ in found(0):
        triples[doc, *key] = min(route, triples.get((doc, *key), route))
    assert Counter((key[0], route) for key, route in triples.items()) == whole


def test_relations_of_runs_are_those_of_the_patterns(spark):
    deal = random.Random(5)
    words = "is a A are ARE in IN at has HAS uſes uses \u0131n \u0130n İs includes leads to works for employed by located x Ann _ éa ΣΑΣ 7 was".split()
    gaps = [" "] * 9 + ["  ", "\n", "\u00a0", "\x1c", "\u2028 ", ", ", ". ", "-", "\u200b"]
    texts = ["".join(deal.choice(words) + deal.choice(gaps) for _ in range(deal.randint(0, 40))) for _ in range(1500)] + [None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = sorted(map(tuple, relations.pattern_relations(df, context=False).select("doc_id", *relations.TRIPLE).collect()))
    rows = relations.with_words(df.select("doc_id", relations.runs(F.col("text")).alias("runs")).toArrow().combine_chunks())
    got = pa.concat_tables(relations.pattern_relations(rows)).select(["doc_id", *relations.TRIPLE]).to_pylist()
    assert len(want) > 1000 and sorted(tuple(r.values()) for r in got) == want


def test_lower_case_of_values_is_that_of_spark(spark):
    letters = [chr(c) for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c))[0] == "L"]
    rows = spark.createDataFrame(pa.table({"w": [*letters, "ΟΔΟΣ", "ΟΔΟΣ_ΧΑ", "ΣΑ", "ΑΣ́", "aİb", "ÄÖ É", "", None]}))
    rows = rows.select("w", F.lower("w").alias("low")).toArrow().combine_chunks()
    assert t.lower_values(rows["w"].chunk(0)).to_pylist() == rows["low"].to_pylist()
    assert t.lower_values(pa.array(["ÄB", None, "ſ"])).to_pylist() == ["äb", None, "ſ"]


def test_word_places_are_those_of_matches(spark):
    rows = [("ab, c  d",), ("",), (None,), ("...",), ("ünd İx 𝒳y z",)]
    df = spark.createDataFrame(rows, "text string").coalesce(1)
    text = F.col("text")
    for row in df.select(t.word_places(text).alias("a"), t.matches(text, f"[{t.WORD}]+").alias("b")).collect():
        assert row["a"] == row["b"]


def test_dictionary_of_words_does_not_scan_texts_for_each_term(spark):
    docs = spark.createDataFrame([(1, "Abc abc_ ABC x-abc İ abc"), (None, "abc"), (2, "a b")], "doc_id int, text string")
    terms = spark.createDataFrame(
        [("ABC", "D", "c"), ("abc", "D", "c"), ("x-abc", "D", "e"), ("", "D", "c"), (None, "D", "c")], "term string, domain string, category string"
    )
    found = entities.table_entities(docs, terms, "doc_id")
    got = sorted(map(tuple, found.select("doc_id", "entity", "label", "start", "end").collect()), key=repr)
    # Behind the letter that grows in lower case, places are those of the lower-case text.
    one = [(1, s, "CUSTOM_D_C", a, a + 3) for s, a in (("Abc", 0), ("ABC", 9), ("abc", 15), ("bc", 22))]
    assert got == sorted([*one, *one, *[(None, "abc", "CUSTOM_D_C", 0, 3)] * 2, (1, "x-abc", "CUSTOM_D_E", 13, 18)], key=repr)
    plan = entities.table_entities(docs, terms.limit(2), "doc_id")._jdf.queryExecution().toString()
    assert "Q" + "abc" not in plan and "collect_set" not in plan


def test_spans_are_cut_out_of_pieces(spark):
    text = "".join(chr(97 + i % 26) if i % 7 else "é" for i in range(1200))
    df = spark.createDataFrame([(text, a, a + n) for a in (0, 511, 512, 1100, 1190) for n in (0, 5, 600)], "text string, a int, b int")
    some, part = F.col("text"), t.pieces(F.col("text"))
    for row in df.select("a", "b", t.around(some, F.col("a"), F.col("b"), 50).alias("x"), t.around_in(part, F.col("a"), F.col("b"), 50).alias("y")).collect():
        assert row.x == row.y, row


def test_unknown_label_reads_the_postings_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def label(x):
        seen.add(1)
        return x

    index = spark.createDataFrame([("L", "qui"), ("M", "a")], "label string, entity string").select(label("label").alias("label"), "entity")
    found = entities.search_entities(index, "NONE", "Qui")
    before = seen.value
    assert [r.entity for r in found.collect()] == ["qui"]
    assert seen.value == before
    assert entities.search_entities(index, "M", "qui").count() == 0


def test_words_of_long_batches_are_hashed_in_steps(spark, monkeypatch):
    import pyarrow as pa

    from docloom.functions import embedding

    tokens = pa.array([["a", "b"], [], ["c"] * 9, ["a"], None], pa.list_(pa.string()))
    whole, steps = embedding._hashed(tokens), []
    monkeypatch.setattr(embedding, "STEP_WORDS", 3)
    plain = embedding._hashed
    monkeypatch.setattr(embedding, "_hashed", lambda x: steps.append(len(x)) or plain(x))
    assert embedding._hash_words.func(tokens).to_pylist() == whole.to_pylist()
    assert len(steps) > 1
