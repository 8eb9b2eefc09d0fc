import re

import pytest
from pyspark.sql import functions as F

from docloom.functions import markup
from docloom.functions import text as t
from docloom.functions.hashing import shard_of
from docloom.operators import chunking, summarize

TEXTS = [
    "",
    "   \n\t ",
    "One",
    "Étion naïve. Is it? Yes!  No end",
    "a. . b. c",
    "x" * 700 + ". short. " + "y" * 499 + ". tail",
    "Mr. X went.\n\nThen he\xa0left! ok",
    "word " * 250,
    "w " * 188,
    "w " * 189,
    " ".join(f"Sentence number {i} has some words." for i in range(60)),
]


def rows(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(3)


def sentences(text):
    return [s for s in re.split(r"(?<=[.!?])\s+", text.strip()) if s]


def test_words_and_sentences(spark):
    found = rows(spark, TEXTS).select("id", t.words(F.col("text")).alias("w"), t.sentences(F.col("text")).alias("s")).collect()
    for r in found:
        assert r.w == TEXTS[r.id].split()
        assert r.s == sentences(TEXTS[r.id])


def fold(text, limit=500):
    """Chunk texts by plain string building, for comparison."""
    out, text_now, held = [], "", []
    for s in sentences(text):
        if text_now and len(text_now) + len(s) > limit:
            out.append(text_now.strip())
            held = held[-2:] + [s] if len(held) > 2 else [s]
            text_now = " ".join(held) if len(held) > 1 else " " + s
        else:
            text_now, held = text_now + " " + s, held + [s]
    return out + ([text_now.strip()] if text_now.strip() else [])


def test_semantic_chunks_equal_string_fold(spark, documents):
    given = [r.text for r in documents.select("text").collect()] + TEXTS
    found = {}
    for r in chunking.semantic_chunks(rows(spark, given)).collect():
        found.setdefault(r.id, {})[r.chunk_index] = r.text
    for i, text in enumerate(given):
        chunks = [found.get(i, {})[j] for j in range(len(found.get(i, {})))]
        assert chunks == fold(text), i


def test_word_windows(spark):
    found = chunking.word_windows(rows(spark, TEXTS)).collect()
    by = {}
    for r in found:
        by.setdefault(r.id, []).append((r.chunk_index, r.start_word, r.end_word))
    assert 0 not in by and 2 not in by
    assert sorted(by[7]) == [(0, 0, 250), (1, 188, 250)]
    assert sorted(by[8]) == [(0, 0, 188)]
    # The second window of 189 words holds one word and is too short to keep.
    assert sorted(by[9]) == [(0, 0, 188 + 1)]


def test_matches_give_positions(spark, documents):
    pattern = r"[\p{L}\p{N}_]+"
    given = [r.text for r in documents.select("text").collect()] + TEXTS
    found = rows(spark, given).select("id", t.matches(F.col("text"), pattern).alias("m")).collect()
    for r in found:
        assert [(m.text, m.start, m.end) for m in r.m] == [(m.group(), m.start(), m.end()) for m in re.finditer(r"\w+", given[r.id])]


def test_counts(spark):
    row = rows(spark, ["b a b c b a"]).select(t.counts(t.words(F.col("text"))).alias("c")).first()
    assert [(x.term, x.tf) for x in row.c] == [("a", 2), ("b", 3), ("c", 1)]


def test_running_sums_cross_blocks(spark):
    row = spark.range(1).select(t.running_sums(F.sequence(F.lit(1), F.lit(1000))).alias("s")).first()
    assert row.s == [i * (i + 1) // 2 for i in range(1, 1001)]
    assert spark.range(1).select(t.running_sums(F.array().cast("array<int>")).alias("s")).first().s == []


@pytest.mark.parametrize("shards", [3, 4, 7, 16])
def test_shard_is_md5_modulo(spark, shards):
    import hashlib

    names = [f"src{i}" for i in range(20)] + ["", "é"]
    found = rows(spark, names).select("id", shard_of(F.col("text"), shards).alias("s")).collect()
    for r in found:
        assert r.s == int(hashlib.md5(names[r.id].encode()).hexdigest(), 16) % shards


def test_boundaries_and_methods(spark):
    text = "Intro text that is long enough.\npublic int add(int a, int b) {\n return a;\n}\nExample:\nadd(1, 2) gives three\n - a list item that is long"
    row = rows(spark, [text]).select(
        chunking.boundary_sections(F.col("text")).alias("s"), chunking.method_info(F.col("text")).alias("m")
    ).first()
    assert row.s == [
        "Intro text that is long enough.", "public int add(int a, int b) {\n return a;\n}",
        "Example:\nadd(1, 2) gives three", "- a list item that is long",
    ]
    assert (row.m.name, row.m.return_type, row.m.parameters, row.m.language) == ("add", "int", ["int a", "int b"], "java")


def test_html_and_markdown(spark):
    html = "<!DOCTYPE html><p a='x>y'>A &amp; B &lt;c&gt; &#233;&#x20AC; &nope; &copy;</p><!-- no --><script>var a='<p>'</script>"
    row = rows(spark, [html]).select(markup.html_text(F.col("text")).alias("x")).first()
    assert row.x == "A & B <c> é€ &nope; ©"
    md = "# Title\n\nSome **bold** and *soft* [link](http://x) `code`\n\n- item\n> quote"
    row = rows(spark, [md]).select(markup.markdown_text(F.col("text")).alias("x")).first()
    assert row.x == "Title\n\nSome bold and soft link code\n\nitem\nquote"


def test_summaries(spark):
    short = "Few words only."
    exactly_fifty = " ".join(["word"] * 49 + ["end."])
    long = TEXTS[-1]
    found = {r.id: r for r in summarize.summarize(rows(spark, [short, exactly_fifty, long])).collect()}
    assert found[0].summary == short and found[0].summary_type == "original"
    assert found[1].summary_type == "extractive" and found[1].compression_ratio == 1.0
    assert found[2].word_count <= 300 and found[2].original_word_count == 360
    # Kept sentences stay in the order of the text.
    places = [int(x) for x in re.findall(r"number (\d+)", found[2].summary)]
    assert places == sorted(places)


def test_relevance(spark):
    df = spark.createDataFrame([("the cat sat", "cat sat"), ("", "x"), ("a b", "c")], "a string, b string")
    assert [r.r for r in df.select(t.relevance(F.col("a"), F.col("b")).alias("r")).collect()] == [2 / 3 + 0.2, 0.0, 0.0]
