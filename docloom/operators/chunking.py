"""Chunkers: one row of text in, several rows out, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom import rules
from docloom.functions import text as t

_SPANS = "array<struct<first:int,last:int>>"


def sentence_spans(sentences: Column, max_chars: int) -> Column:
    """First and last sentence (exclusive) of each chunk.

    Only lengths are folded. A chunk is closed when the next sentence would take it over
    ``max_chars``; its last two sentences are repeated if it held more than two.
    """
    items = F.transform(sentences, lambda s, i: F.struct(i.alias("i"), F.length(s).alias("n")))
    zero = F.struct(
        F.lit(0).alias("size"),
        F.lit(0).alias("first"),
        F.lit(0).alias("prev"),
        F.lit(0).alias("prev2"),
        F.array().cast(_SPANS).alias("spans"),
    )

    def step(acc: Column, s: Column) -> Column:
        full = (acc["size"] > 0) & (acc["size"] + s["n"] > max_chars)
        carry = (s["i"] - acc["first"]) > 2
        span = F.struct(acc["first"].alias("first"), s["i"].alias("last"))
        size = (
            F.when(full & carry, acc["prev2"] + acc["prev"] + s["n"] + 2)
            .when(full, s["n"] + 1)
            .otherwise(acc["size"] + s["n"] + 1)
        )
        first = F.when(full & carry, s["i"] - 2).when(full, s["i"]).otherwise(acc["first"])
        spans = F.when(full, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct(
            size.alias("size"),
            first.alias("first"),
            s["n"].alias("prev"),
            acc["prev"].alias("prev2"),
            spans.alias("spans"),
        )

    def finish(acc: Column) -> Column:
        tail = F.struct(acc["first"].alias("first"), F.size(sentences).alias("last"))
        return F.when(acc["size"] > 0, F.concat(acc["spans"], F.array(tail))).otherwise(acc["spans"])

    return F.aggregate(items, zero, step, finish)


def semantic_array(text: Column, max_chars: int = 500) -> Column:
    """Chunks of a text as ``array<struct<text, sentences>>``."""

    def build(sents: Column) -> Column:
        return F.transform(
            sentence_spans(sents, max_chars),
            lambda s: t.let(
                F.slice(sents, s["first"] + 1, s["last"] - s["first"]),
                lambda part: F.struct(
                    F.array_join(part, " ").alias("text"), part.alias("sentences")
                ),
            ),
        )

    return t.let(t.sentences(text), build)


def semantic_chunks(df: DataFrame, text_col: str = "text", max_chars: int = 500) -> DataFrame:
    """Sentence chunks of at most about ``max_chars`` characters with overlap.

    Adds ``chunk_index, text, sentences, word_count``; keeps all other columns.
    """
    keep = [c for c in df.columns if c != text_col]
    return df.select(
        *keep, F.posexplode(semantic_array(F.col(text_col), max_chars)).alias("chunk_index", "_c")
    ).select(
        *keep,
        "chunk_index",
        F.col("_c.text").alias("text"),
        F.col("_c.sentences").alias("sentences"),
        t.word_count(F.col("_c.text")).alias("word_count"),
    )


def _split_all(parts: Column, pattern: str) -> Column:
    cut = F.flatten(F.transform(parts, lambda p: F.split(p, t.java(pattern))))
    return F.filter(F.transform(cut, t.strip), lambda p: p != "")


def sections_array(text: Column) -> Column:
    """Split at headings, numbered items, capital lines and blank lines; the cuts are dropped."""
    parts = F.array(text)
    for pattern in rules.SECTION_PATTERNS:
        parts = _split_all(parts, pattern)
    return parts


def _split_before(parts: Column, pattern: str) -> Column:
    marked = F.transform(parts, lambda p: F.split(F.regexp_replace(p, pattern, t.MARK + "$0"), t.MARK))
    return F.filter(F.transform(F.flatten(marked), t.strip), lambda p: p != "")


def hierarchical_chunks(df: DataFrame, text_col: str = "text") -> DataFrame:
    keep = [c for c in df.columns if c != text_col]
    return df.select(
        *keep, F.posexplode(sections_array(F.col(text_col))).alias("chunk_index", "text")
    )


def is_technical(text: Column) -> Column:
    return t.any_match(text, rules.TECHNICAL_INDICATORS)


def has_method_signature(text: Column) -> Column:
    return t.any_match(text, rules.METHOD_SIGNATURES)


def boundary_sections(text: Column, min_chars: int = 20) -> Column:
    """Split before technical boundaries; each boundary starts the next section."""
    parts = F.array(text)
    for pattern in rules.BOUNDARY_PATTERNS:
        parts = _split_before(parts, "(?i)" + t.java(pattern))
    return F.filter(parts, lambda p: F.length(p) > min_chars)


def method_info(text: Column) -> Column:
    """Name, signature, parameters, return type and language of the first method."""
    typed, plain = t.java(rules.TYPED_METHOD), t.java(rules.PLAIN_METHOD)
    has_typed, has_plain = text.rlike(typed), text.rlike(plain)
    arguments = F.filter(
        F.transform(F.split(F.regexp_extract(text, typed, 3), ","), t.strip), lambda p: p != ""
    )
    return F.struct(
        F.when(has_typed, F.regexp_extract(text, typed, 2))
        .when(has_plain, F.regexp_extract(text, plain, 1))
        .alias("name"),
        F.when(has_typed, F.regexp_extract(text, typed, 0))
        .when(has_plain, F.regexp_extract(text, plain, 0))
        .alias("signature"),
        F.when(has_typed, arguments).otherwise(t.literals([])).alias("parameters"),
        F.when(has_typed, F.regexp_extract(text, typed, 1)).alias("return_type"),
        F.when(has_typed, F.lit("java")).otherwise(F.lit("unknown")).alias("language"),
    )


def technical_chunks(df: DataFrame, text_col: str = "text", max_chars: int = 500) -> DataFrame:
    """Method documentation chunks for technical texts, sentence chunks for the rest.

    One pass: each text becomes sections, each section one method chunk or several
    sentence chunks. Adds ``section_index, chunk_index, text, word_count, content_type,
    method``.
    """
    keep = [c for c in df.columns if c != text_col]
    body = F.col(text_col)
    sections = F.when(is_technical(body), boundary_sections(body)).otherwise(F.array(body))
    cut = df.select(
        *keep,
        is_technical(body).alias("_tech"),
        F.posexplode(sections).alias("section_index", "_section"),
    ).withColumn("_method", F.col("_tech") & has_method_signature(F.col("_section")))
    pieces = F.when(F.col("_method"), F.array(F.col("_section"))).otherwise(
        F.transform(semantic_array(F.col("_section"), max_chars), lambda c: c["text"])
    )
    rows = cut.select(
        *keep, "section_index", "_method", F.posexplode(pieces).alias("chunk_index", "text")
    )
    return rows.select(
        *keep,
        "section_index",
        "chunk_index",
        "text",
        t.word_count(F.col("text")).alias("word_count"),
        F.when(F.col("_method"), F.lit("method_documentation")).otherwise(F.lit("general")).alias("content_type"),
        F.when(F.col("_method"), method_info(F.col("text"))).alias("method"),
    )


def word_windows(
    df: DataFrame, text_col: str = "text", size: int = 250, min_chars: int = 10
) -> DataFrame:
    """Windows of ``size`` words that overlap by a quarter.

    Adds ``chunk_index, start_word, end_word, word_count, text``. The index counts the
    windows that are kept (more than ``min_chars`` characters).
    """
    step = size - size // 4
    keep = [c for c in df.columns if c != text_col]

    def windows(tokens: Column) -> Column:
        n = F.size(tokens)
        starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(step))).otherwise(
            F.array().cast("array<int>")
        )
        built = F.transform(
            starts,
            lambda i: F.struct(
                i.alias("start_word"),
                F.least(i + size, n).alias("end_word"),
                F.array_join(F.slice(tokens, i + 1, size), " ").alias("text"),
            ),
        )
        return F.filter(built, lambda w: F.length(w["text"]) > min_chars)

    return df.select(
        *keep, F.posexplode(t.let(t.words(F.col(text_col)), windows)).alias("chunk_index", "_w")
    ).select(
        *keep,
        "chunk_index",
        F.col("_w.start_word").alias("start_word"),
        F.col("_w.end_word").alias("end_word"),
        (F.col("_w.end_word") - F.col("_w.start_word")).alias("word_count"),
        F.col("_w.text").alias("text"),
    )


def summary_pieces(text: Column, max_words: int = 800) -> Column:
    """Pieces of at most ``max_words`` words made of whole sentences."""
    zero = F.struct(
        F.lit(0).alias("n"), F.array().cast("array<string>").alias("now"), F.array().cast("array<string>").alias("out")
    )

    def step(acc: Column, s: Column) -> Column:
        n = t.word_count(s)
        over = acc["n"] + n > max_words
        done = F.when(F.size(acc["now"]) > 0, F.concat(acc["out"], F.array(F.array_join(acc["now"], " "))))
        return F.struct(
            F.when(over, n).otherwise(acc["n"] + n).alias("n"),
            F.when(over, F.array(s)).otherwise(F.concat(acc["now"], F.array(s))).alias("now"),
            F.when(over, F.coalesce(done, acc["out"])).otherwise(acc["out"]).alias("out"),
        )

    def finish(acc: Column) -> Column:
        return F.when(
            F.size(acc["now"]) > 0, F.concat(acc["out"], F.array(F.array_join(acc["now"], " ")))
        ).otherwise(acc["out"])

    return F.aggregate(t.sentences(text), zero, step, finish)
