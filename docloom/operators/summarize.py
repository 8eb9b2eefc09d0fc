"""Extractive summaries, built from each row: no shuffle however long the corpus is.

Sentences and words are cut by Spark expressions; the words of a text are counted, and its sentences
chosen, in Arrow batches, since folds over arrays copy their state at every element.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom import rules
from docloom.functions import text as t
from docloom.operators.term_scan import STEP_WORDS, Words


def _sizes(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _ends(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)])


def _listed(values: pa.Array, like: pa.Array) -> pa.Array:
    """``values`` in lists as long as those of ``like``, null where they are."""
    return pa.ListArray.from_arrays(pa.array(_ends(_sizes(like)).astype(np.int32)), values, mask=like.is_null())


def _steps(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]:
    """Texts of about ``STEP_WORDS`` words: their numbers of sentences, the sentences' numbers of words, the words."""
    sizes, words = _sizes(texts), pc.struct_field(texts.flatten(), "words")
    lengths, flat = _sizes(words), words.flatten()
    sentences, ends = _ends(sizes), _ends(lengths)
    first = 0
    while first < len(sizes):
        last = int(np.searchsorted(ends[sentences], ends[sentences[first]] + STEP_WORDS, "right")) - 1
        last = max(last, first + 1)
        a, b = sentences[first], sentences[last]
        yield sizes[first:last], lengths[a:b], flat.slice(ends[a], ends[b] - ends[a])
        first = last


def _scores(sentences: Column, stop_words: list[str]) -> Column:
    """``array<struct<i, extractive, frequency>>`` of an array of sentences."""
    stop_words = list(stop_words)

    def frequencies(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for sizes, lengths, flat in _steps(texts):
            words = Words(lengths, flat, stop_words)
            text = np.repeat(np.arange(len(sizes)), sizes)[words.rows]
            _, cells, counts = np.unique(text * len(words.names) + words.codes, return_inverse=True, return_counts=True)
            many = np.bincount(words.rows, minlength=words.n)
            total = np.bincount(words.rows, counts[cells], words.n)
            yield np.divide(total, many, out=np.zeros(words.n), where=many > 0), many

    def score(texts: pa.Array) -> pa.Array:
        sizes, parts = _sizes(texts), texts.flatten()
        steps = [*frequencies(texts), (np.zeros(0), np.zeros(0, np.int64))]
        mean, many = (np.concatenate(x) for x in zip(*steps))
        i = np.arange(len(parts)) - np.repeat(_ends(sizes)[:-1], sizes)
        size = np.repeat(sizes, sizes)
        place = np.where((i == 0) | (i == size - 1), 0.3, np.where(i < size * 0.2, 0.1, 0.0))
        length = np.where((many >= 10) & (many <= 30), 0.2, 0.0)
        number = np.where(pc.struct_field(parts, "number").to_numpy(zero_copy_only=False), 0.1, 0.0)
        full = np.where(many > 0, mean + place + length + number, 0.0)
        fields = [pa.array(i, pa.int32()), pa.array(full), pa.array(mean)]
        return _listed(pa.StructArray.from_arrays(fields, names=["i", "extractive", "frequency"]), texts)

    parts = F.transform(
        sentences, lambda s: F.struct(t.alnum_runs(F.lower(s)).alias("words"), s.rlike(r"\p{Nd}").alias("number"))
    )
    return F.arrow_udf(score, "array<struct<i: int, extractive: double, frequency: double>>")(parts)


def sentence_scores(sentences: Column, stop_words: list[str]) -> Column:
    """``array<struct<i, n, extractive, frequency>>``; n is the number of words.

    ``frequency`` is the mean of the text-wide counts of a sentence's words, ``extractive`` adds to it for
    place, length and numbers; both are 0 without words other than stop words. Cannot stand inside of a lambda.
    The sentences are read twice, so they should be a column and not the expression that cuts them.
    """

    def with_length(s: Column, x: Column) -> Column:
        n = t.word_count(s).alias("n")
        return F.struct(x["i"].alias("i"), n, x["extractive"].alias("extractive"), x["frequency"].alias("frequency"))

    return F.zip_with(sentences, _scores(sentences, stop_words), with_length)


def _chosen(scores: Column, lengths: Column, budget: int) -> Column:
    """Places of sentences by score while they fit the word budget (others are skipped), in text order."""

    def choose(scores: pa.Array, lengths: pa.Array) -> pa.Array:
        sizes = _sizes(scores)
        by_text, ends = np.repeat(np.arange(len(sizes)), sizes), _ends(sizes)
        order = np.lexsort((-scores.flatten().to_numpy(zero_copy_only=False), by_text))
        n = lengths.flatten().to_numpy(zero_copy_only=False)[order]
        kept = np.zeros(len(n), bool)
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
            used = 0
            for at, words in enumerate(n[a:b].tolist(), a):
                if used + words <= budget:
                    used += words
                    kept[order[at]] = True
        places = (np.arange(len(n)) - np.repeat(ends[:-1], sizes))[kept]
        offsets = _ends(np.bincount(by_text[kept], minlength=len(sizes))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(places, pa.int32()), mask=scores.is_null())

    return F.arrow_udf(choose, "array<int>")(scores, lengths)


def candidates(df: DataFrame, text_col: str, max_words: int, stop_words) -> DataFrame:
    """Adds ``_extractive`` and ``_frequency``, the summaries of texts of 50 words (``_n``) or more, each with
    text, ratio and sentence count. One that is not read is not made.
    """
    text, sents, total = F.col(text_col), F.col("_sentences"), F.col("_n")
    staged = df.withColumn("_sentences", F.when(total >= 50, t.sentences(text)))
    staged = staged.withColumns({"_scored": _scores(sents, stop_words), "_lengths": F.transform(sents, t.word_count)})
    scored, lengths = F.col("_scored"), F.col("_lengths")
    picked = {
        f"_{which}": F.transform(_chosen(scored[which], lengths, max_words), lambda i: F.get(sents, i))
        for which in ("extractive", "frequency")
    }
    staged = staged.withColumns(picked)

    def shape(part: Column) -> Column:
        joined = F.array_join(part, " ")
        return F.struct(
            joined.alias("text"), (t.word_count(joined) / total).alias("ratio"), F.size(part).alias("sentences")
        )

    short = F.struct(text.alias("text"), F.lit(1.0).alias("ratio"), F.size(sents).alias("sentences"))
    extractive, frequency = F.col("_extractive"), F.col("_frequency")
    return staged.withColumns(
        {
            "_extractive": F.when(F.size(sents) <= 3, short).when(sents.isNotNull(), shape(extractive)),
            "_frequency": F.when(sents.isNotNull(), shape(frequency)),
        }
    )


def quality(ratio: Column, words: Column, abstractive: bool = False) -> Column:
    """Near 30 % of the text and 30 to 250 words is best; models get a bonus."""
    fit = (1.0 - F.abs(0.3 - ratio)) * 0.4 + F.when(words.between(30, 250), 1.0).otherwise(0.5) * 0.4
    return fit + (0.2 if abstractive else 0.0)


def summarize(
    df: DataFrame, text_col: str = "text", method: str = "auto", max_words: int = 300, model=None,
    stop_words=tuple(rules.SUMMARY_STOP_WORDS),
) -> DataFrame:
    """Adds ``summary, summary_type, compression_ratio, word_count, original_word_count,
    all_summaries`` to each row.

    Texts under 50 words are their own summary. ``model`` is an optional column function
    of a text (an abstractive model behind a pandas UDF) used for texts over 100 words.
    """
    text = F.col(text_col)
    staged = candidates(df.withColumn("_n", t.word_count(text)), text_col, max_words, stop_words)
    none = F.lit(None).cast("string")
    abstract = F.when(F.col("_n") > 100, model(text)) if model is not None else none
    staged = staged.withColumn("_a", abstract)
    options = []
    if method == "auto":
        shapes = [
            ("extractive", F.col("_extractive.text"), F.col("_extractive.ratio"), False),
            ("abstractive", F.col("_a"), t.word_count(F.col("_a")) / F.col("_n"), True),
            ("frequency", F.col("_frequency.text"), F.col("_frequency.ratio"), False),
        ]
        for place, (name, body, ratio, is_model) in enumerate(shapes):
            if is_model and model is None:
                continue
            score = quality(ratio, t.word_count(body), is_model)
            entry = F.struct(
                (-score).alias("s"), F.lit(place).alias("p"), F.lit(name).alias("type"), body.alias("text"), ratio.alias("ratio")
            )
            options.append(F.when(body.isNotNull(), entry))
        best = F.array_min(F.filter(F.array(*options), lambda o: o.isNotNull()))
    else:
        if method == "abstractive":
            body = F.coalesce(F.col("_a"), F.col("_extractive.text"))
            kind = F.when(F.col("_a").isNotNull(), method).otherwise("extractive")
        else:
            body = F.col("_frequency.text") if method == "frequency" else F.col("_extractive.text")
            kind = F.lit(method)
        named = F.struct(kind.alias("type"), body.alias("text"))
        best = named.withField("ratio", t.word_count(named["text"]) / F.col("_n"))
    staged = staged.withColumn("_best", F.when(F.col("_n") >= 50, best))
    short = F.col("_n") < 50
    return staged.select(
        *df.columns,
        F.when(short, text).otherwise(F.col("_best.text")).alias("summary"),
        F.when(short, "original").otherwise(F.col("_best.type")).alias("summary_type"),
        F.when(short, 1.0).otherwise(F.col("_best.ratio")).alias("compression_ratio"),
        t.word_count(F.when(short, text).otherwise(F.col("_best.text"))).alias("word_count"),
        F.col("_n").alias("original_word_count"),
        F.create_map(
            F.lit("extractive"), F.col("_extractive.text"), F.lit("frequency"), F.col("_frequency.text"),
            F.lit("abstractive"), F.col("_a"),
        ).alias("all_summaries"),
    )


def shortened(text: Column, chars: int = 300) -> Column:
    """The start of a text, as shown where a summary failed."""
    return F.when(F.length(text) > chars, F.concat(F.left(text, F.lit(chars)), F.lit("..."))).otherwise(text)
