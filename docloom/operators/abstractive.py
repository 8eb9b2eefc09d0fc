"""Abstractive summaries by a model, long texts in two passes.

A model gets (text, most words, least words) and returns a summary. A text of more than ``long_words``
words is cut into pieces, which are spread over all tasks, so a book does not stay in one; their
summaries are put together in order and summarized once more if they are still too long. Equal texts
are summarized once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as t
from docloom.operators.chunking import summary_pieces
from docloom.operators.models import Model, model_column
from docloom.operators.summarize import summarize
from docloom.session import written

PIECE_EXTRA = 50  # fixed value: words that a piece's summary may have beyond its share


def _whole(x: Column) -> Column:
    return F.floor(x).cast("int")


def two_pass(
    df: DataFrame, load: Callable[[], Model], text_col: str = "text", max_words: int = 300, min_words: int = 50,
    long_words: int = 1000, piece_words: int = 800, at_least: int = 1, **options,
) -> DataFrame:
    """Adds ``abstract``, ``abstract_error`` and ``abstract_pieces`` to each row.

    If a call fails for one piece, the text has no abstract but the error. Texts of fewer than
    ``at_least`` words and nulls have none of the three. ``options`` are those of ``model_column``.
    """
    column = model_column(load, "string", **options)
    key = F.sha2(F.col(text_col), 256)
    texts = (
        df.select(key.alias("_key"), F.col(text_col).alias("_text"))
        .withColumn("_n", t.word_count(F.col("_text")))
        .where(F.col("_n") >= at_least)
        .dropDuplicates(["_key"])
    )
    cut = F.when(F.col("_n") > long_words, summary_pieces(F.col("_text"), piece_words)).otherwise(F.array("_text"))
    pieces = texts.select("_key", cut.alias("_cut")).select(
        "_key", F.size("_cut").alias("_of"), F.posexplode("_cut").alias("_i", "_piece")
    )
    many = F.col("_of") > 1
    most = F.when(many, _whole(max_words / F.col("_of")) + PIECE_EXTRA).otherwise(max_words)
    least = F.when(many, _whole(min_words / F.col("_of"))).otherwise(min_words)
    first = pieces.repartition("_key", "_i").select("_key", "_of", "_i", column("_piece", most, least).alias("_s"))
    parts = F.sort_array(F.collect_list(F.struct("_i", F.col("_s.result").alias("s"))))
    joined = (
        written(first)  # results of a model are not made twice
        .groupBy("_key")
        .agg(F.max("_of").alias("_of"), parts.alias("_parts"), F.min("_s.error").alias("_error"))
        .withColumn("_all", F.when(F.col("_error").isNull(), F.array_join(F.transform("_parts", lambda p: p["s"]), " ")))
    )
    again = (F.col("_of") > 1) & (t.word_count(F.col("_all")) > max_words)
    second = written(
        joined.withColumn("_s", column(F.when(again, F.col("_all")), F.lit(max_words), F.lit(min_words))).select(
            "_key",
            F.when(again, F.col("_s.result")).otherwise(F.col("_all")).alias("abstract"),
            F.coalesce("_error", "_s.error").alias("abstract_error"),
            F.col("_of").alias("abstract_pieces"),
        )
    )
    kept = [c for c in df.columns if c not in ("abstract", "abstract_error", "abstract_pieces")]
    keyed = df.select(*kept, key.alias("_key"))
    return keyed.join(second, "_key", "left").drop("_key")


def summarize_with_model(
    df: DataFrame, load: Callable[[], Model], text_col: str = "text", method: str = "auto", max_words: int = 300,
    min_words: int = 50, **options,
) -> DataFrame:
    """``summarize`` with abstracts in two passes, for texts of more than 100 words.

    A text without an abstract falls back to the other methods; ``summary_error`` says why.
    """
    made = two_pass(df, load, text_col, max_words, min_words, at_least=101, **options)
    out = summarize(made, text_col, method, max_words, model=lambda _: F.col("abstract"))
    return out.withColumnRenamed("abstract_error", "summary_error").drop("abstract", "abstract_pieces")


def compress_with_model(df: DataFrame, load: Callable[[], Model], text_col: str = "text", **options) -> DataFrame:
    """Texts of more than 100 words become half as long, at most 150 words.

    Adds ``compressed`` and ``compression_error``; a text whose call fails stays as it is.
    """
    column = model_column(load, "string", **options)
    n = t.word_count(F.col(text_col))
    most = F.least(_whole(n / 2), F.lit(150))
    least = F.greatest(_whole(most / 2), F.lit(30))
    made = df.withColumn("_s", column(F.when(n > 100, F.col(text_col)), most, least))
    kept = [F.coalesce("_s.result", text_col).alias(c) if c == text_col else F.col(c) for c in df.columns]
    return made.select(
        *kept, F.col("_s.result").isNotNull().alias("compressed"), F.col("_s.error").alias("compression_error")
    )


def leading_words() -> Model:
    """An offline stand-in: the first words of a text, as many as the summary may have."""
    return lambda rows: [" ".join(text.split()[:most]) for text, most, _ in rows]
