"""Models behind one interface: column functions, with offline stand-ins.

A stand-in has the shape of a model's result, not its quality. A real model is a pandas
UDF with the same arguments.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.embedding import hashed_embedding
from docloom.operators.compress import compress_sentences, token_estimate
from docloom.operators.fusion import lexical_reranker


def extractive_answer(prompt: Column, query: Column, context: Column) -> Column:
    """Offline answerer: the sentences of the context that are closest to the query."""
    best = compress_sentences(F.coalesce(context, F.lit("")), query, 80)["text"]
    return F.struct(
        F.when(best != "", best).otherwise("The passages hold no answer.").alias("answer"),
        token_estimate(prompt).alias("tokens_used"),
        F.lit(True).alias("success"),
        F.lit(None).cast("string").alias("error"),
    )


@dataclass(frozen=True)
class Providers:
    # text -> array<float>
    embed: Callable[[Column], Column] = hashed_embedding
    # (query, text) -> double
    rerank: Callable[[Column, Column], Column] = lexical_reranker
    # (prompt, query, context) -> struct<answer, tokens_used, success, error>
    answer: Callable[[Column, Column, Column], Column] = extractive_answer
    # text -> string, or None without an abstractive model
    summarize: Callable[[Column], Column] | None = None
    # bytes -> list of page texts, or None without a PDF library
    pdf_reader: Callable[[bytes], list[str]] | None = None
