"""Shrinking retrieved context to a token budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.config import Settings
from docloom.functions import text as t


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 4).cast("int")


def compress_sentences(text: Column, query: Column, budget: int = 200) -> Column:
    """``struct<text, original_sentences, compressed_sentences>`` of the best sentences.

    Sentences are taken by relevance, in that order, until the first one does not fit;
    a sentence costs 1.3 per word. Texts of up to two sentences stay as they are.
    """

    def build(sents: Column, asked: Column) -> Column:
        order = F.sort_array(
            F.transform(
                sents,
                lambda s, i: F.struct(
                    (-t.relevance_to(s, asked)).alias("s"), i.alias("i"), (t.word_count(s) * 1.3).alias("cost"), s.alias("text")
                ),
            )
        )
        zero = F.struct(
            F.lit(0.0).alias("used"), F.lit(True).alias("open"), F.array().cast("array<string>").alias("out")
        )

        def step(acc: Column, x: Column) -> Column:
            take = acc["open"] & (acc["used"] + x["cost"] <= budget)
            return F.struct(
                F.when(take, acc["used"] + x["cost"]).otherwise(acc["used"]).alias("used"),
                take.alias("open"),
                F.when(take, F.concat(acc["out"], F.array(x["text"]))).otherwise(acc["out"]).alias("out"),
            )

        chosen = F.aggregate(order, zero, step, lambda acc: acc["out"])
        n = F.size(sents)
        small = F.struct(text.alias("text"), n.alias("original_sentences"), n.alias("compressed_sentences"))
        return F.when(n <= 2, small).otherwise(
            t.let(
                chosen,
                lambda c: F.struct(
                    F.array_join(c, " ").alias("text"), n.alias("original_sentences"), F.size(c).alias("compressed_sentences")
                ),
            )
        )

    # The query is cut into words once per text, not once for each sentence.
    return t.let(t.asked(query), lambda asked: t.let(t.sentences(text), lambda sents: build(sents, asked)))


def compress_context(
    chunks: DataFrame, queries: DataFrame, max_tokens: int = Settings.compress_tokens, model=None,
    large: int = 300, target: int = 200,
) -> DataFrame:
    """Context chunks per query within ``max_tokens``.

    ``chunks`` has ``query_id, rank, id, text`` with a bounded number of chunks per query
    (a retrieval result). A context within the budget is left alone. Otherwise chunks are
    taken by relevance until the first that does not fit, large ones cut to their best
    sentences. With an abstractive ``model`` (text -> summary) and over twice the budget,
    texts over 100 words are replaced by the model's summary.
    """
    text, asked = F.col("text"), F.col("query")
    rows = chunks.join(queries.select("query_id", asked_text(queries).alias("query")), "query_id")
    big = token_estimate(text) > large
    cut = F.when(big, compress_sentences(text, asked, target))
    entry = F.struct(
        (-t.relevance(text, asked)).alias("s"),
        "rank",
        "id",
        "text",
        token_estimate(text).alias("tokens"),
        F.length("text").alias("chars"),
        F.coalesce(F.col("_cut.text"), text).alias("kept"),
        (big & (F.size(t.sentences(text)) > 2)).alias("compressed"),
        (model(text) if model is not None else F.lit(None).cast("string")).alias("summary"),
    )
    lists = (
        rows.withColumn("_cut", cut)
        .groupBy("query_id")
        .agg(F.sort_array(F.collect_list(entry)).alias("c"), ((F.sum(F.length("text")) + F.count("*") - 1) / 4).alias("_t"))
    )
    total = F.floor(F.col("_t"))
    zero = F.struct(
        F.lit(0).alias("used"), F.lit(True).alias("open"), F.array().cast(_kept_type()).alias("out")
    )

    def step(acc: Column, x: Column) -> Column:
        take = acc["open"] & (acc["used"] + x["tokens"] <= max_tokens)
        cost = F.when(x["tokens"] > large, token_estimate(x["kept"])).otherwise(x["tokens"])
        return F.struct(
            F.when(take, acc["used"] + cost).otherwise(acc["used"]).alias("used"),
            take.alias("open"),
            F.when(take, F.concat(acc["out"], F.array(_kept(x, x["kept"], x["compressed"], "extractive")))).otherwise(acc["out"]).alias("out"),
        )

    extractive = F.aggregate("c", zero, step, lambda acc: acc["out"])
    whole = F.transform(
        F.sort_array(F.transform("c", lambda x: F.struct(x["rank"].alias("rank"), x.alias("x")))),
        lambda r: _kept(r["x"], r["x"]["text"], F.lit(False), "none"),
    )
    result = F.when(total <= max_tokens, whole)
    if model is not None:
        long = lambda x: t.word_count(x["text"]) > 100
        abstractive = F.transform(
            F.sort_array(F.transform("c", lambda x: F.struct(x["rank"].alias("rank"), x.alias("x")))),
            lambda r: _kept(
                r["x"], F.when(long(r["x"]), F.coalesce(r["x"]["summary"], r["x"]["text"])).otherwise(r["x"]["text"]),
                long(r["x"]) & r["x"]["summary"].isNotNull(), "abstractive",
            ),
        )
        result = result.when(total > 2 * max_tokens, abstractive)
    return lists.select("query_id", F.posexplode(result.otherwise(extractive)).alias("position", "k")).select(
        "query_id", "position", "k.*"
    )


def asked_text(queries: DataFrame) -> Column:
    return F.col("text") if "text" in queries.columns else F.col("query")


def _kept_type() -> str:
    return "array<struct<id:string,rank:int,text:string,compressed:boolean,compression_method:string>>"


def _kept(x: Column, text: Column, compressed: Column, method: str) -> Column:
    return F.struct(
        x["id"].cast("string").alias("id"),
        x["rank"].alias("rank"),
        text.alias("text"),
        compressed.alias("compressed"),
        F.when(compressed, F.lit(method)).otherwise(F.lit("none")).alias("compression_method"),
    )
