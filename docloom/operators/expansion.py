"""Query variants from a synonym table, and merging the hits of variants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.classify import key_terms
from docloom.operators.dense import dense_search
from docloom.operators.fusion import attach
from docloom.operators.topk import top_k


def usable_synonyms(synonyms: DataFrame, most: int = 2) -> DataFrame:
    """The first ``most`` synonyms of each term as ``term, synonyms``."""
    usable = synonyms.where((F.col("synonym") != F.col("term")) & (F.length("synonym") > 2))
    first = top_k(usable, ["term"], [F.col("rank"), F.col("synonym")], most, "_n")
    pairs = F.sort_array(F.collect_list(F.struct("_n", "synonym")))
    return first.groupBy("term").agg(F.transform(pairs, lambda p: p["synonym"]).alias("synonyms"))


def expand_queries(queries: DataFrame, synonyms: DataFrame, most: int = 3) -> DataFrame:
    """``query_id, variant, text, is_original``: each query and up to ``most`` variants.

    Each of the first three key terms is replaced by its synonyms in turn; a last variant
    adds the synonyms of the first two terms to the query.
    """
    terms = queries.select(
        "query_id", "text", F.posexplode_outer(F.slice(key_terms(F.col("text")), 1, 3)).alias("pos", "term")
    )
    found = terms.join(usable_synonyms(synonyms), "term", "left")
    entry = F.struct(
        F.col("pos"), F.col("term"), F.coalesce("synonyms", F.array().cast("array<string>")).alias("synonyms")
    )
    lists = found.groupBy("query_id", "text").agg(
        F.sort_array(F.collect_list(F.when(F.col("term").isNotNull(), entry))).alias("entries")
    )
    text = F.col("text")
    replaced = F.flatten(
        F.transform(
            "entries",
            lambda e: F.transform(
                F.filter(e["synonyms"], lambda s: F.lower(s) != F.lower(e["term"])),
                lambda s: F.replace(text, e["term"], s),
            ),
        )
    )
    extra = F.slice(F.flatten(F.transform(F.slice("entries", 1, 2), lambda e: e["synonyms"])), 1, 3)
    joined = F.when(F.size(extra) > 0, F.array(F.concat(text, F.lit(" "), F.array_join(extra, " ")))).otherwise(
        F.array().cast("array<string>")
    )
    variants = F.concat(F.array(text), F.filter(replaced, lambda v: v != text), joined)
    return lists.select(
        "query_id", F.posexplode(F.slice(variants, 1, most + 1)).alias("variant", "text")
    ).withColumn("is_original", F.col("variant") == 0)


def search_variants(corpus: DataFrame, variants: DataFrame, embed, k: int, n_variants: int) -> DataFrame:
    """Dense hits of all variants: k for the original, max(2, k // 2) for the others.

    ``corpus`` has ``id, text, embedding``; ``n_variants`` bounds the number of variants.
    """
    key = F.concat_ws("#", F.col("query_id").cast("string"), F.col("variant").cast("string"))
    asked = variants.withColumn("_key", key)
    vectors = asked.select(F.col("_key").alias("query_id"), embed(F.col("text")).alias("embedding"))
    hits = dense_search(corpus, vectors, max(k, 2)).withColumnRenamed("query_id", "_key")
    named = hits.join(asked.drop("text"), "_key").where(
        F.col("rank") <= F.when(F.col("is_original"), k).otherwise(max(2, k // 2))
    )
    return attach(named.drop("_key"), corpus.drop("embedding"), n_variants * max(k, 2))


def merge_variants(hits: DataFrame, k: int, method_docs_first: bool = False) -> DataFrame:
    """First sight of each text wins; hits of the original query lead, then score.

    With ``method_docs_first`` method documentation comes before other chunks.
    """
    seen = top_k(hits, ["query_id", "text"], [F.col("variant"), F.col("rank")], 1, "_seen").drop("_seen", "rank")
    order = [F.col("is_original").desc(), F.col("score").desc(), F.col("id")]
    if method_docs_first:
        order.insert(1, (F.col("content_type") == "method_documentation").desc())
    return top_k(seen, ["query_id"], order, k)


def plain_search(corpus: DataFrame, queries: DataFrame, embed, k: int, n_queries: int) -> DataFrame:
    """Search without expansion: one more hit than asked, copies dropped, best k."""
    vectors = queries.select("query_id", embed(F.col("text")).alias("embedding"))
    hits = dense_search(corpus, vectors, k + 1).drop("rank")
    rows = attach(hits, corpus.drop("embedding"), n_queries * (k + 1))
    order = [F.col("score").desc(), F.col("id")]
    once = top_k(rows, ["query_id", "text"], order, 1, "_copy").drop("_copy")
    return top_k(once, ["query_id"], order, k)


