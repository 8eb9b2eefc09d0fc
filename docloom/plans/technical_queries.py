"""Technical retrieval: variants of a technical question over method documentation."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions.classify import classify_query, technical_variants
from docloom.functions.embedding import hashed_embedding
from docloom.operators import expansion
from docloom.operators.chunking import technical_chunks
from docloom.plans.chunk_queries import _code_pages
from docloom.plans.registry import QUERIES, query
from docloom.plans.search_queries import K, dense_text_sql

_ASKED = (
    "SELECT n_nationkey AS query_id, 'difference between size' || n_nationkey || '() and load' || n_nationkey || '() in ' || n_name AS text, "
    "'difference between load' || n_nationkey || ' and size' || n_nationkey || ' behavior synchronization blocking' AS other FROM nation"
)


@query(
    f"""
    WITH docs AS MATERIALIZED (SELECT p_partkey || '_' || section_index || '_' || chunk_index AS id, text, content_type FROM ({QUERIES['chunk_technical'].sql})),
    variants AS (SELECT query_id || '#0' AS vkey, query_id, 0 AS variant, text FROM ({_ASKED}) UNION ALL SELECT query_id || '#1', query_id, 1, other FROM ({_ASKED})),
    found AS (SELECT query_id AS vkey, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r
              FROM ({dense_text_sql(K, 'docs', 'id', 'variants', 'vkey')})),
    kept AS (SELECT v.query_id, v.variant, found.id, found.score, found.r, docs.text, docs.content_type
             FROM found JOIN variants v USING (vkey) JOIN docs ON docs.id = found.id WHERE found.r <= CASE WHEN v.variant = 0 THEN {K} ELSE {max(2, K // 2)} END),
    seen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, text ORDER BY variant, r) AS n FROM kept) WHERE n = 1)
    SELECT query_id, variant::INTEGER AS variant, id, content_type, score, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY variant = 0 DESC, content_type = 'method_documentation' DESC, score DESC, id)::INTEGER AS rank FROM seen)
    WHERE rank <= {K}
    """
)
def technical_retrieval(db):
    key, name = F.col("n_nationkey").cast("string"), F.col("n_name")
    asked = db.nation.select(
        F.col("n_nationkey").alias("query_id"),
        F.concat(F.lit("difference between size"), key, F.lit("() and load"), key, F.lit("() in "), name).alias("text"),
    )
    variants = asked.select(
        "query_id", F.posexplode(technical_variants(F.col("text"), classify_query(F.col("text")))).alias("variant", "text")
    ).withColumn("is_original", F.col("variant") == 0)
    place = [F.col(c).cast("string") for c in ("p_partkey", "section_index", "chunk_index")]
    chunks = technical_chunks(_code_pages(db)).select(F.concat_ws("_", *place).alias("id"), "text", "content_type")
    corpus = chunks.withColumn("embedding", hashed_embedding(F.col("text")))
    hits = expansion.search_variants(corpus, variants, hashed_embedding, K, asked.count() * 4)
    return expansion.merge_variants(hits, K, method_docs_first=True).select(
        "query_id", "variant", "id", "content_type", "score", "rank"
    )
