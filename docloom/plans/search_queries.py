"""Dense, BM25 and TF-IDF search, and what is built on their hits."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom import rules
from docloom.functions.classify import analyze_query, key_terms
from docloom.functions.embedding import hashed_embedding
from docloom.functions.hashing import shard_of
from docloom.operators import expansion, fusion, parent
from docloom.operators.cell_index import CellIndex
from docloom.operators.dense import dense_search, sharded_dense_search
from docloom.operators.sparse import Bm25Model, TfidfModel
from docloom.operators.term_index import TermIndex
from docloom.operators.topk import union_all
from docloom.plans import sql as q
from docloom.plans.chunk_queries import type_sql, windows_sql
from docloom.plans.registry import query
from docloom.session import work_folder

K = 5


def benchmark_queries(db):
    return db.benchmark.select(F.col("item_id").alias("query_id"), "text")


def label_queries(db):
    """One query vector per label: the first vector that carries it."""
    first = db.embeddings.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("embedding"))
    return first.select(F.col("label").alias("query_id"), "embedding")


_LABEL_QUERIES = "SELECT label AS query_id, arg_min(embedding, vec_id) AS embedding FROM embeddings GROUP BY label"
_DISTANCE = (
    "round(1 - (list_dot_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[]) + list_dot_product(q.embedding::DOUBLE[], "
    "q.embedding::DOUBLE[]) - 2 * list_dot_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[])), 6)"
)


def ranked_sql(scored: str, k: int, by: str = "query_id") -> str:
    return (
        f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY score DESC, id)::INTEGER AS rank "
        f"FROM ({scored})) WHERE rank <= {k}"
    )


_VECTOR_PAIRS = f"SELECT q.query_id, v.vec_id AS id, {_DISTANCE} AS score FROM embeddings v, ({_LABEL_QUERIES}) q"


@query(ranked_sql(_VECTOR_PAIRS, K))
def dense_topk(db):
    return dense_search(db.embeddings, label_queries(db), K, id_col="vec_id")


@query(ranked_sql(_VECTOR_PAIRS, K))
def dense_cells_topk(db):
    cells = 16
    index = CellIndex(db.spark, work_folder(db.spark, "cells"))
    index.build(db.embeddings, "vec_id", cells=cells)
    return index.search(label_queries(db), K, probes=cells)


_VEC_SHARD = "(('0x' || right(md5(vec_id::VARCHAR), 1))::INTEGER % 4)::INTEGER"


@query(
    f"""
    WITH scored AS (SELECT q.query_id, v.vec_id AS id, {_DISTANCE} AS score, {_VEC_SHARD} AS shard_id
                    FROM embeddings v, ({_LABEL_QUERIES}) q),
    local AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, shard_id ORDER BY score DESC, id) AS r FROM scored)
              WHERE r <= 10)
    {ranked_sql('SELECT query_id, id, score, shard_id FROM local', K)}
    """
)
def dense_sharded_topk(db):
    return sharded_dense_search(
        db.embeddings, label_queries(db), K, shard_of(F.col("vec_id").cast("string"), 4), id_col="vec_id"
    )


def bm25_sql(k: int, floor: str = "score > 0", docs: str = "documents", key: str = "doc_id", queries: str = "benchmark", qkey: str = "item_id") -> str:
    return f"""
      SELECT query_id, id, score FROM (
        WITH tokens AS (SELECT {key} AS id, {q.words('lower(text)')} AS w FROM {docs}),
        shape AS (SELECT count(*) AS n, sum(len(w)) / count(*) AS avgdl FROM tokens),
        tf AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(w) AS term FROM tokens) GROUP BY ALL),
        df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
        raw AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM df, shape),
        idf AS (SELECT term, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM raw) ELSE idf END AS idf FROM raw),
        asked AS (SELECT query_id, term, count(*) AS n FROM (SELECT {qkey} AS query_id, unnest({q.words('lower(text)')}) AS term FROM {queries}) GROUP BY ALL),
        hits AS (SELECT a.query_id, tf.id, sum(a.n * idf.idf * tf.tf * 2.5 / (tf.tf + 1.5 * (0.25 + 0.75 * len(tokens.w) / avgdl))) AS s
                 FROM asked a JOIN tf USING (term) JOIN idf USING (term) JOIN tokens ON tokens.id = tf.id, shape GROUP BY ALL),
        full_hits AS (SELECT qs.query_id, tokens.id, round(coalesce(s, 0), 6) AS score
                 FROM (SELECT DISTINCT {qkey} AS query_id FROM {queries}) qs, tokens LEFT JOIN hits ON hits.query_id = qs.query_id AND hits.id = tokens.id)
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM full_hits
      ) WHERE r <= {k} AND {floor}"""


@query(f"SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS rank FROM ({bm25_sql(K)})")
def bm25_topk(db):
    return Bm25Model.fit(db.documents, "doc_id").search(benchmark_queries(db), K)


@query(f"SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS rank FROM ({bm25_sql(K)})")
def bm25_index_topk(db):
    """The stored index by term, filled by two batches, searched with upper bounds."""
    index = TermIndex(db.spark, work_folder(db.spark, "term-index"))
    for turn in (0, 1):
        index.add(db.documents.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == turn), "doc_id")
    return index.search(benchmark_queries(db), K)


_STOP = ", ".join(q.quote(w) for w in rules.TFIDF_STOP_WORDS)


def _terms_sql(key: str, source: str) -> str:
    return f"""
      SELECT {key}, list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS terms
      FROM (SELECT {key}, list_filter({q.word_runs('lower(text)', 2)}, lambda x: x NOT IN ({_STOP})) AS w FROM {source})"""


def tfidf_ctes(docs: str = "documents", key: str = "doc_id") -> str:
    return f"""
      tf AS (SELECT id, term, count(*) AS tf FROM (SELECT {key} AS id, unnest(terms) AS term FROM ({_terms_sql(key, docs)})) GROUP BY ALL),
      vocabulary AS (SELECT term, ln((1 + n) / (1 + df)) + 1 AS idf FROM (SELECT term, count(*) AS df, sum(tf) AS cf FROM tf GROUP BY term),
                     (SELECT count(*) AS n FROM {docs}) WHERE df >= 2 AND df <= 0.8 * n ORDER BY cf DESC, term LIMIT 10000)"""


def tfidf_sql(k: int, docs: str = "documents", key: str = "doc_id", queries: str = "benchmark", qkey: str = "item_id") -> str:
    return f"""
      SELECT query_id, id, score FROM (
        WITH {tfidf_ctes(docs, key)},
        dw AS (SELECT id, term, tf * idf AS w FROM tf JOIN vocabulary USING (term)),
        dn AS (SELECT id, sqrt(sum(w * w)) AS n FROM dw GROUP BY id),
        qt AS (SELECT query_id, term, count(*) AS tf FROM (SELECT {qkey} AS query_id, unnest(terms) AS term FROM ({_terms_sql(qkey, queries)})) GROUP BY ALL),
        qw AS (SELECT query_id, term, tf * idf AS w FROM qt JOIN vocabulary USING (term)),
        qn AS (SELECT query_id, sqrt(sum(w * w)) AS n FROM qw GROUP BY query_id),
        dots AS (SELECT query_id, id, sum(dw.w * qw.w) AS dot FROM dw JOIN qw USING (term) GROUP BY ALL),
        scored AS (SELECT query_id, id, round(dot / dn.n / qn.n, 6) AS score FROM dots JOIN dn USING (id) JOIN qn USING (query_id))
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM scored
      ) WHERE r <= {k} AND score > 0.01"""


@query(f"SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS rank FROM ({tfidf_sql(K)})")
def tfidf_topk(db):
    return TfidfModel.fit(db.documents, "doc_id", max_features=rules.TFIDF_MAX_FEATURES).search(benchmark_queries(db), K)


@query(f"WITH {tfidf_ctes()} SELECT term, round(idf, 6) AS idf FROM vocabulary")
def tfidf_vocabulary(db):
    model = TfidfModel.fit(db.documents, "doc_id", max_features=rules.TFIDF_MAX_FEATURES)
    return model.vocabulary.select("term", F.round("idf", 6).alias("idf"))


@query(
    f"""
    WITH tokens AS (SELECT {q.words('lower(text)')} AS w FROM documents),
    df AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(w)) AS term FROM tokens) GROUP BY term),
    shape AS (SELECT count(*) AS n, sum(len(w)) / count(*) AS avgdl FROM tokens)
    SELECT n AS total_documents, round(avgdl, 6) AS average_words, round(avg(ln(n - df + 0.5) - ln(df + 0.5)), 6) AS average_idf,
           count(*) AS distinct_terms FROM df, shape GROUP BY n, avgdl
    """
)
def bm25_statistics(db):
    model = Bm25Model.fit(db.documents, "doc_id")
    return db.spark.range(1).select(
        F.lit(model.n_docs).cast("long").alias("total_documents"),
        F.round(F.lit(model.avg_len), 6).alias("average_words"),
        F.round(F.lit(model.avg_idf), 6).alias("average_idf"),
        F.lit(model.n_terms).cast("long").alias("distinct_terms"),
    )


def embedding_sql(key: str, source: str) -> str:
    """Sparse rows (key, bucket, x) of the hashed word vectors."""
    return f"""
      SELECT {key}, b, (s / sqrt(sum(s * s) OVER (PARTITION BY {key})))::FLOAT::DOUBLE AS x FROM (
        SELECT {key}, ('0x' || substr(md5(t), 1, 2))::INTEGER % 64 AS b,
               sum(CASE WHEN ('0x' || substr(md5(t), 3, 1))::INTEGER % 2 = 1 THEN -1 ELSE 1 END)::DOUBLE AS s
        FROM (SELECT {key}, unnest({q.word_runs('lower(text)')}) AS t FROM {source}) GROUP BY ALL) WHERE s <> 0"""


@query(f"SELECT doc_id, b::INTEGER AS bucket, round(x, 6) AS x FROM ({embedding_sql('doc_id', 'documents')})")
def text_embedding(db):
    vectors = db.documents.select("doc_id", F.posexplode(hashed_embedding(F.col("text"))).alias("bucket", "x"))
    return vectors.where(F.col("x") != 0).select("doc_id", "bucket", F.round(F.col("x").cast("double"), 6).alias("x"))


# --- fusion ---------------------------------------------------------------------------


def _corpus(db):
    return db.documents.select(
        F.col("doc_id").alias("id"), "text", hashed_embedding(F.col("text")).alias("embedding")
    )


def _hits(db, k: int, three: bool):
    asked = benchmark_queries(db)
    vectors = asked.select("query_id", hashed_embedding(F.col("text")).alias("embedding"))
    found = [fusion.tagged(dense_search(_corpus(db), vectors, 2 * k), "dense")]
    model = Bm25Model.fit(db.documents, "doc_id")
    found.append(fusion.tagged(model.search(asked, 2 * k, positive_only=three), "bm25"))
    if three:
        found.append(fusion.tagged(TfidfModel.fit(db.documents, "doc_id", max_features=rules.TFIDF_MAX_FEATURES).search(asked, 2 * k), "tfidf"))
    texts = db.documents.select(F.col("doc_id").alias("id"), "text")
    return asked, fusion.attach(union_all(found), texts, asked.count() * 2 * k * len(found))


def dense_text_sql(k: int, docs: str, key: str, queries: str = "benchmark", qkey: str = "item_id") -> str:
    """The k nearest texts by hashed vectors; texts without words have a zero vector."""
    return f"""
      SELECT query_id, id, score FROM (
        WITH v AS ({embedding_sql(key, docs)}), qv AS ({embedding_sql(qkey, queries)}),
        vn AS (SELECT d.{key} AS id, coalesce(sum(x * x), 0) AS n FROM {docs} d LEFT JOIN v ON v.{key} = d.{key} GROUP BY 1),
        qn AS (SELECT d.{qkey} AS query_id, coalesce(sum(x * x), 0) AS n FROM {queries} d LEFT JOIN qv ON qv.{qkey} = d.{qkey} GROUP BY 1),
        dots AS (SELECT qv.{qkey} AS query_id, v.{key} AS id, sum(v.x * qv.x) AS dot FROM v JOIN qv USING (b) GROUP BY ALL),
        scored AS (SELECT qn.query_id, vn.id, round(1 - (vn.n + qn.n - 2 * coalesce(dot, 0)), 6) AS score
                   FROM vn CROSS JOIN qn LEFT JOIN dots ON dots.query_id = qn.query_id AND dots.id = vn.id)
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM scored
      ) WHERE r <= {k}"""


_RELEVANCE = f"""
  CASE WHEN len({q.word_runs('lower(text)')}) = 0 OR len({q.word_runs('lower(asked)')}) = 0 THEN 0 ELSE
  least(len(list_intersect({q.word_runs('lower(text)')}, {q.word_runs('lower(asked)')}))
        / len(list_distinct(list_concat({q.word_runs('lower(text)')}, {q.word_runs('lower(asked)')})))
        + CASE WHEN contains(lower(text), lower(asked)) THEN 0.2 ELSE 0 END, 1.0) END"""


def relevance_sql(text: str, asked: str) -> str:
    return _RELEVANCE.replace("(text)", f"({text})").replace("(asked)", f"({asked})")


_TWO = f"""
  two AS (
    SELECT query_id, text, min(id) AS id, coalesce(max(score) FILTER (method = 'dense'), 0) AS dense_score,
           coalesce(max(score) FILTER (method = 'bm25'), 0) AS bm25_score
    FROM (SELECT *, 'dense' AS method FROM ({dense_text_sql(2 * K, 'documents', 'doc_id')})
          UNION ALL SELECT *, 'bm25' FROM ({bm25_sql(2 * K, 'true')})) h JOIN documents d ON d.doc_id = h.id
    GROUP BY query_id, text),
  fused AS (SELECT *, round(0.7::DOUBLE * dense_score + (1 - 0.7::DOUBLE) * CASE WHEN bm25_score > 0 THEN bm25_score / 10 ELSE 0 END, 6) AS score FROM two)"""


@query(f"WITH {_TWO} SELECT query_id, id, score, dense_score, bm25_score, rank FROM ({ranked_sql('SELECT * FROM fused', K)})")
def hybrid_two_way(db):
    _, hits = _hits(db, K, three=False)
    return fusion.best(fusion.fuse_two(hits), K).select("query_id", "id", "score", "dense_score", "bm25_score", "rank")


_RERANKED = """
  SELECT f.*, CASE WHEN count(*) OVER (PARTITION BY f.query_id) > 1 THEN {rel} END AS pair_score
  FROM {source} f JOIN benchmark b ON b.item_id = f.query_id"""


def _reranked_sql(source: str) -> str:
    return _RERANKED.format(rel=relevance_sql("f.text", "b.text"), source=source)


_FINAL = "round(coalesce(0.7::DOUBLE * score + 0.3::DOUBLE * pair_score, score), 6)"


@query(
    f"""
    WITH {_TWO}, r AS ({_reranked_sql('fused')}),
    s AS (SELECT query_id, id, score AS hybrid_score, {_FINAL} AS score FROM r)
    SELECT query_id, id, hybrid_score, score AS final_score, rank FROM ({ranked_sql('SELECT * FROM s', K)})
    """
)
def hybrid_reranked(db):
    asked, hits = _hits(db, K, three=False)
    rows = fusion.rerank(fusion.fuse_two(hits), asked)
    return fusion.best(rows, K, "final_score").select(
        "query_id", "id", F.col("score").alias("hybrid_score"), "final_score", "rank"
    )


_THREE = f"""
  hits AS (SELECT *, 'dense' AS method FROM ({dense_text_sql(2 * K, 'documents', 'doc_id')})
           UNION ALL SELECT *, 'bm25' FROM ({bm25_sql(2 * K)}) UNION ALL SELECT *, 'tfidf' FROM ({tfidf_sql(2 * K)})),
  shares AS (SELECT query_id, id, method, CASE WHEN m > 0 THEN score / m ELSE 0 END AS score
             FROM (SELECT *, max(score) OVER (PARTITION BY query_id, method) AS m FROM hits)),
  three AS (
    SELECT query_id, text, min(id) AS id, coalesce(max(score) FILTER (method = 'dense'), 0) AS dense_score,
           coalesce(max(score) FILTER (method = 'bm25'), 0) AS bm25_score, coalesce(max(score) FILTER (method = 'tfidf'), 0) AS tfidf_score,
           string_agg(DISTINCT method, ',' ORDER BY method) AS methods_used, count(DISTINCT method) AS n
    FROM shares JOIN documents d ON d.doc_id = shares.id GROUP BY query_id, text),
  fused AS (SELECT *, round(0.5::DOUBLE * dense_score + 0.3::DOUBLE * bm25_score + 0.2::DOUBLE * tfidf_score + n * 0.1::DOUBLE, 6) AS score FROM three)"""


@query(
    f"""WITH {_THREE} SELECT query_id, id, score, round(dense_score, 6) AS dense_score, round(bm25_score, 6) AS bm25_score,
    round(tfidf_score, 6) AS tfidf_score, methods_used, rank FROM ({ranked_sql('SELECT * FROM fused', K)})"""
)
def multi_vector_fusion(db):
    _, hits = _hits(db, K, three=True)
    return fusion.best(fusion.fuse_three(hits), K).select(
        "query_id",
        "id",
        "score",
        *[F.round(f"{m}_score", 6).alias(f"{m}_score") for m in rules.METHOD_WEIGHTS],
        F.array_join("methods_used", ",").alias("methods_used"),
        "rank",
    )


@query(
    f"""
    WITH {_THREE}, r AS ({_reranked_sql('fused')}),
    s AS (SELECT query_id, id, score AS similarity_score, {_FINAL} AS score FROM r)
    SELECT query_id, id, similarity_score, score AS final_score, rank FROM ({ranked_sql('SELECT * FROM s', K)})
    """
)
def multi_vector_reranked(db):
    asked, hits = _hits(db, K, three=True)
    rows = fusion.rerank(fusion.fuse_three(hits), asked)
    return fusion.best(rows, K, "final_score").select(
        "query_id", "id", F.col("score").alias("similarity_score"), "final_score", "rank"
    )


# --- expansion ------------------------------------------------------------------------


def derived_synonyms(db):
    """Synonyms made from the query words: the word backwards and the word doubled."""
    words = db.benchmark.select(F.explode(key_terms(F.col("text"))).alias("term")).distinct()
    pairs = F.array(
        F.struct(F.reverse("term").alias("synonym"), F.lit(1).alias("rank")),
        F.struct(F.concat("term", "term").alias("synonym"), F.lit(2).alias("rank")),
    )
    return words.select("term", F.inline(pairs))


_QUERY_STOP = ", ".join(q.quote(w) for w in rules.QUERY_STOP_WORDS)
_KEY_TERMS = f"list_filter({q.words('lower(text)')}, lambda w: length(w) > 2 AND w NOT IN ({_QUERY_STOP}))"
_SYN = (
    "list_filter([reverse(t), t || t], lambda s: s <> t AND length(s) > 2)"
)
_VARIANTS = f"""
  terms AS (SELECT item_id AS query_id, text, list_slice({_KEY_TERMS}, 1, 3) AS ts FROM benchmark),
  lists AS (SELECT *, flatten(list_transform(ts, lambda t: list_transform({_SYN}, lambda s: replace(text, t, s)))) AS replaced,
                   list_slice(flatten(list_transform(list_slice(ts, 1, 2), lambda t: {_SYN})), 1, 3) AS extra FROM terms),
  full_lists AS (SELECT query_id, list_concat([text], list_filter(replaced, lambda v: v <> text),
                   CASE WHEN len(extra) > 0 THEN [text || ' ' || array_to_string(extra, ' ')] ELSE [] END) AS vs FROM lists)"""


@query(
    f"""
    WITH {_VARIANTS}
    SELECT query_id, (i - 1)::INTEGER AS variant, vs[i] AS text, i = 1 AS is_original
    FROM (SELECT *, unnest(range(1, least(len(vs), 4) + 1)) AS i FROM full_lists)
    """
)
def query_expansion(db):
    return expansion.expand_queries(benchmark_queries(db), derived_synonyms(db))


@query(
    f"""
    WITH {_VARIANTS},
    variants AS (SELECT query_id::VARCHAR || '#' || (i - 1) AS vkey, query_id, (i - 1)::INTEGER AS variant, vs[i] AS text
                 FROM (SELECT *, unnest(range(1, least(len(vs), 3) + 1)) AS i FROM full_lists)),
    found AS (SELECT h.query_id AS vkey, h.id, h.score, row_number() OVER (PARTITION BY h.query_id ORDER BY h.score DESC, h.id) AS r
              FROM ({dense_text_sql(K, 'documents', 'doc_id', 'variants', 'vkey')}) h),
    kept AS (SELECT v.query_id, v.variant, found.id, found.score, found.r, d.text FROM found JOIN variants v USING (vkey)
             JOIN documents d ON d.doc_id = found.id WHERE found.r <= CASE WHEN v.variant = 0 THEN {K} ELSE {max(2, K // 2)} END),
    seen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, text ORDER BY variant, r) AS n FROM kept) WHERE n = 1)
    SELECT query_id, variant, id, score, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY variant = 0 DESC, score DESC, id)::INTEGER AS rank FROM seen) WHERE rank <= {K}
    """
)
def expanded_retrieval(db):
    asked = benchmark_queries(db)
    variants = expansion.expand_queries(asked, derived_synonyms(db), most=2)
    hits = expansion.search_variants(_corpus(db), variants, hashed_embedding, K, asked.count() * 3)
    return expansion.merge_variants(hits, K).select("query_id", "variant", "id", "score", "rank")


@query(
    f"""
    WITH found AS (SELECT h.*, d.text FROM ({dense_text_sql(K + 1, 'documents', 'doc_id')}) h JOIN documents d ON d.doc_id = h.id),
    once AS (SELECT query_id, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, text ORDER BY score DESC, id) AS c FROM found) WHERE c = 1)
    {ranked_sql('SELECT * FROM once', K)}
    """
)
def plain_retrieval(db):
    asked = benchmark_queries(db)
    rows = expansion.plain_search(_corpus(db), asked, hashed_embedding, K, asked.count())
    return rows.select("query_id", "id", "score", "rank")


@query(
    f"""
    SELECT item_id AS query_id, array_to_string(list_slice(ks, 1, 10), ' ') AS processed_query, len(ks)::INTEGER AS keywords,
           CASE WHEN {q.has_any('lower(text)', rules.QUESTION_WORDS)} THEN 'question'
                WHEN {q.has_any('lower(text)', rules.COMPARISON_WORDS)} THEN 'comparison'
                WHEN {q.has_any('lower(text)', rules.SUMMARY_WORDS)} THEN 'summary' ELSE 'general' END AS query_type,
           array_to_string(key_terms, ' ') AS key_terms
    FROM (SELECT *, {_KEY_TERMS} AS key_terms,
                 [x FOR x, i IN {q.words('lower(text)')} IF length(x) > 2 AND list_position({q.words('lower(text)')}, x) = i] AS ks FROM benchmark)
    """
)
def query_analysis(db):
    a = analyze_query(F.col("text"))
    return benchmark_queries(db).select("query_id", "text", a.alias("a")).select(
        "query_id",
        "a.processed_query",
        F.size("a.keywords").alias("keywords"),
        "a.query_type",
        F.array_join(key_terms(F.col("text")), " ").alias("key_terms"),
    )


# --- parents --------------------------------------------------------------------------

_CHILDREN = f"SELECT doc_id || '_chunk_' || chunk_index AS chunk_id, * FROM ({windows_sql()})"


@query(
    f"""
    WITH kids AS ({_CHILDREN}),
    hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS rank
             FROM ({dense_text_sql(2 * K, 'kids', 'chunk_id')}))
    SELECT query_id, rank, h.id AS chunk_id, score, kids.doc_id::VARCHAR AS parent_id, chunk_index,
           array_to_string(w[greatest(chunk_index * 250 - 250, 0) + 1 : chunk_index * 250 + 500], ' ') AS parent_context,
           len(w[greatest(chunk_index * 250 - 250, 0) + 1 : chunk_index * 250 + 500])::INTEGER AS context_words
    FROM hits h JOIN kids ON kids.chunk_id = h.id
    JOIN (SELECT doc_id, {q.words('text')} AS w FROM documents) d ON d.doc_id = kids.doc_id
    WHERE rank <= {K}
    """
)
def parent_context(db):
    asked = benchmark_queries(db)
    tops = parent.parents(db.documents)
    kids = parent.children(tops)
    vectors = asked.select("query_id", hashed_embedding(F.col("text")).alias("embedding"))
    corpus = kids.select(F.col("chunk_id").alias("id"), hashed_embedding(F.col("text")).alias("embedding"))
    hits = dense_search(corpus, vectors, 2 * K).where(F.col("rank") <= K)
    return parent.with_parent_context(hits, kids, tops, asked.count() * K).drop("text")


HIERARCHY_SQL = f"""
    WITH kids AS (SELECT doc_id, count(*) AS n FROM ({_CHILDREN}) GROUP BY doc_id),
    tops AS (SELECT doc_id, {q.word_count('text')}::INTEGER AS word_count, {type_sql('lower(text)', rules.DOCUMENT_TYPES)} AS document_type FROM documents)
    SELECT document_type, count(*) AS parent_documents, coalesce(sum(n), 0)::BIGINT AS child_chunks,
           round(coalesce(sum(n), 0) / count(*), 6) AS average_chunks, max(word_count) AS largest_document
    FROM tops LEFT JOIN kids USING (doc_id) GROUP BY ROLLUP (document_type)
    """


@query(HIERARCHY_SQL)
def hierarchy_stats(db):
    tops = parent.parents(db.documents)
    return parent.hierarchy_stats(tops, parent.children(tops))
