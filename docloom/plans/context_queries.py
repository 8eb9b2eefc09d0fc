"""Summaries, context compression, prompts, memory, cache, statistics and markup."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom import rules
from docloom.functions import text as t
from docloom.functions.hashing import cache_key
from docloom.functions.markup import html_text, markdown_text
from docloom.operators import abstractive, cache, compress, memory, prompts, stats, summarize
from docloom.operators.fusion import attach
from docloom.operators.sparse import Bm25Model
from docloom.plans import sql as q
from docloom.plans.chunk_queries import PIECES_SQL, _semantic_sql
from docloom.plans.nlp_queries import _ENTITIES, _RELATIONS, FIXTURE_TERMS
from docloom.plans.registry import query
from docloom.plans.search_queries import HIERARCHY_SQL, K, benchmark_queries, bm25_sql, relevance_sql

# --- summaries ------------------------------------------------------------------------


@query(
    f"""
    WITH pieces AS ({PIECES_SQL}),
    parts AS (
      SELECT doc_id, piece_index, count(*) OVER (PARTITION BY doc_id) AS n, {q.words('pieces.text')} AS w
      FROM pieces JOIN documents USING (doc_id) WHERE {q.word_count('documents.text')} > 1000),
    firsts AS (
      SELECT doc_id, max(n) AS n,
             string_agg(array_to_string(w[1 : CASE WHEN n > 1 THEN 300 // n + 50 ELSE 300 END], ' '), ' ' ORDER BY piece_index) AS a
      FROM parts GROUP BY doc_id),
    made AS (SELECT doc_id, {q.words('coalesce(a, text)')} AS w, coalesce(n, 1)::INTEGER AS n FROM documents LEFT JOIN firsts USING (doc_id))
    SELECT doc_id, CASE WHEN len(w) > 0 THEN array_to_string(w[1 : 300], ' ') END AS abstract, NULL::VARCHAR AS abstract_error,
           CASE WHEN len(w) > 0 THEN n END AS abstract_pieces
    FROM made
    """
)
def summary_two_pass(db):
    made = abstractive.two_pass(db.documents.select("doc_id", "text"), abstractive.leading_words, batch=64)
    return made.drop("text")



_STOP = ", ".join(q.quote(w) for w in rules.SUMMARY_STOP_WORDS)
_SCORES = f"""
  sents AS (SELECT doc_id, len(ss) AS size, (i - 1)::INTEGER AS i, ss[i] AS s FROM (SELECT doc_id, ss, unnest(range(1, len(ss) + 1)) AS i
            FROM (SELECT doc_id, {q.sentences('text')} AS ss FROM documents))),
  toks AS (SELECT doc_id, i, w FROM (SELECT doc_id, i, unnest(regexp_extract_all(lower(s), '[\\p{{L}}\\p{{N}}]+')) AS w FROM sents) WHERE w NOT IN ({_STOP})),
  freq AS (SELECT doc_id, w, count(*) AS f FROM toks GROUP BY ALL),
  sums AS (SELECT doc_id, i, sum(f) AS total, count(*) AS c FROM toks JOIN freq USING (doc_id, w) GROUP BY ALL),
  scores AS (SELECT s.doc_id, s.i, s.s, s.size, {q.word_count('s.s')}::INTEGER AS n, coalesce(total / c, 0)::DOUBLE AS frequency,
     CASE WHEN c IS NULL THEN 0::DOUBLE ELSE (total / c)::DOUBLE
       + (CASE WHEN s.i = 0 OR s.i = s.size - 1 THEN 0.3 WHEN s.i < s.size * 0.2::DOUBLE THEN 0.1 ELSE 0 END)::DOUBLE
       + (CASE WHEN c BETWEEN 10 AND 30 THEN 0.2 ELSE 0 END)::DOUBLE
       + (CASE WHEN regexp_matches(s.s, '\\p{{Nd}}') THEN 0.1 ELSE 0 END)::DOUBLE END AS extractive
     FROM sents s LEFT JOIN sums USING (doc_id, i))"""


def _chosen_sql(which: str) -> str:
    state = "{{'i': {i}, 'n': {n}, 'used': {used}, 'chosen': {chosen}}}"
    item = state.format(i="i", n="n", used="0", chosen="[]::INTEGER[]")
    fits = "a.used + x.n <= 300"
    step = state.format(
        i="x.i", n="x.n", used=f"CASE WHEN {fits} THEN a.used + x.n ELSE a.used END",
        chosen=f"CASE WHEN {fits} THEN list_append(a.chosen, x.i) ELSE a.chosen END",
    )
    zero = state.format(i="0", n="0", used="0", chosen="[]::INTEGER[]")
    return f"list_sort(list_reduce(list({item} ORDER BY {which} DESC, i), lambda a, x: {step}, {zero}).chosen)"


_SUMMARIES = f"""
  {_SCORES},
  picked AS (SELECT doc_id, list(s ORDER BY i) AS ss, {_chosen_sql('extractive')} AS ec, {_chosen_sql('frequency')} AS fc FROM scores GROUP BY doc_id),
  texts AS (SELECT d.doc_id, d.text, {q.word_count('d.text')} AS total,
              CASE WHEN len(ss) <= 3 THEN d.text ELSE array_to_string(list_transform(ec, lambda i: ss[i + 1]), ' ') END AS ext,
              len(ss) <= 3 AS short, array_to_string(list_transform(fc, lambda i: ss[i + 1]), ' ') AS fre
            FROM documents d JOIN picked USING (doc_id)),
  rated AS (SELECT *, CASE WHEN short THEN 1::DOUBLE ELSE {q.word_count('ext')} / total END AS er, {q.word_count('fre')} / total AS fr FROM texts),
  quality AS (SELECT *, (1 - abs(0.3::DOUBLE - er)) * 0.4::DOUBLE + (CASE WHEN {q.word_count('ext')} BETWEEN 30 AND 250 THEN 1 ELSE 0.5 END)::DOUBLE * 0.4::DOUBLE AS eq,
                        (1 - abs(0.3::DOUBLE - fr)) * 0.4::DOUBLE + (CASE WHEN {q.word_count('fre')} BETWEEN 30 AND 250 THEN 1 ELSE 0.5 END)::DOUBLE * 0.4::DOUBLE AS fq FROM rated)"""


@query(f"WITH {_SCORES} SELECT doc_id, i AS sentence_index, n AS words, round(extractive, 6) AS extractive, round(frequency, 6) AS frequency FROM scores")
def sentence_scores(db):
    cut = db.documents.select("doc_id", t.sentences(F.col("text")).alias("sentences"))
    scored = summarize.sentence_scores(F.col("sentences"), rules.SUMMARY_STOP_WORDS)
    rows = cut.select("doc_id", F.explode(scored).alias("x"))
    return rows.select(
        "doc_id", F.col("x.i").alias("sentence_index"), F.col("x.n").alias("words"),
        F.round("x.extractive", 6).alias("extractive"), F.round("x.frequency", 6).alias("frequency"),
    )


@query(
    f"""
    WITH {_SUMMARIES}
    SELECT doc_id, CASE WHEN total < 50 THEN text WHEN eq >= fq THEN ext ELSE fre END AS summary,
           CASE WHEN total < 50 THEN 'original' WHEN eq >= fq THEN 'extractive' ELSE 'frequency' END AS summary_type,
           round(CASE WHEN total < 50 THEN 1 WHEN eq >= fq THEN er ELSE fr END, 6) AS compression_ratio,
           {q.word_count('CASE WHEN total < 50 THEN text WHEN eq >= fq THEN ext ELSE fre END')}::INTEGER AS word_count,
           total::INTEGER AS original_word_count
    FROM quality
    UNION ALL SELECT doc_id, text, 'original', 1, 0, 0 FROM documents WHERE {q.word_count('text')} = 0
    """
)
def document_summary(db):
    rows = summarize.summarize(db.documents.select("doc_id", "text"))
    return rows.drop("text", "all_summaries").withColumn("compression_ratio", F.round("compression_ratio", 6))


@query(
    f"""
    WITH {_SUMMARIES} SELECT doc_id, CASE WHEN total < 50 THEN text ELSE fre END AS summary FROM quality
    UNION ALL SELECT doc_id, text FROM documents WHERE {q.word_count('text')} = 0
    """
)
def summary_by_frequency(db):
    return summarize.summarize(db.documents.select("doc_id", "text"), method="frequency").select("doc_id", "summary")


@query(f"WITH {_SCORES} SELECT doc_id, w AS word, f AS mentions FROM freq")
def word_frequencies(db):
    words = F.filter(t.alnum_runs(F.lower("text")), lambda w: ~w.isin(rules.SUMMARY_STOP_WORDS))
    return db.documents.select("doc_id", F.inline(t.counts(words))).select(
        "doc_id", F.col("term").alias("word"), F.col("tf").cast("long").alias("mentions")
    )


# --- compression ----------------------------------------------------------------------

# Every document meets one benchmark text as its query.
_MATCHED = (
    "SELECT d.doc_id, d.text, b.text AS asked FROM documents d "
    "JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark)"
)


def _matched(db):
    docs = db.documents.select("doc_id", "text", (F.col("doc_id") % db.benchmark.count()).alias("item_id"))
    return docs.join(db.benchmark.select("item_id", F.col("text").alias("asked")), "item_id")


@query(f"SELECT doc_id, round({relevance_sql('m.text', 'm.asked')}, 6) AS relevance FROM ({_MATCHED}) m")
def relevance_score(db):
    return _matched(db).select("doc_id", F.round(t.relevance(F.col("text"), F.col("asked")), 6).alias("relevance"))


def compressed_sql(source: str, keys: str, budget: int = 200) -> str:
    """Rows (keys, text, asked) with the compressed text and its numbers of sentences."""
    state = "{{'c': {c}, 'o': {o}, 't': {t}, 'used': {used}, 'out': {out}}}"
    item = state.format(c=f"{q.word_count('s')} * 1.3::DOUBLE", o="true", t="s", used="0::DOUBLE", out="[]::VARCHAR[]")
    take = f"(a.o AND a.used + x.c <= {budget})"
    step = state.format(
        c="x.c", o=take, t="x.t", used=f"CASE WHEN {take} THEN a.used + x.c ELSE a.used END",
        out=f"CASE WHEN {take} THEN list_append(a.out, x.t) ELSE a.out END",
    )
    zero = state.format(c="0::DOUBLE", o="true", t="''", used="0::DOUBLE", out="[]::VARCHAR[]")
    return f"""
      SELECT {keys}, text, asked, size AS original_sentences, CASE WHEN size <= 2 THEN size ELSE len(c) END AS compressed_sentences,
             CASE WHEN size <= 2 THEN text ELSE array_to_string(c, ' ') END AS kept
      FROM (SELECT {keys}, any_value(text) AS text, any_value(asked) AS asked, any_value(size)::INTEGER AS size,
                   list_reduce(list({item} ORDER BY r DESC, i), lambda a, x: {step}, {zero}).out AS c
            FROM (SELECT *, {relevance_sql('u.s', 'u.asked')} AS r FROM (
              SELECT {keys}, text, asked, len(ss) AS size, unnest(range(0, len(ss))) AS i, unnest(ss) AS s
              FROM (SELECT *, {q.sentences('text')} AS ss FROM {source})) u) GROUP BY {keys})"""


@query(f"SELECT doc_id, kept AS text, original_sentences, compressed_sentences::INTEGER AS compressed_sentences FROM ({compressed_sql(f'({_MATCHED})', 'doc_id')})")
def compress_sentences(db):
    rows = _matched(db).select("doc_id", compress.compress_sentences(F.col("text"), F.col("asked")).alias("c"))
    return rows.select("doc_id", "c.text", "c.original_sentences", "c.compressed_sentences")


_BUDGET = 1200
_HITS = f"""
  SELECT h.query_id, h.id, row_number() OVER (PARTITION BY h.query_id ORDER BY h.score DESC, h.id)::INTEGER AS rank, d.text, b.text AS asked
  FROM ({bm25_sql(2 * K)}) h JOIN documents d ON d.doc_id = h.id JOIN benchmark b ON b.item_id = h.query_id"""
_FOLD = "{{'id': {id}, 'rank': {rank}, 'tok': {tok}, 'cost': {cost}, 'txt': {txt}, 'cut': {cut}, 'used': {used}, 'o': {o}, 'out': {out}}}"
_OUT = "STRUCT(id BIGINT, rank INTEGER, txt VARCHAR, cut BOOLEAN)[]"
_TAKE = f"(a.o AND a.used + x.tok <= {_BUDGET})"
_ITEM = _FOLD.format(id="id", rank="rank", tok="tok", cost="CASE WHEN tok > 300 THEN length(kept) // 4 ELSE tok END", txt="CASE WHEN tok > 300 THEN kept ELSE text END", cut="(tok > 300 AND original_sentences > 2)", used="0::BIGINT", o="true", out=f"[]::{_OUT}")
_STEP = _FOLD.format(
    id="x.id", rank="x.rank", tok="x.tok", cost="x.cost", txt="x.txt", cut="x.cut",
    used=f"CASE WHEN {_TAKE} THEN a.used + x.cost ELSE a.used END", o=_TAKE,
    out=f"CASE WHEN {_TAKE} THEN list_append(a.out, {{'id': x.id, 'rank': x.rank, 'txt': x.txt, 'cut': x.cut}}) ELSE a.out END",
)
_ZERO = _FOLD.format(id="0::BIGINT", rank="0::INTEGER", tok="0::BIGINT", cost="0::BIGINT", txt="''", cut="false", used="0::BIGINT", o="true", out=f"[]::{_OUT}")


@query(
    f"""
    WITH hits AS MATERIALIZED ({_HITS}),
    c AS (SELECT *, length(text) // 4 AS tok, {relevance_sql('k.text', 'k.asked')} AS r FROM ({compressed_sql('hits', 'query_id, id, rank')}) k),
    l AS (SELECT query_id, (sum(length(text)) + count(*) - 1) // 4 AS total,
            list({{'id': id, 'rank': rank, 'txt': text, 'cut': false}} ORDER BY rank) AS whole,
            list_reduce(list({_ITEM} ORDER BY r DESC, rank), lambda a, x: {_STEP}, {_ZERO}).out AS cut FROM c GROUP BY query_id),
    r AS (SELECT query_id, CASE WHEN total <= {_BUDGET} THEN whole ELSE cut END AS ks FROM l)
    SELECT query_id, (i - 1)::INTEGER AS position, ks[i].id::VARCHAR AS id, ks[i].rank AS rank, ks[i].txt AS text, ks[i].cut AS compressed
    FROM (SELECT *, unnest(range(1, len(ks) + 1)) AS i FROM r)
    """
)
def context_compression(db):
    asked = benchmark_queries(db)
    rows = _hit_rows(db, asked)
    return compress.compress_context(rows, asked, _BUDGET).drop("compression_method")


def _hit_rows(db, asked):
    hits = Bm25Model.fit(db.documents, "doc_id").search(asked, 2 * K)
    docs = db.documents.select(F.col("doc_id").alias("id"), "text", "source")
    return attach(hits, docs, asked.count() * 2 * K)


@query(f"SELECT query_id, ((sum(length(text)) + count(*) - 1) // 4)::BIGINT AS tokens, count(*) AS chunks FROM ({_HITS}) GROUP BY query_id")
def context_token_estimate(db):
    rows = _hit_rows(db, benchmark_queries(db))
    return rows.groupBy("query_id").agg(
        F.floor((F.sum(F.length("text")) + F.count("*") - 1) / 4).alias("tokens"), F.count("*").alias("chunks")
    )


# --- prompts --------------------------------------------------------------------------


@query(
    f"""
    SELECT query_id, string_agg('[' || rank || '] ' || d.source || ', page 0, score ' || round(score::DECIMAL(20, 6), 4) || chr(10) || d.text || chr(10), chr(10) ORDER BY rank) AS context_text
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS rank FROM ({bm25_sql(2 * K)})) h
    JOIN documents d ON d.doc_id = h.id GROUP BY query_id
    """
)
def prompt_context(db):
    block = prompts.context_block(F.col("rank"), F.col("source"), F.lit(0), F.col("score"), F.col("text"))
    return prompts.gather(_hit_rows(db, benchmark_queries(db)), block, order="rank")


# --- memory ---------------------------------------------------------------------------

_PAIRS = """
  SELECT a.conv_id AS session_id, a.turn, a.text AS query, b.text AS response
  FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant'"""
_AGED = f"SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn DESC)::INTEGER AS age FROM ({_PAIRS})"


@query(f"SELECT * FROM ({_AGED}) WHERE age <= 10")
def conversation_window(db):
    return memory.last_turns(memory.question_answer_pairs(db.conversations))


@query(
    f"""
    SELECT session_id, string_agg('Previous Q: ' || query || chr(10) || 'Previous A: ' || response || chr(10) || chr(10), '' ORDER BY turn) AS context
    FROM ({_AGED}) WHERE age <= 3 GROUP BY session_id
    """
)
def conversation_context(db):
    return memory.session_context(memory.question_answer_pairs(db.conversations))


# --- cache ----------------------------------------------------------------------------

_NOW = "2024-01-20 12:00:00"
_ANSWERS = """
  SELECT md5(trim(lower(' ' || event_type || ' of ' || user_id || ' '))) AS key, props || '#' || event_id AS value, ts AS created_at,
         ts + INTERVAL 24 HOUR AS expires_at FROM events"""
_NEWEST = f"SELECT key, arg_max({{'value': value, 'created_at': created_at, 'expires_at': expires_at}}, {{'c': created_at, 'v': value}}) AS e FROM ({_ANSWERS}) GROUP BY key"


def _answers(db):
    query_text = F.concat(F.lit(" "), F.col("event_type"), F.lit(" of "), F.col("user_id").cast("string"), F.lit(" "))
    return cache.entries(
        db.events.select(
            query_text.alias("query"), F.concat_ws("#", "props", F.col("event_id").cast("string")).alias("value"), F.col("ts").alias("created_at")
        )
    )


@query("SELECT item_id, md5(trim(lower(text))) AS key, md5(trim(lower(text)) || '_' || md5(text)) AS context_key FROM benchmark")
def cache_keys(db):
    text = F.col("text")
    return db.benchmark.select(
        "item_id", cache_key(text).alias("key"), cache_key(text, F.md5(text.cast("binary"))).alias("context_key")
    )


@query(f"SELECT key, e.value AS value, e.created_at AS created_at, e.expires_at AS expires_at FROM ({_NEWEST})")
def cache_upsert(db):
    return cache.newest(_answers(db))


@query(
    f"""
    WITH newest AS (SELECT key, e.value AS value, e.created_at AS created_at, e.expires_at AS expires_at
                    FROM (SELECT key, arg_max({{'value': value, 'created_at': created_at, 'expires_at': expires_at}}, {{'c': created_at, 'v': value}}) AS e
                          FROM ({_ANSWERS}) WHERE created_at <= TIMESTAMP '{_NOW}' GROUP BY key)),
    asked AS (SELECT DISTINCT user_id, 'VIEW of ' || user_id AS query, md5('view of ' || user_id) AS key FROM events)
    SELECT user_id, query, asked.key, n.value, (CASE WHEN n.key IS NOT NULL THEN 1 END)::INTEGER AS level, n.key IS NOT NULL AS cached
    FROM asked LEFT JOIN (SELECT * FROM newest WHERE expires_at > TIMESTAMP '{_NOW}') n ON n.key = asked.key
    """
)
def cache_lookup(db):
    now = F.lit(_NOW).cast("timestamp")
    stored = cache.newest(_answers(db).where(F.col("created_at") <= now))
    asked = db.events.select("user_id", F.concat(F.lit("VIEW of "), F.col("user_id").cast("string")).alias("query")).distinct()
    return cache.lookup(asked, [stored], now)


# --- statistics -----------------------------------------------------------------------


def _log(db):
    return db.events.select("ts", F.col("value").alias("seconds"), (F.col("event_type") == "view").alias("cached"))


@query(
    """
    SELECT count(*) AS total_queries, round(avg(value) FILTER (event_type <> 'view'), 3) AS average_response_time,
           count(*) FILTER (event_type = 'view') AS cache_hits, round(count(*) FILTER (event_type = 'view') / count(*), 6) AS cache_hit_rate FROM events
    """
)
def performance_stats(db):
    return stats.performance(_log(db))


@query(
    """
    SELECT period, n AS queries, (sum(n) OVER w)::BIGINT AS total_queries, round(sum(s) OVER w / sum(n) OVER w, 4) AS average_response_time
    FROM (SELECT date_trunc('hour', ts) AS period, count(*) AS n, sum(value) AS s FROM events WHERE event_type <> 'view' GROUP BY 1)
    WINDOW w AS (ORDER BY period ROWS UNBOUNDED PRECEDING)
    """
)
def running_response_time(db):
    return stats.running_mean(_log(db))


def _top_sql(source: str, label: str) -> str:
    return f"""SELECT doc_id, sum(n)::BIGINT AS total, string_agg({label} || '=' || n, ',' ORDER BY n DESC, {label}) FILTER (r <= 10) AS tops
      FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, {label}) AS r FROM (SELECT doc_id, {label}, count(*) AS n FROM ({source}) GROUP BY ALL)) GROUP BY doc_id"""


@query(
    f"""
    SELECT d.doc_id, coalesce(c.chunks, 0) AS chunks, coalesce(e.total, 0) AS entities, coalesce(e.tops, '') AS top_entities,
           coalesce(r.total, 0) AS relations, coalesce(r.tops, '') AS top_relations
    FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS chunks FROM ({_semantic_sql('documents', 'doc_id')}) GROUP BY doc_id) c USING (doc_id)
    LEFT JOIN ({_top_sql(_ENTITIES, 'label')}) e USING (doc_id) LEFT JOIN ({_top_sql(_RELATIONS, 'relation')}) r USING (doc_id)
    """
)
def ingest_statistics(db):
    return stats.ingest_statistics(db.documents, "doc_id", dictionary=FIXTURE_TERMS)


@query(
    f"""
    WITH e AS (SELECT label, lower(entity) AS entity FROM ({_ENTITIES})), r AS ({_RELATIONS}),
    h AS ({HIERARCHY_SQL})
    SELECT 'documents' AS part, 'total' AS section, 'documents' AS key, count(*)::DOUBLE AS value FROM documents
    UNION ALL SELECT 'entities', 'total', 'unique_entities', count(DISTINCT entity)::DOUBLE FROM e
    UNION ALL SELECT 'entities', 'label', label, count(*)::DOUBLE FROM e GROUP BY label
    UNION ALL SELECT * FROM (SELECT 'entities', 'common', entity, count(*)::DOUBLE AS n FROM e GROUP BY entity ORDER BY n DESC, entity LIMIT 20)
    UNION ALL SELECT 'relations', 'total', 'total_relationships', count(*)::DOUBLE FROM r
    UNION ALL SELECT 'relations', 'total', 'unique_patterns', count(DISTINCT relation)::DOUBLE FROM r
    UNION ALL SELECT 'relations', 'total', 'average_confidence', 0.8::DOUBLE
    UNION ALL SELECT 'relations', 'method', 'pattern', count(*)::DOUBLE FROM r
    UNION ALL SELECT 'relations', 'pattern', relation, count(*)::DOUBLE FROM r GROUP BY relation
    UNION ALL SELECT 'hierarchy', coalesce(document_type, 'total'), 'parent_documents', parent_documents::DOUBLE FROM h
    UNION ALL SELECT 'hierarchy', coalesce(document_type, 'total'), 'child_chunks', child_chunks::DOUBLE FROM h
    UNION ALL SELECT 'hierarchy', coalesce(document_type, 'total'), 'average_chunks', average_chunks::DOUBLE FROM h
    UNION ALL SELECT 'hierarchy', 'total', 'largest_document', largest_document::DOUBLE FROM h WHERE document_type IS NULL
    """
)
def collection_analysis(db):
    return stats.collection_analysis(db.documents, "doc_id", dictionary=FIXTURE_TERMS)


# --- markup ---------------------------------------------------------------------------

_PLAIN = "regexp_replace(regexp_replace(html, '(?is)<!--.*?-->|<script\\b[^>]*>.*?</script\\s*>|<style\\b[^>]*>.*?</style\\s*>|<template\\b[^>]*>.*?</template\\s*>|<![^>]*>', '', 'g'), '</?[a-zA-Z][^>]*>', '', 'g')"
_REFS = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&nbsp;": "\xa0", "&copy;": "\xa9", "&middot;": "\xb7", "&#39;": "'", "&eacute;": "\xe9", "&amp;": "&"}


def _unescaped(x: str) -> str:
    for ref, char in _REFS.items():
        x = f"replace({x}, {q.quote(ref)}, {q.quote(char)})"
    return x


@query(f"SELECT page_id, {_unescaped(_PLAIN)} AS text FROM pages")
def html_to_text(db):
    return db.pages.select("page_id", html_text(F.col("html")).alias("text"))


@query(
    """
    SELECT conv_id, turn, role || chr(10) || chr(10) || text || chr(10) || 'see ' || role || ' and bold ' || turn || chr(10) || 'item' AS text FROM conversations
    """
)
def markdown_to_text(db):
    turn = F.col("turn").cast("string")
    source = F.concat(
        F.lit("## "), F.col("role"), F.lit("\n\n"), F.col("text"), F.lit("\nsee ["), F.col("role"),
        F.lit("](http://example.org) and **bold** `"), turn, F.lit("`\n- item"),
    )
    return db.conversations.select("conv_id", "turn", markdown_text(source).alias("text"))


@query("SELECT event_id, 'JSON Data:' || chr(10) || '{' || chr(10) || '  \"k\": ' || (props->>'k') || chr(10) || '}' AS text, (props->>'k')::BIGINT AS k FROM events")
def json_source(db):
    from docloom.sources.files import pretty_json

    return db.events.select(
        "event_id",
        F.concat(F.lit("JSON Data:\n"), pretty_json(F.col("props"))).alias("text"),
        F.get_json_object("props", "$.k").cast("long").alias("k"),
    )
