"""Chunking, projection and store queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom import rules
from docloom.functions import text as t
from docloom.functions.classify import document_type
from docloom.operators import chunking, store
from docloom.plans import sql as q
from docloom.plans.registry import query

# The fold over sentence lengths, written as a list reduction: every element is a state.
_STATE = (
    "{{'i': {i}, 'n': {n}, 'size': {size}, 'start': {start}, 'p1': {p1}, 'p2': {p2}, "
    "'spans': {spans}}}"
)
_NO_SPANS = "[]::STRUCT(a BIGINT, b BIGINT)[]"


def _semantic_sql(source: str, keep: str, max_chars: int = 500) -> str:
    """CTE body that turns (keep, text) rows into (keep, chunk_index, text) rows."""
    full = f"(a.size > 0 AND a.size + s.n > {max_chars})"
    carry = "(s.i - a.start > 2)"
    step = _STATE.format(
        i="s.i",
        n="s.n",
        size=f"CASE WHEN {full} AND {carry} THEN a.p2 + a.p1 + s.n + 2 WHEN {full} THEN s.n + 1 ELSE a.size + s.n + 1 END",
        start=f"CASE WHEN {full} AND {carry} THEN s.i - 2 WHEN {full} THEN s.i ELSE a.start END",
        p1="s.n",
        p2="a.p1",
        spans=f"CASE WHEN {full} THEN list_append(a.spans, {{'a': a.start, 'b': s.i}}) ELSE a.spans END",
    )
    zero = _STATE.format(
        i="0::BIGINT", n="0::BIGINT", size="0::BIGINT", start="0::BIGINT", p1="0::BIGINT", p2="0::BIGINT", spans=_NO_SPANS
    )
    item = _STATE.format(
        i="(k - 1)::BIGINT", n="length(sents[k])::BIGINT", size="0::BIGINT", start="0::BIGINT", p1="0::BIGINT",
        p2="0::BIGINT", spans=_NO_SPANS,
    )
    return f"""
      SELECT {keep}, (k - 1)::INTEGER AS chunk_index,
             array_to_string(sents[spans[k].a + 1 : spans[k].b], ' ') AS text,
             (spans[k].b - spans[k].a)::INTEGER AS sentence_count
      FROM (
        SELECT {keep}, sents, spans, unnest(range(1, len(spans) + 1)) AS k FROM (
          SELECT {keep}, sents,
                 CASE WHEN len(sents) = 0 THEN {_NO_SPANS}
                      ELSE list_append(st.spans, {{'a': st.start, 'b': len(sents)::BIGINT}}) END AS spans
          FROM (
            SELECT {keep}, sents,
                   list_reduce(list_transform(range(1, len(sents) + 1), lambda k: {item}), lambda a, s: {step}, {zero}) AS st
            FROM (SELECT {keep}, {q.sentences('text')} AS sents FROM {source})
          )
        )
      )"""


@query(
    f"""
    SELECT doc_id, chunk_index, text, sentence_count, {q.word_count('text')}::INTEGER AS word_count
    FROM ({_semantic_sql('documents', 'doc_id')})
    """
)
def chunk_semantic(db):
    chunks = chunking.semantic_chunks(db.documents.select("doc_id", "text"))
    return chunks.select(
        "doc_id", "chunk_index", "text", F.size("sentences").alias("sentence_count"), "word_count"
    )


@query(
    f"""
    SELECT doc_id, (k - 1)::INTEGER AS sentence_index, sents[k] AS sentence
    FROM (SELECT doc_id, sents, unnest(range(1, len(sents) + 1)) AS k
          FROM (SELECT doc_id, {q.sentences('text')} AS sents FROM documents))
    """
)
def sentence_split(db):
    return db.documents.select(
        "doc_id", F.posexplode(t.sentences(F.col("text"))).alias("sentence_index", "sentence")
    )


def _turn_pages(db):
    """Conversation turns written as pages with headings, numbered items and gaps."""
    return db.conversations.select(
        "conv_id",
        "turn",
        F.concat(
            F.lit("Page\n\n# "), F.col("role"), F.lit("\n"), F.col("text"), F.lit("\n  2. "), F.col("role"),
            F.lit("\n SECTION TWO\n"), F.col("text"), F.lit("\n \n\nend"),
        ).alias("text"),
    )


_TURN_PAGES = (
    "SELECT conv_id, turn, 'Page' || chr(10) || chr(10) || '# ' || role || chr(10) || text || chr(10) || '  2. ' || role "
    "|| chr(10) || ' SECTION TWO' || chr(10) || text || chr(10) || ' ' || chr(10) || chr(10) || 'end' AS text "
    "FROM conversations"
)


def _split_sql(x: str, pattern: str) -> str:
    cut = f"flatten(list_transform({x}, lambda p: string_split(regexp_replace(p, '{q.re2(pattern)}', chr(64976), 'g'), chr(64976))))"
    return f"list_filter(list_transform({cut}, lambda p: {q.strip('p')}), lambda p: p <> '')"


def _sections_sql(x: str) -> str:
    out = f"[{x}]"
    for pattern in rules.SECTION_PATTERNS:
        out = _split_sql(out, pattern)
    return out


@query(
    f"""
    SELECT conv_id, turn, (k - 1)::INTEGER AS chunk_index, parts[k] AS text
    FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS k
          FROM (SELECT conv_id, turn, {_sections_sql('text')} AS parts FROM ({_TURN_PAGES})))
    """
)
def chunk_hierarchical(db):
    return chunking.hierarchical_chunks(_turn_pages(db))


def _code_pages(db):
    """Method descriptions derived from the part table, one page for each part."""
    p = F.col
    return db.part.select(
        "p_partkey",
        F.concat(
            F.lit("Notes on "), p("p_name"), F.lit(". Read before use.\n public int size"), p("p_partkey"),
            F.lit("(String brand, int width) {\n return width;\n}\nExample:\nrun the part "), p("p_type"),
            F.lit(" twice. Then stop.\n - keep "), p("p_brand"), F.lit(" dry and flat at all times\n load"),
            p("p_partkey"), F.lit("():\nloads the stock of "), p("p_name"),
        ).alias("text"),
    )


_CODE_PAGES = (
    "SELECT p_partkey, 'Notes on ' || p_name || '. Read before use.' || chr(10) || ' public int size' || p_partkey || "
    "'(String brand, int width) {' || chr(10) || ' return width;' || chr(10) || '}' || chr(10) || 'Example:' || chr(10) || "
    "'run the part ' || p_type || ' twice. Then stop.' || chr(10) || ' - keep ' || p_brand || ' dry and flat at all times' "
    "|| chr(10) || ' load' || p_partkey || '():' || chr(10) || 'loads the stock of ' || p_name AS text FROM part"
)


def _boundary_sql(x: str) -> str:
    out = f"[{x}]"
    for pattern in rules.BOUNDARY_PATTERNS:
        # The look-ahead of the first pattern is written as a second group.
        if "(?=" in pattern:
            head, tail = pattern[: pattern.index("(?=")], pattern[pattern.index("(?=") + 3 : -1]
            re = f"({q.re2(head)})({q.re2(tail)})"
            new = "chr(64976) || '\\1\\2'"
        else:
            re = f"({q.re2(pattern)})"
            new = "chr(64976) || '\\1'"
        cut = f"flatten(list_transform({out}, lambda p: string_split(regexp_replace(p, '(?i){re}', {new}, 'g'), chr(64976))))"
        out = f"list_filter(list_transform({cut}, lambda p: {q.strip('p')}), lambda p: p <> '')"
    return f"list_filter({out}, lambda p: length(p) > 20)"


_EDGE = f"(?:^|$|[^{q.WORD}])"
_TYPED, _PLAIN = q.re2(rules.TYPED_METHOD), q.re2(rules.PLAIN_METHOD)


@query(
    f"""
    SELECT p_partkey, (k - 1)::INTEGER AS section_index, parts[k] AS section,
           {q.any_match('parts[k]', rules.METHOD_SIGNATURES)} AS has_method,
           {q.any_match('parts[k]', rules.TECHNICAL_INDICATORS, _EDGE)} AS technical
    FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS k
          FROM (SELECT p_partkey, {_boundary_sql('text')} AS parts FROM ({_CODE_PAGES})))
    """
)
def technical_sections(db):
    section = F.col("section")
    return _code_pages(db).select(
        "p_partkey", F.posexplode(chunking.boundary_sections(F.col("text"))).alias("section_index", "section")
    ).select(
        "p_partkey",
        "section_index",
        "section",
        chunking.has_method_signature(section).alias("has_method"),
        chunking.is_technical(section).alias("technical"),
    )


@query(
    f"""
    SELECT p_partkey,
           CASE WHEN typed THEN regexp_extract(text, '{_TYPED}', 2) WHEN plain THEN regexp_extract(text, '{_PLAIN}', 1) END AS name,
           CASE WHEN typed THEN regexp_extract(text, '{_TYPED}', 0) WHEN plain THEN regexp_extract(text, '{_PLAIN}', 0) END AS signature,
           CASE WHEN typed THEN array_to_string(list_filter(list_transform(string_split(regexp_extract(text, '{_TYPED}', 3), ','),
                lambda p: {q.strip('p')}), lambda p: p <> ''), '|') ELSE '' END AS parameters,
           CASE WHEN typed THEN regexp_extract(text, '{_TYPED}', 1) END AS return_type,
           CASE WHEN typed THEN 'java' ELSE 'unknown' END AS language
    FROM (SELECT *, regexp_matches(text, '{_TYPED}') AS typed, regexp_matches(text, '{_PLAIN}') AS plain FROM ({_CODE_PAGES}))
    """
)
def method_info(db):
    info = _code_pages(db).select("p_partkey", chunking.method_info(F.col("text")).alias("m"))
    return info.select(
        "p_partkey", "m.name", "m.signature", F.array_join("m.parameters", "|").alias("parameters"),
        "m.return_type", "m.language",
    )


@query(
    f"""
    WITH pages AS ({_CODE_PAGES}),
    sections AS (
      SELECT p_partkey, (k - 1)::INTEGER AS section_index, parts[k] AS text,
             {q.any_match('parts[k]', rules.METHOD_SIGNATURES)} AS is_method
      FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS k FROM (
        SELECT p_partkey, CASE WHEN {q.any_match('text', rules.TECHNICAL_INDICATORS, _EDGE)} THEN {_boundary_sql('text')} ELSE [text] END AS parts
        FROM pages))
    ),
    plain AS (SELECT p_partkey, section_index, text FROM sections WHERE NOT is_method)
    SELECT p_partkey, section_index, 0::INTEGER AS chunk_index, text, {q.word_count('text')}::INTEGER AS word_count,
           'method_documentation' AS content_type FROM sections WHERE is_method
    UNION ALL
    SELECT p_partkey, section_index, chunk_index, text, {q.word_count('text')}::INTEGER, 'general'
    FROM ({_semantic_sql('plain', 'p_partkey, section_index')})
    """
)
def chunk_technical(db):
    return chunking.technical_chunks(_code_pages(db)).drop("method")


def windows_sql(source: str = "documents", key: str = "doc_id") -> str:
    return f"""
      SELECT {key}, (row_number() OVER (PARTITION BY {key} ORDER BY i) - 1)::INTEGER AS chunk_index,
             i::INTEGER AS start_word, least(i + 250, len(w))::INTEGER AS end_word,
             (least(i + 250, len(w)) - i)::INTEGER AS word_count,
             array_to_string(w[i + 1 : i + 250], ' ') AS text
      FROM (SELECT {key}, w, unnest(range(0, len(w), 188)) AS i
            FROM (SELECT {key}, {q.words('text')} AS w FROM {source}))
      WHERE length(array_to_string(w[i + 1 : i + 250], ' ')) > 10"""


@query(windows_sql())
def chunk_word_windows(db):
    return chunking.word_windows(db.documents.select("doc_id", "text"))


_PIECE = "{{'s': {s}, 'n': {n}, 'now': {now}, 'done': {done}}}"


PIECES_SQL = f"""
    WITH folded AS (
      SELECT doc_id, list_reduce(
          list_transform({q.sentences('text')}, lambda s: {_PIECE.format(s='s', n=q.word_count('s') + '::BIGINT', now="''", done='[]::VARCHAR[]')}),
          lambda a, x: {_PIECE.format(
              s="x.s",
              n="CASE WHEN a.n + x.n > 800 THEN x.n ELSE a.n + x.n END",
              now="CASE WHEN a.n + x.n > 800 OR a.now = '' THEN x.s ELSE a.now || ' ' || x.s END",
              done="CASE WHEN a.n + x.n > 800 AND a.now <> '' THEN list_append(a.done, a.now) ELSE a.done END")},
          {_PIECE.format(s="''", n="0::BIGINT", now="''", done="[]::VARCHAR[]")}) AS f
      FROM documents),
    parts AS (SELECT doc_id, CASE WHEN f.now <> '' THEN list_append(f.done, f.now) ELSE f.done END AS p FROM folded)
    SELECT doc_id, (k - 1)::INTEGER AS piece_index, p[k] AS text
    FROM (SELECT *, unnest(range(1, len(p) + 1)) AS k FROM parts)
    """


@query(PIECES_SQL)
def summary_pieces(db):
    return db.documents.select(
        "doc_id", F.posexplode(chunking.summary_pieces(F.col("text"))).alias("piece_index", "text")
    )


_SHARD = "(('0x' || right(md5(source), 1))::INTEGER % 4)::INTEGER"


@query(f"SELECT doc_id, source, {_SHARD} AS shard_id FROM documents")
def shard_routing(db):
    return store.with_shard(db.documents.select("doc_id", "source"), 4)


def _five_way(x: str) -> str:
    fold = "list_reduce(list_transform(string_split(md5({x}), ''), lambda d: ('0x' || d)::BIGINT), lambda a, d: (a * 16 + d) % 5, 0::BIGINT)"
    return fold.replace("{x}", x)


@query(f"SELECT {_five_way('source')}::INTEGER AS shard_id, count(*) AS document_count FROM documents GROUP BY 1")
def shard_routing_five(db):
    return store.with_shard(db.documents.select("source"), 5).groupBy("shard_id").agg(
        F.count("*").alias("document_count")
    )


@query(f"SELECT shard_id, count(*) AS document_count FROM (SELECT {_SHARD} AS shard_id FROM documents) GROUP BY ROLLUP (shard_id)")
def shard_stats(db):
    return store.shard_stats(store.with_shard(db.documents.select("source"), 4))


@query(
    f"""
    SELECT sha256(source || chr(31) || 'chunk_' || chunk_index || chr(31) || chunk_index) AS id, text, source,
           0::INTEGER AS page_number, 'chunk_' || chunk_index AS chunk_id, {q.word_count('text')}::INTEGER AS word_count,
           'unknown' AS format
    FROM ({_semantic_sql('documents', 'doc_id, source')})
    """
)
def store_records(db):
    chunks = chunking.semantic_chunks(db.documents.select("doc_id", "source", "text"))
    return store.stored_records(chunks)


@query(
    f"""
    SELECT 'shard_' || shard_id || '_' || chunk_id || '_' || chunk_index AS id, shard_id, source, chunk_index, text
    FROM (SELECT *, {_SHARD} AS shard_id FROM ({_semantic_sql("(SELECT *, 'doc' || doc_id || '_full' AS chunk_id FROM documents)", 'chunk_id, source')}))
    """
)
def store_sharded_records(db):
    units = db.documents.select(
        F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit("_full")).alias("chunk_id"), "source", "text"
    )
    return store.sharded_records(chunking.semantic_chunks(units), 4).select(
        "id", "shard_id", "source", "chunk_index", "text"
    )


def type_sql(x: str, types) -> str:
    cases = " ".join(f"WHEN {q.has_any(x, words)} THEN '{name}'" for name, words in types)
    return f"CASE {cases} ELSE 'general' END"


# Words of the given corpus in the places of the default key words.
FIXTURE_TYPES = [("technical", ["thor", "heit "]), ("academic", ["leau", "ness"]), ("legal", ["ción la"]), ("business", ["with", "und "])]


@query(
    f"""
    SELECT doc_id, {type_sql('lower(text)', rules.DOCUMENT_TYPES)} AS default_type,
           {type_sql('lower(text)', FIXTURE_TYPES)} AS fixture_type FROM documents
    """
)
def document_types(db):
    text = F.col("text")
    return db.documents.select(
        "doc_id",
        document_type(text).alias("default_type"),
        document_type(text, FIXTURE_TYPES).alias("fixture_type"),
    )
