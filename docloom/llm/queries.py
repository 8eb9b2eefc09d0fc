"""Registered queries of this folder: name -> (plan, SQL twin or None)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import ann, decontam, fingerprints, importance, langid, mixing, negatives, quality, simhash, suffixes, token_files, toxicity, warc
from docloom.llm.common import fold
from docloom.llm.ranges import with_following

THRESHOLD = 0.3


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def predictions(scored: DataFrame, held_out: Column) -> DataFrame:
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    documents, held_out = table(spark, folder, "documents"), fold(F.col("doc_id"), 4) == 2
    model = toxicity.fit(documents.filter(~held_out), table(spark, folder, "labels").filter(~held_out))
    return predictions(toxicity.with_toxicity(documents, model, keep=["doc_id"]), held_out)


def op2_simhash(spark: SparkSession, folder: str) -> DataFrame:
    groups = simhash.near_groups(table(spark, folder, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_quality(spark: SparkSession, folder: str) -> DataFrame:
    documents, held_out = table(spark, folder, "documents"), fold(F.col("doc_id"), 5) == 0
    model = quality.fit(quality.labelled_sample(documents.filter(~held_out), table(spark, folder, "labels").filter(~held_out), "quality"))
    return predictions(quality.with_score(documents, model, keep=["doc_id"]), held_out)


def op4_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.archived(table(spark, folder, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


WARC_SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), d AS (
  SELECT page_id, octet_length(payload) AS payload_bytes, sha256(payload) AS payload_digest FROM p
), f AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first_id FROM d
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first_id < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first_id < page_id THEN first_id END AS refers_to
FROM f
"""


def op5_language(spark: SparkSession, folder: str) -> DataFrame:
    documents, held_out = table(spark, folder, "documents"), fold(F.col("doc_id"), 3) == 1
    found = langid.identify(documents, langid.fit(documents.filter(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op6_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return ann.search(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


def op7_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontam.with_matches(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        "longest",
    )


def op8_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return token_files.token_index(table(spark, folder, "documents"))


def op9_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(table(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


MIXING_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), sums AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighted AS (
  SELECT *, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::HUGEINT AS w,
    2 * source_size::HUGEINT AS lim, 3 * sum(source_size) OVER ()::HUGEINT AS twice_whole
  FROM sums
), levels AS (
  SELECT a.source, a.source_size, a.w, a.lim, a.twice_whole,
    2 * (SELECT sum(least(b.lim * a.w, b.w * a.lim)) FROM weighted b) < a.twice_whole * a.w AS full_up
  FROM weighted a
), rest AS (
  SELECT any_value(twice_whole) - 2 * coalesce(sum(lim) FILTER (full_up), 0) AS twice_rest, sum(w) FILTER (NOT full_up) AS open_w FROM levels
), targets AS (
  SELECT source, source_size, CASE WHEN full_up THEN lim::DOUBLE
    ELSE CASE WHEN twice_rest % 2 = 0 THEN w::DOUBLE * (twice_rest // 2)::DOUBLE / open_w::DOUBLE ELSE w::DOUBLE * twice_rest::DOUBLE / (2 * open_w)::DOUBLE END END AS target
  FROM levels, rest
), rated AS (
  SELECT doc_id, size, t.source_size, target, CASE WHEN t.source_size > 0 THEN target / t.source_size ELSE 0 END AS rate,
    ('0x' || substr(md5('42:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM rated
"""

def op10_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = suffixes.without_repeats(table(spark, folder, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = F.transform("embedding", lambda x: F.floor(256 * x.cast("double")))
    rows = negatives.usable(table(spark, folder, "embeddings"), whole, label)
    return negatives.mine(rows, F.col("vec_id") % 100 == 0)


NEGATIVES_SQL = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS alike, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT alike AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= 5
"""


def op12_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    pairs = with_following(documents, "next_text")
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    sketched = pairs.select(
        "doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"),
        fingerprints.sketch(F.col("text")).alias("own"), fingerprints.sketch(edited).alias("changed"), fingerprints.sketch(F.col("next_text")).alias("behind"),
    )
    own, changed = F.col("own"), F.col("changed")
    return sketched.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprints.as_text(own).alias("fingerprint"),
        fingerprints.as_text(changed).alias("edited_fingerprint"),
        fingerprints.resemblance(own, changed).alias("near_edited"),
        fingerprints.resemblance(own, F.col("behind")).alias("near_next"),
        fingerprints.different_shingles(own).alias("n_shingles"),
        fingerprints.containment(own, changed).alias("kept_share"),
    )


def op13_importance(spark: SparkSession, folder: str) -> DataFrame:
    ranked = importance.ranked(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return ranked.select("doc_id", "n_features", "weight", "score", "rank")


# crc32 by its definition: a table of 256 remainders, then one step per byte.
IMPORTANCE_SQL = r"""
WITH crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t
), d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), b AS (
  SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark
), dw AS (
  SELECT r, w, count(*) AS n FROM (SELECT r, unnest(words) AS w FROM d) GROUP BY ALL
), bw AS (
  SELECT w, count(*) AS n FROM (SELECT unnest(words) AS w FROM b) GROUP BY ALL
), hashed AS (
  SELECT w, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, octet_length(encode(w)) + 1), lambda i: ('0x' || substr(hex(w), CAST(2 * i - 1 AS BIGINT), 2))::BIGINT)),
    lambda c, x: xor(crc.t[(xor(c, x) & 255) + 1], c >> 8))) % 10000 AS bucket
  FROM (SELECT w FROM dw UNION SELECT w FROM bw), crc
), s AS (
  SELECT bucket, sum(n)::BIGINT AS s FROM dw JOIN hashed USING (w) GROUP BY bucket
), t AS (
  SELECT bucket, sum(n)::BIGINT AS t FROM bw JOIN hashed USING (w) GROUP BY bucket
), gains AS (
  SELECT bucket, floor(1000 * ln(((coalesce(t, 0) + 1) * ((SELECT coalesce(sum(s), 0)::BIGINT FROM s) + 10000))::DOUBLE
    / ((coalesce(s, 0) + 1) * ((SELECT coalesce(sum(t), 0)::BIGINT FROM t) + 10000))::DOUBLE))::BIGINT AS gain
  FROM s FULL JOIN t USING (bucket)
), weights AS (
  SELECT r, floor(sum(n * gain)::DOUBLE / sum(n))::BIGINT AS weight FROM dw JOIN hashed USING (w) JOIN gains USING (bucket) GROUP BY r
), scored AS (
  SELECT doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM d LEFT JOIN weights USING (r)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id, n_features) AS place, count(*) OVER (PARTITION BY n_features >= 20) AS n
  FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * n // 100 THEN place END AS rank
FROM ranked
"""

QUERIES = {
    "op1_toxicity": (op1_toxicity, None),
    "op2_simhash": (op2_simhash, None),
    "op3_quality": (op3_quality, None),
    "op4_warc": (op4_warc, WARC_SQL),
    "op5_language": (op5_language, None),
    "op6_neighbours": (op6_neighbours, None),
    "op7_decontamination": (op7_decontamination, None),
    "op8_token_files": (op8_token_files, None),
    "op9_mixing": (op9_mixing, MIXING_SQL),
    "op10_suffix_dedup": (op10_suffix_dedup, None),
    "op11_hard_negatives": (op11_hard_negatives, NEGATIVES_SQL),
    "op12_fingerprints": (op12_fingerprints, None),
    "op13_importance": (op13_importance, IMPORTANCE_SQL),
}
