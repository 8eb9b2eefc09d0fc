"""The pipeline, stage by stage against brute force."""

import collections

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from docloom.llm import mixing, quality
from tests.conftest import SF
from tests.llm import brute

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_stages(spark):
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{SF}/documents.parquet")

    kept = stages["quality"](spark, docs, SF)
    model = quality.fit(quality.labelled_sample(docs, spark.read.parquet(f"{SF}/labels.parquet"), "quality"))
    scores = model.score(quality.described([(t or "").encode() for _, t in pairs(docs)]))
    assert kept.columns == COLUMNS
    assert sorted(pairs(kept)) == sorted(p for p, s in zip(pairs(docs), scores) if s >= corpus_pipeline.QUALITY)

    unique = stages["near_duplicates"](spark, kept, SF)
    assert unique.columns == COLUMNS and sorted(i for i, _ in pairs(unique)) == sorted(brute.similar_first(pairs(kept)))

    clean = stages["decontamination"](spark, unique, SF)
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    want = sorted(i for i, _, hit, _ in brute.contamination(pairs(unique), items) if not hit)
    assert clean.columns == COLUMNS and sorted(i for i, _ in pairs(clean)) == want

    mixed = stages["mixing"](spark, clean, SF)
    taken = {r.doc_id: r.copies for r in mixing.mix(clean).collect()}
    assert mixed.columns == COLUMNS
    assert collections.Counter(i for i, _ in pairs(mixed)) == collections.Counter({i: n for i, n in taken.items() if n})

    tokens = stages["tokens"](spark, mixed, SF)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert sorted(map(tuple, tokens.collect())) == sorted(brute.token_rows(pairs(mixed), tokenizer))


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "mixing", "tokens"]


def test_stages_with_edges_and_empty_tables(spark, edges, no_documents):
    for docs in (edges, no_documents):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns or name == "tokens"
            assert out.count() <= 2 * docs.count()
