"""A training corpus from raw documents: five stages, each on all that the one before kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame,
which is written as Parquet and read again as the next one's docs. All but the last return the
columns of documents.

1. ``quality``: documents whose quality score is under ``QUALITY`` go; learned from ``labels``.
2. ``near_duplicates``: of texts with equal or similar shingles (five words, Jaccard similarity of
   0.8 or more) the document with the smallest id stays.
3. ``decontamination``: documents with a verbatim match with ``benchmark`` go.
4. ``mixing``: documents are repeated or left out by their source's weight.
5. ``tokens``: token ids are written as flat files; the index that is read back is returned.

Nulls, empty texts, repeated rows and empty tables are treated as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import decontam, mixing, quality, simhash, token_files
from docloom.llm.common import work_folder

QUALITY = 0.3


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(quality.labelled_sample(docs, labels, "quality"))
    return quality.with_score(docs, model, "_quality").filter(F.col("_quality") >= QUALITY).drop("_quality")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.without_similar(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.without_matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_rows(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_files.token_index(docs)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("tokens", write_tokens),
]

# A learned model, near copies and token ids are beyond SQL; tests compare the stages with
# brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = work_folder(spark, "pipeline")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
    return docs
