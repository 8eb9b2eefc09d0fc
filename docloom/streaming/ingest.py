"""Continuous ingest, session memory and usage counters with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom import rules
from docloom.config import Settings
from docloom.operators.chunking import semantic_chunks
from docloom.sources.files import parse_files

_FILES = "path string, modificationTime timestamp, length long, content binary"


def file_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """New files under ``path`` as they appear."""
    return (
        spark.readStream.format("binaryFile")
        .schema(_FILES)
        .option("maxFilesPerTrigger", files_per_batch)
        .option("recursiveFileLookup", "true")
        .load(path)
    )


def ingest_stream(engine, path: str, checkpoint: str, files_per_batch: int = 1000):
    """A query that parses, chunks and appends new files; each file is handled once.

    Chunk ids are derived from the content's place, and ids that are stored are not added
    again, so a batch that is repeated after a failure changes nothing. Files that are too
    large or cannot be parsed are rows of the table ``ingest_errors``. Start it with ``.start()``.
    """
    files = file_stream(engine.spark, path, files_per_batch)
    most = engine.settings.max_upload_bytes

    def append(batch: DataFrame, number: int) -> None:
        small = batch.where(F.col("length") <= most).select("path", "content")
        units = parse_files(small, engine.providers.pdf_reader)
        large = batch.where(F.col("length") > most).select(
            F.col("path").alias("source"), F.lit(rules.SIZE_EXCEEDED.format(most // (1024 * 1024))).alias("error")
        )
        failed = units.where(F.col("error").isNotNull()).select("source", "error").unionByName(large)
        failed = failed.withColumn("batch", F.lit(number).cast("long"))
        if engine.errors.exists():
            failed = failed.join(engine.errors.all().select("source", "batch"), ["source", "batch"], "left_anti")
        engine.errors.append(failed)
        good = units.where(F.col("error").isNull() & (F.trim("text") != ""))
        engine.add_chunks(semantic_chunks(good, max_chars=engine.settings.chunk_chars))

    return files.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)


def usage_stream(log: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Queries, cache hits and mean response time per time window of a log stream."""
    return (
        log.withWatermark("ts", late)
        .groupBy(F.window("ts", window))
        .agg(
            F.count("*").alias("queries"),
            F.sum(F.col("cached").cast("long")).alias("cache_hits"),
            F.round(F.avg(F.when(~F.col("cached"), F.col("seconds"))), 4).alias("average_response_time"),
        )
        .select(F.col("window.start").alias("start"), "queries", "cache_hits", "average_response_time")
    )
