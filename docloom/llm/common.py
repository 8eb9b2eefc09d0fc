"""What several operators of this folder share."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom import session
from docloom.session import removed, work_folder

__all__ = ["file_system", "fold", "runs_by_size", "scratch", "set_aside", "set_back", "stored", "text_runs", "unit_hash", "work_folder"]


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id is in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")), F.lit(0)) % parts


def unit_hash(*cols: Column, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on the values alone, so reruns and lost tasks agree."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11) / F.lit(float(1 << 53))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again: it cuts the lineage,
    and a lost executor costs nothing of it."""
    return session.stored(df, work_folder(df.sparkSession, name))


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """A ``stored`` whose tables are deleted at the end: for steps whose result is stored elsewhere."""
    made: list[str] = []

    def keep(df: DataFrame, name: str) -> DataFrame:
        made.append(work_folder(spark, name))
        return session.stored(df, made[-1])

    try:
        yield keep
    finally:
        for path in made:
            removed(spark, path)


def set_aside(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` with columns of these names renamed, so that an operator's own don't clash with them."""
    return df.withColumnsRenamed({c: f"_aside_{c}" for c in names if c in df.columns})


def set_back(df: DataFrame, columns: list[str]) -> DataFrame:
    """The given columns under their names again."""
    return df.select(*[F.col(f"_aside_{c}" if f"_aside_{c}" in df.columns else c).alias(c) for c in columns])


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The store of a path or URI (local, object store, HDFS) and the path in it."""
    return pafs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path.removeprefix("file:")))


def runs_by_size(sizes, limit: int) -> Iterator[tuple[int, int]]:
    """Cut a sequence into [start, end) runs whose sizes add up to ``limit`` at most;
    an element above it is a run of its own."""
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def text_runs(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of a batch with at most about ``limit`` bytes of text, and their texts (null: empty)."""
    texts = batch.column(column).cast(pa.large_binary())
    sizes = [len(x.as_buffer()) if x.is_valid else 0 for x in texts]
    for start, end in runs_by_size(sizes, limit):
        yield batch.slice(start, end - start), [x or b"" for x in texts.slice(start, end - start).to_pylist()]
