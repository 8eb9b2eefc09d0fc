"""The chunk store: Parquet tables, partitioned by shard where sharding is on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.hashing import chunk_key, shard_of


def _has(df: DataFrame, name: str) -> bool:
    return name in df.columns


def stored_records(chunks: DataFrame, default_format: str = "unknown") -> DataFrame:
    """The stored form of chunks: id, text and five metadata fields with defaults."""

    def field(name: str, default: Column) -> Column:
        return F.coalesce(F.col(name), default) if _has(chunks, name) else default

    index = F.col("chunk_index")
    chunk_id = field("chunk_id", F.concat(F.lit("chunk_"), index.cast("string")))
    source = field("source", F.lit(""))
    return chunks.select(
        chunk_key(source, chunk_id, index).alias("id"),
        F.col("text"),
        source.alias("source"),
        field("page_number", F.lit(0)).cast("int").alias("page_number"),
        chunk_id.alias("chunk_id"),
        field("word_count", F.lit(0)).cast("int").alias("word_count"),
        field("format", F.lit(default_format)).alias("format"),
        *[F.col(c) for c in ("content_type", "method_name", "embedding") if _has(chunks, c)],
    )


def with_shard(df: DataFrame, shards: int, source_col: str = "source") -> DataFrame:
    return df.withColumn("shard_id", shard_of(F.col(source_col), shards))


def sharded_records(chunks: DataFrame, shards: int) -> DataFrame:
    """All chunk columns plus the shard and an id that carries it.

    A sharded id is unique per chunk: the unit's chunk id alone repeats in each of the
    chunks that were cut from the same unit.
    """
    routed = with_shard(chunks, shards)
    return routed.withColumn(
        "id",
        F.concat_ws(
            "_", F.lit("shard"), F.col("shard_id").cast("string"), F.col("chunk_id"), F.col("chunk_index").cast("string")
        ),
    )


def shard_stats(records: DataFrame) -> DataFrame:
    """Chunks per shard and the total (``shard_id`` null), counted in one aggregation."""
    return records.rollup("shard_id").agg(F.count("*").alias("document_count"))


class ChunkStore:
    """A named collection kept as a Parquet table under a shared folder."""

    def __init__(self, spark: SparkSession, root: str, name: str, shards: int = 0):
        self.spark, self.name, self.shards = spark, name, shards
        self.path = f"{root.rstrip('/')}/{name}"

    def _filesystem(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self) -> bool:
        path, fs = self._filesystem()
        return fs.exists(path)

    def append(self, records: DataFrame) -> None:
        """Append; with shards every task writes straight into the shard folders.

        There is no shuffle by shard, so one source with a large share of all chunks does
        not end in one task.
        """
        writer = records.write.mode("append")
        if self.shards:
            writer = writer.partitionBy("shard_id")
        writer.parquet(self.path)

    def without_stored(self, records: DataFrame) -> DataFrame:
        """Records whose id is not in the table; only rows of the same sources are compared."""
        stored = self.all().select("id", "source").join(records.select("source").distinct(), "source", "left_semi")
        return records.join(stored.select("id"), "id", "left_anti")

    def all(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def for_source(self, source: str) -> DataFrame:
        """Chunks of one source; the shard filter prunes all other folders."""
        rows = self.all().where(F.col("source") == source)
        if self.shards:
            shard = shard_of(F.lit(source), self.shards)
            rows = rows.where(F.col("shard_id") == shard)
        return rows

    def stats(self) -> DataFrame:
        return shard_stats(self.all())

    def drop(self) -> None:
        path, fs = self._filesystem()
        fs.delete(path, True)


class VersionedStore(ChunkStore):
    """A table that can be replaced as a whole without readers seeing half of it.

    Rows are in ``data-N`` below the table's folder; the highest number below ``pointers`` says which
    N holds. ``replace`` writes the next N first and its pointer last, so a driver that is lost in
    between leaves the table as it was, and what it had written is taken over by nobody.
    """

    def __init__(self, spark: SparkSession, root: str, name: str):
        super().__init__(spark, root, name)
        self.root = self.path

    def _at(self, path: str):
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return place, place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        place, fs = self._at(f"{self.root}/pointers")
        return max((int(f.getPath().getName()) for f in fs.listStatus(place)), default=0) if fs.exists(place) else 0

    @property
    def path(self) -> str:
        return f"{self.root}/data-{self.version()}" if hasattr(self, "root") else self._first

    @path.setter
    def path(self, value: str) -> None:
        self._first = value

    def _switch(self, number: int) -> None:
        place, fs = self._at(f"{self.root}/pointers/{number}")
        fs.create(place, True).close()

    def replace(self, records: DataFrame) -> None:
        """Make ``records``, which may be made of the table's own rows, its only content."""
        old = self.version()
        place, fs = self._at(f"{self.root}/data-{old + 1}")
        fs.delete(place, True)  # of a try that failed
        records.write.parquet(f"{self.root}/data-{old + 1}")
        self._switch(old + 1)
        # Readers that began before the switch may still read the version before; older ones go.
        place, fs = self._at(f"{self.root}/data-{old - 1}")
        fs.delete(place, True)

    def drop(self) -> None:
        place, fs = self._at(self.root)
        fs.delete(place, True)
