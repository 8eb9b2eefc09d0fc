"""Running totals over a whole table without a task that sees all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import stored


def running_total(df: DataFrame, order: list[Column], value: Column, name: str) -> DataFrame:
    """``df`` with column ``name``: the sum of ``value`` over all rows before, in ``order``.

    Rows are range partitioned and stored with the number of their partition; the partitions'
    sums (one row each) give every partition its base, and a window runs inside each partition.
    """
    parted = stored(
        df.withColumn("_value", value).repartitionByRange(*order).withColumn("_part", F.spark_partition_id()),
        "ranges",
    )
    sums = parted.groupBy("_part").agg(F.sum("_value").alias("_sum"))
    bases = sums.select(
        F.col("_part").alias("_base_part"),
        F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"),
    )
    inside = F.sum("_value").over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return (
        parted.withColumn("_inside", F.coalesce(inside, F.lit(0)))
        .join(bases, F.col("_part") == F.col("_base_part"))
        .withColumn(name, (F.col("_base") + F.col("_inside")).cast("long"))
        .drop("_value", "_part", "_base_part", "_base", "_inside")
    )


def with_following(documents: DataFrame, name: str, descending: bool = True, block: int = 256) -> DataFrame:
    """(doc_id, text) of every row and column ``name``: the text of the row behind it in the order of
    ids; behind the last row comes the first.

    Only ids and hashes of texts are sorted over the whole table; every different row gets a number.
    Texts then meet in blocks of ``block`` neighbouring numbers. The first row of a block goes to the
    block before it as well, so a block holds all that its rows need.

    Null ids come last; equal ids are in order of a hash of their texts. Rows that repeat id and text
    follow each other. A table of one row follows itself.
    """
    keyed = documents.select("doc_id", "text", F.xxhash64("text").alias("_hash"))
    order = [F.col("doc_id").desc_nulls_last() if descending else F.col("doc_id").asc_nulls_last(), F.col("_hash").asc()]
    numbered = running_total(keyed.select("doc_id", "_hash").distinct(), order, F.lit(1), "_number")
    numbered = stored(numbered.withColumnsRenamed({"doc_id": "_id", "_hash": "_same"}), "numbers")
    last = numbered.agg(F.max("_number")).first()[0] or 0

    def place(at: Column, where: Column, extra: bool) -> Column:
        return F.struct(at.alias("_block"), where.alias("_at"), F.lit(extra).alias("_extra"))

    number = F.col("_number")
    before = F.when(number == 0, F.lit(last)).otherwise(number - 1)
    own = place(F.floor(number / block), number, False)
    also = place(F.floor(before / block), before + 1, True)
    dealt = (
        keyed.join(numbered, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_same")))
        .select("doc_id", "text", F.explode(F.when(number % block == 0, F.array(own, also)).otherwise(F.array(own))).alias("_place"))
        .select("doc_id", "text", "_place.*")
    )
    # The first row of the block behind has the largest place in this one.
    window = Window.partitionBy("_block").orderBy(F.col("_at"), F.col("_extra"))
    return dealt.withColumn(name, F.lead("text").over(window)).filter(~F.col("_extra")).select("doc_id", "text", name)
