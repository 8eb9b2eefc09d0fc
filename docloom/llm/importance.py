"""Importance resampling towards a target distribution, ranked by a distributed radix sort.

Features are all runs of 1 to ``n`` words of a text, hashed into ``BUCKETS`` buckets. The counts of
both tables give every bucket a gain, the logarithm of its smoothed share in the target over that in
the documents, and a document's weight is the mean gain of its features. Gumbel noise from a hash of
the id makes the highest scores a draw without replacement, with chances by weight.

Gains are one array of ``BUCKETS`` whole numbers, so a text is scored by looking up its features.
Documents of at least ``least`` words are then ranked by a radix sort from the least significant
digit on. The key is (score down, id up, number of features up), cut into digits of 16 bits; digits
that are alike in all rows are left out. A pass is a stable counting sort:

1. digits are counted per block of rows;
2. prefix sums over (digit, block) give each block the place of its first row of each digit;
3. every block sorts its rows by digit with the order kept, and so knows their places.

A place says which block a row is in next, so blocks are of equal size after each pass, whatever the
scores are, and the last pass gives the final ranks. No task sees more than a block, and what is
summed in one task is one row per digit. Passes are stored, so a lost executor repeats no pass.

Edge cases: null and empty texts have no features and weight 0; a null id draws like the text
``null`` and is the last among equal scores; rows that repeat score, id and number of features are
alike and take neighbouring ranks; empty tables give empty results (an empty target: all gains
follow from its zero counts). Other columns are left out by ``ranked`` and kept by ``resampled``,
whose own column names cannot clash with them.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import stored, text_runs
from docloom.llm.decontam import words_of

BUCKETS = 10_000
WORDS = 1
LEAST = 20
PERCENT = 10
SEED = "2024"
RUN_BYTES = 1 << 24
REMEMBERED = 1 << 19
DIGIT = 16
BLOCK = 1 << 18
SMALL_BLOCK = 1 << 10

SCORED = "row long, doc_id long, text_hash long, n_features long, weight long, score long"


class Features:
    """Buckets of the features of texts; remembers those of words met before."""

    def __init__(self, longest: int, buckets: int):
        self.longest, self.buckets = longest, buckets
        self.known: dict[bytes, int] = {}

    def of(self, text: bytes) -> tuple[int, np.ndarray]:
        """Number of words, and the buckets of all features."""
        words = words_of(text)
        if len(self.known) > REMEMBERED:
            self.known = {}
        known, buckets = self.known, self.buckets
        for w in set(words).difference(known):
            known[w] = zlib.crc32(w) % buckets
        found = [np.fromiter(map(known.__getitem__, words), np.int64, len(words))]
        for n in range(2, self.longest + 1):
            runs = zip(*(words[i:] for i in range(n)))
            found.append(np.array([zlib.crc32(b" ".join(r)) % buckets for r in runs], np.int64))
        return len(words), np.concatenate(found)


def bucket_counts(texts: DataFrame, longest: int = WORDS, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in all texts: a task returns one row per bucket it has met."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, total = Features(longest, buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for _, some in text_runs(batch, "text", RUN_BYTES):
                for text in some:
                    total += np.bincount(features.of(text)[1], minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], names=["bucket", "n"])

    summed = texts.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for row in summed.collect():  # at most ``buckets`` rows
        out[row["bucket"]] = row["n"]
    return out


def gains(documents: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A thousand times the logarithm of the ratio of smoothed shares, rounded down."""
    whole, wanted, buckets = int(documents.sum()), int(target.sum()), len(documents)
    pairs = zip(documents.tolist(), target.tolist())
    return np.array([math.floor(1000 * math.log((t + 1) * (whole + buckets) / ((s + 1) * (wanted + buckets)))) for s, t in pairs], np.int64)


def noise(doc_id: object, seed: str) -> int:
    h = int(hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(documents: DataFrame, gain: np.ndarray, longest: int = WORDS, seed: str = SEED) -> DataFrame:
    """(row, doc_id, text_hash, n_words, n_features, weight, score) of every row; ``row`` is a number of its own."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(longest, len(gain))
        for batch in batches:
            for part, some in text_runs(batch, "text", RUN_BYTES):
                words, found = zip(*map(features.of, some))
                n = np.array([len(f) for f in found], np.int64)
                weight = [int(gain[f].sum()) // len(f) if len(f) else 0 for f in found]
                drawn = [w + noise(i, seed) for w, i in zip(weight, part.column("doc_id").to_pylist())]
                columns = [part.column("doc_id"), part.column("text_hash"), *(pa.array(x, pa.int64()) for x in (words, n, weight, drawn))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "n_words", "n_features", "weight", "score"])

    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    schema = "doc_id long, text_hash long, n_words long, n_features long, weight long, score long"
    return stored(texts.mapInArrow(score, schema).withColumn("row", F.monotonically_increasing_id()), "scored")


def _bits(low: int, high: int) -> int:
    """Bits from the lowest one up to the highest in which numbers between the two can differ."""
    return (low ^ high).bit_length()


def _digits(table: DataFrame) -> list[Column]:
    """Digits of the composite key, the least significant first."""
    sign = -(1 << 63)
    flipped = F.coalesce(F.col("doc_id").bitwiseXOR(F.lit(sign)), F.lit(0))
    low, high, nulls, most, least_score, most_score = table.agg(
        F.min("doc_id"), F.max("doc_id"), F.count(F.when(F.col("doc_id").isNull(), 1)), F.max("n_features"), F.min("score"), F.max("score")
    ).first()
    out: list[Column] = []

    def cut(key: Column, bits: int) -> None:
        out.extend(F.shiftrightunsigned(key, at).bitwiseAND(F.lit((1 << DIGIT) - 1)) for at in range(0, bits, DIGIT))

    cut(F.col("n_features"), _bits(0, most or 0))
    if low is not None:
        cut(flipped, _bits(low + (1 << 63), high + (1 << 63)))
    if nulls:
        out.append(F.col("doc_id").isNull().cast("long"))
    if most_score is not None:
        cut(F.lit(most_score) - F.col("score"), _bits(0, most_score - least_score))
    return out


def _scatter(block: int):
    def place(rows: pa.Table, first: pa.Table) -> pa.Table:
        """Places of one block's rows after the pass, from the places of its first row of each digit."""
        rows = rows.sort_by("place")
        digit = rows.column("digit").to_numpy()
        order = np.argsort(digit, kind="stable")
        digits, begin, count = np.unique(digit[order], return_index=True, return_counts=True)
        base = dict(zip(first.column("digit").to_pylist(), first.column("base").to_pylist()))
        shift = np.array([base[d] for d in digits.tolist()], np.int64) - begin
        places = np.arange(len(order)) + np.repeat(shift, count)
        moved = rows.take(pa.array(order)).drop_columns(["place", "block", "digit"])
        return moved.append_column("place", pa.array(places)).append_column("block", pa.array(places // block))

    return place


def radix_ranked(table: DataFrame, digits: list[Column], block: int | None = None) -> DataFrame:
    """``table`` with ``place``: its position (from 0) in the order of the digits' composite key.

    ``table`` is a stored one with a different number ``row`` in each row.
    """
    columns = table.columns
    if block is None:
        parts = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        block = min(BLOCK, max(SMALL_BLOCK, -(-table.count() // parts)))
    # Numbers of one stored file's rows are neighbours, so so many of them are a first block.
    now = table.withColumn("place", F.col("row")).withColumn("block", F.expr(f"row div {block}"))
    if not digits:
        digits = [F.lit(0).cast("long")]
    for digit in digits:
        now = now.withColumn("digit", digit)
        counts = now.groupBy("block", "digit").agg(F.count(F.lit(1)).alias("n"))
        counts = stored(counts, "digit-counts")
        # One row per digit value is summed in one task, blocks are summed digit by digit.
        totals = counts.groupBy("digit").agg(F.sum("n").alias("total"))
        before = Window.orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)
        starts = totals.select(F.col("digit").alias("_digit"), F.coalesce(F.sum("total").over(before), F.lit(0)).alias("start"))
        inside = Window.partitionBy("digit").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        first = (
            counts.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
            .join(starts, F.col("digit") == F.col("_digit"))
            .select("block", "digit", (F.col("start") + F.col("inside")).alias("base"))
        )
        schema = ", ".join(f"{c} {t}" for c, t in [*table.select(*columns).dtypes, ("place", "bigint"), ("block", "bigint")])
        now = stored(now.groupBy("block").cogroup(first.groupBy("block")).applyInArrow(_scatter(block), schema), "radix-pass")
    return now.select(*columns, "place")


def ranked(
    documents: DataFrame,
    target: DataFrame,
    longest: int = WORDS,
    buckets: int = BUCKETS,
    least: int = LEAST,
    percent: int = PERCENT,
    seed: str = SEED,
    block: int | None = None,
) -> DataFrame:
    """(doc_id, text_hash, n_features, weight, score, rank) of every row of ``documents``.

    ``rank`` counts from 1 among the ``percent`` of the rows of at least ``least`` words that are
    drawn, and is null elsewhere.
    """
    gain = gains(bucket_counts(documents, longest, buckets), bucket_counts(target, longest, buckets))
    table = scored(documents, gain, longest, seed)
    out = ["doc_id", "text_hash", "n_features", "weight", "score"]
    able = table.filter(F.col("n_words") >= least).select("row", *out)
    drawn = able.count() * percent // 100
    placed = radix_ranked(able, _digits(able), block)
    rank = F.when(F.col("place") < drawn, F.col("place") + 1)
    rest = table.filter(F.col("n_words") < least).select(*out, F.lit(None).cast("long").alias("rank"))
    return placed.select(*out, rank.alias("rank")).unionByName(rest)


def resampled(documents: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn rows of ``documents`` with all their columns."""
    drawn = ranked(documents, target, **options).filter(F.col("rank").isNotNull())
    wanted = drawn.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("_n"))
    wanted = wanted.withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"})
    text_hash = F.xxhash64("text")
    rows = documents.join(wanted, F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (text_hash == F.col("_hash")))
    number = F.row_number().over(Window.partitionBy("_id", "_hash").orderBy(F.lit(1)))
    return rows.withColumn("_number", number).filter(F.col("_number") <= F.col("_n")).drop("_id", "_hash", "_n", "_number")
