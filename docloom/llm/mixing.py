"""Mixing sources to target weights.

Sizes are summed per source, a target is set for every source, and each document is taken
``floor(rate)`` times plus one more time with probability ``rate - floor(rate)``, where rate is
the source's target over its size. The draw is a hash of the document's id and a seed, so reruns
and repeated tasks take the same copies, and no document is taken more than ``max_epochs`` times.

Targets share ``share`` of all sizes by weight. A target stops at ``max_epochs`` times the size of
its source; what it leaves is shared by weight among the others until none is above. This level is
found by rounds of one sum over the table of sources: each round fixes the sources whose limit is
below the level of the others. Whole numbers decide, so the outcome doesn't depend on the order of
the sums.

Edge cases: a null text has size 0; a null source is a source of its own, the last in order; a
source of size 0 has target 0 and its documents are not taken; a null id draws like the text
``null``; repeated rows draw alike; an empty table gives an empty result. Other columns stay as
they are, and names that clash with the added ones are replaced.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import set_aside, set_back, stored
from docloom.llm.ranges import running_total

WEIGHTS = (3, 1, 2)
SHARE = Fraction(3, 2)
MAX_EPOCHS = 2
ADDED = ["size", "source_size", "target", "copies"]


def word_count(text: Column) -> Column:
    """Runs of characters that are neither space nor one of the controls 9 to 13."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def draw(doc_id: Column, seed: int) -> Column:
    """52 bits of a digest of seed and id, as a number in [0, 1)."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def source_targets(
    sizes: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: Fraction = SHARE,
    max_epochs: int = MAX_EPOCHS,
) -> DataFrame:
    """(source, source_size, weight, target) of a table (source, source_size).

    The cyclic weights follow the sources in code point order, null last.
    """
    ranked = running_total(sizes, [F.col("source").asc_nulls_last()], F.lit(1).cast("long"), "position")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("position") % len(weights) + 1).cast("int"))
    table = stored(ranked.select("source", "source_size", weight.cast("long").alias("weight")), "mix-sources")

    wide = "decimal(38,0)"
    limit = (F.col("source_size") * max_epochs).cast(wide)
    total = table.agg(F.sum("source_size")).first()[0] or 0
    whole = Fraction(total) * share
    rest, open_weight, fixed = whole, table.agg(F.sum("weight")).first()[0] or 0, -1

    def above(rest: Fraction, open_weight: int) -> Column:
        # limit < rest / open_weight * weight, in whole numbers
        left = limit * F.lit(rest.denominator * open_weight).cast(wide)
        return left < F.col("weight").cast(wide) * F.lit(rest.numerator).cast(wide)

    while open_weight:
        full = above(rest, open_weight)
        now, taken, weight_left = table.agg(
            F.count(F.when(full, 1)), F.sum(F.when(full, limit)), F.sum(F.when(~full, F.col("weight")))
        ).first()
        if now == fixed:
            break
        fixed, rest, open_weight = now, whole - int(taken or 0), weight_left or 0
    if not open_weight:
        target = limit.cast("double")
    else:
        level = F.col("weight") * F.lit(float(rest.numerator)) / F.lit(float(rest.denominator * open_weight))
        target = F.when(above(rest, open_weight), limit.cast("double")).otherwise(level)
    return table.withColumn("target", target)


def mix(
    documents: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: Fraction = SHARE,
    max_epochs: int = MAX_EPOCHS,
    seed: int = 42,
) -> DataFrame:
    """``documents`` with size, source_size, target and copies (how often the mix takes the row).

    The table of sources is joined on the source; sums are made per task before they move.
    """
    sized = documents.drop(*ADDED).withColumn("size", word_count(F.col("text")))
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights, share, max_epochs).select(
        F.col("source").alias("_source"), "source_size", "target"
    )
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    floor = F.floor(rate)
    copies = floor + F.when(draw(F.col("doc_id"), seed) < rate - floor, 1).otherwise(0)
    return (
        sized.join(targets, F.col("source").eqNullSafe(F.col("_source")), "left")
        .withColumn("copies", copies.cast("long"))
        .drop("_source")
    )


def mixed_rows(documents: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as often as it is taken, with its own columns."""
    taken = mix(set_aside(documents, ADDED), **options).filter("copies > 0")
    repeated = taken.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))))
    return set_back(repeated, documents.columns)
