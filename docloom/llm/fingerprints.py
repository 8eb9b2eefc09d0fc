"""Bottom-k sketches of word shingles, in DataFrame functions only.

A text's sketch is the sorted array of the ``k`` smallest different hashes of its shingles of
``words`` words (63 bits, so that they sort as they are). Sketches of parts merge to the sketch of
the whole: the k smallest of both. From two sketches follow

* resemblance: of the k smallest hashes of the union, the share that both have, an unbiased
  estimate of the Jaccard similarity of the shingles with a deviation of about 0.5 / sqrt(k);
* the number of different shingles: exact below k, else (k - 1) over the k-th hash as a fraction;
* containment of one in the other: the shingles in common over those of the first.

A text of fewer words than a shingle is one shingle, one without words has an empty sketch.

Edge cases: null counts as an empty text; two empty sketches are alike (1.0), an empty and a filled
one are not (0.0); repeated rows have equal sketches; very long texts are sketched whole; an empty
table gives an empty one. Columns that clash with the added one are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import let

WORDS = 5
K = 128
BLANKS = r"[\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    """Hashes of all shingles, repeats included. Words are hashed once, a shingle is a run of their hashes."""

    def runs(own: Column) -> Column:
        count = F.size(own) - words + 1
        starts = F.when(count > 0, F.sequence(F.lit(1), F.greatest(count, F.lit(1)))).when(F.size(own) > 0, F.array(F.lit(1)))
        return F.transform(
            F.coalesce(starts, F.array().cast("array<int>")), lambda i: F.shiftrightunsigned(F.xxhash64(F.slice(own, i, words)), 1)
        )

    return let(F.transform(words_of(text), lambda w: F.xxhash64(w)), runs)


def least(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def sketch(text: Column, words: int = WORDS, k: int = K) -> Column:
    return least(shingle_hashes(text, words), k)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of what two sketches cover together."""
    return least(F.concat(a, b), k)


def shared(a: Column, b: Column, k: int = K) -> Column:
    """How many of the union's k smallest hashes are in both."""
    return F.size(F.array_intersect(merged(a, b, k), F.array_intersect(a, b)))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    whole = F.size(merged(a, b, k))
    return F.when(whole == 0, 1.0).otherwise(shared(a, b, k) / F.greatest(whole, F.lit(1)))


def different_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of different shingles."""
    share = (F.element_at(a, -1) + F.lit(1.0)) / F.lit(float(1 << 63))
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the shingles of ``a`` that ``b`` has too (an empty ``a``: 1)."""
    common = resemblance(a, b, k) * different_shingles(merged(a, b, k), k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), common / different_shingles(a, k)))


def as_text(a: Column) -> Column:
    """The hashes in ascending order as 16 hexadecimal digits each."""
    return F.lower(F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")), ""))


def with_sketches(documents: DataFrame, words: int = WORDS, k: int = K, name: str = "sketch") -> DataFrame:
    return documents.withColumn(name, sketch(F.col("text"), words, k))


def group_sketches(sketched: DataFrame, groups: list[str], k: int = K, name: str = "sketch") -> DataFrame:
    """One sketch per group of rows of ``with_sketches``.

    Hashes are made different per group, map-side first, and each task keeps its k smallest of a
    group before they meet, so a group of any size moves k rows per task.
    """
    hashes = sketched.select(*groups, F.explode(name).alias("_hash")).distinct()
    number = F.row_number().over(Window.partitionBy(*groups).orderBy("_hash"))
    kept = hashes.withColumn("_number", number).filter(F.col("_number") <= k).drop("_number")
    made = kept.groupBy(*groups).agg(F.sort_array(F.collect_list("_hash")).alias(f"_{name}"))
    named = made.select(*[F.col(g).alias(f"_group_{g}") for g in groups], f"_{name}")
    same = [F.col(g).eqNullSafe(F.col(f"_group_{g}")) for g in groups]
    empty = F.array().cast("array<bigint>")
    # Groups of empty sketches only are kept.
    found = sketched.select(*groups).distinct().join(named, same, "left")
    return found.select(*groups, F.coalesce(F.col(f"_{name}"), empty).alias(name))
