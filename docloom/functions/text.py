"""Text expressions shared by the operators; all of them run inside the JVM."""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Inside of a character class: word characters and white space as Python's str sees them.
WORD = r"\p{L}\p{N}_"
SPACE = r"\p{Z}\t-\r\x{1c}-\x{1f}\x{85}"
SPACE_CHARS = "".join(
    map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)
# A noncharacter that marks cut positions; it never occurs in interchanged text.
MARK = "\ufdd0"


def java(pattern: str) -> str:
    """Give ``\\w \\s \\d \\b`` their Unicode meaning in a Java pattern."""
    edge = f"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))"
    return "(?d)" + _expand(pattern, edge)


def _expand(pattern: str, edge: str) -> str:
    inner = {"w": WORD, "s": SPACE, "d": r"\p{Nd}"}
    out, in_class, i = [], False, 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two[0] == "\\" and len(two) == 2:
            if two[1] in inner:
                out.append(inner[two[1]] if in_class else f"[{inner[two[1]]}]")
            elif two[1] == "b" and not in_class:
                out.append(edge)
            else:
                out.append(two)
            i += 2
            continue
        if two[0] == "[" and not in_class:
            in_class = True
        elif two[0] == "]" and in_class:
            in_class = False
        out.append(two[0])
        i += 1
    return "".join(out)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` to a name so that it is computed once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE_CHARS))


# Capitals whose lower case is not one letter, or depends on the letters around it.
_ODD_CAPITALS = ("\u0130", "\u03a3")


def lower_values(values: pa.Array) -> pa.Array:
    """``lower`` of Arrow strings. Arrow maps letter by letter, so values with odd capitals are left to Python."""
    low, data = pc.utf8_lower(values), values.buffers()[2]
    held = data.to_pybytes() if data else b""
    if not any(c.encode() in held for c in _ODD_CAPITALS):
        return low
    odd = pc.fill_null(pc.match_substring_regex(values, f"[{''.join(_ODD_CAPITALS)}]"), False)
    return pc.replace_with_mask(low, odd, pa.array([x.lower() for x in values.filter(odd).to_pylist()], values.type))


def words(text: Column) -> Column:
    """White-space separated words, without empty ones."""
    return F.regexp_extract_all(text, F.lit(f"[^{SPACE}]+"), F.lit(0))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"[^{SPACE}]+")).cast("int")


def word_runs(text: Column, min_len: int = 1) -> Column:
    """Runs of word characters."""
    return F.regexp_extract_all(text, F.lit(f"[{WORD}]{{{min_len},}}"), F.lit(0))


def alnum_runs(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def sentences(text: Column) -> Column:
    """Sentences: cut at white space that follows ``.``, ``!`` or ``?``."""
    parts = F.split(strip(text), rf"(?<=[.!?])[{SPACE}]+")
    return F.filter(parts, lambda s: s != "")


def any_match(text: Column, patterns: list[str], ignore_case: bool = True) -> Column:
    flag = "(?i)" if ignore_case else ""
    hit = F.lit(False)
    for pattern in patterns:
        hit = hit | text.rlike(flag + java(pattern))
    return hit


def contains_any(text: Column, needles: list[str]) -> Column:
    """True if one of the literal needles occurs; one pass over the text."""
    if not needles:
        return F.lit(False)
    return text.rlike("|".join(r"\Q" + n + r"\E" for n in needles))


def literals(values: list[str]) -> Column:
    """A constant ``array<string>``."""
    return table(values, "array<string>")


def table(rows: list, schema: str) -> Column:
    """Rule rows as one constant array; folded once when the plan is made."""
    return F.from_json(F.lit(json.dumps(rows)), schema)


def jaccard(left: Column, right: Column) -> Column:
    """Shared distinct elements over all distinct elements; 0 if a side is empty."""
    both = F.size(F.array_intersect(left, right))
    either = F.size(F.array_union(left, right))
    empty = (F.size(left) == 0) | (F.size(right) == 0)
    return F.when(empty, F.lit(0.0)).otherwise(both / either)


def relevance(text: Column, query: Column) -> Column:
    """Word overlap plus 0.2 where the whole query occurs in the text, at most 1."""
    return relevance_to(text, asked(query))


def asked(query: Column) -> Column:
    """The lower-case query and its words; bind it where many texts meet one query in a lambda."""
    low = F.lower(query)
    return F.struct(low.alias("text"), word_runs(low).alias("words"))


def relevance_to(text: Column, query: Column) -> Column:
    """``relevance`` to what ``asked`` gives."""
    low, right = F.lower(text), query["words"]
    left = word_runs(low)
    bonus = F.when(low.contains(query["text"]), F.lit(0.2)).otherwise(F.lit(0.0))
    empty = (F.size(left) == 0) | (F.size(right) == 0)
    score = F.least(jaccard(left, right) + bonus, F.lit(1.0))
    return F.when(empty, F.lit(0.0)).otherwise(score)


def counts(items: Column) -> Column:
    """``array<struct<term, tf>>`` of an array's elements, without a shuffle.

    Sorting brings equal elements together; the length of each stretch is its count.
    """

    def stretches(ordered: Column) -> Column:
        starts = F.filter(
            F.transform(ordered, lambda _, i: i),
            lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1)),
        )
        return let(
            starts,
            lambda s: F.transform(
                s,
                lambda p, j: F.struct(
                    F.get(ordered, p).alias("term"),
                    (F.coalesce(F.get(s, j + 1), F.size(ordered)) - p).alias("tf"),
                ),
            ),
        )

    return let(F.sort_array(items), stretches)


def matches(text: Column, pattern: str | Column) -> Column:
    """All matches of a Java pattern as ``array<struct<text, start, end>>``.

    Positions are code points from 0. They follow from the lengths of the pieces
    between the matches, so no text is scanned twice for each match.
    """
    regex = F.lit(pattern) if isinstance(pattern, str) else pattern
    return let(
        F.regexp_extract_all(text, regex, F.lit(0)), lambda found: placed(F.split(text, regex, -1), found)
    )


def placed(gaps: Column, found: Column) -> Column:
    """Matches with positions, from the pieces between them."""
    steps = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.length(g) + F.length(m))
    return F.zip_with(
        found,
        running_sums(steps),
        lambda m, end: F.struct(m.alias("text"), (end - F.length(m)).alias("start"), end.alias("end")),
    )


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _sums_in_rows(values: pa.Array) -> pa.Array:
    lengths = pc.fill_null(pc.list_value_length(values), 0).to_numpy(zero_copy_only=False)
    sums = np.cumsum(values.flatten().to_numpy(zero_copy_only=False), dtype=np.int64)
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    bases = np.concatenate([[0], sums])[offsets[:-1]]
    each = (sums - np.repeat(bases, lengths)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(each), mask=values.is_null())


def word_places(text: Column) -> Column:
    """Runs of word characters as ``matches`` gives them.

    Positions are summed in Arrow batches, which is quicker than ``running_sums`` for the many words
    of a text but cannot stand inside of a lambda.
    """
    found, gaps = word_runs(text), F.split(text, f"[{WORD}]+", -1)
    steps = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.length(g) + F.length(m))
    return F.zip_with(
        found, _sums_in_rows(steps), lambda m, end: F.struct(m.alias("text"), (end - F.length(m)).alias("start"), end.alias("end"))
    )


_BLOCK = 64


def running_sums(values: Column) -> Column:
    """Sums of an int array up to each element.

    A fold copies its result at every step, so it is run over blocks and over the block
    totals: long arrays cost little more per element than short ones.
    """
    none = F.array().cast("array<int>")

    def fold(items: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), none.alias("out"))
        return F.aggregate(
            items,
            zero,
            lambda acc, x: F.struct(
                (acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"] + x)).alias("out")
            ),
            lambda acc: acc["out"],
        )

    def blocks(items: Column) -> Column:
        starts = F.filter(F.transform(items, lambda _, i: i), lambda i: i % _BLOCK == 0)
        return F.transform(starts, lambda i: fold(F.slice(items, i + 1, _BLOCK)))

    def shift(parts: Column) -> Column:
        ends = fold(F.transform(parts, lambda p: F.element_at(p, -1)))
        return let(
            ends,
            lambda e: F.flatten(
                F.transform(
                    parts,
                    lambda p, i: let(
                        F.coalesce(F.get(e, i - 1), F.lit(0)), lambda base: F.transform(p, lambda x: x + base)
                    ),
                )
            ),
        )

    return let(let(values, blocks), shift)


_PIECE = 512


def pieces(text: Column) -> Column:
    """The text in pieces of ``_PIECE`` characters, for ``cut``: bind it."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(_PIECE))
    return F.transform(starts, lambda i: F.substring(text, i + 1, F.lit(_PIECE)))


def cut(parts: Column, start: Column, end: Column) -> Column:
    """Characters ``start`` to ``end`` of a text in ``pieces``, without reading it from its first one."""
    first = F.floor(start / _PIECE).cast("int")
    some = F.slice(parts, first + 1, F.floor(end / _PIECE).cast("int") - first + 1)
    return F.substring(F.array_join(some, ""), start - first * _PIECE + 1, end - start)


def around_in(parts: Column, start: Column, end: Column, margin: int) -> Column:
    """``around`` on ``pieces``."""
    return cut(parts, F.greatest(start - margin, F.lit(0)), end + margin)


def around(text: Column, start: Column, end: Column, margin: int) -> Column:
    """The span with ``margin`` characters on both sides."""
    left = F.greatest(start - margin, F.lit(0))
    return F.substring(text, left + 1, end + margin - left)
