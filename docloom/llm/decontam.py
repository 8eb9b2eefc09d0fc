"""Benchmark decontamination with suffix arrays over the training documents.

Each task cuts its documents into shards of a few megabytes and builds a suffix array over the
words of a shard: the positions from which a match can start, sorted by the ``WINDOW`` words that
follow. Every suffix of every benchmark item is binary-searched in the shard's array, which finds
all places where its first ``WINDOW`` words occur verbatim; neighbouring places on one line through
document and item are joined to longest matches. An item of fewer words is one window.

Words are maximal runs of digits, letters a to z (A to Z are lowered) and characters beyond ASCII.
Positions whose first two words begin no window can hold no match; leaving them out of the array
changes nothing and keeps it small. Matches never cross documents.

The benchmark goes to the tasks in blocks of at most ``BLOCK_BYTES``: its size is measured first;
a larger benchmark takes one pass over the documents for each block, and the passes are merged per
document.

Edge cases: null or empty texts have no words and no hits; items without words match nothing;
items with a null id hit documents, but are in no list of ids; repeated items count once in the
list; repeated documents get equal results; with an empty benchmark nothing is hit. Columns that
clash with the added ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docloom.llm.common import set_aside, set_back, text_runs

WINDOW = 10
BLOCK_BYTES = 32 << 20
RUN_BYTES = 2 << 20

# Every ASCII byte that is neither digit nor letter becomes a blank, A to Z become a to z.
_WORD_BYTES = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)).translate(
    bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
)

ADDED = "n_words long, n_hit long, item_ids array<string>, longest long, spans array<struct<start:long,n_words:long>>"
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("n_words", pa.int64())]))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORD_BYTES).split()


class Suffixes:
    """The suffixes of one block of benchmark items, ready to be searched."""

    def __init__(self, items: list[tuple[object, str | None]], window: int):
        self.window, self.vocabulary = window, {}
        by_content: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        self.ids: list[str | None] = []
        for item_id, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of((text or "").encode())]
            number = len(self.ids)
            self.ids.append(None if item_id is None else str(item_id))
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                by_content.setdefault(tuple(ids[i : i + window]), []).append((number, i))
        windows = sorted(by_content)
        self.length = np.array([len(w) for w in windows], np.int64)
        # Places of each window: (item, position) pairs as one number, and its set of items.
        stride = 1 + max((i for found in by_content.values() for _, i in found), default=0) + window
        self.places = [np.array([n * stride + i for n, i in by_content[w]], np.int64) for w in windows]
        sets: dict[tuple[int, ...], int] = {}
        self.item_set = np.array([sets.setdefault(tuple(sorted({n for n, _ in by_content[w]})), len(sets)) for w in windows], np.int64)
        self.sets = [np.array(s) for s in sets]
        filled = np.zeros((len(windows), window), np.uint32)
        above = np.full((len(windows), window), 0xFFFFFFFF, np.uint32)
        for k, w in enumerate(windows):
            filled[k, : len(w)] = above[k, : len(w)] = w
        self.low, self.high = keys(filled), keys(above)
        self.singles = np.unique(filled[self.length == 1, 0]) if len(windows) else np.zeros(0, np.uint32)
        self.size = len(self.vocabulary) + 1
        pairs = filled[self.length > 1, :2].astype(np.uint64) if window > 1 else np.zeros((0, 2), np.uint64)
        self.pairs = np.unique(pairs[:, 0] * np.uint64(self.size) + pairs[:, 1])
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[slot(self.pairs)] = True

    def starts(self, ids: np.ndarray) -> np.ndarray:
        """Positions of a shard from which a window may start."""
        following = np.append(ids[1:], 0).astype(np.uint64)
        code = ids.astype(np.uint64) * np.uint64(self.size) + following
        found = np.flatnonzero(self.maybe[slot(code)] & (ids > 0))
        if len(found):
            at = np.searchsorted(self.pairs, code[found])
            found = found[(at < len(self.pairs)) & (self.pairs[np.minimum(at, len(self.pairs) - 1)] == code[found])]
        if len(self.singles):
            found = np.union1d(found, np.flatnonzero(np.isin(ids, self.singles)))
        return found

    def suffix_array(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start positions sorted by the words that follow, and those words as comparable keys."""
        starts = self.starts(ids)
        padded = np.concatenate([ids, np.zeros(self.window, np.uint32)])
        following = keys(padded[starts[:, None] + np.arange(self.window)])
        order = np.argsort(following, kind="stable")
        return starts[order], following[order]

    def search(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, window) of every occurrence of every window in the shard, by position."""
        places, following = self.suffix_array(ids)
        if not len(places) or not len(self.low):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        first = np.searchsorted(following, self.low, "left")
        last = np.searchsorted(following, self.high, "right")
        count = last - first
        hit = np.flatnonzero(count)
        which = np.repeat(hit, count[hit])
        offset = np.arange(len(which)) - np.repeat(np.cumsum(count[hit]) - count[hit], count[hit])
        where = places[first[which] + offset]
        order = np.argsort(where, kind="stable")
        return where[order], which[order]

    def longest(self, where: np.ndarray, which: np.ndarray) -> int:
        """Words of the longest match among the occurrences in one document."""
        counts = np.array([len(self.places[w]) for w in which])
        at = np.repeat(where, counts)
        line = at - np.concatenate([self.places[w] for w in which])
        order = np.lexsort((at, line))
        at, line, size = at[order], line[order], np.repeat(self.length[which], counts)[order]
        new = np.concatenate(([True], (line[1:] != line[:-1]) | (at[1:] != at[:-1] + 1)))
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(at)) - 1
        return int((at[ends] + size[ends] - at[starts]).max())


def keys(words: np.ndarray) -> np.ndarray:
    """Rows of word numbers as byte strings that sort like them."""
    if not len(words):
        return np.zeros(0, f"S{4 * max(1, words.shape[1])}")
    return np.ascontiguousarray(words.astype(">u4")).view(f"S{4 * words.shape[1]}").ravel()


def slot(code: np.ndarray) -> np.ndarray:
    return ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)


def spans_of(covered: np.ndarray) -> list[dict]:
    """Maximal runs of covered words."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], covered.astype(np.int8), [0]))))
    return [{"start": int(a), "n_words": int(b - a)} for a, b in zip(edges[::2], edges[1::2])]


def shard_results(texts: list[bytes], tests: Suffixes) -> list[tuple]:
    """(n_words, n_hit, item_ids, longest, spans) of each text."""
    number = tests.vocabulary.get
    split = [words_of(t) for t in texts]
    lengths = np.array([len(w) for w in split], np.int64)
    bounds = np.concatenate(([0], np.cumsum(lengths + 1)))  # a 0 after every document
    ids = np.fromiter(chain.from_iterable(chain((number(w, 0) for w in words), (0,)) for words in split), np.uint32, int(bounds[-1]))
    where, which = tests.search(ids)
    cover = np.zeros(len(ids) + 1, np.int64)
    np.add.at(cover, where, 1)
    np.add.at(cover, where + tests.length[which], -1)
    covered = np.cumsum(cover)[:-1] > 0
    edges = np.searchsorted(where, bounds)
    out = []
    for k, n in enumerate(lengths):
        a, b = edges[k], edges[k + 1]
        if a == b:
            out.append((int(n), 0, [], 0, []))
            continue
        mine = covered[bounds[k] : bounds[k] + n]
        items = np.unique(np.concatenate([tests.sets[s] for s in np.unique(tests.item_set[which[a:b]])]))
        names = sorted({tests.ids[i] for i in items} - {None})
        out.append((int(n), int(mine.sum()), names, tests.longest(where[a:b], which[a:b]), spans_of(mine)))
    return out


def _pass(documents: DataFrame, items: list[tuple], window: int) -> DataFrame:
    """``documents`` with the columns ADDED, against one block of items."""
    shared = documents.sparkSession.sparkContext.broadcast(Suffixes(items, window))
    columns = documents.columns
    added = StructType.fromDDL(ADDED)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.int64(), SPANS]
        for batch in batches:
            for part, texts in text_runs(batch, "text", RUN_BYTES):
                found = shard_results(texts, shared.value)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, *(pa.array(c, t) for c, t in zip(zip(*found), kinds))], names=[*columns, *added.names]
                )

    return documents.mapInArrow(match, StructType([*documents.schema, *added]))


def with_matches(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``documents`` with n_words, n_hit (words in verbatim matches), item_ids (of the matched
    items, in order), longest (words of the longest match) and spans (runs of hit words)."""
    documents = documents.drop(*StructType.fromDDL(ADDED).names)
    items = benchmark.select("item_id", "text").filter(F.col("text").isNotNull())
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if total <= block_bytes:
        return _pass(documents, [tuple(r) for r in items.collect()], window)
    blocks = -(-2 * total // block_bytes)
    key = [F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_text")]
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    lengths, found = None, None
    for k in range(blocks):
        one = _pass(documents, [tuple(r) for r in items.filter(block == k).collect()], window)
        hits = one.filter("n_hit > 0").select(*key, "item_ids", "longest", "spans")
        lengths, found = lengths or one.select(*documents.columns, "n_words"), hits if found is None else found.union(hits)
    # Copies of a row have equal matches, so one row per id and text is enough.
    merged = found.dropDuplicates(["_id", "_text", "spans", "item_ids"]).groupBy("_id", "_text").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"),
        F.max("longest").alias("longest"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
    )
    # Runs that overlap or touch become one.
    step = lambda runs, s: F.when(
        (F.size(runs) > 0) & (F.element_at(runs, -1)["end"] >= s["start"]),
        F.concat(
            F.slice(runs, 1, F.size(runs) - 1),
            F.array(F.struct(F.element_at(runs, -1)["start"].alias("start"), F.greatest(F.element_at(runs, -1)["end"], s["start"] + s["n_words"]).alias("end"))),
        ),
    ).otherwise(F.concat(runs, F.array(F.struct(s["start"].alias("start"), (s["start"] + s["n_words"]).alias("end")))))
    runs = F.aggregate("spans", F.array().cast("array<struct<start:bigint,end:bigint>>"), step)
    spans = F.transform(runs, lambda r: F.struct(r["start"].alias("start"), (r["end"] - r["start"]).alias("n_words")))
    joined = lengths.join(merged.withColumn("spans", spans), F.col("doc_id").eqNullSafe(F.col("_id")) & F.xxhash64("text").eqNullSafe(F.col("_text")), "left")
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    filled = none(F.col("spans"), "array<struct<start:bigint,n_words:bigint>>")
    return joined.select(
        *documents.columns,
        "n_words",
        F.aggregate(filled, F.lit(0).cast("long"), lambda n, s: n + s["n_words"]).alias("n_hit"),
        none(F.col("item_ids"), "array<string>").alias("item_ids"),
        F.coalesce("longest", F.lit(0)).cast("long").alias("longest"),
        filled.alias("spans"),
    )


def without_matches(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without any verbatim match, with their own columns."""
    matched = with_matches(set_aside(documents, StructType.fromDDL(ADDED).names), benchmark, window)
    return set_back(matched.filter("n_hit = 0"), documents.columns)
