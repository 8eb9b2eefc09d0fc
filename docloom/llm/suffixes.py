"""Exact removal of repeated byte strings with a sampled suffix array.

A byte goes if some string of ``LENGTH`` bytes that covers it also starts anywhere else, in any
document. Sorting the suffixes of all positions would write many times the input, so the array is
built over anchors: of the ``PLACES`` stretches of ``KMER`` bytes within a string of LENGTH bytes,
the one with the smallest hash (the first of equals) is the string's anchor. Equal strings have
their anchor at the same offset, so every repeated string is found among suffixes that begin with
the same anchor, and about 2 in PLACES positions are anchors.

1. A scan computes anchors: the anchor's hash, and a second hash of all bytes that its strings
   cover. Rows are thin (four numbers); of equal rows in a task one stands for all, and the others
   are settled. The rows are sorted by both hashes. Equal rows are whole repeats. An anchor that
   occurs once is dropped.
2. Anchors that occur with different surroundings, one row for each of these, are suffixes to be
   compared byte by byte. Their text is cut out of the documents, and they are range partitioned by
   their leading bytes with sampled splitters. Suffixes with equal anchors begin with the same
   leading bytes and the same hash, so a splitter never parts them: no match crosses a boundary.
   Each bucket is sorted by multikey quicksort, over the bytes to the right and over those to
   the left; common prefixes of neighbours give, for every offset, which strings occur again.
3. Repeated strings are stretches of their document; they are merged and cut out.

Copies of a whole text are known by its hash and length before: a task takes the anchors of a text
once, and all of a text that occurs again goes. A hash that two different texts share is detected
and another seed taken. Anchors with more than ``HOT`` different surroundings, as a very common
passage has at its ends, aren't put into one bucket: their strings are hashed one by one (128 bits)
and counted with sums per task first.

Edge cases: null and empty texts have no bytes; texts shorter than LENGTH lose nothing; strings
overlap freely, also with themselves; texts of any length are scanned in pieces that overlap;
repeated rows are copies of each other; an empty table gives an empty result. Columns that clash
with the added ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docloom.llm.common import stored, text_runs

LENGTH = 200
KMER = 64
PLACES = LENGTH - KMER + 1
HOT = 200_000
RUN_BYTES = 1 << 20
BUCKET_ROWS = 60_000
REMEMBERED = 500_000

ANCHORS = "key long, around long, id long, place long"
FOUND = "id long, begin long, stop long, key long, place long, whole boolean"
CONTEXTS = "lead long, next long, key long, id long, place long, whole boolean, left binary, right binary"
STRETCH = "id long, begin long, stop long"
ADDED = "n_bytes long, n_removed long, n_spans long, kept binary"

BASES = (0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93 | 1)


@lru_cache(maxsize=2)
def _byte_values(which: int) -> np.ndarray:
    return np.random.default_rng(101 + which).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    have = _powers.get(which)
    if have is None or len(have[0]) < n:
        size = 1 << max(20, (n - 1).bit_length())
        base = BASES[which]
        made = []
        for factor in (base, pow(base, -1, 1 << 64)):
            row = np.full(size, factor, np.uint64)
            row[0] = 1
            made.append(np.multiply.accumulate(row))
        have = tuple(made)
        _powers[which] = have
    return have


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


class Hashes:
    """Hashes of any stretch of a byte array from running sums."""

    def __init__(self, data: np.ndarray, which: int):
        up, self.down = powers(which, len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_byte_values(which)[data] * up[: len(data)], out=self.sums[1:])

    def of(self, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mixed((self.sums[stop] - self.sums[begin]) * self.down[begin])

    def every(self, size: int) -> np.ndarray:
        n = max(0, len(self.sums) - size)
        return mixed((self.sums[size:] - self.sums[:n]) * self.down[:n])


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return np.minimum(values[: len(values) - (width - size)], values[width - size :]) if width > size else values


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Anchors of the texts data[starts[i]:ends[i]]: (text, first string, last string, anchor's
    place, hash, hash of all around); places are those in ``data``."""
    long = np.flatnonzero(ends - starts >= LENGTH)
    if not len(long):
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + tuple(np.zeros(0, np.uint64) for _ in range(2))
    first, last = starts[long], ends[long] - LENGTH
    hashes = Hashes(data, 0).every(KMER)
    least = sliding_minimum(hashes, PLACES)
    valid = np.zeros(len(least) + 1, np.int8)
    np.add.at(valid, first, 1)
    np.add.at(valid, last + 1, -1)
    valid = np.cumsum(valid[:-1], dtype=np.int8).astype(bool)
    # The anchor changes where a smaller hash comes in or where the smallest goes out.
    lower = np.zeros(len(least), bool)
    lower[1:] = least[1:] < least[:-1]
    gone = np.zeros(len(least), bool)
    gone[1:] = hashes[: len(least) - 1] == least[:-1]
    new = np.zeros(len(least), bool)
    new[first] = True
    begin = np.flatnonzero((lower | gone | new) & valid)
    seek = gone[begin] & ~lower[begin] | new[begin]
    place = begin + PLACES - 1
    sought = begin[seek]
    at = np.empty(len(sought), np.int64)
    for i in range(0, len(sought), 8192):
        part = sought[i : i + 8192]
        at[i : i + 8192] = part + hashes[part[:, None] + np.arange(PLACES)].argmin(axis=1)
    place[seek] = at
    text = np.searchsorted(first, begin, "right") - 1
    stop = np.minimum(np.append(begin[1:] - 1, len(least)), last[text])
    around = Hashes(data, 1).of(begin, stop + LENGTH)
    around = mixed(around + ((place - begin).astype(np.uint64) << np.uint64(8)) + (stop - begin).astype(np.uint64))
    return long[text], begin, stop, place, hashes[place], around


# A row of the scan occurs once in its task, or stands for several equal ones, or is one of these.
ONCE, SEVERAL, DONE = range(3)


def packed(place: np.ndarray, begin: np.ndarray, stop: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """An anchor's place in its text, its kind, and how far before it its first and last string begin."""
    return place << 18 | kind << 16 | (place - begin) << 8 | (place - stop)


def unpacked(place):
    return place >> 18, place >> 8 & 255, place & 255


def gathered(key: np.ndarray, around: np.ndarray) -> np.ndarray:
    """Kinds of a task's rows: of equal rows the first stands for all in the shuffle."""
    order = np.lexsort((around, key))
    same = (key[order[1:]] == key[order[:-1]]) & (around[order[1:]] == around[order[:-1]])
    kind = np.zeros(len(key), np.int64)
    kind[order[1:][same]] = DONE
    first = np.append(same, False) & ~np.append(False, same) if len(key) else same
    kind[order[first]] = SEVERAL
    return kind


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """ANCHORS rows of (id, text) batches."""
    seen: set[int] = set()
    for batch in batches:
        for part, texts in text_runs(batch, "text", RUN_BYTES):
            pieces, ids, offsets = [], [], []
            for doc, text in zip(part.column("id").to_pylist(), texts):
                if len(text) < LENGTH or doc in seen:
                    continue
                if len(seen) < REMEMBERED:
                    seen.add(doc)
                for a in range(0, len(text) - LENGTH + 1, 4 * RUN_BYTES):  # strings that begin in this piece
                    pieces.append(text[a : a + 4 * RUN_BYTES + LENGTH - 1])
                    ids.append(doc)
                    offsets.append(a)
            i = 0
            while i < len(pieces):
                j, size = i, 0
                while j < len(pieces) and (j == i or size + len(pieces[j]) <= 4 * RUN_BYTES):
                    size += len(pieces[j])
                    j += 1
                data = np.frombuffer(b"".join(pieces[i:j]), np.uint8)
                ends = np.cumsum([len(x) for x in pieces[i:j]])
                starts = ends - [len(x) for x in pieces[i:j]]
                text, begin, stop, place, key, around = anchors(data, starts, ends)
                shift = np.array(offsets[i:j], np.int64)[text] - starts[text]
                kind, docs = gathered(key, around), np.array(ids[i:j], np.int64)[text]
                places = packed(place + shift, begin + shift, stop + shift, kind)
                # Rows that are settled go anywhere.
                key = np.where(kind == DONE, mixed(docs.view(np.uint64) + places.view(np.uint64) * np.uint64(BASES[0])), key)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(around.view(np.int64)), pa.array(docs), pa.array(places)],
                    names=["key", "around", "id", "place"],
                )
                i = j


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """FOUND rows of ANCHORS batches sorted by key and around.

    A row with the same surroundings as another is a whole stretch to remove (key null). The first
    row of each surroundings, where a key has several, is a suffix to compare (key set).
    A key's first row waits until other surroundings show up, so no group is held.
    """
    names = ["key", "around", "id", "place"]
    held = np.zeros((4, 0), np.int64)  # the last row, whose successor isn't known
    before = None  # the row before it
    waiting = None  # first row of the current key, its repetition flag, until it is needed

    def out(rows: np.ndarray, whole: np.ndarray, compare: bool) -> pa.RecordBatch:
        place, back, near = unpacked(rows[3])
        return pa.RecordBatch.from_arrays(
            [
                pa.array(rows[2]),
                pa.array(place - back),
                pa.array(place - near + LENGTH),
                pa.array(rows[0], pa.int64(), mask=np.full(rows.shape[1], not compare)),
                pa.array(rows[3]),
                pa.array(whole),
            ],
            names=["id", "begin", "stop", "key", "place", "whole"],
        )

    def results(rows: np.ndarray, following: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        nonlocal before, waiting
        n = rows.shape[1]
        edge = np.full((4, 1), -1)
        ahead = np.hstack([rows[:, 1:], edge if following is None else following])
        behind = np.hstack([edge if before is None else before, rows[:, :-1]])
        more, had = np.ones(n, bool), np.ones(n, bool)
        more[-1], had[0] = following is not None, before is not None
        next_key, prev_key = more & (ahead[0] == rows[0]), had & (behind[0] == rows[0])
        next_same, prev_same = next_key & (ahead[1] == rows[1]), prev_key & (behind[1] == rows[1])
        whole = next_same | prev_same | (rows[3] >> 16 & 3 == SEVERAL)
        if whole.any():
            yield out(rows[:, whole], whole[whole], False)
        later = prev_key & ~prev_same  # first of further surroundings of a key
        opening = np.flatnonzero(~prev_key)
        # Which opening row each later row belongs to; -1 is the one that waits from before.
        owner = np.searchsorted(opening, np.flatnonzero(later), "right") - 1
        compare = later.copy()
        compare[opening[np.unique(owner[owner >= 0])]] = True
        if (owner < 0).any() and waiting is not None:
            yield out(waiting[0], waiting[1], True)
            waiting = None
        if compare.any():
            yield out(rows[:, compare], whole[compare], True)
        if len(opening):
            k = opening[-1]
            waiting = None if compare[k] else (rows[:, k : k + 1], whole[k : k + 1])
        before = rows[:, -1:]

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.vstack([batch.column(c).to_numpy() for c in names])
        done = rows[3] >> 16 & 3 == DONE
        if done.any():
            yield out(rows[:, done], done[done], False)
        rows = np.hstack([held, rows[:, ~done]])
        held = rows[:, -1:] if rows.shape[1] else held
        if rows.shape[1] > 1:
            yield from results(rows[:, :-1], held)
    if held.shape[1]:
        yield from results(held, None)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """CONTEXTS rows of (id, text, suffixes) batches: the bytes around each suffix's start."""
    kinds = [pa.int64()] * 5 + [pa.bool_(), pa.binary(), pa.binary()]
    names = [x.split()[0] for x in CONTEXTS.split(", ")]
    for batch in batches:
        for part, texts in text_runs(batch, "text", RUN_BYTES):
            rows = []
            for doc, text, suffixes in zip(part.column("id").to_pylist(), texts, part.column("suffixes").to_pylist()):
                for s in suffixes:
                    p = unpacked(s["place"])[0]
                    right = text[p : p + LENGTH]
                    lead = int.from_bytes(right[:8], "big") - (1 << 63), int.from_bytes(right[8:16], "big") - (1 << 63)
                    rows.append((*lead, s["key"], doc, s["place"], s["whole"], text[max(0, p - PLACES + 1) : p], right))
                    if len(rows) >= 8192:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
                        rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)


def matrix(texts: list[bytes], width: int) -> np.ndarray:
    """Texts as rows of 8-byte big-endian words, padded with zeros."""
    width = -(-width // 8) * 8
    return np.frombuffer(b"".join(t.ljust(width, b"\0") for t in texts), ">u8").reshape(len(texts), -1).astype(np.uint64)


def multikey_order(words: np.ndarray) -> np.ndarray:
    """Order of rows by multikey quicksort, a word at a time: rows that are equal so far are open
    groups; all open groups are split by their next word at once, and groups of one are closed."""
    n = len(words)
    order = np.argsort(words[:, 0], kind="stable") if n else np.zeros(0, np.int64)
    group = np.concatenate(([0], np.cumsum(words[order[1:], 0] != words[order[:-1], 0]))) if n else order
    for d in range(1, words.shape[1]):
        size = np.bincount(group, minlength=1)
        open_rows = np.flatnonzero(size[group] > 1)
        if not len(open_rows):
            break
        part = order[open_rows]
        inner = np.lexsort((words[part, d], group[open_rows]))
        order[open_rows] = part[inner]
        change = np.ones(n, bool)
        change[1:] = group[1:] != group[:-1]
        at = order[open_rows]
        differs = (group[open_rows][1:] == group[open_rows][:-1]) & (words[at[1:], d] != words[at[:-1], d])
        change[open_rows[1:][differs]] = True
        group = np.cumsum(change) - 1
    return order


def common_prefix(words: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Bytes that each row of the order has in common with the one before (the first: 0)."""
    apart = words[order[1:]] ^ words[order[:-1]]
    word = np.where(apart.any(axis=1), (apart != 0).argmax(axis=1), words.shape[1])
    inside = np.zeros(len(apart), np.int64)
    differ = np.flatnonzero(word < words.shape[1])
    x = apart[differ, word[differ]]
    for shift in (32, 16, 8):  # leading zero bytes
        zero = x >> np.uint64(64 - shift) == 0
        inside[differ] += np.where(zero, shift // 8, 0)
        x = np.where(zero, x << np.uint64(shift), x)
    return np.concatenate(([0], word * 8 + inside))


def repeated_offsets(left: list[bytes], right: list[bytes], back: np.ndarray, near: np.ndarray) -> np.ndarray:
    """(rows x PLACES) flags: the string that begins ``offset`` bytes before the row's anchor occurs
    again among the rows. A row's strings begin ``near`` to ``back`` bytes before its anchor."""
    n = len(left)
    classes = []
    for texts, width in ((right, LENGTH), ([x[::-1] for x in left], PLACES - 1)):
        words = matrix(texts, width)
        order = multikey_order(words)
        classes.append((order, common_prefix(words, order)))
    hit = np.zeros((n, PLACES), bool)
    numbers = [np.empty(n, np.int64), np.empty(n, np.int64)]
    for offset in range(PLACES):
        rows = np.flatnonzero((near <= offset) & (offset <= back))
        if len(rows) < 2:
            continue
        for number, (order, prefix), depth in zip(numbers, classes, (LENGTH - offset, offset)):
            number[order] = np.cumsum(prefix < depth)
        code = numbers[0][rows] * (n + 1) + numbers[1][rows]
        by = np.argsort(code, kind="stable")
        same = code[by[1:]] == code[by[:-1]]
        again = np.zeros(len(rows), bool)
        again[by[1:][same]] = True
        again[by[:-1][same]] = True
        hit[rows[again], offset] = True
    return hit


def stretches(hit: np.ndarray, ids: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    """STRETCH rows: what the repeated strings of each row cover."""
    flags = np.zeros((len(hit), PLACES + 2), np.int8)
    flags[:, 1:-1] = hit
    row, low = np.nonzero(np.diff(flags, axis=1) == 1)
    _, high = np.nonzero(np.diff(flags, axis=1) == -1)
    at = unpacked(place)[0][row]
    return pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(at - high + 1), pa.array(at - low + LENGTH)], names=["id", "begin", "stop"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """STRETCH rows of a bucket of CONTEXTS sorted by leading bytes and key."""
    rest: list[pa.RecordBatch] = []

    def compared(table: pa.Table) -> pa.RecordBatch:
        place = table.column("place").to_numpy()
        hit = repeated_offsets(table.column("left").to_pylist(), table.column("right").to_pylist(), *unpacked(place)[1:])
        open_rows = np.flatnonzero(~table.column("whole").to_numpy(zero_copy_only=False) & hit.any(axis=1))
        return stretches(hit[open_rows], table.column("id").to_numpy()[open_rows], place[open_rows])

    held = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        rest.append(batch)
        held += batch.num_rows
        if held >= BUCKET_ROWS:
            table = pa.Table.from_batches(rest)
            keys = table.column("key").to_numpy()
            cut = len(keys) - int(np.argmin((keys == keys[-1])[::-1])) if (keys != keys[-1]).any() else 0
            if cut:
                yield compared(table.slice(0, cut))
                rest, held = table.slice(cut).combine_chunks().to_batches(), len(keys) - cut
    if rest:
        yield compared(pa.Table.from_batches(rest))


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h1, h2, id, begin) of every string of the suffixes of very frequent anchors."""
    for batch in batches:
        for row in batch.select(["id", "place", "left", "right"]).to_pylist():
            data = np.frombuffer(row["left"] + row["right"], np.uint8)
            at, back, near = unpacked(row["place"])
            begin = len(row["left"]) - np.arange(near, back + 1)
            pair = [pa.array(Hashes(data, k).of(begin, begin + LENGTH).view(np.int64)) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*pair, pa.array(np.full(len(begin), row["id"])), pa.array(at - np.arange(near, back + 1))], names=["h1", "h2", "id", "begin"])


def identified(documents: DataFrame) -> tuple[Column, DataFrame]:
    """A hash of the text, and (id, n, first, size) with the number of copies and the smallest doc_id
    of each text; the hash is checked against length and a checksum."""
    text = F.coalesce("text", F.lit(""))
    for seed in range(16):
        key = F.xxhash64(F.lit(seed), text)
        copies = stored(
            documents.select(key.alias("id"), "doc_id", F.octet_length(text).alias("size"), F.crc32(text.cast("binary")).alias("check"))
            .groupBy("id")
            .agg(
                F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"), F.max("size").alias("size"),
                ((F.min("size") != F.max("size")) | (F.min("check") != F.max("check"))).alias("clash"),
            ),
            "text-copies",
        )
        if not copies.filter("clash").limit(1).count():
            return key, copies
    raise ValueError("texts collide under every seed")


def removed_stretches(documents: DataFrame, hot: int = HOT) -> tuple[Column, DataFrame]:
    """The hash that names a text, and (id, all, spans) of the texts that lose bytes."""
    key, copies = identified(documents)
    rows = documents.select(key.alias("id"), "doc_id", "text")
    found = stored(
        rows.select("id", "text").mapInArrow(_scan, ANCHORS).repartition("key").sortWithinPartitions("key", "around").mapInArrow(_repeats, FOUND),
        "anchors",
    )
    suffixes = found.filter("key IS NOT NULL")
    # One document of each text gives the bytes around its suffixes.
    wanted = (
        suffixes.groupBy("id")
        .agg(F.collect_list(F.struct("key", "place", "whole")).alias("suffixes"))
        .join(copies.select("id", "first"), "id")
        .select(F.col("id").alias("_id"), "first", "suffixes")
    )
    contexts = (
        rows.select("id", "doc_id", "text")
        .join(wanted, (F.col("id") == F.col("_id")) & F.col("doc_id").eqNullSafe(F.col("first")))
        .select("id", "text", "suffixes")
        .mapInArrow(_contexts, CONTEXTS)
    )
    busy = suffixes.groupBy("key").count().filter(F.col("count") > hot).select("key").collect()  # at most rows / hot keys
    parts = [found.filter("key IS NULL").select("id", "begin", "stop")]
    if busy:
        contexts = stored(contexts, "contexts")
        many = F.col("key").isin([r[0] for r in busy])
        strings = contexts.filter(many).mapInArrow(_strings, "h1 long, h2 long, id long, begin long")
        again = strings.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h1", "h2")
        parts.append(strings.join(again, ["h1", "h2"]).select("id", "begin", (F.col("begin") + LENGTH).alias("stop")))
        contexts = contexts.filter(~many)
    parts.append(contexts.repartitionByRange("lead", "next", "key").sortWithinPartitions("lead", "next", "key").mapInArrow(_compare, STRETCH))
    pieces = parts[0]
    for p in parts[1:]:
        pieces = pieces.union(p)
    spans = pieces.distinct().groupBy("id").agg(F.collect_list(F.struct("begin", "stop")).alias("spans"))
    whole = copies.filter((F.col("n") > 1) & (F.col("size") >= LENGTH)).select("id")
    lost = spans.join(whole, "id", "left_anti").select("id", F.lit(False).alias("all"), "spans")
    none = F.array().cast("array<struct<begin:bigint,stop:bigint>>")
    return key, lost.union(whole.select("id", F.lit(True), none))


def without_repeats(documents: DataFrame, hot: int = HOT) -> DataFrame:
    """``documents`` with n_bytes, n_removed, n_spans (maximal runs removed) and kept (the rest)."""
    added = StructType.fromDDL(ADDED)
    documents = documents.drop(*added.names)
    key, lost = removed_stretches(documents, hot)
    columns = documents.columns
    losses = lost.select(F.col("id").alias("_id"), F.col("all").alias("_all"), F.col("spans").alias("_spans"))
    joined = documents.join(losses, key == F.col("_id"), "left").drop("_id")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            for part, texts in text_runs(batch, "text", 4 * RUN_BYTES):
                made = []
                for text, everything, spans in zip(texts, part.column("_all").to_pylist(), part.column("_spans").to_pylist()):
                    if everything:
                        made.append((len(text), len(text), 1, b""))
                        continue
                    kept, at, gone, runs = [], 0, 0, 0
                    for a, b in merged(sorted((s["begin"], s["stop"]) for s in spans or [])):
                        kept.append(text[at:a])
                        at, gone, runs = b, gone + b - a, runs + 1
                    kept.append(text[at:])
                    made.append((len(text), gone, runs, b"".join(kept)))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in columns), *(pa.array(c, t) for c, t in zip(zip(*made), kinds))], names=[*columns, *added.names]
                )

    schema = StructType([*documents.schema, *added])
    return joined.mapInArrow(cut, schema)


def merged(spans: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Sorted spans, those that overlap or touch joined."""
    begin = stop = None
    for a, b in spans:
        if stop is not None and a <= stop:
            stop = max(stop, b)
            continue
        if stop is not None:
            yield begin, stop
        begin, stop = a, b
    if stop is not None:
        yield begin, stop
