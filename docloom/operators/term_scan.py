"""Terms of texts in Arrow batches: the counts of a corpus, and its texts' scores for a block of queries.

Words come as one list a text, or as texts that are cut at white space here, as Python and the library's
``words`` see it alike. A text is counted and scored where it is read, so
neither its postings nor pairs of texts and queries are written or shuffled: counting gives each
different term of a step once, scoring at most k rows a query and task. Steps bound the memory of a
task, whatever the length of the texts and the number of rows in a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Words and scores of a step (more only if one text has more).
STEP_WORDS = 1 << 20
STEP_SCORES = 1 << 20

COUNTS = "term string, df long, cf long, docs long, words long"


class Words:
    """The words of some texts: the text and the code of each word, and the words of the codes."""

    def __init__(self, lengths: np.ndarray, flat: pa.Array, stop_words: list[str] = ()):
        coded = flat.dictionary_encode()
        self.n, self.lengths, self.names = len(lengths), lengths, coded.dictionary
        self.rows = np.repeat(np.arange(self.n), lengths)
        self.codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        if stop_words:
            kept = ~self._isin(stop_words)[self.codes]
            self.rows, self.codes = self.rows[kept], self.codes[kept]

    def _isin(self, words: list[str]) -> np.ndarray:
        return pc.is_in(self.names, value_set=pa.array(words, self.names.type)).to_numpy(zero_copy_only=False)

    def index_in(self, words: list[str]) -> np.ndarray:
        """The place of each code's word in ``words``, or -1."""
        found = pc.index_in(self.names, value_set=pa.array(words, self.names.type))
        return pc.fill_null(found, -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, first and second code of neighbours in one text."""
        same = self.rows[1:] == self.rows[:-1]
        return self.rows[1:][same], self.codes[:-1][same], self.codes[1:][same]


def steps(tokens: pa.Array, stop_words: list[str] = (), most_rows: int = 1 << 30) -> Iterator[tuple[int, Words]]:
    """The first text of each step of a batch, and the step's words."""
    if not pa.types.is_list(tokens.type):
        yield from _split_steps(tokens, most_rows)
        return
    lengths = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat, ends = tokens.flatten(), np.concatenate([[0], np.cumsum(lengths)])
    first = 0
    while first < len(lengths):
        last = int(np.searchsorted(ends, ends[first] + STEP_WORDS, "right")) - 1
        last = min(max(last, first + 1), first + most_rows)
        yield first, Words(lengths[first:last], flat.slice(ends[first], ends[last] - ends[first]), stop_words)
        first = last


def _split_steps(texts: pa.Array, most_rows: int) -> Iterator[tuple[int, Words]]:
    ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)])
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(ends, ends[first] + 4 * STEP_WORDS, "right")) - 1
        last = min(max(last, first + 1), first + most_rows)
        cut = [(x or "").split() for x in texts.slice(first, last - first).to_pylist()]
        yield first, Words(np.array([len(x) for x in cut], np.int64), pa.array([w for x in cut for w in x], pa.string()))
        first = last


def tallied(rows: np.ndarray, keys: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, key and number of each different key (below ``size``) of a text."""
    cells, tf = np.unique(rows * size + keys, return_counts=True)
    return cells // max(size, 1), cells % max(size, 1), tf


def term_counts(tokens: DataFrame, stop_words: list[str] = ()) -> DataFrame:
    """``term, df, cf, docs, words`` of a column of word lists or texts.

    Rows and words are in the sums of ``docs`` and ``words``, on a row without a term.
    """
    stop_words = list(stop_words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, words in steps(batch.column(0), stop_words):
                _, codes, tf = tallied(words.rows, words.codes, len(words.names))
                yield _counted(words.names, codes, tf)
                yield _rows([None], [0], [0], [words.n], [int(words.lengths.sum())])

    sums = [F.sum(c).alias(c) for c in ("df", "cf", "docs", "words")]
    return tokens.mapInArrow(count, COUNTS).groupBy("term").agg(*sums)


def pair_counts(tokens: DataFrame, stop_words: list[str], kept: list[str]) -> DataFrame:
    """``pair, df, cf`` of neighbours that are both in ``kept``, as first place * len(kept) + second place."""
    stop_words = list(stop_words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, words in steps(batch.column(0), stop_words):
                place = words.index_in(kept)
                rows, left, right = words.pairs()
                left, right = place[left], place[right]
                both = (left >= 0) & (right >= 0)
                met, numbers = np.unique(left[both] * len(kept) + right[both], return_inverse=True)
                _, codes, tf = tallied(rows[both], numbers, len(met))
                sums = np.bincount(codes, minlength=len(met)), np.bincount(codes, tf, len(met)).astype(np.int64)
                columns = [pa.array(x, pa.int64()) for x in (met, *sums)]
                yield pa.RecordBatch.from_arrays(columns, names=["pair", "df", "cf"])

    sums = [F.sum(c).alias(c) for c in ("df", "cf")]
    return tokens.mapInArrow(count, "pair long, df long, cf long").groupBy("pair").agg(*sums)


def _counted(names: pa.Array, codes: np.ndarray, tf: np.ndarray) -> pa.RecordBatch:
    df, cf = np.bincount(codes, minlength=len(names)), np.bincount(codes, tf, len(names)).astype(np.int64)
    used = np.flatnonzero(df)
    none = np.zeros(len(used), np.int64)
    return _rows(names.take(pa.array(used)), df[used], cf[used], none, none)


def _rows(terms, *numbers) -> pa.RecordBatch:
    columns = [pa.array(terms, pa.string()) if isinstance(terms, list) else terms.cast(pa.string())]
    columns += [pa.array(n, pa.int64()) for n in numbers]
    return pa.RecordBatch.from_arrays(columns, names=["term", "df", "cf", "docs", "words"])


class Asked:
    """Weights of the queries of a block by the number of their term."""

    def __init__(self, terms: np.ndarray, queries: np.ndarray, weights: np.ndarray, n_terms: int, n_queries: int):
        order = np.lexsort((queries, terms))
        self.queries, self.weights, self.n_queries = queries[order], weights[order], n_queries
        self.starts = np.searchsorted(terms[order], np.arange(n_terms + 1))

    def most_rows(self) -> int:
        return max(STEP_SCORES // max(self.n_queries, 1), 1)

    def scores(self, n: int, rows: np.ndarray, terms: np.ndarray, value) -> np.ndarray:
        """Sums of ``value(entries, weights)`` by text and query; an entry is a text's term."""
        many = self.starts[terms + 1] - self.starts[terms]
        entries = np.repeat(np.arange(len(terms)), many)
        places = np.arange(len(entries)) + np.repeat(self.starts[terms] - (np.cumsum(many) - many), many)
        cells = rows[entries] * self.n_queries + self.queries[places]
        sums = np.bincount(cells, value(entries, self.weights[places]), n * self.n_queries)
        return sums.astype(np.float64).reshape(n, self.n_queries)


def bm25_scorer(names: list[str], asked: Asked, average: float, k1: float, b: float):
    """Okapi scores; words that no query asks for are left out before anything is counted."""

    def score(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for first, words in steps(batch.column(1), most_rows=asked.most_rows()):
            terms = words.index_in(names)[words.codes]
            known = terms >= 0
            rows, terms, tf = tallied(words.rows[known], terms[known], len(names))
            share = words.lengths[rows] / average if average else np.zeros(len(rows))
            length = k1 * (1 - b + b * share)
            sums = asked.scores(words.n, rows, terms, lambda e, w: w * tf[e] * (k1 + 1) / (tf[e] + length[e]))
            yield np.arange(first, first + words.n), sums

    return score


def tfidf_scorer(names: list[str], idf: np.ndarray, stop_words: list[str], asked: Asked, lengths: np.ndarray):
    """Cosines of the weights of the vocabulary ``names``; ``lengths`` are those of the queries."""
    sides = [x.split(" ") for x in names]
    single = [" " if len(s) > 1 else s[0] for s in sides]
    halves = sorted({w for s in sides if len(s) > 1 for w in s})
    place = {w: i for i, w in enumerate(halves)}
    double = sorted((place[s[0]] * len(halves) + place[s[1]], i) for i, s in enumerate(sides) if len(s) > 1)
    keys, numbers = np.array(double, np.int64).reshape(-1, 2).T

    def score(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for first, words in steps(batch.column(1), stop_words, asked.most_rows()):
            rows, terms = words.rows, words.index_in(single)[words.codes]
            if len(keys):
                half = words.index_in(halves)
                of, left, right = words.pairs()
                left, right = half[left], half[right]
                pair = np.where((left >= 0) & (right >= 0), left * len(halves) + right, -1)
                at = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
                rows = np.concatenate([rows, of])
                terms = np.concatenate([terms, np.where(keys[at] == pair, numbers[at], -1)])
            known = terms >= 0
            rows, terms, tf = tallied(rows[known], terms[known], len(names))
            weights = tf * idf[terms]
            norms = np.sqrt(np.bincount(rows, weights * weights, words.n))
            dots = asked.scores(words.n, rows, terms, lambda e, w: weights[e] * w)
            norms[norms == 0] = 1.0
            yield np.arange(first, first + words.n), dots / norms[:, None] / lengths[None, :]

    return score
