"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts the n-grams of every language per task and sums them in Spark; the matrix of
log-probabilities (buckets x languages) is broadcast. It has at most ``CELLS`` numbers: with more than
``CELLS / BUCKETS`` languages, neighbouring buckets are merged. Scoring takes whole texts in batches: the hashed n-grams of a batch are one
array, and a text's log-likelihoods are segment sums over the gathered rows.

Text is lower-cased, digits and signs become blanks, and runs of blanks count once; n-grams of one
to four characters are hashed. Training uses about ``sample`` texts of each language that has more, chosen
by a hash of id and text, so all reruns choose the same and no rare language is lost in a large table;
scoring covers every text.

Edge cases: a null text or a text without a letter is ``und`` with score 0; rows without language
are not learned from; without any learned language all texts are ``und``; ties go to the language
that is first in order; repeated rows are scored alike. Other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import runs_by_size, unit_hash

BUCKETS = 1 << 15
ORDERS = (1, 2, 3, 4)
SAMPLE = 4_000
CELLS = 1 << 24
SMOOTHING = 0.5
CHUNK_CHARS = 1 << 20
# How much one more n-gram counts towards the certainty: overlapping n-grams repeat each other.
EVIDENCE = 0.25

LETTER = regex.compile(r"\p{L}")
NOT_LETTERS = regex.compile(r"[^\p{L}\p{M}]+")
SCHEMA = "doc_id long, lang_pred string, score double"


def ngram_buckets(text: str) -> np.ndarray:
    """Bucket of every n-gram of the normalized text."""
    points = np.frombuffer(f" {NOT_LETTERS.sub(' ', text.lower())} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    parts, h = [], np.zeros(len(points), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        if len(points) < n:
            break
        h = h[: len(points) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + points[n - 1 :] + np.uint64(n)
        if n in ORDERS:
            mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            parts.append((mixed >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int32))
    return np.concatenate(parts)


def pieces(text: str) -> Iterator[str]:
    """Very long texts in parts, which bounds memory; counts add up."""
    for start in range(0, max(1, len(text)), CHUNK_CHARS):
        yield text[start : start + CHUNK_CHARS]


class Model:
    """Languages in order and the matrix of log-probabilities, buckets x languages."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        self.shift = (BUCKETS // len(counts)).bit_length() - 1  # merged buckets
        smooth = counts.astype(np.float64) + SMOOTHING
        self.logs = np.log(smooth / smooth.sum(axis=0, keepdims=True)).astype(np.float32)

    def score(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
        known = [i for i, t in enumerate(texts) if t is not None and self.languages and LETTER.search(t)]
        for a, b in runs_by_size([len(texts[i]) for i in known], CHUNK_CHARS):
            totals = np.zeros((b - a, len(self.languages)))
            if b - a == 1:  # possibly very long
                n = 0
                for part in pieces(texts[known[a]]):
                    found = ngram_buckets(part)
                    n += len(found)
                    totals[0] += self.logs[found >> self.shift].sum(axis=0, dtype=np.float64)
                lengths = np.array([n])
            else:
                found = [ngram_buckets(texts[i]) for i in known[a:b]]
                lengths = np.array([len(x) for x in found])
                rows, starts = np.concatenate(found) >> self.shift, np.concatenate(([0], np.cumsum(lengths)[:-1]))
                for k in range(len(self.languages)):
                    totals[:, k] = np.add.reduceat(self.logs[:, k][rows], starts, dtype=np.float64)
            best = totals.argmax(axis=1)
            gap = (totals - totals.max(axis=1, keepdims=True)) * EVIDENCE
            chance = 1 / np.exp(gap).sum(axis=1)
            for i, k, p in zip(known[a:b], best, chance):
                out[i] = (self.languages[k], float(p))
        return out


def fit(labelled: DataFrame, sample: int | None = SAMPLE, cells: int = CELLS) -> Model:
    """Learn from (doc_id, text, lang). ``sample`` bounds the number of texts of a language (None: all of them)."""
    usable = labelled.select("doc_id", "text", "lang").filter("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    shift = 0
    while (BUCKETS >> shift) * len(sizes) > cells and BUCKETS >> shift > 1:
        shift += 1
    buckets = BUCKETS >> shift
    if sample is not None and any(n > sample for n in sizes.values()):
        # As many rows as languages, which the matrix bounds.
        rates = labelled.sparkSession.createDataFrame([(x, sample / n) for x, n in sizes.items()], "lang string, _rate double")
        u = unit_hash(F.col("doc_id"), F.xxhash64("text"), seed=5)
        usable = usable.join(F.broadcast(rates), "lang").filter(u < F.col("_rate"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if LETTER.search(text):
                    mine = sums.setdefault(lang, np.zeros(buckets, np.int64))
                    for part in pieces(text):
                        mine += np.bincount(ngram_buckets(part) >> shift, minlength=buckets)
        for lang, mine in sums.items():
            at = np.flatnonzero(mine)
            yield pa.RecordBatch.from_pydict(
                {"lang": pa.array([lang] * len(at), pa.string()), "bucket": pa.array(at, pa.int32()), "n": pa.array(mine[at], pa.int64())}
            )

    counted = (
        usable.select("text", "lang").mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    )
    table = counted.toArrow()
    languages = sorted(set(table.column("lang").to_pylist()))
    counts = np.zeros((buckets, len(languages)), np.int64)
    place = {x: i for i, x in enumerate(languages)}
    counts[table.column("bucket").to_numpy(), [place[x] for x in table.column("lang").to_pylist()]] = table.column("n").to_numpy()
    return Model(languages, counts)


def identify(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) of (doc_id, text)."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            found = model.score(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([p for _, p in found], pa.float64())],
                names=["doc_id", "lang_pred", "score"],
            )

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(predict, SCHEMA)
