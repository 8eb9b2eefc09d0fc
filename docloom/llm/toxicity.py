"""Toxicity by compression distance.

Two zstandard dictionaries are trained: one on windows of ordinary text, one on the toxic text
that sets it apart (the words much more frequent in toxic documents). A window is compressed once
with the ordinary dictionary and once with the toxic one laid before it; the bytes saved by the
toxic dictionary are the window's gain. Both see the same ordinary text at the same places, so
ordinary windows gain nothing. Thresholds are calibrated: every gain has the log-odds that labelled
windows show for it. A document is described by its largest gains and the sum of its windows'
evidence; a logistic fit and an isotonic fit on rows kept apart turn that into a score.

Training takes at most about ``SAMPLE`` labelled documents of at most ``SAMPLE_TEXT`` characters,
chosen by a hash of their id; they are what the driver gets. Scoring takes every window of every
text in the tasks; the model that is broadcast has a fixed size.

Edge cases: null and empty texts are one empty window; rows without a label or id are not learned
from; an id with several labels is toxic if one of them is 1; without both classes every score
is the share of toxic rows (0.5 without rows); repeated rows get equal scores. Other columns are
left out of the result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from docloom.llm.calibrate import calibrated, isotonic
from docloom.llm.common import text_runs, unit_hash

WINDOW = 128
ORDINARY_BYTES = 440_000
TOXIC_BYTES = 3_072
ORDINARY_WINDOWS = 80_000
SAMPLE = 9_000
SAMPLE_TEXT = 1 << 17
LEVEL = 6  # lower ones index a dictionary at some places only and miss short words
# A word is toxic training text if it is in so many toxic documents, and so many times as
# frequent there as in ordinary ones.
LIFT_SHARE = 0.008
LIFT = 15.0
GAINS = 24
RUN_BYTES = 4 << 20
# Dictionaries are cut to whole steps, so that the ordinary text has the same alignment in both.
STEP = 24


def windows(text: bytes) -> list[bytes]:
    """The whole text in pieces of at most WINDOW bytes, cut at blanks where there are any."""
    if len(text) <= WINDOW:
        return [text]
    out, start, end = [], 0, len(text)
    while end - start > WINDOW:
        cut = text.rfind(b" ", start + 1, start + WINDOW)
        cut = cut if cut > start else start + WINDOW
        out.append(text[start:cut])
        start = cut
    out.append(text[start:])
    return out


def trained(samples: list[bytes], size: int, segment: int) -> bytes:
    """Content of a trained dictionary, in whole steps; short training text is its own dictionary."""
    joined = b"".join(samples)
    try:
        if len(joined) < 8 * size or len(samples) < 16:
            raise zstandard.ZstdError("too little text to train on")
        content = zstandard.train_dictionary(size, samples, level=LEVEL, k=segment, d=8 if segment >= 24 else 6).as_bytes()
        content = content[400:]  # the tables before the content
    except zstandard.ZstdError:
        content = joined[-size:]
    return content[len(content) % STEP :]


class Model:
    """Both dictionaries, the log-odds of gains, logistic weights and calibration knots."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.ordinary, self.toxic = ordinary, toxic
        self.evidence = np.zeros(GAINS)
        self.weights = np.zeros(0)
        self.knots = isotonic(np.zeros(0), np.zeros(0))
        self._packers = None

    def __getstate__(self):
        return {**self.__dict__, "_packers": None}

    def packers(self):
        if self._packers is None:
            made = []
            for content in (self.ordinary, self.toxic + self.ordinary):
                options = zstandard.ZstdCompressionParameters.from_level(
                    LEVEL, source_size=WINDOW, dict_size=len(content), min_match=4, hash_log=18, chain_log=18,
                    window_log=20, write_content_size=False, write_checksum=False, write_dict_id=False,
                )
                words = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                words.precompute_compress(compression_params=options)
                made.append(zstandard.ZstdCompressor(compression_params=options, dict_data=words))
            self._packers = made
        return self._packers

    def gains(self, text: bytes) -> np.ndarray:
        """How many times each gain (clipped to 0 to GAINS - 1) occurs among the text's windows."""
        plain, toxic = (p.compress for p in self.packers())
        pieces = windows(text.lower())
        saved = np.fromiter((len(plain(w)) - len(toxic(w)) for w in pieces), np.int64, len(pieces))
        return np.bincount(np.clip(saved, 0, GAINS - 1), minlength=GAINS)

    def features(self, counts: np.ndarray) -> np.ndarray:
        """Of (documents x gains) counts: the three largest gains, evidence, and size."""
        n = counts.sum(axis=1)
        above = np.cumsum(counts[:, ::-1], axis=1)
        top = [GAINS - 1 - (above >= k).argmax(axis=1) for k in (1, 2, 3)]
        top = [np.where(n >= k, t, 0) for k, t in zip((1, 2, 3), top)]
        strong = counts @ np.where(self.evidence > 0, self.evidence, 0)
        return np.column_stack([*top, np.sqrt(strong), counts @ self.evidence / np.sqrt(n), np.log1p(strong / n), np.log1p(n), np.ones(len(n))])

    def raw(self, counts: np.ndarray) -> np.ndarray:
        return self.features(counts) @ self.weights if len(self.weights) else np.zeros(len(counts))

    def score(self, counts: np.ndarray) -> np.ndarray:
        return calibrated(self.raw(counts), self.knots)


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-2) -> np.ndarray:
    """Newton steps for ridge logistic regression."""
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + penalty * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w)), gradient)
        w -= np.clip(step, -5, 5)
    return w


def toxic_words(toxic: list[bytes], ordinary: list[bytes]) -> set[bytes]:
    """Words that set toxic documents apart from ordinary ones."""
    here, there = (Counter(w for t in texts for w in set(t.split())) for texts in (toxic, ordinary))
    least = max(2.0, LIFT_SHARE * len(toxic))
    return {w for w, n in here.items() if n >= least and n / len(toxic) >= LIFT * (there[w] + 0.5) / len(ordinary)}


def learned(rows: list[tuple[bytes, int, float]]) -> Model:
    """A model from (text, label, unit hash) rows; a quarter of them, by hash, is kept for calibration."""
    fit = [(t.lower(), y) for t, y, u in rows if u >= 0.25]
    toxic, ordinary = [t for t, y in fit if y], [t for t, y in fit if not y]
    if not toxic or not ordinary:
        model = Model(b"", b"")
        share = float(np.mean([y for _, y, _ in rows])) if rows else 0.5
        model.knots = (np.array([0.0]), np.array([share]))
        return model
    rng = np.random.default_rng(3)
    # The dictionaries take two thirds of each class, the evidence of gains the rest.
    cut_t, cut_o = -(-len(toxic) * 2 // 3), -(-len(ordinary) * 2 // 3)
    words = toxic_words(toxic[:cut_t], ordinary[:cut_o])
    said = [b" " + w + b" " for t in toxic[:cut_t] for w in t.split() if w in words]
    plain = [w for t in ordinary[:cut_o] for w in windows(t)]
    if len(plain) > ORDINARY_WINDOWS:
        plain = [plain[i] for i in np.sort(rng.permutation(len(plain))[:ORDINARY_WINDOWS])]
    model = Model(trained(plain, ORDINARY_BYTES, 32), trained([b"".join(said[i : i + 4]) for i in range(0, len(said), 4)], TOXIC_BYTES, 16))
    rest = toxic[cut_t:] or toxic, ordinary[cut_o:] or ordinary
    seen = [np.array([model.gains(t) for t in texts]) for texts in rest]
    odds = [s.sum(axis=0) + 0.5 for s in seen]
    model.evidence = np.clip(np.log(odds[0] / odds[0].sum()) - np.log(odds[1] / odds[1].sum()), -5, 5)
    x = model.features(np.vstack(seen))
    y = np.repeat([1.0, 0.0], [len(rest[0]), len(rest[1])])
    model.weights = logistic(x, y)
    kept = [(t, y) for t, y, u in rows if u < 0.25]
    if not kept:
        kept = [(t, y) for t, y, _ in rows]
    model.knots = isotonic(model.raw(np.array([model.gains(t) for t, _ in kept])), np.array([float(y) for _, y in kept]))
    return model


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, sample: int) -> DataFrame:
    """(text, label, u) of at most about ``sample`` labelled documents. The chosen ids are bounded by
    ``sample``, so they are broadcast and no text is shuffled."""
    known = (
        labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        .groupBy("doc_id")
        .agg(F.max(F.col(label).cast("int")).alias("label"))
    )
    total = known.count()
    if total > sample:
        known = known.filter(unit_hash(F.col("doc_id"), seed=11) < sample / total)
    chosen = known.select(F.col("doc_id").alias("_id"), "label")
    texts = documents.select("doc_id", "text").filter(F.coalesce(F.length("text"), F.lit(0)) <= SAMPLE_TEXT)
    return (
        texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
        .select(F.coalesce(F.col("text"), F.lit("")).alias("text"), "label", unit_hash(F.col("doc_id"), seed=13).alias("u"), "doc_id")
    )


def fit(documents: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE) -> Model:
    """Learn from the labelled documents among ``documents``."""
    table = labelled_sample(documents, labels, label, sample).toArrow()
    rows = zip(*(table.column(c).to_pylist() for c in ("doc_id", "u", "text", "label")))
    return learned([(t.encode(), y, u) for _, u, t, y in sorted(rows)])


def with_toxicity(documents: DataFrame, model: Model, name: str = "score", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (None: all) of every row of ``documents``, and the score of its whole text."""
    kept = [c for c in (keep or documents.columns) if c != name]
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_runs(batch, "text", RUN_BYTES):
                score = shared.value.score(np.array([shared.value.gains(t) for t in texts]))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(score, pa.float64())], names=[*kept, name])

    schema = StructType([*documents.select(*kept).schema, StructField(name, DoubleType())])
    return documents.select(*dict.fromkeys([*kept, "text"])).mapInArrow(predict, schema)
