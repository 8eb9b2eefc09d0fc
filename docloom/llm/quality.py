"""Quality classifier: random Fourier features, ridge scores, isotonic calibration.

Every text is described by statistics of its characters, words and lines. A fixed set of random
cosines of the standardized statistics approximates a Gaussian kernel; each task sums its rows'
products into normal equations, the driver adds one matrix per task and solves for the ridge
weights. A part of the training rows is kept from the solution and used for isotonic calibration.

Training takes at most about ``sample`` labelled rows, chosen by a hash of their id, in
``FIT_TASKS`` tasks, so what the driver gets is fixed: ``FIT_TASKS`` matrices of
(FEATURES + 1) squared, and two numbers per calibration row. Scoring covers every whole text.

Edge cases: null and empty texts are described by zeros and scored like any other; rows without a
label or with a null id are not learned from; an id with several labels counts as 1 if one of them
is 1; without training rows every score is 0.5; repeated rows get equal scores. Other columns are
left out of the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from docloom.llm.calibrate import calibrated, isotonic
from docloom.llm.common import text_runs, unit_hash

FEATURES = 384
BANDWIDTH = 3.0
RIDGE = 1e-4
SAMPLE = 12_000
FIT_TASKS = 8
SEED = 7
RUN_BYTES = 4 << 20
STATISTICS = 20

_KIND = np.zeros(256, np.int64)  # 0 sign, 1 upper, 2 lower, 3 digit, 4 blank, 5 beyond ASCII
_KIND[65:91], _KIND[97:123], _KIND[48:58], _KIND[128:] = 1, 2, 3, 5
_KIND[[9, 10, 11, 12, 13, 32]] = 4


def statistics(text: bytes, packer: zstandard.ZstdCompressor) -> list[float]:
    """STATISTICS numbers about one whole text."""
    words = text.split()
    if not words:
        return [0.0] * STATISTICS
    size, n = len(text), len(words)
    bytes_of = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    sign, upper, lower, digit, blank, beyond = np.bincount(_KIND, weights=bytes_of, minlength=6)
    lines = [x for x in text.split(b"\n") if x.strip()]
    different = set(words)
    same = sum(map(bytes.__eq__, words, words[1:]))
    lengths = np.fromiter(map(len, words), np.int64, n)
    stops = int(bytes_of[46] + bytes_of[33] + bytes_of[63])
    closed = sum(x.rstrip()[-1:] in b".!?" for x in lines)
    # How far the words' variety falls short of that of a text of this length.
    variety = np.log1p(len(different)) / np.log1p(n)
    return [
        np.log1p(n),
        np.log1p(size),
        lengths.mean(),
        lengths.std(),
        np.log1p(lengths.max()),
        len(different) / n,
        variety,
        same / n,
        len(set(lines)) / len(lines),
        np.log1p(len(lines)),
        np.log1p(n / len(lines)),
        np.log1p(n / (stops + 1)),
        closed / len(lines),
        sign / size,
        upper / size,
        lower / size,
        digit / size,
        beyond / size,
        (sign - bytes_of[44] - bytes_of[46]) / n,
        np.log((len(packer.compress(text)) + 16) / (size + 16)),
    ]


def described(text_batch: list[bytes]) -> np.ndarray:
    packer = zstandard.ZstdCompressor(level=1)
    return np.array([statistics(t, packer) for t in text_batch], np.float64).reshape(-1, STATISTICS)


class Model:
    """Standardization, random cosines, ridge weights and calibration knots."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.mean, self.scale = mean, scale
        self.directions = rng.normal(size=(len(mean), FEATURES)) / BANDWIDTH
        self.phases = rng.uniform(0, 2 * np.pi, FEATURES)
        self.weights: np.ndarray | None = None
        self.knots = isotonic(np.zeros(0), np.zeros(0))

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -8, 8)
        waves = np.sqrt(2 / FEATURES) * np.cos(z @ self.directions + self.phases)
        return np.hstack([waves, np.ones((len(z), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return np.zeros(len(stats)) if self.weights is None else self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return calibrated(self.raw(stats), self.knots)


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, text, label) of at most about ``sample`` labelled documents.

    The chosen labels are bounded by ``sample``, so they are broadcast and no text moves.
    """
    known = (
        labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        .groupBy("doc_id")
        .agg(F.max(F.col(label).cast("double")).alias("label"))
    )
    total = known.count()
    if total > sample:
        known = known.filter(unit_hash(F.col("doc_id"), seed=11) < sample / total)
    chosen = known.select(F.col("doc_id").alias("_id"), F.col("label"))
    texts = documents.select("doc_id", "text")
    return texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "label")


def fit(training: DataFrame) -> Model:
    """Learn from the bounded (doc_id, text, label)."""
    n = STATISTICS

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_runs(batch, "text", RUN_BYTES):
                stats = described(texts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(stats), pa.list_(pa.float64())), part.column("label"), part.column("held")], names=["stats", "label", "held"]
                )

    held = (unit_hash(F.col("doc_id"), seed=SEED) < 0.25).alias("held")
    rows = training.select("text", "label", held).mapInArrow(describe, "stats array<double>, label double, held boolean")
    rows = rows.repartition(FIT_TASKS).persist()

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * n + 1)
        for batch in batches:
            x = np.array(batch.column(0).to_pylist(), np.float64).reshape(-1, n)
            total += np.concatenate([x.sum(axis=0), (x * x).sum(axis=0), [len(x)]])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    sums = sum((np.frombuffer(r[0]) for r in rows.select("stats").mapInArrow(moments, "sums binary").collect()), np.zeros(2 * n + 1))
    count = max(sums[-1], 1.0)
    mean = sums[:n] / count
    spread = np.sqrt(np.maximum(sums[n : 2 * n] / count - mean**2, 0))
    model = Model(mean, np.where(spread > 1e-9, spread, 1.0))
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, moment = np.zeros((FEATURES + 1, FEATURES + 1)), np.zeros(FEATURES + 1)
        for batch in batches:
            x = shared.value.features(np.array(batch.column(0).to_pylist(), np.float64).reshape(-1, n))
            gram += x.T @ x
            moment += x.T @ batch.column(1).to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array([gram.tobytes()], pa.binary()), pa.array([moment.tobytes()], pa.binary())], names=["gram", "moment"])

    parts = rows.filter("NOT held").select("stats", "label").mapInArrow(equations, "gram binary, moment binary").collect()
    gram = sum((np.frombuffer(p[0]) for p in parts), np.zeros((FEATURES + 1) ** 2)).reshape(FEATURES + 1, -1)
    moment = sum((np.frombuffer(p[1]) for p in parts), np.zeros(FEATURES + 1))
    if gram[-1, -1] > 0:
        penalty = RIDGE * gram[-1, -1] * np.eye(FEATURES + 1)
        penalty[-1, -1] = 1e-9
        model.weights = np.linalg.solve(gram + penalty, moment)
    kept = rows.filter("held").select("stats", "label").toArrow()
    if kept.num_rows and model.weights is not None:
        model.knots = isotonic(model.raw(np.array(kept.column(0).to_pylist(), np.float64)), kept.column(1).to_numpy())
    elif model.weights is not None:
        model.knots = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    rows.unpersist()
    return model


def with_score(documents: DataFrame, model: Model, name: str = "score", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (None: all) of every row of ``documents``, and the score of its text."""
    kept = [c for c in (keep or documents.columns) if c != name]
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_runs(batch, "text", RUN_BYTES):
                score = shared.value.score(described(texts))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(score, pa.float64())], names=[*kept, name])

    schema = StructType([*documents.select(*kept).schema, StructField(name, DoubleType())])
    return documents.select(*dict.fromkeys([*kept, "text"])).mapInArrow(predict, schema)
