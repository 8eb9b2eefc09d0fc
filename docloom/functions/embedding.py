"""Offline stand-in for an embedding model: signed word hashing.

It has the shape of a model's output (fixed width, unit length), not its meaning.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions.text import word_runs

WIDTH = 64


def _place(term: str) -> tuple[int, int]:
    digest = hashlib.md5(term.encode()).digest()
    return digest[0] % WIDTH, -1 if (digest[1] >> 4) & 1 else 1


# Words that are hashed at a time (more only if one text holds more): a batch of long texts takes no more
# memory than one of short ones.
STEP_WORDS = 1 << 18


@F.arrow_udf(T.ArrayType(T.FloatType()))
def _hash_words(tokens: pa.Array) -> pa.Array:
    ends = tokens.offsets.to_numpy()
    parts, first = [], 0
    while first < len(tokens):
        last = max(int(np.searchsorted(ends, ends[first] + STEP_WORDS, "right")) - 1, first + 1)
        parts.append(_hashed(tokens.slice(first, last - first)))
        first = last
    return pa.concat_arrays(parts) if parts else _hashed(tokens)


def _hashed(tokens: pa.Array) -> pa.Array:
    n = len(tokens)
    lengths = np.diff(tokens.offsets.to_numpy())
    rows = np.repeat(np.arange(n), lengths)
    coded = tokens.flatten().dictionary_encode()
    places = np.array([_place(x) for x in coded.dictionary.to_pylist()], dtype=np.int64).reshape(-1, 2)
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    cells = rows * WIDTH + places[codes, 0]
    sums = np.bincount(cells, places[codes, 1], minlength=n * WIDTH).reshape(n, WIDTH)
    norm = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
    unit = np.divide(sums, norm, out=np.zeros_like(sums), where=norm > 0).astype(np.float32)
    return pa.ListArray.from_arrays(np.arange(0, (n + 1) * WIDTH, WIDTH, dtype=np.int32), unit.ravel())


def hashed_embedding(text: Column) -> Column:
    return _hash_words(word_runs(F.lower(text)))
