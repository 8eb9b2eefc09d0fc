import random

import pytest
from pyspark.sql import functions as F

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def sort_key(row):
    return tuple((x is not None, x if not isinstance(x, list) else str(x)) for x in row)


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls in every column, empty and very long texts, repeated rows and near copies."""
    rng = random.Random(4)

    def text(n):
        return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 9))) for _ in range(n))

    passage, base = text(70), text(150)
    rows = [
        (1, None, "en", "a", 0),
        (2, "", "en", "a", 0),
        (3, " \n\t ", None, None, None),
        (None, text(40), "en", "b", 1),
        (None, None, None, None, None),
        (4, "12 34 !!", "fr", "b", 8),
        (5, base, "en", "a", 9),
        (6, base, "en", "c", 9),
        (6, base, "en", "c", 9),
        (7, base.upper(), "en", "c", 9),
        (8, base + " x", "en", None, 9),
        (9, text(30) + passage + text(20), "de", "b", 9),
        (10, passage + text(5) + passage, "de", "a", 9),
        (11, "x" * 450, "de", "a", 9),
        (12, text(12_000), "es", "b", 9),
        (13, text(60), "es", "b", 9),
        (13, text(61), "es", "b", 9),
    ]
    return rows + [(i, text(rng.randrange(1, 60)), "en", rng.choice("abc"), 5) for i in range(20, 50)]


@pytest.fixture(scope="session")
def edges(spark, edge_rows):
    """The edge rows with columns whose names clash with those the operators add."""
    df = spark.createDataFrame(edge_rows, DOCUMENTS).repartition(3)
    clash = ["size", "target", "copies", "score", "fp", "id", "spans", "n_words", "longest", "key", "place", "u", "v", "label", "start"]
    return df.select("*", *[F.lit("other").alias(c) for c in clash])


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], DOCUMENTS)
