"""Small tables with every hard case: nulls, empty and long texts, ties, repeated rows, clashing names."""

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
# Names the operators use themselves.
CLASHES = ["key", "size", "n_words", "score", "digest", "spans", "items", "start", "kept", "lines", "label", "minima"]

PROSE = " ".join(f"word{i % 37} tail{i % 11} stem{i % 23}" for i in range(60))
LONG = "\n".join(f"row {i} of a very long text with number {i * 7919 % 10007}" for i in range(20_000))


@pytest.fixture(scope="session")
def hard_rows():
    return [
        (1, PROSE, "en", "a", 1), (2, PROSE, "en", "b", 1), (3, PROSE + " more words here", "en", None, 1),
        (4, None, None, "a", None), (5, "", "en", "a", 0), (6, " \n\t ", "en", "a", 4),
        (7, LONG, "en", "b", len(LONG)), (8, "short one", None, None, 9), (8, "short one", None, None, 9),
        (9, "tie a", "en", "c", 5), (9, "tie b", "en", "c", 5), (None, "no id " + PROSE[:80], "en", "a", 1),
        (None, None, None, None, None), (10, "élan Überfluß 日本語 mañana’s end", "fr", "", 3),
    ]


@pytest.fixture(scope="session")
def hard(spark, hard_rows):
    return spark.createDataFrame(hard_rows, SCHEMA)


@pytest.fixture(scope="session")
def clashing(spark, hard):
    from pyspark.sql import functions as F

    return hard.select("*", *[F.lit("x").alias(c) for c in CLASHES])


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
