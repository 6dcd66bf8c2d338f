from __future__ import annotations

import pytest

LONG = "lorem ipsum dolor sit amet " * 4000
ROWS = [
    (1, "alpha beta gamma\nsecond line here\nthird line too", "en", "s0", 5),
    (1, "alpha beta gamma\nsecond line here\nthird line too", "en", "s0", 5),  # a repeated row
    (2, None, None, None, None),
    (3, "", "en", "s0", 0),
    (4, " \n\t ", "en", None, 3),
    (None, "no id but text, mail a@b.example", "de", "s1", 9),
    (None, None, None, None, None),
    (5, LONG, "fr", "s0", len(LONG)),
    (6, "x" * 5000, "fr", "s0", 5000),
    (7, "alpha beta gamma\nsecond line here\nthird line too\nand more words that are new", "en", "s0", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls, empty and very long texts, ties and repeated rows, and columns with clashing names."""
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    for name in ("fp", "score", "hits", "n", "chunk", "bucket", "curve", "ids", "component_id", "start", "left", "kept", "c", "d2", "all"):
        df = df.selectExpr("*", f"'clash' as {name}")
    return df


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark):
    from tests.conftest import SF

    return spark.read.parquet(f"{SF}/documents.parquet")
