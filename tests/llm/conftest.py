import glob
import os

import duckdb
import pytest

SCHEMA = (
    "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT, id STRING, key STRING, hashes STRING, next STRING, comp STRING,"
    " a STRING, b STRING, n_shingles STRING, length STRING, tree STRING, kept STRING, component_id STRING, grade STRING, idx STRING, row STRING"
)
LONG = " ".join(f"word{i % 977} thing{i % 31}" for i in range(60_000))
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog. It was happy.\nAnd then it slept.", "en"),
    (2, "The quick  brown fox jumps over the lazy dog. It was happy.\n\nAnd then it slept.", "en"),
    (3, "Der schnelle braune Fuchs springt. Er war froh.", "de"),
    (4, None, "en"), (5, "", None), (6, " \t\n", None), (7, "12 34 !!", None),
    (8, LONG, "en"), (9, LONG + " end", "en"), (10, "x" * 50_000, None),
    (11, "one two three", "en"), (12, "one two three", "en"), (12, "one two three", "en"),
    (None, "one two three", "en"), (13, "ONE Two three", None),
]


def edge_rows():
    return [(i, t, lang, "s", None if t is None else len(t), *["clash"] * 15) for i, t, lang in TEXTS]


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Documents with nulls, empty and very long texts, ties, repeated rows, and columns whose names clash with inner ones."""
    return spark.createDataFrame(edge_rows(), SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con
