import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SF = "/root/testdata/sf0.001"
DOC_SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
              "n_words int, key string, bucket int, doc string, mark int, word string, `row` int, kept string, piece int")


def edge_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing extra columns."""
    prose = "The quick brown fox jumps over the lazy dog near the old river bank, and then it sleeps. " * 4
    extra = (1, "k", 2, "d", 3, "w", 4, "x", 5)
    none = (None,) * 9
    rows = [
        (1, prose, "en", "s", len(prose), *extra),
        (1, prose, "en", "s", len(prose), *extra),          # a repeated row
        (1, "another text under the same id, short.", "en", "s", 38, *extra),
        (2, prose, "en", None, None, *none),                 # an exact copy
        (3, None, "en", "s", None, *extra),
        (4, "", "de", "s", 0, *extra),
        (None, "text without an id password=ed4186779a4aeb1eeb here", None, None, None, *none),
        (None, "text without an id password=ed4186779a4aeb1eeb here", None, None, None, *none),
        (None, None, None, None, None, *none),
        (5, "1234 !!! 5678", "en", "s", 13, *extra),         # no letter
        (6, "\n\n \t\n", "en", "s", 5, *extra),
        (7, "word " * 40_000, "en", "s", 200_000, *extra),   # very long, one word
        (8, "x" * 60_000, "fr", "s", 60_000, *extra),        # a single very long word
        (9, "Ein kurzer Text mit Umlauten: äöü ÄÖÜ ß und 日本語 😀.", "de", "s", 50, *extra),
        (-3, prose.replace("lazy", "sleepy"), "en", "s", 1, *extra),
    ]
    return rows


@pytest.fixture(scope="session")
def edges(spark):
    return spark.createDataFrame(edge_rows(), DOC_SCHEMA)


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def doc_rows(docs):
    return docs.collect()
