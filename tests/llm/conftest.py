import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          "score double, size long, label string, fp long, `copies` int")


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, clashing extra columns."""
    long_text = "The river ran past the old mill and the quiet town. " * 8000
    rows = [
        (1, "Call me at +1 (212) 555-0123 or bob@mail.example.com now please", "en", "a"),
        (2, "", "en", "a"), (3, None, "en", None), (4, " \t\n ", None, "b"), (5, long_text, "en", "a"),
        (6, "x" * 20000, "en", None), (7, "7" * 20000, None, "b"), (8, "@" * 5000 + "." * 5000, "de", "b"),
        (None, "a text without an id", "en", "a"), (9, "one", "fr", "c"), (9, "one", "fr", "c"),
        (10, "Grüße aus Köln 🙂     \x1c end", "de", "\U0001F600"), (11, "日本語のテキスト", "ja", ""),
        (12, "12 34 5678", "es", "c"), (13, "the river ran past the old mill", None, None),
        (14, "the river ran past the old mill", "en", "b"),
    ]
    rows = [r + (None, 0.5, 3, "x", 1, 2) for r in rows] + [(None,) * 10]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small_docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def sf_tables(tmp_path_factory):
    """Writes a documents table into a folder of its own and returns the folder."""
    def write(docs):
        path = str(tmp_path_factory.mktemp("sf"))
        docs.write.parquet(f"{path}/documents.parquet")
        return path
    return write
