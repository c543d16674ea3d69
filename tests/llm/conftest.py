import pytest


@pytest.fixture(scope="session")
def documents(spark):
    """Rows of (doc_id, text) as a documents table with every column."""

    def make(rows):
        rows = [(i, t, "en", "src", None if t is None else len(t)) for i, t in rows]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")

    return make


# Cases that every operator on texts must bear.
HARD = [
    (1, None),
    (2, ""),
    (3, " \t\n\x0b\x0c\r "),
    (4, "one"),
    (5, "the same few words of one short text"),
    (6, "the same few words of one short text"),
    (6, "the same few words of one short text"),
    (None, "the same few words of one short text"),
    (7, "Grüße, привет, 你好 🙂   é " * 40),
    (8, "word " * 30_000),
    (9, "x" * 70_000),
    (10, " " * 40_000 + "end"),
]


@pytest.fixture
def hard(documents):
    """Nulls, empty and very long texts, ties, repeated rows, and columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    clash = ["kept", "print", "ids", "same", "place", "label", "key", "n", "score", "_llm_kept_id2", "component_id"]
    return documents(HARD).withColumns({c: F.lit("mine") for c in clash})
