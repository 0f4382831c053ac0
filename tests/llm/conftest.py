import pytest

EXTRA = ", text_hash string, __row string, n int"


@pytest.fixture
def documents(spark):
    """Makes documents, with further columns whose names clash with those that operators make."""

    def make(rows):
        full = [(i, t, lang, source, None if t is None else len(t), "x", "y", 1) for i, t, lang, source in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long" + EXTRA).repartition(3)

    return make


@pytest.fixture
def odd(documents):
    """Nulls in every column, empty and long texts, ties and repeated rows."""
    long = " ".join(f"word{i % 997}x{i}" for i in range(20_000))
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, " \t\n", "en", None), (4, long, "en", "a"), (5, long, "en", "b"), (5, long, "en", "b"), (None, "One text without an id stands here with ten words.", None, "a"), (7, "One", "fr", "a"), (8, "…!? 123", "fr", "a")]
    return documents(rows)


@pytest.fixture
def nothing(documents):
    return documents([])
