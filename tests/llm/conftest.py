import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Rows (id, text, source) as a table of documents."""
    def make(rows):
        return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)
    return make


def words(n, start=0):
    return " ".join(f"w{start + k}x" for k in range(n))


#: Nulls, empty texts, repeated rows and ids, a very long word and a long text.
ODD = [(1, None, "a"), (2, "", "a"), (3, " \t\n", None), (None, words(40), "b"), (None, None, None), (5, words(40), "b"),
       (5, words(40), "b"), (5, words(30, 100), "c"), (7, "x" * 70_000, "c"), (8, words(9000), "c"), (9, words(3), "a"),
       (10, words(3), "a"), (11, "Ünï 日本 ▁ code", "b")]


@pytest.fixture(scope="session")
def odd(documents):
    return documents(ODD)
