import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """A table of documents from texts (or pairs of id and text), with the other columns filled in."""

    def made(*texts, **over):
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        full = [(i, t, over.get("lang", "en"), over.get("source", f"s{k % 3}"), None if t is None else len(t)) for k, (i, t) in enumerate(rows)]
        return spark.createDataFrame(full, SCHEMA)

    return made


ODD = [None, "", " ", "\n\t\x0b", "one", "Ünï çödé 日本 ", "same words here", "same words here", "a" * 5000, "x y " * 4000, "\x00\x1c\x85  b"]


@pytest.fixture
def odd():
    """Null, empty, blank, repeated, very long and unusual texts."""
    return list(ODD)
