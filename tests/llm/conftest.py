import pytest


@pytest.fixture
def docs(spark):
    """rows of (doc_id, text, lang, source) -> documents with n_chars and a column whose name clashes with results'."""

    def make(rows):
        full = [(i, t, lang, source, None if t is None else len(t), "x") for i, t, lang, source in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, kept string")

    return make


@pytest.fixture
def odd_texts():
    """Texts that operators must bear: null, empty, blank, short, long, with marks, repeated."""
    return [None, "", " \t\n ", "one", "a b c d", "ẞ İ ï 漢字 e\u0301", "word " * 3000, "x" * 20000, "a\n\na\nb\nb", "same same same", "same same same"]
