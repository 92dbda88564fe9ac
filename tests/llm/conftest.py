import pytest


@pytest.fixture
def docs_of(spark):
    """documents of (doc_id, text) pairs, with the other columns and some that clash."""

    def make(rows, extra=True):
        schema = "doc_id long, text string, lang string, source string, n_chars long" + (", row long, key string, at int, kept string, n int, line long" if extra else "")
        more = (1, "k", 2, "x", 3, 4) if extra else ()
        return spark.createDataFrame([(d, t, "en" if d is None or d % 2 else None, "s", None if t is None else len(t), *more) for d, t in rows], schema)

    return make


#: Nulls, empty and blank texts, ties, repeated rows, a very long text.
ODD = [(1, None), (2, ""), (3, " \n\t\n"), (None, "a text without an id, with a few words in it"), (4, "word " * 40_000), (5, "same text here, of some words"), (5, "same text here, of some words"), (6, "same text here, of some words"), (7, "é漢字😀 \x1c\x85\xa0 x")]


@pytest.fixture
def odd():
    return list(ODD)
