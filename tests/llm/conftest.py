import pytest

from tests.conftest import SMALL

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: names that operators use inside or for their results
EXTRA = "shard int, slot string, _doc string, _n int, _id string, _fp string, ids int, decoded int, kept boolean, score string, lang_pred string, p string, copies string, component_id string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and blank texts, ties, repeated rows, a long text, columns with clashing names."""
    long = "word " * 40_000 + "end"
    rows = [
        (1, None, "en", "s", 0),
        (2, "", "en", None, None),
        (3, " \n\t ", None, "s", 3),
        (4, "same text here", "en", "s", 5),
        (5, "same text here", "de", "t", 5),
        (5, "same text here", "de", "t", 5),
        (None, "same text here", "fr", "t", 5),
        (6, long, "en", "s", len(long)),
        (7, "日本語 <|endoftext|> ünï 😀", "xx", "s", 1),
        (8, "12345 !!! ???", "en", "s", 1),
    ]
    extra = (1, "a", "b", 2, "c", "d", 3, 4, True, "e", "f", "g", "h", "i")
    return spark.createDataFrame([r + extra for r in rows], f"{DOCS}, {EXTRA}")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SMALL}/labels.parquet")
