import pytest

TEXTS = [
    (1, "plain words that say little, and then some more of them to have a few shingles here", "en", "a"),
    (2, None, "en", "a"),
    (3, "", "en", None),
    (4, "write to ann@example.com or call +1 (212) 555-0100 now", None, "b"),
    (4, "write to ann@example.com or call +1 (212) 555-0100 now", None, "b"),
    (5, "x" * 5000, "en", "b"),
    (6, ("long text with many words repeated again " * 400).strip(), "en", "a"),
    (7, "plain words that say little, and then some more of them to have a few shingles here", "en", "a"),
    (None, "a row without an id", "en", "a"),
    (8, "é漢字😀 und ß ẞ İ ÀÉ\x00\x0b\xa0 x", "de", "a"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, keys string, spans string, id string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, columns with clashing names."""
    return spark.createDataFrame([(*r, len(r[1]) if r[1] is not None else None, "s", None, "p", "q") for r in TEXTS], SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
