import pytest

#: Rows that every operator must take: nulls in any column, no words, one word, long texts, ties and repeated rows.
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog", "en", "a", 5),
    (2, "The Quick brown fox jumps over the lazy dog", "en", "a", 5),
    (2, "The Quick brown fox jumps over the lazy dog", "en", "a", 5),
    (3, None, "en", None, None),
    (4, "", None, "b", 0),
    (5, " \t\n\x0b\x0c\r ", "fr", "b", 6),
    (6, "word", "fr", "c", 4),
    (7, "é £ 日本語 \x1c <|endoftext|> ###", "fr", "c", None),
    (8, "line one is here\nline one is here\nanother line\n\n", "en", None, 3),
    (9, "a b c d e a b c d e a b c d e", "en", "a", 3),
    (None, "a null id with some words in it", None, "a", 1),
    (10, "long " * 30000 + "tail", "en", "b", 1),
    (11, "x" * 5000, "en", "b", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """The rows, with extra columns named like the operators' own."""
    d = spark.createDataFrame(ROWS, SCHEMA)
    for c in ("score", "rep", "key", "tid", "k1", "n", "rank", "run", "_id", "kept", "size", "features", "node", "component", "chunk", "_size", "_source", "_of_source", "_mix", "_t", "_copy", "_out", "_row", "_gone", "h", "words", "a", "b", "low", "least", "row"):
        d = d.selectExpr("*", f"'extra' as {c}")
    return d.cache()


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 0), (2, 1, 0), (9, 0, 0), (None, 1, 0), (6, None, 0)], "doc_id long, quality int, toxic int")
