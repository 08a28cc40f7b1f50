import pytest

LONG = ("word " * 40_000).strip()
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog. " * 5, "en", "a", 225),
    (2, None, None, None, None),
    (3, "", "en", "a", 0),
    (4, " \n\t ", "en", "b", 4),
    (5, "The quick brown fox jumps over the lazy dog. " * 5, "en", "a", 225),
    (5, "The quick brown fox jumps over the lazy dog. " * 5, "en", "a", 225),
    (None, "a row without an id but with some words in it", "en", "a", 45),
    (7, LONG, "en", "b", len(LONG)),
    (8, "漢字 é😀 ▁ token = \"24be64439e3e49cf46b2d7c90f3602a3\" <|endoftext|> ﷺ", "de", "b", 60),
    (9, "x" * 5000, "de", "c", 5000),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows."""
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="session")
def clash(odd):
    """The same with extra columns under names that the operators use inside or return."""
    from pyspark.sql import functions as F

    return odd.withColumns({c: F.lit("extra") for c in ("key", "rep", "bucket", "label", "score", "ids", "piece_ids", "n_pieces", "_host", "_boilerplate", "host", "lines", "n_dropped", "bands", "id", "component", "spans", "start", "copies", "p", "hashes", "kept", "a.b", "part", "segment", "phrase", "words", "term", "n", "labels")})


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
