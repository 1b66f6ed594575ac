import pytest

#: A documents table with every odd case: nulls, empty and blank texts, a very long one, repeated
#: rows, equal ids with different texts, and columns whose names clash with inner ones.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, node string, digest int, `__id` int, pii_spans string, kind string"


@pytest.fixture(scope="session")
def odd(spark):
    long = " ".join(f"word{i % 997} tail{i % 1009}" for i in range(40_000))
    base = " ".join(f"alpha{i} beta{i % 7}" for i in range(60))
    texts = [
        (1, None), (2, ""), (3, " \t\n "), (4, "one two"), (4, "one two"), (5, long), (6, base), (7, base + " end"), (8, base), (8, base),
        (9, "A B c"), (10, "a b C"), (None, base + " other end here"), (None, "alone with no id at all"), (11, base), (12, "é ü ß 漢字 \U0001f600 " * 30), (6, "same id but another text"),
    ]
    rows = [(i, t, "en", "s", len(t or ""), 5, "n", 1, 2, "x", "k") for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
