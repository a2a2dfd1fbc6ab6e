import pytest

#: rows every text operator must take: nulls anywhere, empty, white space, long, ties, repeats
LONG = "alpha beta gamma delta " * 30_000
TEXTS = [
    (1, "one two three four five six seven eight nine ten", "en", "a"),
    (2, "one two three four five six seven eight nine ten", "en", "a"),
    (2, "one two three four five six seven eight nine ten", "en", "a"),
    (3, "one  two\tthree four five six seven eight nine\n ten", None, None),
    (4, None, "de", "b"),
    (5, "", "de", None),
    (6, " \n\t ", None, "b"),
    (7, LONG, "en", "a"),
    (8, LONG + "omega", "en", "a"),
    (9, "12345 67890 !!!", "fr", "c"),
    (10, "Der schnelle Fuchs läuft über die Straße", "de", "c"),
    (None, "a row without an id", "en", "c"),
    (11, "short one", None, "c"),
    (12, "SHORT one", None, "c"),
]
SCHEMA = "doc_id bigint, text string, lang string, source string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Hard rows, with further columns whose names operators use inside."""
    rows = [(*r, k, float(k), "x", k) for k, r in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA + ", id int, score double, node string, `row` int")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
