import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
# Names that the operators use for their own columns.
CLASHING = "shard int, spans string, n_words string, key string, label string, fused string, hits string, text_a string"


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and long texts, ties and repeated rows."""
    long = "word " * 30000 + "end"
    return [
        (1, "The cat sat on the mat, and the dog looked at it for a while.", "en", "a", 61),
        (1, "The cat sat on the mat, and the dog looked at it for a while.", "en", "a", 61),
        (2, "The cat sat on the mat, and the dog looked at it for a while.", "en", "b", 61),
        (3, None, "en", "a", None),
        (4, "", "de", "a", 0),
        (None, "ohne Nummer, aber mit Text", "de", None, 26),
        (None, None, None, None, None),
        (5, long, None, "a", len(long)),
        (6, " \t\n", "fr", "", 3),
        (7, "!!! ??? ***", "es", "c", 11),
        (8, "a", "en", "a", 1),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, DOCS)


@pytest.fixture(scope="session")
def clashing(spark, odd_rows):
    """The same rows with further columns under names that operators might use."""
    return spark.createDataFrame([(*r, 1, "x", "x", "x", "x", "x", "x", "x") for r in odd_rows], f"{DOCS}, {CLASHING}")


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def benchmark(spark):
    return spark.createDataFrame(
        [(1, "one two three four five six seven eight nine ten eleven"), (2, "Short item."), (3, None), (None, ""), (4, "a b c d e f g h i j")],
        "item_id bigint, text string",
    )


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 1, 1), (5, None, None)], "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def bag(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="session")
def same_with_extra_columns():
    """Rows don't depend on columns that an operator has no use for."""
    return lambda run, plain, extra: bag(run(plain)) == bag(run(extra))
