import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, first string, class_id string, n_words string, kept string, stratum string, stats string, shard string, score string, y string, term string, `row` string, `key` string"

GOOD = "the quick brown fox jumps over the lazy dog while a small bird sings in the old tree near our house by the river every morning of this long summer"


def rows():
    extra = ["x"] * 12
    texts = [
        (1, GOOD, "en"), (2, GOOD, "en"), (2, GOOD, "en"), (3, GOOD.replace("small", "tiny"), None), (4, None, "en"), (5, "", None), (None, "no id " + GOOD[::-1], "en"),
        (6, "   \n\t ", "fr"), (7, "word " * 30_000, "en"), (8, "x" * 200_000, "en"), (9, "mail bob@example.com or 10.0.0.1, card 4111 1111 1111 1111, call +1 (555) 123-4567 now", "en"),
        (10, "#$%&|<> " * 40, "en"), (11, "a line here\na line here\na line here\n" + GOOD, "fr"), (None, None, None), (12, "héllo wörld ünïcode — “quotes” 日本語 \U0001f600 " * 10, "de"),
    ]
    return [(i, t, lang, "s" if i else None, len(t) if t is not None else None, *extra) for i, t, lang in texts]


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, and columns named as operators name theirs."""
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def marks(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 0), (2, 0, 1), (3, None, None), (None, 1, 1), (10, 0, 1), (11, 1, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").cache()


@pytest.fixture(scope="session")
def no_marks(marks):
    return marks.limit(0)
