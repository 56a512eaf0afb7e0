import pytest

from leadspan.llm.texts import ready

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, _id string, _content int, _row string, size string, fp int, n int, component_id string, item string, tokens int"
EXTRA = ("x", 1, "y", "z", 2, 3, "c", "i", 4)


@pytest.fixture(scope="session")
def spark(spark):
    return ready(spark)


def rows_of(pairs, source="s"):
    return [(i, t, "en", source, len(t or ""), *EXTRA) for i, t in pairs]


LONG = " ".join(f"word{i}" for i in range(30000))
ODD = [(1, None), (2, ""), (3, " \t\n\x0b"), (4, LONG), (5, "same words again " * 30), (5, "same words again " * 30), (None, "no id here"), (None, None), (6, "same words again " * 30), (7, "é 😀 　 x y")]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(rows_of(ODD), COLUMNS).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)
