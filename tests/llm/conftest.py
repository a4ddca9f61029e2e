import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, _lines string, target int"


@pytest.fixture(scope="session")
def hard(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and extra columns named as ones that operators use inside."""
    long = " ".join(f"w{i % 977}" for i in range(30000))
    rows = [(1, "a b\nc d\ne f"), (2, None), (3, ""), (4, long), (5, long), (5, long), (None, "x y z"), (6, " \n\t "), (7, "é" * 5000), (8, "one"), (9, "one")]
    return spark.createDataFrame([(i, t, None if k % 3 == 0 else "en", None if k % 4 == 0 else "s", None, 0.5, "x", 1) for k, (i, t) in enumerate(rows)], SCHEMA)


@pytest.fixture(scope="session")
def none(hard):
    return hard.where("false")
