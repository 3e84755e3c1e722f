import pytest


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


DOCS = "doc_id long, text string, lang string, source string, n_chars long, lines string, score double, h0 long"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns named like the operators' own."""
    long = "wörter und mehr " * 20_000
    rows = [(1, None), (2, ""), (3, "  \n \n"), (4, "One two three four five six seven."), (4, "One two three four five six seven."), (None, "One two three four five six seven."), (None, None), (5, long), (6, long + "x"), (7, "!!! ???"), (8, "a"), (9, "İstanbul ﬁ 𝔘 \x00 token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\" end")]
    return spark.createDataFrame([(i, t, None, None if i == 4 else "src", None if t is None else len(t), "x", 0.5, 7) for i, t in rows], DOCS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
