import pytest

EXTRA = ", score double, line string, h bigint, rank int, bucket int"


@pytest.fixture(scope="session")
def docs(spark):
    """Makes a documents table with extra columns of clashing names from (doc_id, text[, source]) rows."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s0", len(r[1] or ""), 0.5, "x", 7, 1, 2) for r in rows]
        return spark.createDataFrame(full, "doc_id bigint, text string, lang string, source string, n_chars bigint" + EXTRA).repartition(3)

    return make


ODD = [(1, None), (2, ""), (3, "a"), (4, "word " * 30000), (5, "a"), (5, "a"), (None, "no id here"), (None, None), (7, "\u00e9\u4e2d\U0001f600 x"), (8, " \n\t ")]


@pytest.fixture
def odd(docs):
    return docs(ODD)


@pytest.fixture
def empty(docs):
    return docs([(1, "x")]).where("doc_id > 5")
