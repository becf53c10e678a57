import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents of (doc_id, text[, source]) rows, with columns whose names clash with what operators use inside."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "a", None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(full, SCHEMA).selectExpr("*", "'x' AS row", "1 AS node", "2 AS nth", "'k' AS key", "3 AS tokens", "4 AS hash")

    return make
