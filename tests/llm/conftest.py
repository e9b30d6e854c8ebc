import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, _id long, key string"


@pytest.fixture
def make(spark):
    """Documents with columns whose names clash with the operators' own."""

    def docs(rows, schema=SCHEMA):
        full = [(i, t, la, s, None if t is None else len(t), "x", 7, "k") for i, t, la, s in rows]
        return spark.createDataFrame(full, schema)

    return docs
