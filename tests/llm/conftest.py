import datetime

import pytest

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Rows of (doc_id, text, source) as a documents table, with columns whose names clash with the operators' own."""

    def make(rows, path):
        full = [(i, t, "en", s, len(t or ""), "x", "y", 1) for i, t, s in rows]
        df = spark.createDataFrame(full, DOCUMENT + ", score string, name string, row int")
        df.coalesce(2).write.parquet(str(path))
        return spark.read.parquet(str(path))

    return make


@pytest.fixture
def hour():
    return datetime.timedelta(hours=1)
