import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs_of(spark):
    """documents from (doc_id, text) or full rows, with an extra column whose name clashes with inner ones."""

    def make(rows, extra=False):
        full = [(*r, *(None, None, None)[len(r) - 2 :]) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        return df.selectExpr("*", "doc_id as fp", "text as size", "1 as key", "2 as target") if extra else df

    return make
