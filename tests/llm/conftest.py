import pytest


@pytest.fixture
def docs(spark):
    """Documents with odd rows: null, empty, blank, repeated, tied, and columns that clash with results."""

    def make(rows, more=True):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        return df.selectExpr("doc_id", "text", "'s' AS source", "7 AS kept", "8 AS score", "9 AS shard", "'x' AS keep_id") if more else df

    return make
