import pytest


@pytest.fixture()
def docs(spark):
    """A table with every odd row: nulls in each column, empty and long texts, repeated rows, an extra column named like the operators' own."""

    def make(rows, extra=True):
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
        return df.selectExpr("*", "'x' AS size", "1 AS length", "'y' AS spans", "2 AS component_id", "3 AS quality", "4 AS node") if extra else df

    return make
