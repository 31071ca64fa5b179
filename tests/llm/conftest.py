import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def docs(spark):
    """Makes a document table from (id, text) or (id, text, lang, source) rows, with extra columns that clash with results."""

    def make(rows, extra=False):
        full = [(r[0], r[1], *(r[2:] if len(r) > 2 else ("en", "s0")), len(r[1]) if r[1] is not None else None) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        return df.selectExpr("*", "'x' AS score", "1 AS findings", "2 AS n_words", "3 AS component_id", "4 AS ids") if extra else df

    return make
