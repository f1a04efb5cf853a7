import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture
def documents(spark):
    """documents(rows of (doc_id, text, source)) with null and odd rows left as they are."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], DOCS)

    return make


ODD = [(None, None, None), (1, "", "a"), (1, "", "a"), (2, None, "b"), (3, "word " * 3000, "a"), (4, " \t\n ", None), (5, "same words here in this text", "b"), (6, "same words here in this text", "b")]


@pytest.fixture
def odd():
    return list(ODD)
