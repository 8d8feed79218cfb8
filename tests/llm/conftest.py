import pytest
from pyspark.sql import types as T

DOC = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("score", T.StringType()), ("_items", T.IntegerType()), ("n_words", T.IntegerType()))])


@pytest.fixture
def docs(spark):
    """Builds documents from (id, text[, lang, source]), with extra columns of clashing names."""

    def make(*rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", "extra", 7, 9) for r in rows]
        return spark.createDataFrame(full, DOC)

    return make
