from __future__ import annotations

import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

#: documents, with a column that clashes with names the operators add
DOCS = StructType(
    [
        StructField("doc_id", LongType()),
        StructField("text", StringType()),
        StructField("lang", StringType()),
        StructField("source", StringType()),
        StructField("n_chars", LongType()),
        StructField("score", StringType()),
    ]
)


@pytest.fixture(scope="session")
def make_docs(spark):
    """Rows from (doc_id, text[, lang[, source]]) tuples."""

    def make(rows):
        full = [(*r, *(None,) * (4 - len(r)), len(r[1]) if r[1] is not None else None, "x") for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make
