from __future__ import annotations

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture
def docs_of(spark):
    """Documents from texts or (id, text, lang, source) tuples; ``extra`` adds columns of any name."""

    def make(rows, extra=()):
        full = []
        for i, row in enumerate(rows):
            key, text, lang, source = row if isinstance(row, tuple) else (i, row, "en", "s")
            full.append((key, text, lang, source, len(text or ""), *["x"] * len(extra)))
        schema = T.StructType(SCHEMA.fields + [T.StructField(name, T.StringType()) for name in extra])
        return spark.createDataFrame(full, schema)

    return make


@pytest.fixture(scope="session")
def documents(spark, folder):
    return {r.doc_id: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
