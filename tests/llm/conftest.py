from __future__ import annotations

import pytest


@pytest.fixture
def docs(spark):
    """Documents from (doc_id, text) pairs, with columns whose names operators use for their own."""

    def make(rows, extra=True):
        schema = "doc_id long, text string, lang string, source string, n_chars long"
        data = [(i, t, "en", "src1", len(t or "")) for i, t in rows]
        df = spark.createDataFrame(data, schema)
        if not extra:
            return df
        from pyspark.sql import functions as F

        clashing = ("id", "score", "x", "n", "key", "rep", "tokens", "hash", "block", "band", "component_id", "kept", "ids", "epoch")
        return df.select("*", *[F.lit("clash").alias(c) for c in clashing])

    return make


def by_id(df, key):
    return {r[key]: r.asDict() for r in df.collect()}
