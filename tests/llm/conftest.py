from __future__ import annotations

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture
def docs_of(spark):
    """A documents table of (doc_id, text[, lang, source]) rows, with two extra columns of clashing names."""
    def make(rows):
        full = [(i, t, *(rest or ("en", "a"))) for i, t, *rest in rows]
        df = spark.createDataFrame(full, "doc_id bigint, text string, lang string, source string")
        return df.selectExpr("*", "length(text) as n_chars", "'x' as size", "'y' as fp")

    return make


@pytest.fixture
def sf(spark):
    return lambda name: spark.read.parquet(f"{SF}/{name}.parquet")
