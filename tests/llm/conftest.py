"""Small tables for the corpus operators."""

from __future__ import annotations

import pytest
from pyspark.sql import DataFrame, SparkSession


@pytest.fixture(scope="module")
def docs(spark: SparkSession):
    """Documents of the given rows, with columns whose names clash with those the operators make."""
    def make(*rows: tuple[int | None, str | None]) -> DataFrame:
        table = spark.createDataFrame([(i, t, "en", "src1", len(t or "")) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
        return table.selectExpr("*", "'x' AS ids", "1 AS score", "2 AS n", "'y' AS sid", "3 AS word", "'z' AS drops", "4 AS kind", "5 AS token")

    return make
