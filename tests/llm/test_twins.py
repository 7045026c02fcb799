"""Corpus queries next to their SQL twins."""

from __future__ import annotations

import pytest

from crawlsift.llm import registry
from tests.compare import compare, connect

SF = "/root/testdata/sf0.001"
SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", list(SQL))
def test_query_matches_sql(spark, name):
    assert compare(spark, connect(SF), name, registry.queries()[name], SQL[name], SF) == []
