"""The registered queries against DuckDB on the smallest tables."""

import pytest

from acadspark import llm
from acadspark.plans.compare import compare, duck_connect

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(llm.queries()))
def test_query(spark, name):
    r = compare(spark, duck_connect(SF), SF, name, llm.queries()[name], llm.oracle_sql().get(name))
    assert r["status"] in ("equal", "rows-only"), r


def test_one_query_for_each_operator():
    assert [int(n[2:].split("_")[0]) for n in llm.queries()] == list(range(1, 14))
