"""Registered queries against their DuckDB SQL, and without the subpackage."""

import pytest

import __spark_entry__ as E
from souq.llm import registry
from tools.check_oracle import compare, duck, rows_of

SMOKE = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_matches_oracle(spark, name):
    df = E.queries()[name](spark, SMOKE)
    cur = duck(SMOKE).execute(E.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    ok, why = compare(rows_of(df.columns, [tuple(r) for r in df.collect()]), rows_of(cols, cur.fetchall()))
    assert ok, why


def test_one_query_for_each_operator():
    names = [n for n in E.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names if n in registry.QUERIES) == list(range(1, 14))
    assert "pipeline" in E.queries()
