"""Every registered query of the insertion job against its SQL, value for value; and its plan."""

import duckdb
import pytest

from hoptrace.plans.fixtures import TABLES
from hoptrace.plans.oracle import ORACLE
from hoptrace.plans.queries import QUERIES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_all_have_sql():
    assert QUERIES.keys() == ORACLE.keys()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    quoted = ", ".join(f'"{c}"' for c in columns)
    rows = lambda x: sorted((tuple(r) for r in x), key=repr)
    assert rows(got.select(*columns).collect()) == rows(duck.execute(f"SELECT {quoted} FROM ({ORACLE[name]})").fetchall())
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan and "CartesianProduct" not in plan
