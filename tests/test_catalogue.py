"""The query catalogue against DuckDB, and the plans that matter."""

import duckdb
import pytest

from quillon import catalogue
from quillon.plans.explain import physical

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in catalogue.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order) for r in values), key=repr)


@pytest.mark.parametrize("name", catalogue.queries())
def test_same_rows_as_duckdb(spark, duck, name):
    got = catalogue.queries()[name](spark, SF)
    want = duck.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(names, want.fetchall())


PLANS = {"knn_topk": "TakeOrderedAndProject", "topk": "TakeOrderedAndProject", "semi_exists": "LeftSemi", "anti_not_exists": "LeftAnti", "filter_between": "GreaterThanOrEqual(c_acctbal", "tpch_like_q6": "PushedFilters: [IsNotNull(l_discount)"}


@pytest.mark.parametrize("name", PLANS)
def test_plans(spark, name):
    plan = physical(catalogue.queries()[name](spark, SF))
    assert PLANS[name] in plan and "Python" not in plan and "Cartesian" not in plan
