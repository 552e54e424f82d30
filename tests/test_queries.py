"""Every registered star-schema query against its SQL, on the smallest data."""

import math
import os

import duckdb
import pytest

from cubewright import families, queries  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if v is None or isinstance(v, bool):
        return v
    if isinstance(v, (int, float)) or hasattr(v, "as_tuple"):
        return "nan" if math.isnan(v) else float(f"{float(v):.9g}") + 0.0
    return str(v)


@pytest.mark.parametrize("name", list(queries.SQL))
def test_query(spark, sql, name):
    df = queries.QUERIES[name](spark, SF)
    want = sql.sql(queries.SQL[name])
    names = sorted(df.columns)
    assert names == sorted(want.columns)
    order = lambda rows, columns: sorted((tuple(plain(r[columns.index(n)]) for n in names) for r in rows), key=repr)
    assert order([tuple(r) for r in df.collect()], df.columns) == order(want.fetchall(), want.columns)


def test_flagship_is_one_pass(spark):
    plan = queries.QUERIES["agg_sum_by_nation"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lineitem.parquet") == 1 and "CartesianProduct" not in plan and "Python" not in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_extendedprice:double,l_discount:double>" in plan


def test_whole_tables_are_computed(spark):
    """No subset of ids: a row for each part, a rate for each customer's whole flows."""
    for name in ("finance_annuity_all", "dist_normal_all"):
        assert queries.QUERIES[name](spark, "/root/testdata/sf0.01").count() == 2000
    got = {r["c_custkey"]: r["r"] for r in queries.QUERIES["xirr"](spark, SF).collect()}
    flows = {}
    for r in spark.read.parquet(f"{SF}/orders.parquet").collect():
        flows.setdefault(r["o_custkey"], []).append((r["o_totalprice"] * (1 if r["o_orderkey"] % 2 == 0 else -0.5), r["o_orderdate"]))
    assert set(flows) <= set(got) and sum(r is not None for r in got.values()) > len(flows) / 2
    for k, flow in flows.items():
        start = min(d for _, d in flow)
        worth = lambda rate: sum(v / (1 + rate) ** ((d - start).days / 365) for v, d in flow)  # noqa: B023, E731
        if got[k] is None:  # blank only where no rate is between the bounds, or an even number
            assert worth(-0.99999) * worth(100) >= 0
        else:
            assert worth(max(got[k] - 1e-6, -0.9999999)) * worth(got[k] + 1e-6) <= 0
