"""The driver contract on the smallest scale: names, SQL twins and a sample of compared queries."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
SAMPLE = ["uni_06_universe_top_n", "uni_11_compare_monthly", "shk_01_market_shock", "grf_03_build_rule_graph", "sig_04_zscore_xsec",
          "pf_12_build_portfolio", "cst_06_cost_breakdown", "met_07_calmar_performance", "inf_05_ic_by_horizon", "src_02_fixed_width_decode"]


def test_registry_is_consistent():
    q, s = E.queries(), E.oracle_sql()
    assert len(q) > 180 and set(s) <= set(q)
    optional = {n for n in q if n == "pipeline" or n.startswith("op")}  # of the optional subpackage, tested on their own
    assert not set(q) - set(s) - optional


def test_entry_has_rows(spark):
    assert E.entry(spark).count() > 0


def key(v):
    return "" if v is None else f"{round(v, 5) + 0.0:.5f}" if isinstance(v, float) else str(v)[:10] if hasattr(v, "isoformat") else str(v)


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df = E.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted([tuple(r) for r in df.select(*cols).collect()], key=lambda r: [key(v) for v in r])
    cur = con.execute(E.oracle_sql()[name])
    have = [c[0] for c in cur.description]
    exp = sorted([tuple(r[have.index(c)] for c in cols) for r in cur.fetchall()], key=lambda r: [key(v) for v in r])
    assert sorted(have) == cols and len(got) == len(exp) and got
    for a, b in zip(got, exp):
        for x, y in zip(a, b):
            assert (x == y) or (isinstance(x, float) and y is not None and math.isclose(x, y, abs_tol=2e-6)) or key(x) == key(y), (name, a, b)
