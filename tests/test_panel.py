import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketripple.functions.quantiles import group_quantiles
from marketripple.operators import panel as O
from marketripple.operators import shock as S
from marketripple.operators import signal as SG
from tests.helpers import day


def _sparse(spark, seed=1, t=60, n=5, keep=0.7):
    rng = np.random.default_rng(seed)
    rows = [(day(i), f"T{j}", float(rng.normal())) for i in range(t) for j in range(n) if rng.random() < keep]
    return rows, spark.createDataFrame(rows, "date date, ticker string, v double")


def test_densify_matches_reindex(spark):
    rows, df = _sparse(spark)
    cal = O.trading_calendar(df)
    got = O.densify(df, cal, {"v": None}).toPandas().pivot(index="date", columns="ticker", values="v").sort_index()
    exp = pd.DataFrame(rows, columns=["date", "ticker", "v"]).pivot(index="date", columns="ticker", values="v").sort_index()
    assert got.shape == exp.shape
    np.testing.assert_allclose(got.to_numpy(float), exp.to_numpy(float), equal_nan=True)
    zero = O.densify(df, cal, {"v": 0.0}).toPandas().pivot(index="date", columns="ticker", values="v").sort_index()
    np.testing.assert_allclose(zero.to_numpy(float), exp.fillna(0).to_numpy(float))


def test_rolling_counts_calendar_rows(spark):
    _, df = _sparse(spark, 2)
    d = O.densify(df, O.trading_calendar(df), {"v": None})
    w = d.toPandas().pivot(index="idx", columns="ticker", values="v").sort_index().astype(float)
    for fn, pdf in {"sum": w.rolling(9, min_periods=4).sum(), "std": w.rolling(9, min_periods=4).std(),
                    "median": w.rolling(9, min_periods=4).median()}.items():
        got = O.roll(d, "v", 9, 4, fn, "o").toPandas().pivot(index="idx", columns="ticker", values="o").sort_index()
        np.testing.assert_allclose(got.to_numpy(float), pdf.to_numpy(float), atol=1e-12, equal_nan=True)


def test_accumulate_is_rolling_then_shift(spark):
    _, df = _sparse(spark, 3)
    d = O.densify(df, O.trading_calendar(df), {"v": None}).withColumnRenamed("v", "eps")
    w = d.toPandas().pivot(index="idx", columns="ticker", values="eps").sort_index().astype(float)
    exp = w.rolling(12, min_periods=5).sum().shift(3)
    got = S.accumulate_shock(d, 12, 3, 5).toPandas().pivot(index="idx", columns="ticker", values="acc").sort_index()
    np.testing.assert_allclose(got.to_numpy(float), exp.to_numpy(float), atol=1e-12, equal_nan=True)


def test_market_shock_matches_least_squares(spark):
    rng = np.random.default_rng(4)
    t, n, win, need = 80, 4, 30, 18
    m = rng.normal(0, .02, t)
    r = .5 * m[:, None] + rng.normal(0, .02, (t, n))
    r[rng.random((t, n)) < .2] = np.nan
    m[7] = np.nan
    rows = [(day(i), i, f"T{j}", None if np.isnan(r[i, j]) else float(r[i, j]), None if np.isnan(m[i]) else float(m[i]))
            for i in range(t) for j in range(n)]
    df = spark.createDataFrame(rows, "date date, idx int, ticker string, r double, m double")
    got = S.market_shock(df, win, need).toPandas()
    e = got.pivot(index="idx", columns="ticker", values="eps").to_numpy(float)
    b = got.pivot(index="idx", columns="ticker", values="beta").to_numpy(float)
    for j in range(n):
        for i in range(t):
            lo = max(0, i - win + 1)
            ok = ~np.isnan(r[lo:i + 1, j]) & ~np.isnan(m[lo:i + 1])
            if ok.sum() < need:
                assert np.isnan(b[i, j]) and np.isnan(e[i, j])
                continue
            x, y = m[lo:i + 1][ok], r[lo:i + 1, j][ok]
            slope, icept = np.polyfit(x, y, 1)
            np.testing.assert_allclose(b[i, j], slope, atol=1e-9)
            if ok[-1]:
                np.testing.assert_allclose(e[i, j], r[i, j] - icept - slope * m[i], atol=1e-9)
            else:
                assert np.isnan(e[i, j])


def test_two_factor_shock_matches_least_squares(spark):
    rng = np.random.default_rng(5)
    t, win = 60, 20
    m, g = rng.normal(0, .02, t), rng.normal(0, .02, t)
    r = .4 * m + .3 * g + rng.normal(0, .01, t)
    r[rng.random(t) < .15] = np.nan
    rows = [(day(i), i, "A", None if np.isnan(r[i]) else float(r[i]), float(m[i]), float(g[i])) for i in range(t)]
    df = spark.createDataFrame(rows, "date date, idx int, ticker string, r double, m double, g double")
    got = S.two_factor_shock(df, win, 5).orderBy("idx").toPandas()
    own = np.flatnonzero(~np.isnan(r))
    assert len(got) == len(own)
    for k, i in enumerate(own):
        if k < win - 1:
            assert np.isnan(got["eps2"][k])
            continue
        sel = own[k - win + 1:k + 1]
        x = np.column_stack([np.ones(win), m[sel], g[sel]])
        coef = np.linalg.lstsq(x, r[sel], rcond=None)[0]
        np.testing.assert_allclose(got["eps2"][k], r[i] - np.array([1, m[i], g[i]]) @ coef, atol=1e-9)


def test_quantiles_exact_in_every_mode(spark):
    rng = np.random.default_rng(6)
    vals = {0: rng.normal(size=3000), 1: np.r_[np.zeros(1500), rng.normal(size=900)], 2: rng.normal(size=7), 3: np.array([1.5])}
    rows = [(k, float(x)) for k, v in vals.items() for x in v] + [(0, None)]
    df = spark.createDataFrame(rows, "k int, v double").repartition(4)
    probs = [0.0, 0.01, 0.37, 0.5, 0.99, 1.0]
    names = [f"q{i}" for i in range(len(probs))]
    for kw in ({"accuracy": 50}, {"accuracy": 10_000}):
        got = {r["k"]: [r[n] for n in names] for r in group_quantiles(df, ["k"], "v", probs, names, **kw).collect()}
        for k, v in vals.items():
            np.testing.assert_allclose(got[k], np.quantile(v, probs), atol=1e-12, err_msg=str((kw, k)))


def test_period_tags(spark):
    df = spark.createDataFrame([(day(0),), (day(400),)], "date date")
    got = {(r["date"], r["period"]) for r in O.slice_period(df, O.is_oos_full("2020-12-31")).collect()}
    assert got == {(day(0), "IS"), (day(0), "full"), (day(400), "OOS"), (day(400), "full")}


def test_resample_last_is_last_known(spark):
    df = spark.createDataFrame([(day(0), "A", 1.0), (day(5), "A", 2.0), (day(9), "A", None)], "date date, ticker string, v double")
    assert O.resample_month(df, "v", "last", "o").first()["o"] == 2.0


def test_no_look_ahead(spark):
    """Values at t do not change when later rows are removed."""
    rng = np.random.default_rng(7)
    t = 50
    rows = [(day(i), i, f"T{j}", float(rng.normal(0, .02)), float(np.sin(i) / 50)) for i in range(t) for j in range(3)]
    df = spark.createDataFrame(rows, "date date, idx int, ticker string, r double, m double")
    calc = lambda d: S.accumulate_shock(S.market_shock(d, 15, 8), 10, 2, 4)
    cut = 35
    a = calc(df).where(F.col("idx") <= cut).orderBy("ticker", "idx").toPandas()
    b = calc(df.where(F.col("idx") <= cut)).orderBy("ticker", "idx").toPandas()
    pd.testing.assert_frame_equal(a, b)


def test_densify_rejects_duplicates(spark):
    p = spark.createDataFrame([(day(i), "A", 1.0) for i in (0, 1, 1, 2)], "date date, ticker string, volume double")
    with pytest.raises(Exception, match="two rows of one date for A"):
        O.densify(p, O.trading_calendar(p), {"volume": 0.0}).collect()


def test_large_early_values_leave_small_windows_exact(spark):
    """A window of zeros after a large value is exactly zero, so that 0 stays "no signal"."""
    v = [1e9, -3.0, 7e8] + [0.0] * 6
    p = spark.createDataFrame([(day(i), i, "A", x) for i, x in enumerate(v)], "date date, idx int, ticker string, eps double")
    got = [r["acc"] for r in S.accumulate_shock(p, 3, 0, 1).orderBy("idx").collect()]
    assert got[5:] == [0.0] * 4


def test_peer_groups_skip_unknown_classes_and_unpriced_names(spark):
    m = spark.createDataFrame([(f"N{i}", "S", "A DEFINIR" if i < 7 else "X") for i in range(12)], "ticker string, sector string, subsector string")
    got = lambda df: {r["ticker"]: r["peer_group"] for r in df.collect()}
    g = got(S.peer_group_choice(m, 4))
    assert all(g[f"N{i}"] == "sec:S" for i in range(7)) and all(g[f"N{i}"] == "sub:X" for i in range(7, 12))
    priced = m.where("ticker <> 'N8'").select("ticker")
    assert set(got(S.peer_group_choice(m, 4, priced)).values()) == {"sec:S"}


def test_names_are_one_to_one(spark):
    from marketripple.plans.market import ticker_of
    keys = spark.range(3_000_000).unionByName(spark.range(10**12, 10**12 + 1000))
    r = keys.select(ticker_of(F.col("id")).alias("t")).agg(F.count_distinct("t").alias("n"), F.count("t").alias("all"), F.min(F.length("t"))).first()
    assert r[0] == r[1] == 3_001_000 and r[2] == 5


@pytest.mark.parametrize("rows,listed", [(1000, 100_000), (1000, 0), (20_000, 100_000)])
def test_salted_join_is_a_join(spark, monkeypatch, rows, listed):
    from marketripple.functions import expr
    monkeypatch.setattr(expr, "LISTED_KEYS", listed)
    large = spark.range(5000).selectExpr("if(id < 4000, 'hub', if(id = 4999, null, concat('k', id % 7))) as src", "id as dst")
    small = spark.createDataFrame([("hub", 1), ("k1", 2), ("k1", 3), ("none", 4), (None, 5)], "src string, x int")
    assert [tuple(r) for r in expr.hot_keys(large, ["src"], 1000).collect()] == [("hub", 4)]
    got = expr.salted_join(small, large, ["src"], "dst", rows)
    want = small.join(large, "src")
    assert got.columns == want.columns and got.count() == want.count() and got.exceptAll(want).isEmpty()


def test_hot_rows_never_move_by_their_bare_key(spark):
    from marketripple.functions import expr
    large = spark.range(50_000).selectExpr("if(id < 45000, 'hub', concat('k', id % 7)) as src", "id as dst")
    small = spark.createDataFrame([("hub", 1), ("k1", 2)], "src string, x int")
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        joined = expr.salted_join(small, large, ["src"], "dst")
        plan = plan_of(joined)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    exchanges = [line for line in plan.splitlines() if "hashpartitioning" in line]
    assert len(exchanges) == 2 and all("_salt" in line for line in exchanges), plan


def plan_of(df):
    import contextlib
    import io
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_rounding_of_equal_sums_is_no_signal(spark):
    near = 0.1 + 0.2  # 0.30000000000000004
    rows = [(day(0), f"T{i}", near if i % 3 else 0.3) for i in range(12)] + [(day(1), f"T{i}", 0.1 * i + 1e-9) for i in range(12)]
    z = SG.zscore_xsec(spark.createDataFrame(rows, "date date, ticker string, clipped double")).toPandas()
    assert z[z["date"] == day(0)]["z"].abs().max() < 1e-12
    assert abs(z[z["date"] == day(1)]["z"].std() - 1) < 1e-12
