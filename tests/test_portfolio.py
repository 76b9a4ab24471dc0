"""The scenarios a portfolio builder must survive, on small seeded panels."""

import numpy as np
import pytest

from marketripple.operators import portfolio as O
from marketripple.operators.returns import HEDGE_TICKER
from tests.helpers import book, wide

RNG = lambda: np.random.default_rng(42)


def build(spark, z, r, p=O.BookParams(smoothing=10), **kw):
    return wide(O.build_portfolio(book(spark, z, r, **kw), p))


def test_vol_equals_covariance_form(spark):
    rng = RNG()
    z, r = rng.normal(size=(30, 4)), rng.normal(0, .02, (30, 4))
    r[5, 1] = np.nan
    got = {x["idx"]: x["vol"] for x in O.portfolio_vol(book(spark, z, r), 12).collect()}
    assert min(got) == 12
    r0 = np.nan_to_num(r)
    for i, v in got.items():
        c = np.cov(r0[i - 12:i], rowvar=False)
        assert v == pytest.approx(np.sqrt(z[i] @ c @ z[i] * 252), rel=1e-10)


def test_sign_polarity(spark):
    z = np.zeros((100, 2))
    z[-2:] = [2.0, -2.0]
    w = build(spark, z, RNG().normal(0, .02, (100, 2)))
    assert w["T000"].iloc[-1] > 0 > w["T001"].iloc[-1]


def test_name_cap(spark):
    z = np.zeros((100, 1))
    z[-5:] = 10.0
    w = build(spark, z, RNG().normal(0, .02, (100, 1)))
    assert w["T000"].abs().max() <= 0.05 + 1e-9


def test_liquidity_cap(spark):
    z = np.full((100, 1), 10.0)
    w = build(spark, z, RNG().normal(0, .02, (100, 1)), adtv=np.full((100, 1), 5e6))
    assert w["T000"].abs().max() == pytest.approx(0.005)


def test_sector_cap_binds(spark):
    z = np.zeros((100, 4))
    z[-15:] = 5.0
    p = O.BookParams(smoothing=10, max_name=0.10)
    w = build(spark, z, RNG().normal(0, .02, (100, 4)), p, sectors=["S"] * 4).drop(columns=HEDGE_TICKER)
    assert w.abs().sum(axis=1).iloc[-1] == pytest.approx(0.25)
    assert w.abs().sum(axis=1).max() <= 0.25 + 1e-9


def test_smoothing_keeps_limits(spark):
    rng = RNG()
    p = O.BookParams(smoothing=10, max_name=0.05, max_sector=0.10)
    w = build(spark, rng.normal(size=(200, 3)), rng.normal(0, .02, (200, 3)), p, sectors=["S"] * 3).drop(columns=HEDGE_TICKER)
    assert w.abs().max().max() <= 0.05 + 1e-9
    assert w.abs().sum(axis=1).max() <= 0.10 + 1e-9


def test_liquidity_cap_follows_collapsing_volume(spark):
    rng = RNG()
    adtv = np.full((200, 2), 200e6)
    adtv[100:] = 1e6
    b = book(spark, np.tile([3.0, -3.0], (200, 1)), rng.normal(0, .02, (200, 2)), adtv=adtv)
    p = O.BookParams(smoothing=10)
    w = O.build_portfolio(b, p)
    v = O.verify_limits(w, b, p).first()
    assert v["n_liquidity"] == v["n_name"] == v["n_sector"] == 0
    after = wide(w).drop(columns=HEDGE_TICKER).iloc[101:]
    assert after.abs().max().max() <= 0.001 + 1e-9


def test_delisted_name_holds_nothing(spark):
    rng = RNG()
    r = rng.normal(0, .02, (200, 2))
    r[100:, 1] = np.nan
    w = build(spark, np.tile([2.0, -2.0], (200, 1)), r)
    assert (w["T001"].iloc[101:] == 0).all() and (w["T000"].iloc[101:].abs() > 0).all()


def test_beta_neutral_and_unknown_beta_closed(spark):
    rng = RNG()
    beta = np.full((100, 2), np.nan)
    beta[98] = [1.2, 0.7]
    w = build(spark, np.tile([2.0, -1.0], (100, 1)), rng.normal(0, .02, (100, 2)), beta=beta)
    row = w.iloc[99]
    assert row["T000"] * 1.2 + row["T001"] * 0.7 + row[HEDGE_TICKER] == pytest.approx(0, abs=1e-12)
    assert (w.iloc[1:99].abs().to_numpy() == 0).all()


def test_holiday_does_not_liquidate(spark):
    rng = RNG()
    r = rng.normal(0, .02, (120, 40))
    r[60, 1:] = np.nan
    w = build(spark, np.tile(np.where(np.arange(40) % 2, 1.0, -1.0), (120, 1)), r).drop(columns=HEDGE_TICKER)
    assert w.iloc[61].abs().sum() > 0.5 * w.iloc[60].abs().sum()


def test_unknown_adtv_means_zero_and_gaps_carry(spark):
    adtv = np.full((5, 2), 5e6)
    adtv[2, 0] = np.nan
    adtv[:, 1] = np.nan
    lim = wide(O.liquidity_limit(book(spark, np.ones((5, 2)), np.zeros((5, 2)), adtv=adtv)), "lim")
    assert lim["T000"].tolist() == pytest.approx([0.005] * 5) and (lim["T001"] == 0).all()


def test_smoothing_axis_equals_single_runs(spark):
    rng = RNG()
    b = book(spark, rng.normal(size=(60, 3)), rng.normal(0, .02, (60, 3)))
    p = O.BookParams(vol_window=12, smoothing=4)
    both = O.build_portfolio(b, p, smoothings=(4, 9))
    one = wide(O.build_portfolio(b, p))
    np.testing.assert_allclose(wide(both.where("smooth = 4").drop("smooth")).to_numpy(float), one.to_numpy(float), equal_nan=True)


def test_no_trade_band_matches_loop(spark):
    rng = RNG()
    x = np.cumsum(rng.normal(0, .01, (40, 2)), axis=0)
    b = book(spark, x, np.zeros((40, 2)))
    got = wide(O.no_trade_band(b.select("date", "idx", "ticker", "w"), 0.02), "held").to_numpy(float)
    held = np.zeros(2)
    for i in range(40):
        held = np.where(np.abs(x[i] - held) < 0.02, held, x[i])
        np.testing.assert_allclose(got[i], held)


def test_no_trade_band_is_linear_in_dates(spark):
    """Four times the dates take about four times as long: nothing grows along a ticker's history."""
    import time

    def seconds(n):
        rows = spark.range(n * 8).selectExpr("cast(id % 8 as string) as ticker", "cast(id div 8 as int) as idx", "date_add(date'1990-01-01', cast(id div 8 as int)) as date",
                                             "sin(id * 0.37) * 0.05 as w")
        t = time.time()
        out = O.no_trade_band(rows, 0.02).where("held <> 0").count()
        assert out > n
        return time.time() - t

    seconds(2_000)
    assert seconds(80_000) < 40 * max(seconds(2_000), 0.2)
