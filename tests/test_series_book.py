"""Books read from one row per name equal those that carry scenarios as rows."""

from dataclasses import replace

import helpers as H
import numpy as np
import pytest
from pyspark.sql import functions as F

from marketripple.operators import evidence, panel, pnl, portfolio, series_book
from marketripple.plans import market as P

KEYS = ["aum", "smooth"]


@pytest.fixture(scope="module")
def inputs(spark):
    g = np.random.default_rng(5)
    t, n = 70, 30
    z, r = g.normal(size=(t, n)), g.normal(0, 0.03, (t, n))
    z[g.random((t, n)) < 0.3], r[g.random((t, n)) < 0.1], r[40] = 0.0, np.nan, np.nan
    z[33] = 0.7  # no variance on a date
    adtv, beta = g.uniform(2e4, 2e5, (t, n)), g.normal(1, 0.3, (t, n))
    adtv[:6, :9], adtv[20:25, 3], beta[:10], beta[50, 4] = np.nan, 0.0, np.nan, np.nan
    b = H.book(spark, z, r, adtv, beta, [None if j == 7 else f"S{j % 4}" for j in range(n)]).cache()
    days = b.select("date", "idx").distinct()
    index = days.where("idx not in (0, 31, 32)").withColumn("m", F.sin(F.col("idx")) / 50)
    return b, days, index


def packed(b, days, few):
    z = b.select("idx", "ticker", F.col("w").alias("z"))
    return series_book.pack(b.select("idx", "ticker", "r", "adtv", "beta"), b.select("ticker", "sector").distinct(), days,
                            {"all": (b, z), "few": (b.where(few), z.where(few).where("idx > 20"))})


def same(got, want, keys):
    x, y = (d.toPandas().sort_values(keys).reset_index(drop=True) for d in (got, want))
    assert len(x) == len(y) > 0
    for c in y.columns:
        if y[c].dtype.kind == "f":
            np.testing.assert_allclose(x[c].astype(float), y[c].astype(float), rtol=1e-9, atol=1e-12, err_msg=c)
        else:
            assert (x[c] == y[c]).all(), c


def test_books_equal_rows(spark, inputs):
    b, days, index = inputs
    few = F.col("ticker") < "T012"
    all_ = packed(b, days, few)
    assert all_.rows.count() == 30  # not one row more for a scenario or a date
    kept = pnl.on_session_dates(b.select("date", "idx", "ticker", "r", "adtv"), index)
    fallback = pnl.impact_fallback(kept, P.COST).first()[0]
    aums = (2e4, 9e5)
    wanted = [(i, n, {"aum": a, "smooth": n}) for i, a in enumerate(aums) for n in (1, 12)]
    day, held = series_book.books(all_, [series_book.Loop("all", a) for a in aums], wanted, index, fallback, P.BOOK, P.COST)
    rows = b.withColumn("aum", F.explode(F.array(*[F.lit(a) for a in aums])))
    w = portfolio.build_portfolio(rows, replace(P.BOOK, aum="aum"), ("aum",), (1, 12)).cache()
    led = pnl.ledger(w, b.select("date", "idx", "ticker", "r", "adtv"), index, P.COST, KEYS)
    same(day, pnl.daily_costs(led, "aum", P.COST, KEYS), [*KEYS, "date"])
    same(held.join(days, "idx").select(*KEYS, "date", "n_positions"), portfolio.positions_count(w, KEYS), [*KEYS, "date"])


def test_names_of_a_signal_masks_and_ic(spark, inputs):
    b, days, index = inputs
    few = F.col("ticker") < "T012"
    loops = [series_book.Loop("few", P.AUM, 3), series_book.Loop("all", P.AUM, 1, True)]
    wanted = [(0, 4, {"variant": "few"}), (1, 4, {"variant": "all"})]
    day, _ = series_book.books(packed(b, days, few), loops, wanted, index, None, P.BOOK, P.COST)
    w = portfolio.rolling("w", portfolio.series_window((), "ticker"), 3, 1)
    one = b.where(few).withColumn("w", F.when(F.col("idx") > 20, F.col("w")).otherwise(0.0)).withColumn("w", w).withColumn("variant", F.lit("few"))
    two = b.withColumn("w", F.when(F.col("r").isNotNull(), F.col("w")).otherwise(0.0)).withColumn("variant", F.lit("all"))
    both = one.unionByName(two).cache()
    wts = portfolio.build_portfolio(both, replace(P.BOOK, smoothing=4), ("variant",))
    led = pnl.ledger(wts, b.select("date", "idx", "ticker", "r", "adtv"), index, P.COST, ("variant",))
    same(day.drop("impact", "cost", "net"), pnl.daily_costs(led, P.AUM, P.COST, ("variant",)).drop("impact", "cost", "net"), ["variant", "date"])
    got = series_book.signal_ic(packed(b, days, few), loops, [{"variant": "few"}, {"variant": "all"}]).join(days, "idx").select("variant", "date", "ic")
    forward = panel.shift(b, "r", -1, "y").select("date", "ticker", "y")
    same(got, evidence.ic_daily(both, forward, z="w", keys=("variant",)), ["variant", "date"])


def test_a_missing_calendar_row_is_an_error(spark, inputs):
    b, days, _ = inputs
    with pytest.raises(Exception, match="rows for 70 dates"):
        packed(b.where("not (idx = 5 and ticker = 'T001')"), days, F.lit(True))
