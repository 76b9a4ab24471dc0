"""Panel kernel queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketripple.catalog import base_sql as B
from marketripple.catalog.registry import query
from marketripple.operators import panel as O
from marketripple.operators import universe as U
from marketripple.plans import market as P

W = "over (partition by ticker order by idx)"

query("pnl_01_densify", lambda m: O.densify(U.shares_only(m.obs, m.classes), m.calendar, {"volume": 0.0, "close": None}),
      "select date, idx, ticker, volume, close from t_px", d="volume close")
query("pnl_02_align_right", lambda m: O.align_right(m.panel.select("date", "ticker", "adtv"), m.universe_dates),
      """select u.date, u.ticker, p.adtv from (select distinct date, ticker from t_obs) u
      left join t_panel p on p.date = u.date and p.ticker = u.ticker""", d="adtv")
query("pnl_03_align_inner", lambda m: O.align_inner(m.panel.select("date", "ticker", "r"), m.index),
      "select date, ticker, r from t_panel where date in (select date from t_index)", d="r")
query("pnl_04_shift", lambda m: O.shift(O.shift(m.panel.select("date", "idx", "ticker", "r"), "r", 2, "lag2"), "r", -1, "lead1"),
      f"select date, idx, ticker, r, lag(r, 2) {W} as lag2, lead(r) {W} as lead1 from t_panel", d="r lag2 lead1")
query("pnl_05_diff_abs", lambda m: O.diff_abs(m.panel.select("date", "idx", "ticker", "volume"), "volume", "d"),
      f"select date, idx, ticker, volume, abs(volume - lag(volume) {W}) as d from t_panel", d="volume d")
query("pnl_06_ffill", lambda m: O.ffill(m.panel.select("date", "idx", "ticker", "close"), "close", "filled"),
      f"""select date, idx, ticker, close, last_value(close ignore nulls) over (partition by ticker order by idx
      rows between unbounded preceding and current row) as filled from t_panel""", d="close filled")


def _rolls(m):
    d = m.panel.select("date", "idx", "ticker", "r")
    for fn in ("sum", "avg", "std", "median"):
        d = O.roll(d, "r", 8, 3, fn, f"r_{fn}")
    return d


query("pnl_07_rolling", _rolls, f"""
select date, idx, ticker, r, case when count(r) over w >= 3 then sum(r) over w end as r_sum,
 case when count(r) over w >= 3 then avg(r) over w end as r_avg,
 case when count(r) over w >= 3 then stddev_samp(r) over w end as r_std,
 case when count(r) over w >= 3 then median(r) over w end as r_median
from t_panel window w as (partition by ticker order by idx {B.rows_back(8)})""", d="r r_sum r_avg r_std r_median")
query("pnl_08_pct_change", lambda m: O.pct_change(m.prices.select("date", "idx", "ticker", "close"), "close", "r"),
      f"select date, idx, ticker, close, close / nullif(lag(close) {W}, 0) - 1 as r from t_px", d="close r")
CURVE = """select date, m, product(1 + coalesce(m, 0)) over (order by date rows between unbounded preceding and current row)
 as curve from t_index"""
query("pnl_09_cumulate", lambda m: O.cumulate(m.index.select("date", "m"), "m", "curve"), CURVE, d="m curve")
query("pnl_10_rebase", lambda m: O.rebase(O.cumulate(m.index.select("date", "m"), "m", "curve"), "curve", "based").select("date", "based"),
      f"select date, curve / first_value(curve) over (order by date) as based from ({CURVE})", d="based")


def _months(m):
    d = m.panel.select("date", "ticker", "r", "adtv")
    a = O.resample_month(d, "adtv", "last", "adtv_last")
    b = O.resample_month(d, "adtv", "mean", "adtv_mean")
    c = O.resample_month(d, "r", "sum", "r_sum")
    e = O.resample_month(d, "r", "prod", "r_prod")
    k = ["ticker", "month_end"]
    return a.join(b, k).join(c, k).join(e, k)


query("pnl_11_resample_month", _months, """
select ticker, last_day(date) as month_end, arg_max(adtv, date) filter (adtv is not null) as adtv_last,
 avg(adtv) as adtv_mean, sum(r) as r_sum, product(1 + coalesce(r, 0)) - 1 as r_prod from t_panel group by 1, 2""",
      d="adtv_last adtv_mean r_sum r_prod")
query("pnl_12_slice_period", lambda m: O.slice_period(m.index, P.PERIODS).groupBy("period").agg(
    F.count("m").alias("n"), F.avg("m").alias("mean_m")),
      f"select period, count(m) as n, avg(m) as mean_m from t_index join {B.periods_sql()} p on date between lo and hi group by period",
      d="mean_m")


def _round_trip(m):
    wide = m.panel.select("date", "ticker", "volume", "close", "adtv")
    long = O.to_long(wide, "value", ids=("date", "ticker"), name="measure")
    return O.to_wide(long, "value", ["volume", "close", "adtv"], column="measure", ids=("date", "ticker"))


query("pnl_13_unpivot_pivot", _round_trip, "select date, ticker, volume, close, adtv from t_panel", d="volume close adtv")
query("pnl_14_xsec_stat", lambda m: O.xsec_stat(m.panel, "r", [0.05, 0.5, 0.95], ["p05", "median", "p95"]),
      """select date, count(r) as n, avg(r) as mean, stddev_samp(r) as std, quantile_cont(r, 0.05) as p05,
      quantile_cont(r, 0.5) as median, quantile_cont(r, 0.95) as p95 from t_panel group by date""",
      d="mean std p05 median p95")
query("pnl_15_active_window", lambda m: O.active_window(m.signal.select("date", F.col("z").alias("w"))),
      "select date, sum(abs(z)) as gross from t_sig group by date having sum(abs(z)) > 1e-9", d="gross")
