"""Performance metric queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketripple.catalog import base_sql as B
from marketripple.catalog.registry import cte, query
from marketripple.operators import metrics as O
from marketripple.operators import panel as N
from marketripple.operators import portfolio as PF
from marketripple.plans import market as P

Y = P.YEAR
cte("t_days", """
with w as (select date, sum(abs(w)) as g, count(*) filter (abs(w) > 1e-6 and ticker <> 'IBOV_SYNTHETIC') as n_pos from t_w
 where w is not null group by date)
select p.date, net_flat as flat, net as real, net_flat + coalesce(rf, 0) as fund_flat, net + coalesce(rf, 0) as fund_real,
 coalesce(i.m, 0) as index, coalesce(rf, 0) as cash, turnover, n_pos, gross, cost, spread, impact, borrow, hedge
from t_pnl p join w on w.date = p.date and g > 1e-9 left join t_index i on i.date = p.date left join t_rf r on r.date = p.date""")
cte("t_series", " union all ".join(f"select date, '{s}' as series, {s} as r, cash as rf from t_days" for s in O.SERIES))
cte("t_sdd", """
with c as (select *, product(1 + r) over (partition by series order by date rows between unbounded preceding and current row) as curve from t_series)
select *, curve / max(curve) over (partition by series order by date rows between unbounded preceding and current row) - 1 as drawdown from c""")
cte("t_perf", f"""
with g as (select series, count(r) as n, product(1 + r) - 1 as total_return, stddev_samp(r) * sqrt({Y}) as vol,
 avg(r) / nullif(stddev_samp(r), 0) * sqrt({Y}) as sharpe,
 avg(r) / nullif(stddev_samp(case when r < 0 then r end), 0) * sqrt({Y}) as sortino, min(drawdown) as max_drawdown from t_sdd group by series),
h as (select *, pow(1 + total_return, {Y}::double / n) - 1 as annual_return from g where n >= 20)
select *, case when max_drawdown < 0 then annual_return / abs(max_drawdown) end as calmar from h""")

K = ("series",)
query("met_01_total_return", lambda m: O.total_return(m.series, keys=K), "select series, total_return from t_perf", d="total_return")
query("met_02_annualised_return", lambda m: O.annualised_return(m.series, periods=Y, keys=K), "select series, annual_return from t_perf", d="annual_return")
query("met_03_sharpe", lambda m: O.sharpe(m.series, periods=Y, min_obs=20, keys=K), "select series, sharpe from t_perf", d="sharpe")
query("met_03_sharpe_over_cash", lambda m: O.sharpe(m.series, rf="rf", periods=Y, keys=K),
      f"select series, avg(r - rf) / nullif(stddev_samp(r - rf), 0) * sqrt({Y}) as sharpe from t_series group by 1", d="sharpe")
query("met_03_sharpe_constant_rate", lambda m: O.sharpe(m.series, rf=0.02, periods=Y, keys=K),
      f"select series, avg(r - 0.02::double / {Y}) / nullif(stddev_samp(r - 0.02::double / {Y}), 0) * sqrt({Y}) as sharpe from t_series group by 1", d="sharpe")
query("met_04_volatility", lambda m: O.volatility(m.series, periods=Y, keys=K), "select series, vol from t_perf", d="vol")
query("met_05_sortino", lambda m: O.sortino(m.series, periods=Y, keys=K), "select series, sortino from t_perf", d="sortino")
query("met_06_drawdown_series", lambda m: O.drawdown(m.series, keys=K).select("series", "date", "curve", "drawdown"),
      "select series, date, curve, drawdown from t_sdd", d="curve drawdown")
query("met_06_max_drawdown", lambda m: O.max_drawdown(m.series, keys=K), "select series, max_drawdown from t_perf", d="max_drawdown")
PERF = "total_return vol sharpe sortino max_drawdown annual_return calmar"
query("met_07_calmar_performance", lambda m: O.performance(m.series, periods=Y, keys=K), "select * from t_perf", d=PERF)


def period_metrics_sql(pnl: str, keys: str) -> str:
    """Twin of ``period_metrics`` over ``pnl`` with columns keys, period, date, net, gross, turnover, rf."""
    w = f"(partition by {keys} order by date rows between unbounded preceding and current row)"
    return f"""
with c as (select *, product(1 + net) over {w} as curve from {pnl}), d as (select *, curve / max(curve) over {w} - 1 as dd from c)
select {keys}, count(net) as n, product(1 + net) - 1 as total_return, product(1 + net + rf) - 1 as fund_total, avg(net) * {Y} as net_year,
 avg(net + rf) * {Y} as fund_year, avg(gross) * {Y} as gross_year, avg(rf) * {Y} as cash_year, stddev_samp(net) * sqrt({Y}) as vol_year,
 avg(net) / nullif(stddev_samp(net), 0) * sqrt({Y}) as sharpe, avg(turnover) as turnover, min(dd) as max_drawdown
from d group by {keys} having count(net) >= 20"""


PM = "total_return fund_total net_year fund_year gross_year cash_year vol_year sharpe turnover max_drawdown"
cte("t_pp", f"select p.date, period, net, gross, turnover, rf from t_fund p join {B.periods_sql()} on date between lo and hi")
query("met_08_period_metrics", lambda m: O.period_metrics(N.slice_period(m.pnl_rf(m.pnl), P.PERIODS), Y, ("period",)),
      period_metrics_sql("t_pp", "period"), d=PM)
cte("t_grid_pp", " union all ".join(
    f"select {n}::integer as smooth, p.date, period, net, gross, turnover, coalesce(rf, 0) as rf from t_pnl_main_{n} p "
    f"left join t_rf r on r.date = p.date join {B.periods_sql('p.date')} on p.date between lo and hi" for n in P.GRID))
query("met_09_metrics_by_window", lambda m: O.period_metrics(N.slice_period(m.pnl_rf(m.pnl_grid), P.PERIODS), Y, ("smooth", "period")),
      period_metrics_sql("t_grid_pp", "smooth, period"), d=PM)
cte("t_aum_pp", " union all ".join(
    f"select {a}::double as aum, p.date, period, net, gross, turnover, coalesce(rf, 0) as rf "
    f"from t_pnl_{'main' if a == P.AUM else f'a{int(a)}'}_{P.SMOOTH} p left join t_rf r on r.date = p.date "
    f"join {B.periods_sql('p.date')} on p.date between lo and hi" for a in P.AUMS))
query("pf_18_capacity_curve", lambda m: O.period_metrics(N.slice_period(m.pnl_rf(m.pnl_aum), P.PERIODS), Y, ("aum", "period")),
      period_metrics_sql("t_aum_pp", "aum, period"), d="aum " + PM)
query("met_10_annual_table", lambda m: O.annual_table(m.days, Y), f"""
with y as (select *, cast(year(date) as integer) as year from t_days),
c as (select *, product(1 + flat) over (partition by year order by date rows between unbounded preceding and current row) as curve from y),
d as (select *, curve / max(curve) over (partition by year order by date rows between unbounded preceding and current row) - 1 as dd from c)
select year, count(*) as n, product(1 + flat) - 1 as flat, product(1 + real) - 1 as real, product(1 + fund_real) - 1 as fund_real,
 product(1 + cash) - 1 as cash, product(1 + index) - 1 as index, avg(flat) / nullif(stddev_samp(flat), 0) * sqrt({Y}) as sharpe,
 min(dd) as max_drawdown, stddev_samp(flat) * sqrt({Y}) as vol, avg(n_pos) as names, avg(turnover) as turnover
from d group by year having count(*) >= 20 and avg(n_pos) >= 1""", d="flat real fund_real cash index sharpe max_drawdown vol names turnover")
MON = [f"m{i:02d}" for i in range(1, 13)]
query("met_11_monthly_returns", lambda m: O.monthly_returns(m.series, keys=K), "select series, cast(year(date) as integer) as year, " + ", ".join(
    f"product(1 + r) filter (month(date) = {i}) - 1 as m{i:02d}" for i in range(1, 13)) + " from t_series group by 1, 2", d=" ".join(MON))
cte("t_roll", f"""
select series, date, case when count(r) over a >= {Y} then avg(r) over a / nullif(stddev_samp(r) over a, 0) * sqrt({Y}) end as rolling_sharpe,
 case when count(r) over b >= 12 then stddev_samp(r) over b * sqrt({Y}) end as rolling_vol from t_series
window a as (partition by series order by date {B.rows_back(Y)}), b as (partition by series order by date {B.rows_back(12)})""")
query("met_12_rolling_sharpe_vol", lambda m: O.rolling_risk(m.series, n_sharpe=Y, n_vol=12, periods=Y, keys=K), "select * from t_roll",
      d="rolling_sharpe rolling_vol")
query("met_12_rolling_summary", lambda m: O.rolling_risk_summary(O.rolling_risk(m.series, n_sharpe=Y, n_vol=12, periods=Y, keys=K), 0.05, K), """
select series, avg(case when rolling_vol is not null then case when rolling_vol > 0.05 then 1.0::double else 0 end end) as share_above,
 median(rolling_vol) as median_vol, max(rolling_vol) as max_vol, arg_max(date, rolling_vol) as date_of_max from t_roll group by 1""",
      d="share_above median_vol max_vol")
query("met_13_moments", lambda m: O.moments(m.series, keys=K), """
select series, count(r) as n, avg(r) as mean, stddev_samp(r) as std, skewness(r) as skew, kurtosis(r) as kurtosis from t_series group by 1""",
      d="mean std skew kurtosis")
query("met_13_histogram", lambda m: O.histogram(m.series, bins=70, keys=K), """
with l as (select series, min(r) as lo, max(r) as hi from t_series group by 1)
select s.series, cast(least(69, floor((r - lo) / (hi - lo) * 70)) as integer) as bin, count(*) as n from t_series s join l on l.series = s.series group by 1, 2""")
query("met_14_market_neutrality", lambda m: O.market_neutrality(m.series.join(m.index.select("date", "m"), "date"), keys=K), f"""
with j as (select s.*, m from t_series s join t_index i on i.date = s.date),
g as (select series, {B.corr_sql('m', 'r')} as corr, {B.slope_sql('m', 'r')} as slope from j group by series)
select *, abs(corr) > 0.3 as alert from g""", d="corr slope")
query("met_15_execution_diagnostic", lambda m: O.execution_diagnostic(m.pnl, Y), f"""
with g as (select avg(turnover) as turnover, avg(turnover) * 0.0005 * {Y} as cost_year, avg(gross) * {Y} as gross_year, avg(net_flat) * {Y} as net_year,
 stddev_samp(net_flat) * sqrt({Y}) as vol_year from t_pnl)
select *, gross_year > 0 and net_year <= 0 as cost_eats_gross, vol_year < 0.06 as below_vol_target from g""",
      d="turnover cost_year gross_year net_year vol_year")
query("met_16_report_days", lambda m: m.days, "select * from t_days",
      d="flat real fund_flat fund_real index cash turnover gross cost spread impact borrow hedge")
query("met_16_period_comparison_table", lambda m: O.period_comparison_table(m.days, Y), f"""
with o as (select series, avg(r - rf) / nullif(stddev_samp(r - rf), 0) * sqrt({Y}) as sharpe_over_cash from t_series
 where series in ('fund_flat', 'fund_real', 'index') group by 1)
select p.series, n, total_return, annual_return, vol, max_drawdown, case when p.series <> 'cash' then sharpe end as sharpe,
 case when p.series <> 'cash' then sortino end as sortino, case when p.series <> 'cash' then calmar end as calmar, sharpe_over_cash,
 case when o.series is not null then total_return - (select total_return from t_perf where series = 'cash') end as excess
from t_perf p left join o on o.series = p.series""", d=PERF + " sharpe_over_cash excess")
query("met_17_signals_table", lambda m: O.signals_table(m.weights, B.marked_names(m), "1999-01-01"), """
with z as (select w.ticker, n.subsector, round(sum(abs(w)), 9) as size from t_w w join t_marked n on n.ticker = w.ticker where n.subsector <> 'A DEFINIR' group by 1, 2),
c as (select *, row_number() over (partition by subsector order by size desc, ticker) as rn from z),
p as (select ticker, subsector from c where rn = 1 order by size desc, ticker limit 6),
a as (select w.ticker, p.subsector, last_day(date) as month_end, avg(w) as weight from t_w w join p on p.ticker = w.ticker
 where date >= date '1999-01-01' group by 1, 2, 3)
select *, case when weight is null or abs(weight) < 1e-4 then 'HOLD' when weight > 0 then 'BUY' else 'SELL' end as side from a""", d="weight")
query("met_18_best_years_concentration", lambda m: O.best_years_concentration(m.series, keys=K), """
with y as (select series, cast(year(date) as integer) as year, product(1 + r) - 1 as v from t_series group by 1, 2),
k as (select *, row_number() over (partition by series order by v desc, year) as rk from y)
select series, sum(v) filter (rk <= 2) as best_two, product(1 + v) - 1 as total, count(*) filter (v < 0) as negative_years,
 arg_max(year, v) as best_year, arg_min(year, v) as worst_year from k group by 1""", d="best_two total")
query("met_19_monthly_activity", lambda m: O.monthly_activity(m.days),
      "select last_day(date) as month_end, avg(n_pos) as positions, avg(turnover) as turnover from t_days group by 1", d="positions turnover")
query("met_20_cost_vs_alpha", lambda m: O.cost_vs_alpha(m.days, Y), f"""
select avg(spread) / avg(cost) as share_spread, avg(impact) / avg(cost) as share_impact, avg(borrow) / avg(cost) as share_borrow,
 avg(hedge) / avg(cost) as share_hedge, avg(cost) * {Y} as cost_year, avg(cost) / avg(turnover) * 10000 as cost_bps,
 avg(gross) / avg(turnover) * 10000 as alpha_bps from t_days""",
      d="share_spread share_impact share_borrow share_hedge cost_year cost_bps alpha_bps")
query("met_21_unit_alpha", lambda m: O.unit_alpha(m.days),
      "select avg(gross) / avg(turnover) * 10000 as alpha_bps, avg(cost) / avg(turnover) * 10000 as cost_bps from t_days", d="alpha_bps cost_bps")
query("met_22_tail_risk", lambda m: O.tail_risk(m.series, keys=K), """
with q as (select series, quantile_cont(r, 0.05) as q5, quantile_cont(r, 0.01) as q1 from t_series group by 1)
select s.series, -any_value(q5) as var95, -any_value(q1) as var99, -avg(case when r <= q5 then r end) as es95,
 -avg(case when r <= q1 then r end) as es99 from t_series s join q on q.series = s.series group by 1""", d="var95 var99 es95 es99")
query("met_22_underwater_days", lambda m: O.underwater_days(m.series, keys=K), """
with i as (select *, sum(case when drawdown >= 0 then 1 else 0 end) over (partition by series order by date) as island from t_sdd)
select series, max(run) as underwater_days from (select series, island, count(*) filter (drawdown < 0) as run from i group by 1, 2) group by 1""")
query("met_22_top5_pnl_share", lambda m: O.top_names_pnl_share(m.ledger), """
with b as (select ticker, abs(sum(w * coalesce(r, 0))) as a from t_led group by 1)
select (select sum(a) from (select a from b order by a desc, ticker limit 5)) / sum(a) as top_share from b""", d="top_share")
STRESS = (("first_half_1998", "1998-01-01", "1998-06-30"), ("year_2000", "2000-01-01", "2000-12-31"))
query("met_22_stress_windows", lambda m: O.stress_windows(m.series, STRESS, keys=K), " union all ".join(
    f"select series, '{n}' as \"window\", count(r) as n, product(1 + r) - 1 as total_return from t_series where date between date '{a}' and date '{b}' group by 1"
    for n, a, b in STRESS), d="total_return")
query("met_22_rolling_beta", lambda m: O.rolling_beta(m.series.join(m.index.select("date", "m"), "date"), 26, keys=K), f"""
with j as (select s.series, s.date, r, m from t_series s join t_index i on i.date = s.date),
b as (select series, case when count(r) over w >= 26 then covar_pop(m, r) over w / nullif(var_pop(m) over w, 0) end as b from j
 window w as (partition by series order by date {B.rows_back(26)}))
select series, quantile_cont(b, 0.05) as p05, quantile_cont(b, 0.5) as p50, quantile_cont(b, 0.95) as p95 from b group by 1""", d="p05 p50 p95")
