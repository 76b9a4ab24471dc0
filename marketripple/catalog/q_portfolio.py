"""Portfolio construction queries."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from marketripple.catalog import base_sql as B
from marketripple.catalog.registry import cte, query
from marketripple.operators import portfolio as O
from marketripple.plans import market as P

K = P.BOOK
OUT = ("date", "ticker", "w")
cte("t_b", "select * from t_b_main")

query("pf_01_portfolio_vol", lambda m: O.portfolio_vol(m.book, P.VOL, P.YEAR).select("idx", "vol"),
      B.vol_sql("t_b"), d="vol")
query("pf_02_vol_target", lambda m: O.vol_target(m.book, O.portfolio_vol(m.book, P.VOL, P.YEAR), K).select(*OUT),
      "select date, ticker, w from t_s0_main", d="w")
query("pf_03_cap_liquidity", lambda m: O.cap_liquidity(O.liquidity_limit(m.book, K)).select(*OUT, "lim"),
      "select date, ticker, greatest(-lim, least(lim, w)) as w, lim from t_b", d="w lim")
query("pf_04_cap_name", lambda m: O.cap_name(m.book, K).select(*OUT),
      "select date, ticker, greatest(-0.05, least(0.05, w)) as w from t_b", d="w")
query("pf_05_cap_sector", lambda m: O.cap_sector(O.cap_name(m.book, K), K).select(*OUT), f"""
with c as (select * replace (greatest(-0.05, least(0.05, w)) as w) from t_b),
s as ({B.sector_sql('c')}) select date, ticker, w from s""", d="w")
query("pf_06_calibrate_loop", lambda m: O.calibrate_loop(m.prepared, K).select(*OUT), "select date, ticker, w from t_l2_main", d="w")
query("pf_07_smooth_weights", lambda m: O.smooth_weights(m.book, P.SMOOTH).select(*OUT),
      f"select date, ticker, w from ({B.smooth_sql('t_b', P.SMOOTH)})", d="w")
query("pf_08_reapply_limits", lambda m: O.apply_limits(O.smooth_weights(O.calibrate_loop(m.prepared, K), P.SMOOTH), K).select(*OUT),
      f"select date, ticker, w from t_sl_main_{P.SMOOTH}", d="w")
query("pf_09_mask_untradable", lambda m: O.mask_untradable(m.book, K).select(*OUT),
      f"select date, ticker, w from ({B.mask_sql('t_b')})", d="w")
query("pf_10_beta_hedge", lambda m: O.beta_hedge(m.book).select(*OUT), """
select date, ticker, case when beta is null and abs(w) > 0 then 0 else w end as w from t_b union all
select date, 'IBOV_SYNTHETIC', -coalesce(sum(w * beta), 0) from t_b group by date""", d="w")
query("pf_11_execution_lag", lambda m: O.execution_lag(m.book).select(*OUT),
      "select date, ticker, lag(w) over (partition by ticker order by idx) as w from t_b", d="w")
query("pf_12_build_portfolio", lambda m: O.build_portfolio(m.book, K), "select date, idx, ticker, w from t_w", d="w")
query("pf_12_build_portfolio_grid", lambda m: m.weights_grid,
      " union all ".join(f"select {n}::integer as smooth, date, idx, ticker, w from t_w_main_{n}" for n in P.GRID), d="w")
ALT = replace(K, smooth_in_loop=True, session_mask=False)
query("pf_13_build_portfolio_alt", lambda m: O.build_portfolio(m.book, ALT),
      f"select date, idx, ticker, w from t_w_alt_{P.SMOOTH}", d="w")
query("pf_14_verify_limits", lambda m: O.verify_limits(m.weights, m.book, K), f"""
with l as (select date, ticker, sector, lag(adtv * 0.10 / {P.AUM}::double) over (partition by ticker order by idx) as lim from t_b),
j as (select w.date, l.sector, abs(coalesce(w.w, 0)) as aw, l.lim from t_w w left join l on l.date = w.date and l.ticker = w.ticker
 where w.ticker <> 'IBOV_SYNTHETIC'),
s as (select date, sector, max(aw) as mx, sum(aw) as sg, max(aw - lim) as lx, count(*) filter (aw - 0.05 > 1e-6) as nv,
 count(*) filter (aw - lim > 1e-6) as lv from j group by 1, 2)
select max(mx) as max_name, max(sg) as max_sector, max(lx) as max_over_liquidity, cast(sum(nv) as bigint) as n_name,
 count(*) filter (sg - 0.25 > 1e-6) as n_sector, cast(sum(lv) as bigint) as n_liquidity from s""",
      d="max_name max_sector max_over_liquidity")
query("pf_15_phantom_exposure", lambda m: O.phantom_exposure(m.weights, m.panel), """
with g as (select date, ticker, r is null as now, lag(r is null, 1, true) over (partition by ticker order by idx) as before from t_panel),
d as (select w.date, sum(abs(coalesce(w, 0))) as g, sum(case when now then abs(coalesce(w, 0)) else 0 end) as t,
 sum(case when now and before then abs(coalesce(w, 0)) else 0 end) as c from t_w w join g on g.date = w.date and g.ticker = w.ticker
 where w.ticker <> 'IBOV_SYNTHETIC' group by 1)
select avg(t / nullif(g, 0)) as share_total, avg(c / nullif(g, 0)) as share_by_construction from d""", d="share_total share_by_construction")
STAGES = {"0_signal": "t_b_main"}
for _i in range(3):
    STAGES[f"{_i + 1}a_vol"] = f"t_s{_i}_main"
    STAGES[f"{_i + 1}b_limits"] = f"t_l{_i}_main"
STAGES["4_smooth"] = f"t_sm_main_{P.SMOOTH}"
cte("t_st_hedge", f"select * replace (case when beta is null and abs(w) > 0 then 0 else w end as w) from t_sm_main_{P.SMOOTH}")
STAGES["5_hedge"] = "t_st_hedge"
query("pf_16_stage_diagnostics", lambda m: O.stage_diagnostics(m.prepared, K), " union all ".join(f"""
select '{s}' as stage, avg(g) as gross, avg(n) as positions, (select avg(vol) from ({B.vol_sql(t)})) as vol from (
 select idx, sum(abs(w)) as g, count(*) filter (abs(w) > 1e-9) as n from {t} group by idx)""" for s, t in STAGES.items()),
      d="gross positions vol")
cte("t_bite_n", "select * replace (greatest(-0.05, least(0.05, w)) as w) from t_s0_main")
cte("t_bite_l", "select * replace (greatest(-lim, least(lim, w)) as w) from t_s0_main")
cte("t_bite_ns", B.sector_sql("t_bite_n"))
query("pf_17_limit_bite", lambda m: O.limit_bite(m.prepared, K), "with g as (" + " union all ".join(
    f"select '{c}' as cap, avg(g) as gross from (select idx, sum(abs(w)) as g from {t} group by idx)" for c, t in {
        "none": "t_s0_main", "liquidity": "t_bite_l", "name": "t_bite_n", "name_sector": "t_bite_ns", "all": "t_l0_main"}.items())
    + ") select cap, gross, gross / (select gross from g where cap = 'none') - 1 as cut from g", d="gross cut")
query("pf_17_leverage_ceiling", lambda m: O.leverage_ceiling_share(O.portfolio_vol(m.book, P.VOL, P.YEAR), K), """
select median(s) as median_scalar, avg(case when s >= 3 then 1.0::double else 0 end) as share_at_ceiling
from (select 0.12 / nullif(vol, 0) as s from t_v0_main) where s is not null""", d="median_scalar share_at_ceiling")
cte("t_exp", """
with d as (select date, sum(case when ticker <> 'IBOV_SYNTHETIC' then greatest(coalesce(w, 0), 0) else 0 end) as l,
 sum(case when ticker <> 'IBOV_SYNTHETIC' then least(coalesce(w, 0), 0) else 0 end) as s,
 sum(case when ticker = 'IBOV_SYNTHETIC' then coalesce(w, 0) else 0 end) as h from t_w group by date),
m as (select last_day(date) as month_end, avg(l) as long, avg(s) as short, avg(h) as hedge from d group by 1)
select *, long + short as net, long - short as gross, long + short + hedge as total_net from m""")
query("pf_19_exposures", lambda m: O.exposures(m.weights), "select * from t_exp", d="long short hedge net gross total_net")
query("pf_19_exposure_bands", lambda m: O.exposure_bands(O.exposures(m.weights)), """
select quantile_cont(net, 0.05) as net_p05, quantile_cont(net, 0.95) as net_p95, quantile_cont(total_net, 0.05) as total_p05,
 quantile_cont(total_net, 0.95) as total_p95, avg(total_net) as total_mean, avg(gross) as gross_mean from t_exp""",
      d="net_p05 net_p95 total_p05 total_p95 total_mean gross_mean")
query("pf_20_positions_count", lambda m: O.positions_count(m.weights),
      "select date, count(*) filter (abs(w) > 1e-9) as n_positions from t_w where ticker <> 'IBOV_SYNTHETIC' group by date")


def _net_sql(by: str, limit: float) -> str:
    return f"""
with c as (select * replace (greatest(-0.05, least(0.05, w)) as w) from t_b),
s as (select *, sum(greatest(w, 0)) over (partition by {by}) as l, sum(least(w, 0)) over (partition by {by}) as s from c)
select date, ticker, w * case when w > 0 then case when l + s > {limit} then ({limit} - s) / l else 1 end
 else case when l + s < -{limit} then (-{limit} - l) / s else 1 end end as w from s"""


query("pf_21_net_cap", lambda m: O.net_cap(O.cap_name(m.book, K), 0.10).select(*OUT), _net_sql("idx", 0.10), d="w")
query("pf_21_net_sector_cap", lambda m: O.net_cap(O.cap_name(m.book, K), 0.05, group="sector").select(*OUT),
      _net_sql("idx, sector", 0.05), d="w")
query("pf_21_order_participation_cap", lambda m: O.order_participation_cap(O.cap_name(m.book, K), 0.02, K).select(
    "date", "ticker", "order", "order_capped", "over"), f"""
with c as (select *, greatest(-0.05, least(0.05, w)) as cw, coalesce(adtv, 0) * 0.02 / {P.AUM}::double as room from t_b),
o as (select *, cw - coalesce(lag(cw) over (partition by ticker order by idx), 0) as ord from c)
select date, ticker, ord as "order", greatest(-room, least(room, ord)) as order_capped, abs(ord) > room + 1e-12 as over from o""",
      d='"order" order_capped')
query("pf_21_validate_final", lambda m: O.validate_final(m.weights, m.book, K), f"""
with l as (select date, ticker, sector, lag(adtv) over (partition by ticker order by idx) as a from t_b),
w as (select date, ticker, coalesce(w, 0) as w, abs(coalesce(w, 0) - coalesce(lag(coalesce(w, 0)) over (partition by ticker order by idx), 0)) as dw
 from t_w where ticker <> 'IBOV_SYNTHETIC'),
d as (select w.date, w.ticker, sector, w, dw, a * 0.10 / {P.AUM}::double as lim, a * 0.02 / {P.AUM}::double as room from w left join l on l.date = w.date and l.ticker = w.ticker),
s as (select date, sector, sum(abs(w)) as g, abs(sum(w)) as n from d group by 1, 2), t as (select date, abs(sum(w)) as n from d group by 1)
select 'name' as "limit", max(abs(w)) as worst, count(*) filter (abs(w) - 0.05 > 1e-6) as n_violations from d union all
select 'liquidity', max(abs(w) - lim), count(*) filter (abs(w) - lim > 1e-6) from d union all
select 'order', max(dw - room), count(*) filter (dw - room > 1e-6) from d union all
select 'sector', max(g), count(*) filter (g - 0.25 > 1e-6) from s union all
select 'sector_net', max(n), count(*) filter (n - 0.05 > 1e-6) from s union all
select 'net', max(n), count(*) filter (n - 0.10 > 1e-6) from t""", d="worst")
query("pf_22_no_trade_band", lambda m: O.no_trade_band(m.weights, 0.01).select("date", "ticker", "target", "held"), """
with recursive s as (select ticker, idx, date, w, coalesce(w, 0) as t from t_w),
f(ticker, idx, held) as (select ticker, 0::integer, case when abs(t) < 0.01 then 0 else t end from s where idx = 0
 union all select s.ticker, s.idx, case when abs(s.t - f.held) < 0.01 then f.held else s.t end from f join s on s.ticker = f.ticker and s.idx = f.idx + 1)
select s.date, s.ticker, s.w as target, f.held from s join f on f.ticker = s.ticker and f.idx = s.idx""", d="target held")
