"""Return and shock queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketripple.catalog import base_sql as B
from marketripple.catalog.registry import cte, query
from marketripple.functions.expr import months_between_rule  # noqa: F401
from marketripple.operators import panel as N
from marketripple.operators import returns as O
from marketripple.operators import shock as S
from marketripple.operators import universe as U
from marketripple.plans import market as P

query("ret_01_daily_returns", lambda m: O.daily_returns(m.prices.select("date", "idx", "ticker", "close")),
      "select date, idx, ticker, close, r from t_px", d="close r")

# Prices with a split: half the price from 1998-01-05 on for keys 3 mod 10.
cte("t_split", """
select p.date, p.idx, p.ticker, case when k % 10 = 3 and date >= date '1998-01-05' then close / 2 else close end as close
from t_px p join t_names n on n.ticker = p.ticker""")
cte("t_clean", f"""
with q as (select *, case when close >= 1 then close end / nullif(lag(case when close >= 1 then close end)
  over (partition by ticker order by idx), 0) as q from t_split)
select date, idx, ticker, close, case when q is null then null
 when abs(q - 1) > 0.35 and len(list_filter({list(map(float, O.SPLIT_FACTORS))}, lambda f: abs(q / f - 1) <= 0.12 or abs(q * f - 1) <= 0.12)) > 0
 then 0 else greatest(-0.5, least(0.5, q - 1)) end as r from q""")


def _split(m):
    k = m.names.select("ticker", "k")
    d = m.prices.select("date", "idx", "ticker", "close").join(k, "ticker")
    cut = (F.col("k") % 10 == 3) & (F.col("date") >= F.lit("1998-01-05").cast("date"))
    return d.withColumn("close", F.when(cut, F.col("close") / 2).otherwise(F.col("close"))).drop("k")


query("ret_02_clean_corporate_actions", lambda m: O.clean_corporate_actions(_split(m)),
      "select date, idx, ticker, close, r from t_clean", d="close r")
query("ret_03_hybrid_union", lambda m: O.hybrid_union(
    m.panel.join(m.names.where(F.col("k") % 3 != 0), "ticker", "left_semi"), O.clean_corporate_actions(_split(m)), 230), """
with pr as (select date, ticker, r from t_panel where ticker in (select ticker from t_names where k % 3 <> 0))
select date, ticker, r, 'primary' as source from pr
union all select date, ticker, r, 'fallback' from t_clean
where ticker not in (select ticker from pr where r is not null)
 and ticker in (select ticker from t_clean group by 1 having count(r) >= 230)""", d="r")
query("ret_04_source_agreement", lambda m: O.source_agreement(
    m.panel, O.daily_returns(_split(m))), f"""
with s as (select date, ticker, close / nullif(lag(close) over (partition by ticker order by idx), 0) - 1 as y from t_split),
a as (select p.ticker, {B.corr_sql('p.r', 's.y')} as corr, stddev_samp(p.r - s.y) as sd_diff,
 count(case when y is not null then r end) as n from t_panel p join s on s.date = p.date and s.ticker = p.ticker group by 1)
select *, corr < 0.90 as abaixo_090 from a""", d="corr sd_diff")
cte("t_cover", f"""
with n as (select date, count(r) as n from t_panel group by date),
f as (select *, coalesce(case when count(n) over w >= {P.GUARD_MIN} then median(n) over w end,
  (select median(n) from n)) as ref from n window w as (order by date {B.rows_back(P.GUARD)}))
select date, n, ref, n >= greatest(ref * 0.6, 1) or ref < 20 as sessao from f""")
query("ret_05_session_coverage", lambda m: O.session_coverage(m.panel, P.GUARD, P.GUARD_MIN),
      "select date, n, ref, sessao from t_cover", d="ref")
query("ret_05_ghost_holiday_filter", lambda m: O.ghost_holiday_filter(m.panel.select("date", "ticker", "r"), P.GUARD, P.GUARD_MIN),
      "select date, ticker, r from t_panel where date in (select date from t_cover where sessao)", d="r")
query("ret_06_inject_index_asset", lambda m: O.inject_index_asset(m.panel, m.index), """
select date, ticker, r from t_panel where date in (select date from t_index)
union all select date, 'IBOV_SYNTHETIC', m from t_index""", d="r")
query("ret_07_coverage_by_day", lambda m: O.coverage_by_day(m.panel),
      "select date, count(r) as n, count(r)::double / (select count(distinct ticker) from t_panel) as cobertura from t_panel group by date",
      d="cobertura")

query("shk_01_market_shock", lambda m: S.market_shock(m.prices, P.REG, P.REG_MIN).select("date", "ticker", "eps", "beta"),
      "select date, ticker, eps, beta from t_shk", d="eps beta")
cte("t_gm", """
with x as (select p.date, p.idx, p.ticker, p.r, p.m, n.sector, n.subsector from t_px p join t_names n on n.ticker = p.ticker),
t as (select date, subsector, sum(r) as s, count(r) as n from x group by 1, 2)
select x.*, (t.s - coalesce(x.r, 0)) / nullif(t.n - case when x.r is not null then 1 else 0 end, 0) as g
from x join t on t.date = x.date and t.subsector = x.subsector""")


def _with_class(m, *cols):
    return m.prices.select("date", "idx", "ticker", "r", "m").join(m.names.select("ticker", *cols), "ticker")


def _grouped(m):
    return S.group_mean_of_others(_with_class(m, "sector", "subsector"), "subsector")


query("shk_02_ex_self_group_mean", lambda m: _grouped(m).select("date", "ticker", "g"), "select date, ticker, g from t_gm", d="g")
N2 = 60
cte("t_two", f"""
with o as (select *, coalesce(m, 0) as x, coalesce(g, 0) as z, count(*) over (partition by ticker) as n_rows from t_gm where r is not null),
s as (select *, cast(count(*) over w as double) as n, sum(x) over w as sx, sum(z) over w as sz, sum(r) over w as sy, sum(x*x) over w as sxx,
  sum(z*z) over w as szz, sum(x*z) over w as sxz, sum(x*r) over w as sxy, sum(z*r) over w as szy
  from o where n_rows >= {N2 + 10} window w as (partition by ticker order by idx {B.rows_back(N2)})),
c as (select *, sxx-sx*sx/n as cxx, szz-sz*sz/n as czz, sxz-sx*sz/n as cxz, sxy-sx*sy/n as cxy, szy-sz*sy/n as czy from s),
d as (select *, cxx*czz-cxz*cxz as det from c),
b as (select *, case when n >= {N2} and det > 1e-14*cxx*czz and det > 0 then (cxy*czz-czy*cxz)/det end as b1,
  case when n >= {N2} and det > 1e-14*cxx*czz and det > 0 then (czy*cxx-cxy*cxz)/det end as b2 from d)
select date, idx, ticker, r, r - (sy-b1*sx-b2*sz)/n - b1*x - b2*z as eps2, b1 as beta_m, b2 as beta_g from b""")
query("shk_03_two_factor_shock", lambda m: S.two_factor_shock(_grouped(m), N2).select("date", "ticker", "eps2", "beta_m", "beta_g"),
      "select date, ticker, eps2, beta_m, beta_g from t_two", d="eps2 beta_m beta_g")
# every 23rd name has no class yet, and names without a price are no peers
query("shk_04_peer_group_choice", lambda m: S.peer_group_choice(B.marked_names(m), 15, m.prices.where(F.col("close").isNotNull())).select("ticker", "peer_group"), """
with c as (select subsector, count(*) as n from t_marked where subsector <> 'A DEFINIR' and ticker in (select ticker from t_px where close is not null) group by 1)
select ticker, case when c.n - 1 >= 15 then 'sub:' || m.subsector else 'sec:' || m.sector end as peer_group from t_marked m left join c on c.subsector = m.subsector""")
query("shk_05_accumulate_shock", lambda m: S.accumulate_shock(
    m.panel.select("date", "idx", "ticker", "eps"), P.ACC, P.ACC_LAG, P.ACC_MIN), "select date, idx, ticker, eps, acc from t_panel", d="eps acc")
query("shk_06_restrict_targets", lambda m: S.restrict_targets(
    m.panel.select("date", "ticker", "eps"), m.edges.select(F.col("src").alias("ticker"))),
      "select date, ticker, eps from t_panel where ticker in (select src from t_edges)", d="eps")
query("shk_07_beta_summary", lambda m: S.beta_summary(m.panel),
      "select count(beta) as n_beta, median(beta) as beta_mediana from t_panel", d="beta_mediana")
