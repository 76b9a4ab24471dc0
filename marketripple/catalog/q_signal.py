"""Signal queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketripple.catalog import base_sql as B
from marketripple.catalog.registry import cte, query
from marketripple.operators import signal as O
from marketripple.plans import market as P
from marketripple.plans.flagship import strongest_names

query("sig_01_propagate_static", lambda m: O.propagate_static(m.panel.select("date", "ticker", F.col("eps").alias("x")), m.edges), """
select p.date, e.dst as ticker, sum(coalesce(p.eps, 0) * e.strength * e.direction) as raw from t_panel p
join t_edges e on e.src = p.ticker group by 1, 2""", d="raw")
query("sig_02_propagate_temporal_ensemble", lambda m: O.propagate_temporal_ensemble(m.panel, m.graph),
      "select date, ticker, raw from t_raw", d="raw")
query("sig_03_winsorize_xsec", lambda m: O.winsorize_xsec(m.raw_signal), "select date, ticker, raw, clipped from t_z", d="raw clipped")
query("sig_04_zscore_xsec", lambda m: O.standardise(m.raw_signal).select("date", "ticker", "z"), "select date, ticker, z from t_z", d="z")
query("sig_05_smooth", lambda m: O.smooth(m.signal.select("date", "idx", "ticker", "z"), n=P.SMOOTH),
      f"select date, idx, ticker, z, avg(z) over (partition by ticker order by idx {B.rows_back(P.SMOOTH)}) as z_smooth from t_sig",
      d="z z_smooth")


def _zb(m, *extra):
    d = m.signal.select("date", "ticker", "z").join(m.panel.select("date", "ticker", "beta"), ["date", "ticker"])
    return d.join(m.names.select("ticker", *extra), "ticker") if extra else d


def _neutral_sql(group: bool) -> str:
    src = """select s.date, s.ticker, s.z, p.beta, n.subsector from t_sig s join t_panel p on p.date = s.date and p.ticker = s.ticker
      join t_names n on n.ticker = s.ticker"""
    zz = "z - avg(case when z <> 0 then z end) over (partition by date, subsector)" if group else "z"
    sub = ", subsector" if group else ""
    return f"""
with b as ({src}), v as (select *, case when z <> 0 then {zz} end as zn from b),
o as (select *, case when beta is not null then zn end as y, case when zn is not null then beta end as x from v),
s as (select date, count(x) as n, avg(x) as mx, avg(y) as my, covar_pop(x, y) as cxy, var_pop(x) as vx from o group by date)
select o.date, o.ticker, o.z, o.beta{', o.subsector' if group else ''}, coalesce(y - my - case when vx * n > 1e-12 and n >= 5 then cxy / vx else 0 end * (beta - mx), 0)
 as z_neutral from o join s on s.date = o.date"""


query("sig_06_neutralize_beta_xsec", lambda m: O.neutralize_beta_xsec(_zb(m)), _neutral_sql(False), d="z beta z_neutral")
query("sig_07_mask_untradable_signal", lambda m: O.mask_untradable_signal(m.signal.select("date", "ticker", "z"), m.panel), """
select s.date, s.ticker, case when p.r is not null then z else 0 end as z from t_sig s
join t_panel p on p.date = s.date and p.ticker = s.ticker""", d="z")
cte("t_own_z", """
with a as (select date, ticker, acc as raw from t_panel where acc <> 0 and ticker in (select dst from t_graph)),
q as (select date, quantile_cont(raw, 0.01) as lo, quantile_cont(raw, 0.99) as hi from a group by date),
c as (select a.*, greatest(lo, least(hi, raw)) as clipped from a join q on q.date = a.date),
s as (select date, avg(clipped) as mu, stddev_samp(clipped) as sd from c group by date)
select c.date, c.ticker, coalesce((clipped - mu) / case when sd = 0 then 1 else sd end, 0) as z from c join s on s.date = c.date""")
query("sig_08_own_persistence_signal", lambda m: m.own_signal.where(F.col("raw").isNotNull()).select("date", "ticker", "z"),
      "select date, ticker, z from t_own_z", d="z")
query("sig_09_active_names_per_day", lambda m: O.active_names_per_day(m.signal),
      "select date, count(*) filter (abs(z) > 1e-9) as n_active from t_sig group by date")
FW = P.FACTOR_WINDOWS
cte("t_scores", f"""
with c as (select date, idx, ticker, r,
 case when count(r) over w4 >= 4 then avg(r) over w4 end as mom21, case when count(r) over w40 >= 40 then sum(r) over w40 end as mom12_1,
 case when count(r) over w2 >= 2 then -avg(r) over w2 end as rev5, case when count(r) over w6 >= 6 then -stddev_samp(r) over w6 end as lowvol
 from t_panel window w4 as (partition by ticker order by idx {B.rows_back(4)}), w40 as (partition by ticker order by idx {B.rows_back(40, 4)}),
 w2 as (partition by ticker order by idx {B.rows_back(2)}), w6 as (partition by ticker order by idx {B.rows_back(6)})),
u as (select date, idx, ticker, r, 'mom21' as factor, mom21 as score from c union all select date, idx, ticker, r, 'mom12_1', mom12_1 from c
 union all select date, idx, ticker, r, 'rev5', rev5 from c union all select date, idx, ticker, r, 'lowvol', lowvol from c),
s as (select date, factor, avg(score) as mu, stddev_samp(score) as sd from u group by 1, 2)
select u.*, (score - mu) / case when sd = 0 then 1 else sd end as z from u join s on s.date = u.date and s.factor = u.factor""")
query("sig_10_factor_scores", lambda m: O.factor_scores(m.panel, **FW), "select date, idx, ticker, r, factor, score, z from t_scores", d="r score z")
query("sig_11_neutralize_beta_and_sector", lambda m: O.neutralize_beta_xsec(_zb(m, "subsector"), group="subsector"),
      _neutral_sql(True), d="z beta z_neutral")
query("flagship_strongest_names", lambda m: strongest_names(m.signal, 5), """
with a as (select date, ticker, raw, z, round(abs(z), 9) as az from t_sig where abs(z) > 1e-9)
select date, ticker, raw, z, cast(row_number() over (partition by date order by az desc, ticker) as integer) as rank from a
qualify rank <= 5""", d="raw z")
