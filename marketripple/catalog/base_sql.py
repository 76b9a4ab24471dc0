"""SQL twins of the engine inputs and contract tables."""

from __future__ import annotations

from marketripple.catalog.registry import cte
from marketripple.plans import market as P


def ticker_sql(k: str) -> str:
    letters = " || ".join(f"chr(cast(65 + (({k} // 2) // {26**p}) % 26 as integer))" for p in range(12, -1, -1))
    return (f"regexp_replace({letters}, '^A{{0,9}}', '') || case when {k} % 20 = 19 then '34' when {k} % 20 = 17 then '11' "
            f"when {k} % 2 = 0 then '3' else '4' end")


def bdi_sql(k: str) -> str:
    return f"case when {k} % 40 = 17 then '14' when {k} % 50 = 13 then '12' else '02' end"


def marked_names(m):
    """The names, every 23rd with the marker of unknown classes."""
    from pyspark.sql import functions as F
    return m.names.withColumn("subsector", F.when(F.col("k") % 23 == 5, "A DEFINIR").otherwise(F.col("subsector")))


def rows_back(n: int, lag: int = 0) -> str:
    return f"rows between {n - 1 + lag} preceding and {f'{lag} preceding' if lag else 'current row'}"


def clip_sql(v: str, lo: str, hi: str) -> str:
    return f"case when {v} is not null then greatest({lo}, least({hi}, {v})) end"


def corr_sql(x: str, y: str) -> str:
    xm, ym = f"case when {y} is not null then {x} end", f"case when {x} is not null then {y} end"
    return (f"case when stddev_pop({xm}) > 1e-12 and stddev_pop({ym}) > 1e-12 then covar_pop({xm}, {ym}) "
            f"/ (stddev_pop({xm}) * stddev_pop({ym})) end")


def slope_sql(x: str, y: str) -> str:
    xm, ym = f"case when {y} is not null then {x} end", f"case when {x} is not null then {y} end"
    return f"case when stddev_pop({xm}) > 1e-12 then covar_pop({xm}, {ym}) / var_pop({xm}) end"


def periods_sql(date: str = "date") -> str:
    """Table expression that tags a date with IS, OOS and full."""
    return (f"(select 'full' as period, date '0001-01-01' as lo, date '9999-01-01' as hi union all "
            f"select 'IS', date '0001-01-01', date '{P.CUT}' union all "
            f"select 'OOS', date '{P.CUT}' + 1, date '9999-01-01')")


cte("t_names", f"""
select s_suppkey as k, {ticker_sql('s_suppkey')} as ticker, n_name as sector, r_name as subsector
from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey""")
cte("t_rec", f"""
select cast(date_trunc('week', l_shipdate) as date) as date, {ticker_sql('l_suppkey')} as ticker,
 {bdi_sql('l_suppkey')} as bdi, cast(round(l_extendedprice * 100) as bigint) as vol_c,
 cast(round(l_discount * 100) as bigint) as disc_c, cast(round(l_tax * 100) as bigint) as tax_c,
 l_orderkey as file_no, l_linenumber as line_no from lineitem""")
cte("t_obs", """
select date, ticker, cast(sum(vol_c) as double) / 100 as volume,
 cast(sum(100 - disc_c) as double) / count(*) as close from t_rec group by date, ticker""")
cte("t_cal", """
select date, cast(row_number() over (order by date) - 1 as integer) as idx from (select distinct date from t_obs)""")
cte("t_codes", "select ticker, list_sort(list(distinct bdi)) as codes from t_rec group by ticker")
cte("t_classes", """
select ticker, case when regexp_matches(ticker, '3[1-9]$') then 'bdr' when list_contains(codes, '12') then 'fii'
 when ticker like '%11' and list_contains(codes, '14') then 'etf' else 'acao' end as classe from t_codes""")
cte("t_index", """
with wk as (select cast(date_trunc('week', o_orderdate) as date) as date,
  cast(sum(cast(round(o_totalprice * 100) as bigint)) as double) / 100 as v from orders group by 1),
j as (select c.date, c.idx, v / nullif(lag(v) over (order by c.idx), 0) - 1 as m from t_cal c left join wk on wk.date = c.date)
select * from j where m is not null""")
cte("t_rf", f"select date, cast(sum(tax_c) as double) / count(*) / 100 / {P.YEAR} as rf from t_rec group by date")
cte("t_monthly", """
select strftime(date, '%Y-%m') as mes, ticker, cast(sum(vol_c) as double) / 100 as volume_mes from t_rec group by 1, 2""")
cte("t_uni", f"""
select mes, ticker, volume_mes, cast(rank as integer) as rank from (
 select *, row_number() over (partition by mes order by volume_mes desc, ticker) as rank from t_monthly
 where ticker in (select ticker from t_classes where classe = 'acao')) where rank <= {P.TOP_N}""")
cte("t_official", f"""
select mes, ticker from (select *, row_number() over (partition by mes order by n desc, ticker) as rk from (
 select strftime(date, '%Y-%m') as mes, ticker, count(*) as n from t_rec group by 1, 2)) where rk <= {P.TOP_N}""")
cte("t_edges", f"""
with o as (select k, ticker, lead(ticker) over (partition by subsector order by k) as nxt from t_names)
select ticker as src, nxt as dst,
 case k % 6 {' '.join(f"when {i} then '{x}'" for i, x in enumerate(P.KINDS))} end as kind,
 0.5 + cast(k % 5 as double) / 10 as strength, cast(case when k % 6 = 5 then -1 else 1 end as integer) as direction
from o where nxt is not null""")
cte("t_px", f"""
with g as (select c.date, c.idx, s.ticker, coalesce(o.volume, 0) as volume, o.close
  from t_cal c cross join (select ticker from t_classes where classe = 'acao') s
  left join t_obs o on o.date = c.date and o.ticker = s.ticker)
select g.*, case when count(volume) over w >= {P.ADTV_MIN} then avg(volume) over w end as adtv,
 close / nullif(lag(close) over (partition by ticker order by g.idx), 0) - 1 as r, m
from g left join t_index i on i.date = g.date
window w as (partition by ticker order by g.idx {rows_back(P.ADTV)})""")
cte("t_shk", f"""
with v as (select *, case when r is not null and m is not null then r end as y,
  case when r is not null and m is not null then m end as x from t_px),
s as (select *, count(x) over w as n, coalesce(sum(x) over w, 0) as sx, coalesce(sum(y) over w, 0) as sy,
  coalesce(sum(x * x) over w, 0) as sxx, coalesce(sum(x * y) over w, 0) as sxy
  from v window w as (partition by ticker order by idx {rows_back(P.REG)})),
b as (select *, case when abs(n * sxx - sx * sx) > 1e-14 then (n * sxy - sx * sy) / (n * sxx - sx * sx) end as b from s)
select date, idx, ticker, volume, close, adtv, r, m,
 case when n >= {P.REG_MIN} and x is not null then r - ((sy - b * sx) / n + b * m) end as eps,
 case when n >= {P.REG_MIN} then b end as beta from b""")
cte("t_panel", f"""
select *, case when count(eps) over w >= {P.ACC_MIN} then sum(eps) over w end as acc from t_shk
window w as (partition by ticker order by idx {rows_back(P.ACC, P.ACC_LAG)})""")
cte("t_madtv", """
with l as (select ticker, last_day(date) as me, arg_max(adtv, date) filter (adtv is not null) as v from t_px group by 1, 2)
select ticker, last_day(me + 1) as valid_month, v from l
where last_day(me + 1) in (select last_day(date) from t_cal)""")
cte("t_members", f"""
with m as (select a.valid_month, n.subsector, a.ticker, regexp_replace(a.ticker, '[0-9]+$', '') as root, a.v
  from t_madtv a join t_names n on n.ticker = a.ticker where a.v >= {P.MIN_ADTV})
select *, count(*) over (partition by valid_month, subsector) as n_members from m
qualify n_members >= {P.MIN_MEMBERS}""")
cte("t_heads", """
with br as (select valid_month, subsector, root, ticker, v from t_members
  qualify row_number() over (partition by valid_month, subsector, root order by v desc, ticker) = 1),
rk as (select *, row_number() over (partition by valid_month, subsector order by v desc, ticker) as rk from br),
hk as (select r.*, k from rk r, (values (2), (3), (5)) as ks(k) where rk <= k)
select valid_month, subsector, root, ticker as head, v as hv, k,
 count(*) over w as n_heads, sum(v) over w as sum_hv from hk
window w as (partition by valid_month, subsector, k) qualify n_heads >= 2""")
cte("t_graph", """
select m.valid_month, 'K' || h.k || '_' || wn as variant, h.head as src, m.ticker as dst,
 case wn when 'equal' then 1.0::double / n_heads else hv / sum_hv end as strength, 1::integer as direction
from t_members m join t_heads h on h.valid_month = m.valid_month and h.subsector = m.subsector and h.root <> m.root,
 (values ('equal'), ('adtv')) as ws(wn)""")
cte("t_raw", """
select date, ticker, raw from (
 select p.date, g.dst as ticker,
  sum(p.acc * g.strength * g.direction) / (select count(distinct variant) from t_graph) as raw
 from t_panel p join t_graph g on g.valid_month = last_day(p.date) and g.src = p.ticker
 where p.acc is not null group by 1, 2) where raw <> 0""")
cte("t_z", """
with q as (select date, quantile_cont(raw, 0.01) as lo, quantile_cont(raw, 0.99) as hi from t_raw group by date),
c as (select r.date, r.ticker, r.raw, greatest(lo, least(hi, raw)) as clipped from t_raw r join q on q.date = r.date),
s as (select date, avg(clipped) as mu, stddev_samp(clipped) as sd from c group by date)
select c.date, c.ticker, c.raw, c.clipped, coalesce((clipped - mu) / case when sd = 0 then 1 else sd end, 0) as z
from c join s on s.date = c.date""")
cte("t_sig", """
select p.date, p.idx, p.ticker, z.raw, coalesce(z.z, 0) as z
from t_panel p left join t_z z on z.date = p.date and z.ticker = p.ticker
where p.ticker in (select dst from t_graph)""")
cte("t_fwd", "select *, lead(r) over (partition by ticker order by idx) as y from t_panel")

# ---- books ---------------------------------------------------------------------------------------------------
BOOK = dict(share=0.10, target=0.12, name=0.05, sector=0.25)


def vol_sql(weights: str) -> str:
    """Annualised volatility per date index of a weight table with columns (idx, ticker, w)."""
    return f"""select idx, sqrt(greatest(var_samp(p), 0) * {P.YEAR}) as vol from (
 select b.idx, q.idx as j, sum(b.w * coalesce(q.r, 0)) as p from {weights} b join t_panel q
  on q.ticker = b.ticker and q.idx between b.idx - {P.VOL} and b.idx - 1 where b.idx >= {P.VOL} group by 1, 2) group by idx"""


def scaled_sql(weights: str, vol: str) -> str:
    """Volatility-targeted rows of a book."""
    return f"""select b.* replace (b.w * coalesce(greatest(0.1, least(3, coalesce({BOOK['target']} / nullif(v.vol, 0), 1))), 1) as w)
 from {weights} b left join {vol} v on v.idx = b.idx"""


def clipped_sql(weights: str) -> str:
    n = BOOK["name"]
    return f"select * replace (greatest(-{n}, least({n}, greatest(-lim, least(lim, w)))) as w) from {weights}"


def sector_sql(weights: str, extra: str = "") -> str:
    return f"""select * exclude (g) replace (w * case when g > {BOOK['sector']} then {BOOK['sector']} / g else 1 end as w)
 from (select *, sum(abs(w)) over (partition by idx, sector{extra}) as g from {weights})"""


def smooth_sql(weights: str, n: int) -> str:
    return f"select * replace (avg(w) over (partition by ticker order by idx {rows_back(n)}) as w) from {weights}"


def hedge_lag_sql(weights: str) -> str:
    return f"""
with h as (select date, idx, ticker, case when beta is null and abs(w) > 0 then 0 else w end as w, beta from {weights}),
u as (select date, idx, ticker, w from h union all
  select date, idx, 'IBOV_SYNTHETIC', -coalesce(sum(w * beta), 0) from h group by date, idx)
select date, idx, ticker, lag(w) over (partition by ticker order by idx) as w from u"""


def mask_sql(weights: str) -> str:
    return f"""
with n as (select date, idx, count(r) as n from {weights} group by 1, 2),
f as (select *, coalesce(case when count(n) over w >= {P.GUARD_MIN} then median(n) over w end, (select median(n) from n)) as ref
  from n window w as (order by idx {rows_back(P.GUARD)}))
select b.* replace (case when b.r is null and (n >= greatest(ref * 0.6, 1) or ref < 20) then 0 else b.w end as w)
from {weights} b join f on f.idx = b.idx"""


def book_ctes(tag: str, source: str, aum: float, smooths: tuple[int, ...] = (P.SMOOTH,), iterations: int = 3,
              in_loop: bool = False, mask: bool = True) -> None:
    """CTEs t_b_<tag> (input book), t_w_<tag>_<n> (executed weights)."""
    cte(f"t_b_{tag}", f"""
select s.date, s.idx, s.ticker, s.z as w, p.r, p.adtv, p.beta, n.sector,
 coalesce(last_value(p.adtv ignore nulls) over (partition by s.ticker order by s.idx rows between unbounded preceding and current row), 0)
 * {BOOK['share']} / {aum}::double as lim
from {source} s join t_panel p on p.idx = s.idx and p.ticker = s.ticker join t_names n on n.ticker = s.ticker""")
    cur = f"t_b_{tag}"
    for i in range(iterations):
        cte(f"t_v{i}_{tag}", vol_sql(cur))
        cte(f"t_s{i}_{tag}", scaled_sql(cur, f"t_v{i}_{tag}"))
        cte(f"t_c{i}_{tag}", clipped_sql(f"t_s{i}_{tag}"))
        cte(f"t_l{i}_{tag}", sector_sql(f"t_c{i}_{tag}"))
        cur = f"t_l{i}_{tag}"
        if in_loop:
            cte(f"t_i{i}_{tag}", smooth_sql(cur, smooths[0]))
            cur = f"t_i{i}_{tag}"
    for n in smooths:
        t = f"{tag}_{n}"
        cte(f"t_sm_{t}", f"select * from {cur}" if in_loop else smooth_sql(cur, n))
        cte(f"t_sc_{t}", clipped_sql(f"t_sm_{t}"))
        cte(f"t_sl_{t}", sector_sql(f"t_sc_{t}"))
        last = f"t_sl_{t}"
        if mask:
            cte(f"t_sk_{t}", mask_sql(last))
            last = f"t_sk_{t}"
        cte(f"t_w_{t}", hedge_lag_sql(last))


COST = dict(half=(2.0, 5.0, 11.0, 24.0), brok=(3.0, 3.0, 3.5, 4.0), borrow=(0.01, 0.02, 0.035, 0.06), vol=12, vol_min=4)


def band_sql(a: str = "adtv") -> str:
    b = P.BANDS
    return (f"case when coalesce({a}, 0) >= {b[0]} then 0 when coalesce({a}, 0) >= {b[1]} then 1 "
            f"when coalesce({a}, 0) >= {b[2]} then 2 else 3 end")


def by_band(values: tuple[float, ...], band: str = "band") -> str:
    return f"(case {band} " + " ".join(f"when {i} then {v}::double" for i, v in enumerate(values)) + " end)"


def pnl_ctes(tag: str, weights: str, aum: float, sigma: str = "t_sigma") -> None:
    """CTEs t_led_<tag> (positions) and t_pnl_<tag> (per date)."""
    cte(f"t_led_{tag}", f"""
with w as (select date, idx, ticker, coalesce(w, 0) as w from {weights} where date in (select date from t_index)),
d as (select *, coalesce(abs(w - lag(w) over (partition by ticker order by idx)), 0) as dw from w)
select d.date, d.idx, d.ticker, d.w, d.dw, coalesce(s.r, i.m) as r, s.adtv, s.sigma, {band_sql('s.adtv')} as band
from d left join {sigma} s on s.date = d.date and s.ticker = d.ticker
left join t_index i on i.date = d.date and d.ticker = 'IBOV_SYNTHETIC'""")
    cte(f"t_pnl_{tag}", f"""
with c as (select date, sum(w * coalesce(r, 0)) as gross, sum(dw) as turnover,
 sum(case when ticker <> 'IBOV_SYNTHETIC' then dw * ({by_band(COST['half'])} + 2.3 + {by_band(COST['brok'])}) / 10000 else 0 end) as spread,
 sum(case when ticker <> 'IBOV_SYNTHETIC' then dw * 0.4 * sigma * sqrt(coalesce(least(dw * {aum}::double / nullif(adtv, 0), 0.25), 0.25)) else 0 end) as impact,
 sum(case when ticker <> 'IBOV_SYNTHETIC' then abs(least(w, 0)) * {by_band(COST['borrow'])} / {P.YEAR} else 0 end) as borrow,
 sum(case when ticker = 'IBOV_SYNTHETIC' then dw * 2.2 / 10000 else 0 end) as hedge from t_led_{tag} group by date)
select *, spread + impact + borrow + hedge as cost, gross - (spread + impact + borrow + hedge) as net, gross - turnover * 0.0005 as net_flat from c""")


for _name, _where in (("t_sigma", "and p.ticker in (select dst from t_graph)"), ("t_sigma_all", "")):
    cte(_name, f"""
with k as (select p.date, p.ticker, p.r, p.adtv, case when count(r) over w >= {COST['vol_min']} then stddev_samp(r) over w end as s
  from t_panel p where p.date in (select date from t_index) {_where}
  window w as (partition by ticker order by idx {rows_back(COST['vol'])})),
m as (select median(m) as m from (select date, median(s) as m from k group by date))
select date, ticker, r, adtv, coalesce(s, (select m from m)) as sigma from k""")
GRID = (4, 8, 12, 24)
AUMS = (60_000.0, 300_000.0, 900_000.0)
book_ctes("main", "t_sig", P.AUM, GRID)
for _n in GRID:
    pnl_ctes(f"main_{_n}", f"t_w_main_{_n}", P.AUM)
for _a in (AUMS[0], AUMS[2]):
    book_ctes(f"a{int(_a)}", "t_sig", _a)
    pnl_ctes(f"a{int(_a)}_{P.SMOOTH}", f"t_w_a{int(_a)}_{P.SMOOTH}", _a)
cte("t_own_sig", """select s.date, s.idx, s.ticker, coalesce(o.z, 0) as z from t_sig s
 left join t_own_z o on o.date = s.date and o.ticker = s.ticker""")
book_ctes("own", "t_own_sig", P.AUM)
pnl_ctes(f"own_{P.SMOOTH}", f"t_w_own_{P.SMOOTH}", P.AUM)
book_ctes("alt", "t_sig", P.AUM, (P.SMOOTH,), in_loop=True, mask=False)
# the production book under plain names
cte("t_w", f"select * from t_w_main_{P.SMOOTH}")
cte("t_led", f"select * from t_led_main_{P.SMOOTH}")
cte("t_pnl", f"select * from t_pnl_main_{P.SMOOTH}")


def z_sql(raw: str) -> str:
    """Winsorized z-score of a raw table (date, ticker, raw)."""
    return f"""
with v as (select date, ticker, raw from {raw} where raw is not null and raw <> 0),
q as (select date, quantile_cont(raw, 0.01) as lo, quantile_cont(raw, 0.99) as hi from v group by date),
c as (select v.*, greatest(lo, least(hi, raw)) as clipped from v join q on q.date = v.date),
s as (select date, avg(clipped) as mu, stddev_samp(clipped) as sd from c group by date)
select c.date, c.ticker, coalesce((clipped - mu) / case when sd = 0 then 1 else sd end, 0) as z from c join s on s.date = c.date"""


def static_ctes(tag: str, edges: str, window: int, shocks: str = "(select date, ticker, eps as x from t_panel)") -> None:
    """CTE t_ss_<tag>: dense smoothed signal of static edges."""
    cte(f"t_se_{tag}", edges)
    cte(f"t_sr_{tag}", f"""select p.date, e.dst as ticker, sum(coalesce(p.x, 0) * e.strength * e.direction) as raw
 from {shocks} p join t_se_{tag} e on e.src = p.ticker group by 1, 2""")
    cte(f"t_sz_{tag}", z_sql(f"t_sr_{tag}"))
    cte(f"t_ss_{tag}", f"""select p.date, p.idx, p.ticker, avg(coalesce(z.z, 0)) over (partition by p.ticker order by p.idx {rows_back(window)}) as z
 from t_panel p left join t_sz_{tag} z on z.date = p.date and z.ticker = p.ticker where p.ticker in (select dst from t_se_{tag})""")


def variant_ctes(tag: str, signal: str, smooth: int) -> None:
    """CTE t_vt_<tag>: metrics, IC and positions per period of one book."""
    book_ctes(tag, signal, P.AUM, (smooth,))
    pnl_ctes(tag, f"t_w_{tag}_{smooth}", P.AUM, "t_sigma_all")
    w = "(partition by period order by date rows between unbounded preceding and current row)"
    cte(f"t_ic_{tag}", f"""select s.date, {corr_sql('s.z', 'f.y')} as ic from {signal} s join t_fwd f on f.date = s.date and f.ticker = s.ticker
 group by s.date having {corr_sql('s.z', 'f.y')} is not null""")
    cte(f"t_vt_{tag}", f"""
with p as (select p.date, period, net, gross, turnover, coalesce(rf, 0) as rf from t_pnl_{tag} p left join t_rf r on r.date = p.date
  join {periods_sql('p.date')} on p.date between lo and hi),
c as (select *, product(1 + net) over {w} as curve from p), d as (select *, curve / max(curve) over {w} - 1 as dd from c),
g as (select period, count(net) as n, product(1 + net) - 1 as total_return, product(1 + net + rf) - 1 as fund_total, avg(net) * {P.YEAR} as net_year,
 avg(net + rf) * {P.YEAR} as fund_year, avg(gross) * {P.YEAR} as gross_year, avg(rf) * {P.YEAR} as cash_year, stddev_samp(net) * sqrt({P.YEAR}) as vol_year,
 avg(net) / nullif(stddev_samp(net), 0) * sqrt({P.YEAR}) as sharpe, avg(turnover) as turnover, min(dd) as max_drawdown from d group by period having count(net) >= 20),
i as (select period, avg(ic) as ic, case when count(*) > 1 then avg(ic) / nullif(stddev_samp(ic) / sqrt(count(*)), 0) end as ic_t, count(*) as ic_n
 from t_ic_{tag} join {periods_sql()} on date between lo and hi group by period),
o as (select period, avg(n) as n_positions from (select date, count(*) filter (abs(w) > 1e-9) as n from t_w_{tag}_{smooth}
 where ticker <> 'IBOV_SYNTHETIC' group by date) join {periods_sql()} on date between lo and hi group by period)
select g.*, ic, ic_t, ic_n, n_positions, case g.period when 'IS' then 0 when 'OOS' then 1 when 'full' then 2 else 3 end::integer as period_order
from g left join i on i.period = g.period left join o on o.period = g.period""")

cte("t_marked", f"""select n.ticker, n.sector, case when s_suppkey % 23 = 5 then 'A DEFINIR' else n.subsector end as subsector
 from t_names n join (select s_suppkey, {ticker_sql('s_suppkey')} as t from supplier) s on s.t = n.ticker""")
