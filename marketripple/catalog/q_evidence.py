"""Inference and evidence queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from marketripple.catalog import base_sql as B
from marketripple.catalog.q_graph import MIN_PAIRS, PRIOR, PRIOR_SQL, _dir
from marketripple.catalog.q_metrics import PM
from marketripple.catalog.q_returns import N2, _with_class
from marketripple.catalog.q_signal import FW
from marketripple.catalog.registry import body, cte, query
from marketripple.functions.expr import known_class
from marketripple.operators import breadth as BR
from marketripple.operators import evidence as O
from marketripple.operators import graph as G
from marketripple.operators import panel as N
from marketripple.operators import pnl as PNL
from marketripple.operators import portfolio as PF
from marketripple.operators import shock as S
from marketripple.operators import signal as SG
from marketripple.plans import market as P
from marketripple.plans import variants as VR
from marketripple.session import materialise
from marketripple.plans.summary import bundle_rows, evidence_bundle, placebo_test

Y = P.YEAR
H = 4
HORIZONS = (1, 2, 4, 8, 13, 20, 26)

cte("t_ic1", f"""select s.date, {B.corr_sql('s.z', 'f.y')} as ic from t_sig s join t_fwd f on f.date = s.date and f.ticker = s.ticker
 group by s.date having {B.corr_sql('s.z', 'f.y')} is not null""")
query("inf_01_ic_daily", lambda m: m.ic1, "select date, ic from t_ic1", d="ic")
cte("t_fwdh", " union all ".join(f"""select {h}::integer as h, date, ticker, case when count(r) over (partition by ticker order by idx
 rows between 1 following and {h} following) = {h} then sum(r) over (partition by ticker order by idx rows between 1 following and {h} following) end as y
 from t_panel""" for h in HORIZONS))
query("inf_02_ic_forward", lambda m: O.forward_returns(m.panel, HORIZONS), "select h, date, ticker, y from t_fwdh", d="y")
cte("t_ics", f"""
select period, avg(ic) as ic, case when count(*) > 1 then avg(ic) / nullif(stddev_samp(ic) / sqrt(count(*)), 0) end as t, count(*) as n
from t_ic1 join {B.periods_sql()} on date between lo and hi group by period""")
query("inf_03_ic_summary", lambda m: O.ic_summary(N.slice_period(m.ic1, P.PERIODS), ("period",)), "select * from t_ics", d="ic t")
cte("t_ich", f"""select f.h, s.date, {B.corr_sql('s.z', 'f.y')} as ic from t_sig s join t_fwdh f on f.date = s.date and f.ticker = s.ticker
 group by f.h, s.date having {B.corr_sql('s.z', 'f.y')} is not null""")
query("inf_04_ic_overlap_t", lambda m: O.ic_summary(N.slice_period(O.ic_daily(
    m.signal, O.forward_returns(m.panel, (H,)), fwd_keys=("h",)), P.PERIODS), ("period",), H), f"""
select period, avg(ic) as ic, case when count(*) > {H} then avg(ic) / nullif(stddev_samp(ic) / sqrt(count(*)::double / {H}), 0) end as t, count(*) as n
from t_ich join {B.periods_sql()} on date between lo and hi where h = {H} group by period""", d="ic t")
query("inf_05_ic_by_horizon", lambda m: O.ic_by_horizon(m.signal, m.panel, HORIZONS), """
with g as (select h, avg(ic) as ic, count(*) as n, avg(ic) / nullif(stddev_samp(ic), 0) * sqrt(count(*)::double / h) as t, avg(ic) / sqrt(h) as ic_root_h
 from t_ich group by h)
select *, 1 - ic_root_h / (select ic_root_h from g where h = 1) as decay, 1 - 1 / sqrt(h) as decay_one_day from g""",
      d="ic t ic_root_h decay decay_one_day")


def _pairs(m):
    return G.edge_pairs(m.edges, m.panel.select("date", "ticker", F.col("eps").alias("x")), m.forward.select("date", "ticker", "y"))


query("inf_06_clustered_t_by_kind", lambda m: O.clustered_t_by_kind(_pairs(m), MIN_PAIRS), f"""
with p as (select e.kind, e.src, e.dst, s.date, s.eps as x, f.y from t_edges e join t_panel s on s.ticker = e.src and s.eps is not null
  join t_fwd f on f.ticker = e.dst and f.date = s.date and f.y is not null qualify count(*) over (partition by e.kind, e.src, e.dst) >= {MIN_PAIRS}),
f as (select kind, avg(x) as mx, avg(y) as my, {B.slope_sql('x', 'y')} as b, {B.corr_sql('x', 'y')} as corr, count(*) as n, var_pop(x) * count(*) as sxx,
  count(distinct (src, dst)) as n_edges from p group by kind),
s as (select p.kind, p.date, sum((x - mx) * (y - my - b * (x - mx))) as s from p join f on f.kind = p.kind group by 1, 2),
m as (select kind, sum(s * s) as meat, count(*) as n_dates from s group by kind),
t as (select f.*, meat, n_dates, corr * sqrt(n - 2) / sqrt(greatest(1 - corr * corr, 1e-12)) as t_naive,
  b / (sqrt(n_dates::double / (n_dates - 1) * (n - 1) / (n - 2) * meat) / sxx) as t_cluster from f join m on m.kind = f.kind)
select kind, n_edges, n, n_dates, corr, t_naive, t_cluster, abs(t_naive) / abs(t_cluster) as inflation,
 n / pow(abs(t_naive) / abs(t_cluster), 2) as n_effective, abs(t_naive) >= 2 as passes_naive, abs(t_cluster) >= 2 as passes_cluster from t""",
      d="corr t_naive t_cluster inflation n_effective")
L = 12
_e = ", ".join(f"lag(e, {k}) over (partition by period order by date) as e{k}" for k in range(1, 41))
_yl = ", ".join(f"lag(ic, {k}) over (partition by period order by date) as y{k}" for k in range(1, L + 1))
_g = ", ".join(f"coalesce(sum(e * e{k}), 0) as g{k}" for k in range(1, 41))
_r = ", ".join(f"{B.corr_sql('ic', f'y{k}')} as rho{k}" for k in range(1, L + 1))
_hac = " + ".join(f"(1 - {k}::double / ({L} + 1)) * g{k}" for k in range(1, L + 1))
_auto = " + ".join(f"case when {k} <= lags_auto then (1 - {k}::double / (lags_auto + 1)) * g{k} else 0 end" for k in range(1, 41))
_rs = " + ".join(f"coalesce(rho{k}, 0)" for k in range(1, L + 1))
cte("t_hac", f"""
with p as (select period, date, ic, ic - avg(ic) over (partition by period) as e from t_ic1 join {B.periods_sql()} on date between lo and hi),
l as (select *, {_e}, {_yl} from p),
a as (select period, count(*) as n, avg(ic) as ic, stddev_samp(ic) as std_ic, sum(e * e) as g0, {_g}, {_r} from l group by period having count(*) >= 30),
b as (select *, cast(floor(4 * pow(n::double / 100, 2.0::double / 9)) as integer) as lags_auto from a),
c as (select *, ic / (std_ic / sqrt(n)) as t_naive, ic / sqrt((g0 + 2 * ({_hac})) / (n * n)) as t_hac, ic / sqrt((g0 + 2 * ({_auto})) / (n * n)) as t_hac_auto from b)
select period, n, ic, std_ic, t_naive, t_hac, t_hac_auto, lags_auto, rho1, rho5, rho{L} as rho_last, sqrt(greatest(1 + 2 * ({_rs}), 1e-12)) as inflation_theoretical,
 abs(t_naive) / abs(t_hac) as inflation_measured from c""")
HAC = "ic std_ic t_naive t_hac t_hac_auto rho1 rho5 rho_last inflation_theoretical inflation_measured"


def _hac_df(m):
    return O.newey_west_mean(N.slice_period(m.ic1, P.PERIODS), L, ("period",))


query("inf_07_newey_west_mean", _hac_df, "select * from t_hac", d=HAC)


def _breadth(m):
    return BR.effective_breadth(N.slice_period(m.signal.select("date", "ticker", "z"), P.PERIODS), ("period",))


def pair_breadth_sql(key: str, src: str) -> str:
    """p^2 over the sum of squared correlations, each over the dates on which both names signal."""
    return f"""
with s as (select {key}, date, ticker, z from {src} where z <> 0),
p as (select {key}, ticker from s group by 1, 2 having stddev_samp(z) > 1e-12),
v as (select s.* from s join p on p.{key} = s.{key} and p.ticker = s.ticker),
c as (select a.{key}, a.ticker as x, b.ticker as y, {B.corr_sql('a.z', 'b.z')} as c from v a join v b on b.{key} = a.{key} and b.date = a.date and b.ticker <> a.ticker group by 1, 2, 3),
n as (select {key}, count(*) as n_names from p group by 1 having count(*) > 1),
e as (select n.{key}, n_names + coalesce(sum(c * c), 0) as e from n left join c on c.{key} = n.{key} group by n.{key}, n_names)
select n.{key}, n_names, n_names::double * n_names / e as n_eff, n_names::double / e as ratio from n join e on e.{key} = n.{key}"""


cte("t_br", pair_breadth_sql("period", f"(select period, date, ticker, z from t_sig join {B.periods_sql()} on date between lo and hi)"))


def spectrum_sql(key: str, src: str, steps: int = 50, squares: int = 24) -> str:
    """The sign of the pairwise-complete matrix by Newton-Schulz steps, its positive part, and that part's powers, by joins."""
    return f"""
with recursive s as (select {key}, date, ticker, z from {src} where z <> 0),
p as (select {key}, ticker, row_number() over (partition by {key} order by ticker) as x, count(*) over (partition by {key}) as n_names
  from (select {key}, ticker from s group by 1, 2 having stddev_samp(z) > 1e-12)),
v as (select s.{key}, s.date, s.z, p.x from s join p on p.{key} = s.{key} and p.ticker = s.ticker),
pc as (select a.{key}, a.x, b.x as y, {B.corr_sql('a.z', 'b.z')} as c from v a join v b on b.{key} = a.{key} and b.date = a.date and b.x <> a.x group by 1, 2, 3),
c as materialized (select a.{key}, a.x, b.x as y, case when a.x = b.x then 1.0::double else coalesce(pc.c, 0) end as c from p a join p b on b.{key} = a.{key} and b.n_names > 1
  left join pc on pc.{key} = a.{key} and pc.x = a.x and pc.y = b.x),
g(step, {key}, x, y, v) as (select 0, c.{key}, x, y, c / f from c join (select {key}, sqrt(sum(c * c)) as f from c group by 1) n on n.{key} = c.{key}
  union all select a.step + 1, a.{key}, a.x, h.y, sum(a.v * h.w) from g a join
   (select a.{key}, a.x, b.y, case when a.x = b.y then 1.5::double else 0 end - 0.5::double * sum(a.v * b.v) as w from g a join g b on b.{key} = a.{key} and b.x = a.y group by a.{key}, a.x, b.y) h
   on h.{key} = a.{key} and h.x = a.y where a.step < {steps} group by 1, 2, 3, 4),
sg as materialized (select {key}, x, y, v from g where step = {steps}),
ab as materialized (select a.{key}, a.x, b.y, sum(a.c * b.v) as v from c a join sg b on b.{key} = a.{key} and b.x = a.y group by 1, 2, 3),
po as materialized (select c.{key}, c.x, c.y, (c.c + ab.v) / 2 as v from c join ab on ab.{key} = c.{key} and ab.x = c.x and ab.y = c.y),
t as (select {key}, sum(case when x = y then v else 0 end) as one, sum(v * v) as two, max(x) as n_names from po group by 1),
q(step, {key}, x, y, v) as (select 0, po.{key}, x, y, v / one from po join t on t.{key} = po.{key}
  union all select step + 1, {key}, x, y, v / sum(case when x = y then v else 0 end) over (partition by {key}) from
   (select a.step, a.{key}, a.x, b.y, sum(a.v * b.v) as v from q a join q b on b.{key} = a.{key} and b.x = a.y where a.step < {squares} group by 1, 2, 3, 4)),
top as (select q.{key}, sum(q.v * po.v) as top from q join po on po.{key} = q.{key} and po.x = q.x and po.y = q.y where step = {squares} group by 1)
select t.{key}, n_names, one * one / two as n_eff, one * one / two / n_names as ratio, top / one as pc1_share from t join top on top.{key} = t.{key}"""


def _positive_breadth(m):
    return BR.spectral_breadth(N.slice_period(m.signal.select("date", "ticker", "z"), P.PERIODS), ("period",))


cte("t_br_positive", spectrum_sql("period", f"(select period, date, ticker, z from t_sig join {B.periods_sql()} on date between lo and hi)"))


def _dense_breadth(m):
    return BR.dense_breadth(N.slice_period(m.signal.select("date", "ticker", "z"), P.PERIODS), ("period",))


cte("t_br_dense", f"""
with s as (select period, date, ticker, z from t_sig join {B.periods_sql()} on date between lo and hi),
k as (select period, ticker, avg(z) as mu, stddev_pop(z) as sd, count(*) as n from s group by 1, 2 having stddev_pop(z) > 1e-12),
u as (select s.period, s.date, s.ticker, (z - mu) / (sd * sqrt(n)) as v from s join k on k.period = s.period and k.ticker = s.ticker),
g as (select a.period, a.date as d, b.date as e, sum(a.v * b.v) as g from u a join u b on b.period = a.period and b.ticker = a.ticker group by 1, 2, 3),
e as (select period, sum(g * g) as e from g group by 1), n as (select period, count(*) as n_names from k group by 1)
select n.period, n_names, n_names::double * n_names / e as n_eff, n_names::double / e as ratio from n join e on e.period = n.period""")
query("inf_08_effective_breadth", _breadth, "select * from t_br", d="n_eff ratio")
query("inf_08_positive_breadth", _positive_breadth, "select * from t_br_positive", d="n_eff ratio pc1_share")
query("inf_08_correlation_energy", lambda m: _dense_breadth(m).select("period", "n_names", (F.col("n_names") / F.col("ratio")).alias("energy")),
      "select period, n_names, n_names / ratio as energy from t_br_dense", d="energy")


def attribution_sql(name: str, books: str, names: tuple[str, ...], lags: int, periods: int) -> None:
    """Registers CTE ``name``: normal equations by Gauss-Jordan steps, errors from each term's score series."""
    n = len(names) + 1
    x = ["1.0::double", *names]
    wide = ", ".join(f"max(case when factor = '{f}' then pnl end) as {f}" for f in names)
    left = ", ".join(f"sum({x[i]} * {x[j]}) as a_{i}_{j}" for i in range(n) for j in range(n))
    right = ", ".join(f"{float(i == j)}::double as a_{i}_{n + j}" for i in range(n) for j in range(n))
    rhs = ", ".join(f"sum({x[i]} * y) as b_{i}, sum({x[i]} * {x[i]}) as d_{i}" for i in range(n))
    steps = []
    for k in range(n):
        head = lambda j: f"case when a_{k}_{k} > 1e-12 * d_{k} then a_{k}_{j} / a_{k}_{k} else 0 end"  # noqa: E731, B023
        cells = ", ".join(f"{head(j) if i == k else f'a_{i}_{j} - a_{i}_{k} * ({head(j)})'} as a_{i}_{j}" for i in range(n) for j in range(2 * n))
        steps.append(f"g{k + 1} as (select {', '.join(f'b_{i}, d_{i}' for i in range(n))}, {cells} from g{k})")
    coef = ", ".join("(" + " + ".join(f"a_{i}_{n + j} * b_{j}" for j in range(n)) + f") as c_{i}" for i in range(n))
    resid = "y - (" + " + ".join(f"c_{i} * {x[i]}" for i in range(n)) + ")"
    scores = " union all ".join(f"select date, '{t}' as term, c_{i} as c, (" + " + ".join(f"a_{i}_{n + j} * {x[j]}" for j in range(n)) + ") * u as v from r"
                                for i, t in enumerate(("alpha_year", *names)))
    lagged = ", ".join(f"lag(v, {k}) over (partition by term order by date) as v{k}" for k in range(1, lags + 1))
    var = "sum(v * v)" + "".join(f" + 2 * (1 - {k}::double / {lags + 1}) * coalesce(sum(v * v{k}), 0)" for k in range(1, lags + 1))
    cte(name, f"""
with w as (select date, {wide} from ({books}) group by date),
j as (select p.date, p.net as y, {', '.join(names)} from t_pnl p join w on w.date = p.date where net is not null{''.join(f' and {f} is not null' for f in names)}),
g0 as (select {rhs}, {left}, {right} from j), {', '.join(steps)},
o as (select *, {coef} from g{n}), r as (select j.*, o.*, {resid} as u from j, o), s as ({scores}), l as (select *, {lagged} from s),
q as (select term, any_value(c) as c, count(*) as n, {var} as var from l group by term)
select term, case when term = 'alpha_year' then c * {periods} else c end as coef, case when var > 0 then c / sqrt(var) end as t, n from q""")


def _pos(m):
    return N.slice_period(PF.positions_count(m.weights), P.PERIODS).groupBy("period").agg(F.avg("n_positions").alias("n_positions"))


cte("t_npos", f"""select period, avg(n) as n_positions from (select date, count(*) filter (abs(w) > 1e-9) as n from t_w where ticker <> 'IBOV_SYNTHETIC'
 group by date) join {B.periods_sql()} on date between lo and hi group by period""")
cte("t_scale", """
select h.period, n_positions, std_ic, 1 / sqrt(greatest(n_positions - 3, 1)) as std_predicted, std_ic / (1 / sqrt(greatest(n_positions - 3, 1))) as ratio,
 3 + 1 / (std_ic * std_ic) as n_ic_effective, abs(t_hac) as t_now, ic from t_hac h join t_npos p on p.period = h.period""")
query("inf_09_scale_check", lambda m: O.scale_check(_hac_df(m), _pos(m), ("period",)), "select * from t_scale",
      d="n_positions std_ic std_predicted ratio n_ic_effective t_now ic")
query("inf_10_required_positions", lambda m: O.required_positions(O.scale_check(_hac_df(m), _pos(m), ("period",)), 2.0, ("period",)), """
select period, t_now, n_ic_effective, pow(2 / t_now, 2) as multiplier, n_ic_effective * pow(2 / t_now, 2) as n_required from t_scale""",
      d="t_now n_ic_effective multiplier n_required")
query("inf_11_breadth_for_ir", lambda m: O.breadth_for_ir(_hac_df(m).select("period", "ic"), _positive_breadth(m), periods=Y, keys=("period",)), f"""
with j as (select h.period, ic, n_eff, n_names, cast(t as double) as ir_target from t_hac h join t_br_positive b on b.period = h.period, (values (0.75), (1.0), (1.5)) as r(t) where ic > 0),
d as (select *, pow(ir_target / (ic * sqrt({Y})), 2) as breadth_needed from j)
select period, ir_target, breadth_needed, breadth_needed / n_eff as factor_vs_now, breadth_needed * n_names / n_eff as positions_at_ratio,
 ic * sqrt(n_eff) * sqrt({Y}) as ir_now from d""", d="ir_target breadth_needed factor_vs_now positions_at_ratio ir_now")

DRAWS = 300
cte("t_pl_real", f"""select period, avg(ic) as ic from t_ich join {B.periods_sql()} on date between lo and hi where h = {H} group by period""")
cte("t_pl_graph", f"""
with e as (select g.*, n.subsector as block from t_graph g join t_names n on n.ticker = g.dst),
h as (select *, row_number() over (partition by valid_month, variant, block order by src) as rk from (select distinct valid_month, variant, block, src from e)),
nh as (select valid_month, variant, block, count(*) as k from h group by 1, 2, 3),
mem as (select valid_month, variant, block, src as member from e union select valid_month, variant, block, dst from e),
d as (select mem.*, draw, row_number() over (partition by draw, valid_month, variant, block
  order by md5('42|' || draw || '|' || strftime(valid_month, '%Y-%m') || '|' || variant || '|' || block || '|' || member), member) as rk
  from mem, range(0, {DRAWS}) as r(draw)),
mp as (select h.*, d.draw, d.member as new_src from d join h on h.valid_month = d.valid_month and h.variant = d.variant and h.block = d.block and h.rk = d.rk)
select cast(mp.draw as integer) as draw, e.valid_month, e.variant, mp.new_src as src, e.dst, e.strength, e.direction from e join mp
 on mp.valid_month = e.valid_month and mp.variant = e.variant and mp.block = e.block and mp.src = e.src where mp.new_src <> e.dst""")
cte("t_pl_ic", f"""
with l as (select draw, valid_month, src, dst, sum(strength * direction) as f from t_pl_graph group by 1, 2, 3, 4),
r as (select l.draw, p.date, l.dst as ticker, sum(p.acc * l.f) / (select count(distinct variant) from t_graph) as raw from t_panel p
  join l on l.valid_month = last_day(p.date) and l.src = p.ticker where p.acc is not null group by 1, 2, 3),
q as (select draw, date, quantile_cont(raw, 0.01) as lo, quantile_cont(raw, 0.99) as hi from r where raw <> 0 group by 1, 2),
c as (select r.draw, r.date, r.ticker, greatest(lo, least(hi, raw)) as v from r join q on q.draw = r.draw and q.date = r.date where raw <> 0),
s as (select draw, date, avg(v) as mu, stddev_samp(v) as sd from c group by 1, 2),
z as (select c.draw, c.date, c.ticker, coalesce((v - mu) / case when sd = 0 then 1 else sd end, 0) as z from c join s on s.draw = c.draw and s.date = c.date),
g as (select d.draw, p.date, p.ticker, coalesce(z.z, 0) as z from (select distinct draw, dst from t_pl_graph) d join t_panel p on p.ticker = d.dst
  left join z on z.draw = d.draw and z.date = p.date and z.ticker = p.ticker)
select g.draw, g.date, {B.corr_sql('g.z', 'f.y')} as ic from g join t_fwdh f on f.h = {H} and f.date = g.date and f.ticker = g.ticker group by 1, 2""")
query("inf_12_placebo_graphs", lambda m: O.placebo_sizes(m.graph, m.names, DRAWS),
      """select draw, valid_month, variant, count(*) as n_edges, sum(strength * direction) as strength, count(distinct src) as n_triggers, min(src) as first_src,
      max(src) as last_src from t_pl_graph group by 1, 2, 3""", d="strength")
query("inf_12_trigger_placebo", lambda m: placebo_test(m, DRAWS, H), f"""
with f as (select period, draw, avg(ic) as ic from t_pl_ic join {B.periods_sql()} on date between lo and hi where ic is not null group by 1, 2)
select f.period, any_value(r.ic) as ic_real, avg(f.ic) as placebo_mean, stddev_pop(f.ic) as placebo_sd,
 avg(case when f.ic >= r.ic then 1.0::double else 0 end) as p_one_sided, avg(case when f.ic < r.ic then 1.0::double else 0 end) as percentile, count(f.ic) as n_draws
from f join t_pl_real r on r.period = f.period group by 1""", d="ic_real placebo_mean placebo_sd p_one_sided percentile")
query("inf_13_persistence_control", lambda m: O.persistence_control(m.pnl, m.pnl_own, Y), f"""
with j as (select a.net as y, b.net as x from t_pnl a join t_pnl_own_{P.SMOOTH} b on b.date = a.date),
e as (select *, y - (select {B.slope_sql('x', 'y')} from j) * x as e from j)
select avg(y) / nullif(stddev_samp(y), 0) * sqrt({Y}) as sharpe_signal, avg(x) / nullif(stddev_samp(x), 0) * sqrt({Y}) as sharpe_persistence,
 {B.corr_sql('x', 'y')} as corr, {B.slope_sql('x', 'y')} as beta, avg(e) * {Y} as alpha_year, avg(e) / (stddev_samp(e) / sqrt(count(*))) as t_alpha from e""",
      d="sharpe_signal sharpe_persistence corr beta alpha_year t_alpha")
NAMES4 = ("mom21", "mom12_1", "rev5", "lowvol")
cte("t_fbook", """
with t as (select factor, date, sum(abs(z)) as t from t_scores group by 1, 2),
w as (select s.*, coalesce(z / nullif(t, 0), 0) as w from t_scores s join t on t.factor = s.factor and t.date = s.date),
l as (select *, lag(w) over (partition by factor, ticker order by idx) * r as c from w)
select factor, date, coalesce(sum(c), 0) as pnl from l group by 1, 2""")
query("inf_14_factor_books", lambda m: O.factor_books(SG.factor_scores(m.panel, **FW)), "select factor, date, pnl from t_fbook", d="pnl")
attribution_sql("t_attr4", "select * from t_fbook", NAMES4, L, Y)
query("inf_14_factor_attribution", lambda m: O.factor_attribution(m.pnl, O.factor_books(SG.factor_scores(m.panel, **FW)), NAMES4, L, Y),
      "select * from t_attr4", d="coef t")
_root = math.sqrt(2 * math.log(294))
_thr = 0.42 * ((1 - O.EULER) * _root + O.EULER / _root) / math.sqrt(Y)
query("inf_15_deflated_sharpe", lambda m: O.deflated_sharpe(m.series, periods=Y, keys=("series",)), f"""
with g as (select series, count(r) as n, avg(r) / nullif(stddev_samp(r), 0) * sqrt({Y}) as sharpe, skewness(r) as skew, kurtosis(r) + 3 as kurtosis from t_series group by 1),
s as (select *, (sharpe / sqrt({Y}) - {_thr!r}::double) * sqrt(n - 1) / sqrt(greatest(1 - skew * sharpe / sqrt({Y}) + (kurtosis - 1) / 4 * pow(sharpe / sqrt({Y}), 2), 1e-9)) as x from g),
t as (select *, 1 / (1 + 0.2316419::double * abs(x)) as t from s),
p as (select *, exp(-x * x / 2) / sqrt(2 * pi()) * t * (0.319381530::double + t * (-0.356563782::double + t * (1.781477937::double + t * (-1.821255978::double + t * 1.330274429::double)))) as tail from t)
select series, sharpe, 294::integer as n_configs, {_thr * math.sqrt(Y)!r}::double as sharpe_threshold, case when x >= 0 then 1 - tail else tail end as dsr, skew, kurtosis from p""",
      d="sharpe sharpe_threshold dsr skew kurtosis")
FIRST = 1998
cte("t_gridp", " union all ".join(f"select {n}::integer as smooth, date, net, cast(year(date) as integer) as year from t_pnl_main_{n}" for n in P.GRID))
cte("t_wf", f"""
with yr as (select distinct year from t_gridp where year >= {FIRST}),
s as (select yr.year, g.smooth, case when count(case when g.year < yr.year then net end) > 60 then coalesce(avg(case when g.year < yr.year then net end)
  / nullif(stddev_samp(case when g.year < yr.year then net end), 0) * sqrt({Y}), -9) else -9 end as score from yr, t_gridp g group by 1, 2),
c as (select year, smooth from s qualify row_number() over (partition by year order by score desc, smooth) = 1),
d as (select g.year, g.smooth as chosen, g.date, g.net, count(*) over (partition by g.year) as k from t_gridp g join c on c.year = g.year and c.smooth = g.smooth)
select year, chosen, date, net from d where k >= 20""")
query("inf_16_walk_forward", lambda m: O.walk_forward(m.pnl_grid, "smooth", FIRST, Y), f"""
select year, chosen, case when count(net) > 20 then avg(net) / nullif(stddev_samp(net), 0) * sqrt({Y}) end as sharpe, product(1 + net) - 1 as total_return, count(net) as n
from t_wf group by 1, 2""", d="sharpe total_return")
query("inf_16_walk_forward_curve", lambda m: O.walk_forward_curve(m.pnl_grid, O.walk_forward_choice(m.pnl_grid, "smooth", FIRST, Y), "smooth"),
      "select year, chosen, date, net from t_wf", d="net")

# ---- static-graph variants ---------------------------------------------------------------------------------
VT = PM + " ic ic_t n_positions"
_J = "from t_edges e left join t_dir_is d on d.kind = e.kind"
EDGES = {
    "current": "select src, dst, strength, direction from t_edges",
    "sign": f"select src, dst, strength, coalesce(d.sign, e.direction) as direction {_J}",
    "conservative": f"select src, dst, strength, case when abs(d.t) >= 2 then d.sign else {PRIOR_SQL.replace('kind', 'e.kind')} end as direction {_J}",
    "prior": f"select src, dst, strength, {PRIOR_SQL} as direction from t_edges",
    "reverse": "select dst as src, src as dst, strength, direction from t_edges",
    "bidirectional": "select src, dst, strength, direction from t_edges union all select dst, src, strength, direction from t_edges",
    "base": "select src, dst, strength, direction from t_edges where kind in ('concorrente', 'cliente', 'holding')",
}
for _t, _sql in EDGES.items():
    B.static_ctes(f"v_{_t}", _sql, P.SMOOTH)
    B.variant_ctes(f"v_{_t}", f"t_ss_v_{_t}", P.SMOOTH)
cte("t_ss_masked", """select s.date, s.idx, s.ticker, case when p.r is not null then z else 0 end as z from t_ss_v_current s
 join t_panel p on p.date = s.date and p.ticker = s.ticker""")
B.variant_ctes("v_masked", "t_ss_masked", P.SMOOTH)


def _family(names: dict[str, str]) -> str:
    return " union all ".join(f"select '{n}' as variant, * from t_vt_v_{t}" for n, t in names.items())


def _fz(m, rule):
    return G.freeze_directions(m.edges, _dir(m), PRIOR, rule)


query("met_09_variant_table", lambda m: VR.compare(
    m, {"current": m.edges, "sign": _fz(m, "sign"), "conservative": _fz(m, "conservative"), "prior": _fz(m, "prior")}),
      _family({k: k for k in ("current", "sign", "conservative", "prior")}), d=VT)
PAIRS = ((1, 4), (2, 12), (4, 12), (12, 12), (4, 24))
for _a in sorted({a for a, _ in PAIRS}):
    B.static_ctes(f"j{_a}", EDGES["current"], _a)
for _a, _b in PAIRS:
    B.variant_ctes(f"j{_a}_{_b}", f"t_ss_j{_a}", _b)
query("inf_18_window_sensitivity", lambda m: VR.window_sensitivity(m, m.edges, PAIRS), " union all ".join(
    f"select {a}::integer as signal_window, {b}::integer as smooth, * from t_vt_j{a}_{b} where period = 'OOS'" for a, b in PAIRS), d=VT)
query("inf_19_bidirectional_test", lambda m: VR.compare(
    m, {"only_b": m.edges, "bidirectional": G.bidirectional(m.edges), "only_a": G.reverse_graph(m.edges)}),
      _family({"only_b": "current", "bidirectional": "bidirectional", "only_a": "reverse"}), d=VT)


def _point_in_time(m):
    base = m.edges.where(F.col("kind").isin("concorrente", "cliente", "holding"))
    return VR.compare(m, {"base": base, "expanded": m.edges}, masked={"masked": "expanded"})


query("inf_20_point_in_time_test", _point_in_time, _family({"base": "base", "expanded": "current", "masked": "masked"}), d=VT)

# ---- frozen choice of the peer-group threshold -------------------------------------------------------------
KGRID = (0, 12, 14, 16, 18, 19, 20, 22)
for _k in KGRID:
    grp = "'sec:' || n.sector" if _k == 0 else (f"case when count(case when n.ticker in (select ticker from t_px where close is not null) then 1 end) over (partition by n.subsector) - 1 >= {_k} then 'sub:' || n.subsector else 'sec:' || n.sector end")
    cte(f"t_k{_k}", f"""
with pg as (select ticker, {grp} as grp from t_names n), x as (select p.date, p.idx, p.ticker, p.r, p.m, grp from t_px p join pg on pg.ticker = p.ticker),
t as (select date, grp, sum(r) as s, count(r) as n from x group by 1, 2),
gm as (select x.*, (t.s - coalesce(x.r, 0)) / nullif(t.n - case when x.r is not null then 1 else 0 end, 0) as g from x join t on t.date = x.date and t.grp = x.grp),
o as (select *, coalesce(m, 0) as x, coalesce(g, 0) as z, count(*) over (partition by ticker) as n_rows from gm where r is not null),
s as (select *, cast(count(*) over w as double) as n, sum(x) over w as sx, sum(z) over w as sz, sum(r) over w as sy, sum(x*x) over w as sxx,
  sum(z*z) over w as szz, sum(x*z) over w as sxz, sum(x*r) over w as sxy, sum(z*r) over w as szy
  from o where n_rows >= {N2 + 10} window w as (partition by ticker order by idx {B.rows_back(N2)})),
c as (select *, sxx-sx*sx/n as cxx, szz-sz*sz/n as czz, sxz-sx*sz/n as cxz, sxy-sx*sy/n as cxy, szy-sz*sy/n as czy from s),
d as (select *, cxx*czz-cxz*cxz as det from c),
b as (select *, case when n >= {N2} and det > 1e-14*cxx*czz and det > 0 then (cxy*czz-czy*cxz)/det end as b1,
  case when n >= {N2} and det > 1e-14*cxx*czz and det > 0 then (czy*cxx-cxy*cxz)/det end as b2 from d)
select date, ticker, r - (sy-b1*sx-b2*sz)/n - b1*x - b2*z as x from b""")
    B.static_ctes(f"k{_k}", EDGES["current"], P.SMOOTH, f"t_k{_k}")
    B.variant_ctes(f"k{_k}", f"t_ss_k{_k}", P.SMOOTH)
cte("t_frozen_is", " union all ".join(f"select {k}::integer as k, ic as ic_is, ic_t as t_is from (select * from t_vt_k{k} where period = 'IS')" for k in KGRID))


def _k_classes(m):
    """Threshold to the smallest one that chooses the same peer groups. The narrow classes that pass are nested, so as many
    are the same ones; one number per threshold reaches the driver."""
    if "k_classes" not in m.__dict__:
        priced = m.panel.where(F.col("close").isNotNull()).select("ticker").distinct()
        size = m.names.join(priced, "ticker", "left_semi").where(known_class("subsector")).groupBy("subsector").agg(F.count("ticker").alias("n"))
        passing = size.agg(*[F.count_if(F.col("n") - 1 >= k).alias(str(k)) for k in KGRID]).first().asDict() | {"0": 0}
        m.__dict__["k_classes"] = {k: min(o for o in KGRID if passing[str(o)] == passing[str(k)]) for k in KGRID}
    return m.__dict__["k_classes"]


def _for_all_k(m, df):
    """Rows of the thresholds that were worked out, for each threshold that chooses the same."""
    same = _k_classes(m)
    ks = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(of).alias("of")) for k, of in same.items()])
    return df.withColumn("k", F.explode(F.transform(F.filter(ks, lambda x: x["of"] == F.col("k")), lambda x: x["k"])))


def _k_signal(m):
    """Static signal per threshold k of the peer-group choice (0: always the sector); once where several choose the same."""
    base = _with_class(m, "sector", "subsector")
    priced = m.prices.where(F.col("close").isNotNull()).select("ticker").distinct()
    grid_k = sorted(set(_k_classes(m).values()))
    out = None
    for k in grid_k:
        g = S.peer_group_choice(m.names, k or None, priced).select("ticker", "peer_group")
        d = S.group_mean_of_others(base.join(g, "ticker"), "peer_group").withColumn("k", F.lit(k))
        out = d if out is None else out.unionByName(d)
    sh = S.two_factor_shock(out, N2, keys=("k",)).select("k", "date", "ticker", F.col("eps2").alias("x"))
    load = m.edges.select("src", "dst", "strength", "direction")
    raw = SG.propagate_static_keyed(sh, load, keys=("k",))
    z = SG.standardise(materialise(raw, "raw"), keys=("k",)).select("k", "date", "ticker", "z")
    dst = load.select(F.col("dst").alias("ticker")).distinct()
    grid = m.panel.select("date", "idx", "ticker").join(dst, "ticker", "left_semi").withColumn("k", F.explode(F.array(*[F.lit(k) for k in grid_k])))
    dense = grid.join(z, ["k", "date", "ticker"], "left").withColumn("z", F.coalesce("z", F.lit(0.0)))
    return SG.smooth(dense, "z", P.SMOOTH, "zs", ("k",)).select("k", "date", "idx", "ticker", F.col("zs").alias("z"))


def _frozen_table(m):
    return _for_all_k(m, m.once("frozen", lambda: VR.evaluate(m, m.once("k_signal", lambda: _k_signal(m)), keys=("k",))))


query("inf_17_frozen_choice", lambda m: O.frozen_choice(_frozen_table(m).where(F.col("period") == "IS").select("k", F.col("ic").alias("ic_is")), "k", "ic_is"),
      "select k from t_frozen_is order by ic_is desc, k limit 1")
query("inf_17_in_sample_grid", lambda m: _frozen_table(m).where(F.col("period") == "IS").select("k", F.col("ic").alias("ic_is"), F.col("ic_t").alias("t_is")),
      "select k, ic_is, t_is from t_frozen_is", d="ic_is t_is")


def _decision(m):
    t = _frozen_table(m)
    sig = m.once("k_signal", lambda: _k_signal(m))
    win = O.frozen_choice(t.where(F.col("period") == "IS").select("k", "ic"), "k")
    breadth = BR.spectral_breadth(N.slice_period(sig, P.PERIODS).where(F.col("period") == "OOS").select("k", "date", "ticker", "z"), ("k",))
    oos = t.where(F.col("period") == "OOS").join(_for_all_k(m, breadth), "k")
    return O.frozen_decision(oos.where(F.col("k") == 0), oos.join(win, "k"))


cte("t_k_signal", " union all ".join(f"select {k}::integer as k, date, ticker, z from t_ss_k{k}" for k in KGRID))
cte("t_k_br", spectrum_sql("k", f"(select * from t_k_signal where date > date '{P.CUT}')"))
cte("t_k_oos", " union all ".join(f"select {k}::integer as k, sharpe from t_vt_k{k} where period = 'OOS'" for k in KGRID))
query("inf_17_frozen_decision", _decision, """
with w as (select k from t_frozen_is order by ic_is desc, k limit 1),
b as (select sharpe as sharpe_base, n_eff as breadth_base from t_k_oos o join t_k_br r on r.k = o.k where o.k = 0),
x as (select sharpe as sharpe_winner, n_eff as breadth_winner from t_k_oos o join t_k_br r on r.k = o.k join w on w.k = o.k),
d as (select *, sharpe_winner - sharpe_base as d_sharpe, breadth_winner - breadth_base as d_breadth from b, x)
select *, case when d_sharpe > 0.05 and d_breadth > 1 then 'adopt' when d_sharpe > 0.05 then 'sharpe_only' else 'reject' end as decision from d""",
      d="sharpe_base breadth_base sharpe_winner breadth_winner d_sharpe d_breadth")

# ---- bundle, resampling, documented cuts -------------------------------------------------------------------
_dsr = "sharpe n_configs sharpe_threshold dsr skew kurtosis"
PARTS = {
    "active": ("first_session_day n_sessions", """select date_diff('day', date '1970-01-01', min(date)) as first_session_day, count(*) as n_sessions
 from (select date from t_w where ticker <> 'IBOV_SYNTHETIC' and abs(w) > 1e-9 group by date)"""),
    "sharpe": ("flat layered", f"""select avg(net_flat) / nullif(stddev_samp(net_flat), 0) * sqrt({Y}) as flat, avg(net) / nullif(stddev_samp(net), 0) * sqrt({Y}) as layered from t_pnl"""),
    "unit_alpha": ("alpha_bps cost_bps", body("met_21_unit_alpha")),
    "cost": ("spread impact borrow hedge cost turnover bps_per_turnover", body("cst_07_cost_summary")),
    "persistence": ("sharpe_signal sharpe_persistence corr beta alpha_year t_alpha", body("inf_13_persistence_control")),
    "walk_forward": ("n total_return vol sharpe sortino max_drawdown annual_return calmar", f"""
with c as (select date, net, product(1 + net) over (order by date) as curve from t_wf),
d as (select *, curve / max(curve) over (order by date) - 1 as dd from c),
g as (select count(net) as n, product(1 + net) - 1 as total_return, stddev_samp(net) * sqrt({Y}) as vol, avg(net) / nullif(stddev_samp(net), 0) * sqrt({Y}) as sharpe,
 avg(net) / nullif(stddev_samp(case when net < 0 then net end), 0) * sqrt({Y}) as sortino, min(dd) as max_drawdown from d),
h as (select *, pow(1 + total_return, {Y}::double / n) - 1 as annual_return from g)
select *, case when max_drawdown < 0 then annual_return / abs(max_drawdown) end as calmar from h"""),
    "deflated_curve": (_dsr, body("inf_15_deflated_sharpe").replace("from t_series", "from (select 'wf' as series, net as r from t_wf)")),
    "deflated": (_dsr, f"select * from ({body('inf_15_deflated_sharpe')}) where series = 'real'"),
    "attribution": (" ".join(f"{t}_{c}" for t in ("alpha_year", *NAMES4) for c in ("coef", "t")),
                    "select " + ", ".join(f"max(case when term = '{t}' then {c} end) as {t}_{c}" for t in ("alpha_year", *NAMES4) for c in ("coef", "t")) + " from t_attr4"),
    "ic": ("ic t n", "select ic, t, n from t_ics where period = 'full'"),
}
for _p, (_f, _sql) in PARTS.items():
    cte(f"t_part_{_p}", _sql)
query("inf_21_evidence_bundle", lambda m: bundle_rows(evidence_bundle(m)), " union all ".join(
    f"select '{p}' as part, '{f}' as field, cast({f} as double) as value from t_part_{p}" for p, (fs, _) in PARTS.items() for f in fs.split()), d="value")
BOOT = 1000
cte("t_boot", f"""
with p as (select row_number() over (order by date) - 1 as pos, net as r, count(*) over () as n from t_pnl),
d as (select draw, b, n, ('0x' || substr(md5('42|' || draw || '|' || b), 1, 8))::bigint % greatest(n - 12 + 1, 1) as start
 from (select any_value(n) as n from p), range(0, {BOOT}) as r(draw), range(0, 1000) as q(b) where b < ceil(n::double / 12)),
x as (select draw, start + j as pos from d, range(0, 12) as t(j) where b * 12 + j < n)
select cast(draw as integer) as draw, avg(r) / nullif(stddev_samp(r), 0) * sqrt({Y}) as sharpe from x join p on p.pos = x.pos group by draw""")
query("inf_22_block_bootstrap", lambda m: O.block_bootstrap(m.pnl, "net", 12, BOOT, periods=Y), "select draw, sharpe from t_boot", d="sharpe")
query("inf_22_bootstrap_summary", lambda m: O.bootstrap_summary(O.block_bootstrap(m.pnl, "net", 12, BOOT, periods=Y)), """
select quantile_cont(sharpe, 0.025) as ci_low, quantile_cont(sharpe, 0.975) as ci_high, avg(case when sharpe > 0 then 1.0::double else 0 end) as p_positive,
 count(sharpe) as n_draws from t_boot""", d="ci_low ci_high p_positive")
query("inf_23_ic_by_liquidity_band", lambda m: O.ic_by_band(
    m.signal.select("date", "ticker", "z"), O.forward_returns(m.panel, (H,)).select("date", "ticker", "y"),
    m.panel.select("date", "ticker", PNL.liquidity_band("adtv", P.BANDS).alias("band")), H), f"""
with j as (select {B.band_sql('p.adtv')} as band, s.date, s.z, f.y from t_sig s join t_fwdh f on f.h = {H} and f.date = s.date and f.ticker = s.ticker
 join t_panel p on p.date = s.date and p.ticker = s.ticker),
i as (select band, date, {B.corr_sql('z', 'y')} as ic from j group by 1, 2)
select cast(band as integer) as band, avg(ic) as ic, case when count(ic) > {H} then avg(ic) / nullif(stddev_samp(ic) / sqrt(count(ic)::double / {H}), 0) end as t,
 count(ic) as n from i where ic is not null group by 1""", d="ic t")


def _leader(m):
    acc = m.panel.select("date", "idx", "ticker", "acc").join(m.names.select("ticker", "subsector"), "ticker")
    sec = S.group_mean_of_others(acc, "subsector", "sector_mean", r="acc").select("date", "ticker", "sector_mean")
    return (m.raw_signal.select("date", "ticker", F.col("raw").alias("leader")).join(sec, ["date", "ticker"])
            .join(O.forward_returns(m.panel, (H,)).select("date", "ticker", "y"), ["date", "ticker"]))


query("inf_23_leader_vs_sector", lambda m: O.leader_vs_sector(_leader(m), H), f"""
with a as (select p.date, p.ticker, p.acc, n.subsector from t_panel p join t_names n on n.ticker = p.ticker),
t as (select date, subsector, sum(acc) as s, count(acc) as n from a group by 1, 2),
j as (select r.date, r.raw as l, (t.s - coalesce(a.acc, 0)) / nullif(t.n - case when a.acc is not null then 1 else 0 end, 0) as s, f.y
 from t_raw r join a on a.date = r.date and a.ticker = r.ticker join t on t.date = a.date and t.subsector = a.subsector
 join t_fwdh f on f.h = {H} and f.date = r.date and f.ticker = r.ticker),
o as (select * from j where l is not null and s is not null and y is not null),
g as (select date, count(*) as n, var_pop(l) as v1, var_pop(s) as v2, covar_pop(l, s) as c12, covar_pop(l, y) as c1, covar_pop(s, y) as c2 from o group by date),
w as (select *, v1 * v2 - c12 * c12 as det from g where n >= 5 and v1 * v2 - c12 * c12 > 1e-9 * v1 * v2),
u as (select 'leader_alone' as term, c1 / v1 as b from w union all select 'sector_alone', c2 / v2 from w
 union all select 'leader_joint', (c1 * v2 - c2 * c12) / det from w union all select 'sector_joint', (c2 * v1 - c1 * c12) / det from w)
select term, avg(b) as slope, avg(b) / nullif(stddev_samp(b) / sqrt(count(b)::double / {H}), 0) as t, count(b) as n from u group by 1""", d="slope t")


def _industry(m):
    return O.industry_momentum_scores(SG.factor_scores(m.panel, **FW), m.names)


cte("t_indbook", """
with g as (select s.date, n.subsector, avg(score) as g from t_scores s join t_names n on n.ticker = s.ticker where factor = 'mom12_1' group by 1, 2),
x as (select s.date, s.idx, s.ticker, s.r, g.g as score from t_scores s join t_names n on n.ticker = s.ticker
 join g on g.date = s.date and g.subsector = n.subsector where factor = 'mom12_1'),
z as (select x.*, (score - avg(score) over (partition by date)) / case when stddev_samp(score) over (partition by date) = 0 then 1
  else stddev_samp(score) over (partition by date) end as z from x),
w as (select *, coalesce(z / nullif(sum(abs(z)) over (partition by date), 0), 0) as w from z),
l as (select *, lag(w) over (partition by ticker order by idx) * r as c from w)
select 'industry_mom' as factor, date, coalesce(sum(c), 0) as pnl from l group by date""")
query("inf_23_industry_momentum", lambda m: O.factor_books(_industry(m)), "select * from t_indbook", d="pnl")
attribution_sql("t_attr5", "select * from t_fbook union all select * from t_indbook", (*NAMES4, "industry_mom"), L, Y)
query("inf_23_attribution_with_industry", lambda m: O.factor_attribution(
    m.pnl, O.factor_books(SG.factor_scores(m.panel, **FW).unionByName(_industry(m))), (*NAMES4, "industry_mom"), L, Y), "select * from t_attr5", d="coef t")
