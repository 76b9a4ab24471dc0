"""Graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketripple.catalog import base_sql as B
from marketripple.catalog.registry import cte, query
from marketripple.operators import graph as O
from marketripple.plans import market as P

PRIOR = {"concorrente": 1, "cliente": 1, "imob_logistica": 1, "fornecedor": -1, "holding": 1, "substituto": -1}
MIN_PAIRS = 60

query("grf_01_ticker_root", lambda m: m.names.select("ticker", O.ticker_root("ticker").alias("root")),
      "select ticker, regexp_replace(ticker, '[0-9]+$', '') as root from t_names")
query("grf_02_lagged_month_end", lambda m: m.month_adtv, "select ticker, valid_month, v from t_madtv", d="v")
query("grf_03_build_rule_graph", lambda m: O.build_rule_graph(
    m.panel.select("date", "ticker", "adtv"), m.names, min_adtv=P.MIN_ADTV, min_members=P.MIN_MEMBERS),
      "select valid_month, variant, src, dst, strength, direction from t_graph", d="strength")
query("grf_04_cap_satellites", lambda m: O.build_rule_graph(
    m.panel.select("date", "ticker", "adtv"), m.names, ks=(3,), weights=("equal",), min_adtv=P.MIN_ADTV,
    min_members=P.MIN_MEMBERS, max_satellites=4), """
with j as (select m.*, exists (select 1 from t_heads h where h.valid_month = m.valid_month and h.subsector = m.subsector
  and h.k = 3 and h.head = m.ticker) as is_head from t_members m
  where exists (select 1 from t_heads h where h.valid_month = m.valid_month and h.subsector = m.subsector and h.k = 3)),
s as (select *, row_number() over (partition by valid_month, subsector, is_head order by v desc, ticker) as rn from j)
select s.valid_month, 'K3_equal' as variant, h.head as src, s.ticker as dst, 1.0::double / h.n_heads as strength, 1::integer as direction
from s join t_heads h on h.valid_month = s.valid_month and h.subsector = s.subsector and h.k = 3 and h.root <> s.root
where is_head or rn <= 4""", d="strength")
query("grf_05_graph_stats", lambda m: O.graph_stats(m.graph), """
select variant, count(*) as n_edges, count(distinct valid_month) as n_months, count(distinct src) as n_triggers,
 count(distinct dst) as n_satellites, count(*)::double / count(distinct valid_month) as edges_per_month from t_graph group by 1""",
      d="edges_per_month")
query("grf_05_graph_stats_by_year", lambda m: O.graph_stats_by_year(m.graph), """
with e as (select cast(year(valid_month) as integer) as year, src, dst from t_graph),
n as (select year, count(distinct t) as n_names from (select year, src as t from e union all select year, dst from e) group by 1)
select e.year, count(*) as n_edges, count(distinct (src, dst)) as n_pairs, any_value(n_names) as n_names
from e join n on n.year = e.year group by 1""")
query("grf_06_reverse_graph", lambda m: O.reverse_graph(m.edges),
      "select dst as src, src as dst, kind || '_rev' as kind, strength, direction from t_edges", d="strength")
query("grf_07_bidirectional", lambda m: O.bidirectional(m.edges), """
select src, dst, kind, strength, direction from t_edges
union all select dst, src, kind || '_rev', strength, direction from t_edges""", d="strength")
query("grf_08_split_by_provenance", lambda m: O.split_by_provenance(m.edges, m.edges.where(F.col("kind").isin("concorrente", "cliente"))), """
select e.src, e.dst, e.kind, case when kind in ('concorrente', 'cliente') then 'base' else 'historical' end as source,
 count(*) over (partition by src, dst) as copies from t_edges e""")
query("grf_09_edge_reproduction", lambda m: O.edge_reproduction(m.graph, m.edges, m.names), """
with r as (select distinct src, dst from t_graph),
j as (select m.src, r.src as hit, b.src as rev from (select distinct src, dst from t_edges) m
 join t_names a on a.ticker = m.src join t_names c on c.ticker = m.dst and c.subsector = a.subsector
 left join r on r.src = m.src and r.dst = m.dst left join r b on b.dst = m.src and b.src = m.dst)
select count(*) as n_manual, count(hit) as n_found, count(rev) as n_reversed, count(hit)::double / count(*) as share_found,
 count(rev)::double / count(*) as share_reversed from j""", d="share_found share_reversed")
query("grf_10_degree_stats", lambda m: O.degree_stats(m.graph), """
with d as (select src, count(*) as degree from t_graph group by 1)
select count(*) as n_triggers, max(degree) as max_degree, avg(degree) as mean_degree, cast(sum(degree) as bigint) as n_edges,
 (select count(distinct dst) from t_graph) as n_satellites,
 (select count(*) from (select src from t_graph union select dst from t_graph)) as n_nodes from d""", d="mean_degree")
query("grf_10_top_degree", lambda m: O.top_degree(m.graph, 8),
      "select src, count(*) as degree from t_graph group by 1 order by 2 desc, 1 limit 8")
query("grf_11_effective_triggers", lambda m: O.effective_triggers(m.graph, ("variant",)), """
with d as (select variant, src, count(*)::double as g from t_graph group by 1, 2)
select variant, sum(g) * sum(g) / sum(g * g) as effective_triggers from d group by 1""", d="effective_triggers")
query("grf_12_merge_parallel_edges", lambda m: O.merge_parallel_edges(m.graph, ("valid_month",)),
      "select valid_month, src, dst, sum(strength) as strength, count(*) as n_merged from t_graph group by 1, 2, 3", d="strength")
query("grf_13_connected_components", lambda m: O.connected_components(m.edges), """
with recursive s as (select src as a, dst as b from t_edges union select dst, src from t_edges),
reach(node, other) as (select a, a from s union select r.node, s.b from reach r join s on s.a = r.other)
select node, min(other) as component from reach group by node""")
query("grf_14_bridges", lambda m: O.bridges(m.edges), "select src as node from t_edges intersect select dst from t_edges")
query("grf_15_density", lambda m: O.density(m.graph), """
with e as (select distinct src, dst from t_graph), n as (select count(*) as n from (select src from e union select dst from e))
select count(*) as n_edges, any_value(n) as n_nodes, count(*)::double / (any_value(n) * (any_value(n) - 1)) as density from e, n""", d="density")
query("grf_15_degree_centrality", lambda m: O.degree_centrality(m.graph), """
with e as (select distinct src, dst from t_graph), t as (select src as node from e union all select dst from e)
select node, count(*) as degree, count(*)::double / ((select count(distinct node) from t) - 1) as centrality from t group by 1""", d="centrality")


def _dir_sql(where: str) -> str:
    return f"""
with p as (select e.kind, e.src, e.dst, s.date, s.eps as x, f.y from t_edges e
  join t_panel s on s.ticker = e.src and s.eps is not null join t_fwd f on f.ticker = e.dst and f.date = s.date and f.y is not null
  where {where}),
k as (select * from p qualify count(*) over (partition by kind, src, dst) >= {MIN_PAIRS}),
c as (select kind, {B.corr_sql('x', 'y')} as corr, count(*) as n, count(distinct (src, dst)) as n_edges from k group by kind)
select *, corr * sqrt(n - 2) / sqrt(1 - corr * corr) as t, cast(case when corr >= 0 then 1 else -1 end as integer) as sign from c"""


cte("t_dir_is", _dir_sql(f"s.date <= date '{P.CUT}'"))
cte("t_dir_oos", _dir_sql(f"s.date > date '{P.CUT}'"))


def _dir(m, oos=False):
    s = m.panel.select("date", "ticker", F.col("eps").alias("x"))
    f = m.forward.select("date", "ticker", "y")
    if oos:
        return O.direction_by_kind(m.edges, s.where(F.col("date") > F.lit(P.CUT).cast("date")), f, min_pairs=MIN_PAIRS)
    return O.direction_by_kind(m.edges, s, f, until=P.CUT, min_pairs=MIN_PAIRS)


query("grf_16_direction_by_kind", _dir, "select * from t_dir_is", d="corr t")
PRIOR_SQL = "case kind " + " ".join(f"when '{k}' then {v}" for k, v in PRIOR.items()) + " end"
for rule, expr in {"sign": "coalesce(d.sign, e.direction)", "prior": PRIOR_SQL.replace("kind", "e.kind"),
                   "conservative": f"case when abs(d.t) >= 2 then d.sign else {PRIOR_SQL.replace('kind', 'e.kind')} end"}.items():
    query(f"grf_17_freeze_directions_{rule}", lambda m, rule=rule: O.freeze_directions(m.edges, _dir(m), PRIOR, rule),
          f"""select src, dst, e.kind, strength, cast({expr} as integer) as direction from t_edges e
          left join t_dir_is d on d.kind = e.kind""", d="strength")
query("grf_18_graph_diff", lambda m: O.graph_diff(m.edges, O.freeze_directions(m.edges, _dir(m), PRIOR, "sign")), """
select src, dst, e.kind, e.direction as direction_a, coalesce(d.sign, e.direction) as direction_b from t_edges e
left join t_dir_is d on d.kind = e.kind where e.direction <> coalesce(d.sign, e.direction)""")
query("grf_19_direction_stability", lambda m: O.direction_stability(_dir(m), _dir(m, oos=True)), """
select a.kind, a.corr as corr_a, a.sign as sign_a, b.corr as corr_b, b.sign as sign_b, a.sign = b.sign as same_sign
from t_dir_is a join t_dir_oos b on b.kind = a.kind""", d="corr_a corr_b")
query("grf_20_two_hop_paths", lambda m: O.two_hop_paths(m.edges), """
select a.src, b.dst, count(*) as n_paths, sum(a.strength * b.strength) as strength from t_edges a join t_edges b on b.src = a.dst
where a.src <> b.dst group by 1, 2""", d="strength")
query("grf_21_overlay_graphs", lambda m: O.overlay_graphs(m.graph, m.edges), """
with r as (select src, dst, avg(strength) as strength from t_graph group by 1, 2)
select src, dst, strength, 'rule' as layer from r union all
select src, dst, sum(strength), 'manual' from t_edges e where not exists (select 1 from r where r.src = e.src and r.dst = e.dst)
group by 1, 2""", d="strength")
query("grf_22_liquidity_gap_strength", lambda m: O.liquidity_gap_strength(m.graph, m.month_adtv), """
select g.valid_month, variant, src, dst, a.v as v_src, b.v as v_dst, greatest(0, ln(a.v / b.v)) as strength from t_graph g
join t_madtv a on a.valid_month = g.valid_month and a.ticker = src join t_madtv b on b.valid_month = g.valid_month and b.ticker = dst""",
      d="v_src v_dst strength")
