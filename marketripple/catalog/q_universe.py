"""Universe construction, audits and reference-data maintenance queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketripple.catalog import base_sql as B  # noqa: F401
from marketripple.catalog.registry import cte, query
from marketripple.operators import reference_data as R
from marketripple.operators import universe as U
from marketripple.plans import market as P

query("uni_01_traded_volume_monthly", lambda m: m.monthly, "select mes, ticker, volume_mes from t_monthly", d="volume_mes")
query("uni_02_traded_volume_daily", lambda m: U.traded_volume_daily(m.records.withColumn("volume", F.col("vol_c"))),
      "select date, ticker, cast(sum(vol_c) as bigint) as volume from t_rec group by 1, 2")
query("uni_03_last_price_daily", lambda m: U.last_price_daily(
    m.records.select("date", "ticker", (100 - F.col("disc_c")).alias("price"), F.struct("file_no", "line_no", "vol_c").alias("pos")), "pos"),
      """select date, ticker, arg_max(100 - disc_c, row(file_no, line_no, vol_c)) as price from t_rec
      where 100 - disc_c > 0 group by 1, 2""")
query("uni_04_codes_ever_seen", lambda m: U.codes_ever_seen(m.records).select("ticker", F.array_join("codes", ",").alias("codes")),
      "select ticker, array_to_string(codes, ',') as codes from t_codes")
query("uni_05_classify_instrument", lambda m: m.classes, "select ticker, classe from t_classes")
query("uni_06_universe_top_n", lambda m: m.universe, "select mes, ticker, volume_mes, rank from t_uni", d="volume_mes")
query("uni_07_removed_counts", lambda m: U.removed_counts(m.monthly, m.classes),
      "select classe as motivo, count(*) as n_tickers from t_classes where classe <> 'acao' group by 1")
query("uni_08_adtv", lambda m: U.adtv(U.traded_volume_daily(m.records.withColumn("volume", F.col("vol_c") / 100.0)),
                                      m.calendar, m.classes, P.ADTV, P.ADTV_MIN),
      "select date, idx, ticker, adtv from t_px", d="adtv")
query("uni_09_price_panel", lambda m: U.price_panel(m.obs.select("date", "ticker", "close"), m.calendar, m.classes, "close"),
      "select date, idx, ticker, close from t_px", d="close")
query("uni_10_universe_report", lambda m: U.universe_span(m.universe),
      """select min(mes) as primeiro, max(mes) as ultimo, count(distinct mes) as n_meses,
      count(distinct ticker) as n_tickers from t_uni""")
query("uni_10_universe_edges", lambda m: U.universe_edges(m.universe, 10),
      """select case when mes = (select min(mes) from t_uni) then 'first' else 'last' end as ponta, rank, ticker, volume_mes
      from t_uni where rank <= 10 and (mes = (select min(mes) from t_uni) or mes = (select max(mes) from t_uni))""", d="volume_mes")
query("uni_10_universe_leavers", lambda m: U.universe_leavers(m.universe),
      """select 'left' as kind, ticker from t_uni where mes = (select min(mes) from t_uni)
      and ticker not in (select ticker from t_uni where mes = (select max(mes) from t_uni))
      union all select distinct 'suffix_11', ticker from t_uni where ticker like '%11'""")
query("uni_11_compare_monthly", lambda m: U.compare_monthly(m.universe, m.official), """
select coalesce(u.mes, o.mes) as mes, count(u.ticker) as n_universo, count(o.ticker) as n_oficial,
 count(*) filter (u.ticker is not null and o.ticker is not null) as n_comum,
 count(*) filter (o.ticker is null) as n_sobra, count(*) filter (u.ticker is null) as n_falta,
 coalesce(string_agg(case when u.ticker is null then o.ticker end, ',' order by o.ticker), '') as faltam
from t_uni u full join t_official o on o.mes = u.mes and o.ticker = u.ticker group by 1""")
query("uni_11_missing_monthly", lambda m: U.missing_monthly(m.universe, m.official), """
select distinct o.mes, o.ticker as falta from t_official o left join t_uni u on u.mes = o.mes and u.ticker = o.ticker where u.ticker is null""")
query("uni_12_compare_consolidated", lambda m: U.compare_consolidated(m.universe, m.official), """
select count(u.ticker) as n_universo, count(o.ticker) as n_oficial,
 count(*) filter (u.ticker is not null and o.ticker is not null) as n_comum,
 count(*) filter (o.ticker is null) as n_sobra, count(*) filter (u.ticker is null) as n_falta
from (select distinct ticker from t_uni) u full join (select distinct ticker from t_official) o on o.ticker = u.ticker""")
cte("t_life", """
select ticker, min(mes) as primeiro, max(mes) as ultimo, count(*) as n_meses,
 min(mes) = (select min(mes) from t_uni) as desde_inicio, max(mes) < (select max(mes) from t_uni) as saiu
from t_uni group by ticker""")
cte("t_nodes", "select src as ticker from t_edges union select dst from t_edges")
query("uni_13_ticker_life", lambda m: U.ticker_life(m.universe), "select * from t_life")
query("uni_14_liquid_in", lambda m: U.liquid_in(m.universe, 1996, 1997, 6),
      """select ticker, count(*) as n_meses from t_uni where mes between '1996-01' and '1997-12' group by 1
      having count(*) >= 6""")
query("uni_15_graph_names_not_yet_liquid", lambda m: U.graph_names_not_yet_liquid(m.edges, m.universe, 1995, 4), """
select n.ticker, case when l.primeiro is null then 'never' else 'entered' end as motivo, l.primeiro
from t_nodes n left join t_life l on l.ticker = n.ticker where n.ticker not in (
 select ticker from t_uni where mes between '1995-01' and '1995-12' group by 1 having count(*) >= 4)""")
query("uni_16_large_names_that_left", lambda m: U.large_names_that_left(m.universe, m.edges, 1995, 12), """
select ticker, ultimo, ticker in (select ticker from t_nodes) as no_grafo from t_life where saiu and ticker in (
 select ticker from t_uni where mes like '1995-%' and rank <= 12)""")
query("uni_17_graph_coverage", lambda m: U.graph_coverage(m.edges, m.universe, [("early", 1995, 1997), ("late", 1999, 2001)], 4), """
with l as (select 'early' as periodo, ticker from t_uni where mes between '1995-01' and '1997-12' group by 2 having count(*) >= 4
 union all select 'late', ticker from t_uni where mes between '1999-01' and '2001-12' group by 2 having count(*) >= 4)
select periodo, count(*) as n_liquidos, count(n.ticker) as n_no_grafo, count(n.ticker)::double / count(*) as cobertura
from l left join t_nodes n on n.ticker = l.ticker group by periodo""", d="cobertura")

# Sector map with unknown markers: nations 0-9 have their sector, the rest wait for the fill table.
cte("t_map", """select ticker, case when k % 3 = 0 then 'A DEFINIR' else sector end as sector,
 case when k % 4 = 0 then null when k % 4 = 1 then 'A DEFINIR' else subsector end as subsector from t_names where k % 7 <> 6""")
cte("t_fill", "select ticker, sector, subsector from t_names where k % 6 <> 3")


def _map(m):
    k = F.col("k")
    return m.names.where(k % 7 != 6).select(
        "ticker", F.when(k % 3 == 0, R.UNKNOWN).otherwise(F.col("sector")).alias("sector"),
        F.when(k % 4 == 0, F.lit(None)).when(k % 4 == 1, R.UNKNOWN).otherwise(F.col("subsector")).alias("subsector"))


def _fill(m):
    return m.names.where(F.col("k") % 6 != 3).select("ticker", "sector", "subsector")


query("ref_01_fill_sector", lambda m: R.fill_class(_map(m), _fill(m), "sector"),
      """select m.ticker, case when m.sector = 'A DEFINIR' then coalesce(f.sector, m.sector) else m.sector end as sector,
      m.subsector from t_map m left join t_fill f on f.ticker = m.ticker""")
query("ref_02_append_missing_keys", lambda m: R.append_missing_keys(_map(m), _fill(m)),
      "select * from t_map union all select * from t_fill where ticker not in (select ticker from t_map)")
query("ref_03_class_conflicts", lambda m: R.class_conflicts(_fill(m).unionByName(
    _fill(m).withColumn("sector", F.upper(F.substring("sector", 1, 3)))), "sector"),
      "select ticker, 2::bigint as n_classes from t_fill where sector <> upper(substring(sector, 1, 3))")
query("ref_03_assert_single_class", lambda m: R.assert_single_class(_fill(m), "sector"), "select ticker, sector from t_fill")
query("ref_04_fill_subsector", lambda m: R.fill_class(_map(m), _fill(m), "subsector"),
      """select m.ticker, m.sector, case when m.subsector is null or m.subsector = 'A DEFINIR'
      then coalesce(f.subsector, m.subsector) else m.subsector end as subsector
      from t_map m left join t_fill f on f.ticker = m.ticker""")
query("ref_05_class_sizes", lambda m: R.class_sizes(_map(m), 4),
      """select subsector, count(*) as n, count(*) >= 4 as usable, count(distinct sector) as n_sectors from t_map
      where subsector is not null and subsector <> 'A DEFINIR' group by 1""")
query("ref_05_taxonomy_orphans", lambda m: R.taxonomy_orphans(_fill(m), _map(m)),
      "select ticker from t_fill where ticker not in (select ticker from t_map)")
query("ref_05_classes_spanning_sectors", lambda m: R.classes_spanning_sectors(_fill(m)),
      """select subsector, array_to_string(list_sort(list(distinct sector)), ',') as sectors, count(distinct sector) as n_sectors
      from t_fill group by 1 having count(distinct sector) > 1""")
query("ref_06_nodes_without_sector", lambda m: R.nodes_without_class(m.edges, _map(m), "sector"),
      "select ticker from t_nodes where ticker not in (select ticker from t_map where sector <> 'A DEFINIR')")
query("ref_07_sector_distribution", lambda m: R.distribution(_map(m), R.fill_class(_map(m), _fill(m), "sector"), "sector"), """
with f as (select m.ticker, case when m.sector = 'A DEFINIR' then coalesce(f.sector, m.sector) else m.sector end as sector
 from t_map m left join t_fill f on f.ticker = m.ticker),
a as (select sector, count(*) as n from t_map group by 1), b as (select sector, count(*) as n from f group by 1)
select coalesce(a.sector, b.sector) as sector, coalesce(a.n, 0) as n_before, coalesce(b.n, 0) as n_after
from a full join b on a.sector = b.sector""")
