"""Source and sink queries: every one writes Spark-derived files to the shared scratch folder and reads them back."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketripple.catalog import base_sql as B  # noqa: F401
from marketripple.catalog.registry import cte, query
from marketripple.operators import shock as S
from marketripple.operators import universe as U
from marketripple.plans import market as P
from marketripple.session import scratch_dir
from marketripple.sources import files as O


def _path(m, label: str) -> str:
    return f"{scratch_dir(m.spark)}/{label}-{uuid.uuid4().hex}"


def _pad(c: Column, n: int) -> Column:
    return F.lpad(c.cast("string"), n, "0")


def _lines(m) -> DataFrame:
    """Fixed-width lines of all line items with accents, headers, other markets, zero factors and short lines."""
    o, n = F.col("file_no"), F.col("line_no")
    factor = F.when(o % 13 == 0, 1000).when(o % 13 == 1, 0).otherwise(1)
    line = F.concat(
        F.when(o % 89 == 0, "00").otherwise("01"), F.date_format("date", "yyyyMMdd"), F.col("bdi"), F.rpad("ticker", 12, " "),
        F.when(n == 7, "020").otherwise("010"), F.rpad(F.lit("AÇÃO ORDINÁRIA"), 81, " "),
        _pad(F.when(o % 101 == 0, 0).otherwise((100 - F.col("disc_c")) * 100), 13), F.lpad(F.lit(""), 49, "0"),
        _pad(F.col("vol_c"), 18), F.lpad(F.lit(""), 22, " "), _pad(factor, 7), F.lpad(F.lit(""), 28, " "))
    short = F.when(o % 97 == 0, F.substring(line, 1, 240)).otherwise(line)
    # a folder per year needs the rows by year: they are sorted while they are narrow
    rows = m.records.withColumn("year", F.year("date")).sortWithinPartitions("year")
    return rows.select("year", F.encode(short, "ISO-8859-1").cast("string").alias("line"))


def _landed(m) -> DataFrame:
    if "landed_root" not in m.__dict__:
        m.__dict__["landed_root"] = _path(m, "landed")
        _lines(m).write.partitionBy("year").option("compression", "gzip").text(m.__dict__["landed_root"])
    return O.raw_lines(m.spark, m.__dict__["landed_root"])


cte("t_line", """
select cast(year(date) as varchar) as source, date, bdi, ticker, file_no % 97 = 0 as short, file_no % 89 = 0 as header, line_no = 7 as other,
 case when file_no % 101 = 0 then 0 else 100 - disc_c end::double as close, cast(vol_c as double) / 100 as volume,
 case when file_no % 13 = 0 then 1000 else 1 end::double as factor from t_rec""")
cte("t_parsed", """
select date, bdi, ticker, close, volume, factor, case when close / factor > 0 then close / factor end as price from t_line
where not short and not header and not other""")


def _source() -> Column:
    return F.regexp_extract("file", "year=([0-9]{4})", 1)



query("src_01_discover_files", lambda m: _landed(m).select(_source().alias("source")).groupBy("source").agg(F.count(F.lit(1)).alias("n_lines")),
      "select source, count(*) as n_lines from t_line group by 1")
query("src_02_fixed_width_decode", lambda m: O.parse_records(_landed(m)), "select * from t_parsed", d="close volume factor price")
query("src_02_ingest_daily_tables", lambda m: U.daily_tables(O.parse_records(_landed(m))).withColumn("codes", F.array_join("codes", ",")),
      """select p.date, p.ticker, sum(volume) as volume, any_value(codes) as codes from t_parsed p
      join (select ticker, array_to_string(list_sort(list(distinct bdi)), ',') as codes from t_parsed group by 1) c on c.ticker = p.ticker group by 1, 2""",
      d="volume")
query("src_03_ingest_counters", lambda m: O.ingest_counters(_landed(m), _source()), """
select source, count(*) as n_lines, count(*) filter (short) as n_wrong_width, count(*) filter (not short and not header) as n_records,
 count(*) filter (not short and not header and not other) as n_cash, 0::bigint as n_bad_number from t_line group by 1""")


def _fallback(m):
    p = _path(m, "panelfile")
    O.write_table(m.panel.select("date", "ticker", "r", "adtv"), p)
    return O.read_first(m.spark, [p + "-complete", p])


query("src_04_read_panel_fallback", _fallback, "select date, ticker, r, adtv from t_panel", d="r adtv")


def _edge_files(m):
    a, b = _path(m, "edges"), _path(m, "edges")
    base = F.col("kind").isin("concorrente", "cliente")
    O.write_csv(m.edges.where(base), a)
    O.write_csv(m.edges.where(~base), b)
    return O.read_edges(m.spark, a, b)


query("src_05_read_edges", _edge_files, """select src, dst, kind, strength, direction,
 case when kind in ('concorrente', 'cliente') then 'base' else 'historical' end as source from t_edges""", d="strength")


def _rates(m):
    p = _path(m, "rates")
    O.write_json(m.riskfree.select(F.date_format("date", "dd/MM/yyyy").alias("data"), (F.col("rf") * 100).cast("string").alias("valor")), p)
    return O.read_riskfree(m.spark, p)


query("src_06_riskfree_normalise", _rates, "select date, rf from t_rf", d="rf")


def _membership(m):
    p = _path(m, "members")
    rows = m.official.select(F.col("ticker").alias("codigo")).distinct().withColumn("participacao", F.lit("1,0"))
    total = rows.agg(F.concat(F.lit("Total "), F.count(F.lit(1)).cast("string")).alias("codigo")).withColumn("participacao", F.lit("100"))
    O.write_csv(rows.unionByName(total), p)
    return O.read_membership(m.spark, p)


query("src_07_membership_without_trailer", _membership, "select distinct ticker from t_official")


def _cached(m):
    params = {"sf": m.sf_dir, "window": P.REG, "min": P.REG_MIN, "app": m.spark.sparkContext.applicationId}
    build = lambda: S.market_shock(m.prices, P.REG, P.REG_MIN).select("date", "ticker", "eps", "beta")
    O.cached_table(m.spark, "shocks", params, build, recompute=True)
    return O.cached_table(m.spark, "shocks", params, build)


query("src_08_cached_intermediate", _cached, "select date, ticker, eps, beta from t_panel", d="eps beta")


def _contract(m):
    p = _path(m, "contract")
    O.write_table(m.graph, p, ("valid_month",))
    return m.spark.read.parquet(p).select(F.col("valid_month").cast("date").alias("valid_month"), "variant", "src", "dst", "strength", "direction")


query("snk_01_write_contract_table", _contract, "select valid_month, variant, src, dst, strength, direction from t_graph", d="strength")


def _csv(m):
    p = _path(m, "csv")
    O.write_csv(m.universe, p)
    return m.spark.read.csv(p, header=True, schema="mes string, ticker string, volume_mes double, rank int")


query("snk_02_write_csv", _csv, "select mes, ticker, volume_mes, rank from t_uni", d="volume_mes")


def _json(m):
    p = _path(m, "json")
    nested = m.series.groupBy("series").agg(F.struct(F.count("r").alias("n"), F.round(F.sum("r"), 6).alias("sum_r")).alias("stats"))
    O.write_json(nested, p)
    return m.spark.read.schema("series string, stats struct<n: bigint, sum_r: double>").json(p).select("series", "stats.n", "stats.sum_r")


query("snk_03_write_json", _json, "select series, count(r) as n, sum(r) as sum_r from t_series group by 1", d="sum_r")
