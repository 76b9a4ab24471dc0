"""Liquid-universe construction from trade records, and universe audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketripple.operators.panel import densify, roll
from marketripple.session import materialise

# Receipt suffixes, fund and ETF market codes, class labels.
BDR_SUFFIX = r"3[1-9]$"
FUND_CODE, ETF_CODE = "12", "14"
SHARE, BDR, FUND, ETF = "acao", "bdr", "fii", "etf"


def traded_volume_monthly(records: DataFrame) -> DataFrame:
    return records.groupBy(F.date_format("date", "yyyy-MM").alias("mes"), "ticker").agg(
        F.sum("volume").alias("volume_mes"))


def daily_tables(records: DataFrame) -> DataFrame:
    """(date, ticker, volume, codes) from one pass over raw records; ``codes`` are the BDI codes ever seen for the ticker.

    Records collapse to one row per date and ticker first, written once, and the codes come from those rows.
    """
    day = materialise(records.groupBy("date", "ticker").agg(F.sum("volume").alias("volume"), F.collect_set("bdi").alias("_b")), "daily")
    codes = codes_ever_seen(day.select("ticker", F.explode("_b").alias("bdi")))
    return day.drop("_b").join(codes, "ticker")


def traded_volume_daily(records: DataFrame) -> DataFrame:
    return records.groupBy("date", "ticker").agg(F.sum("volume").alias("volume"))


def last_price_daily(records: DataFrame, position: str) -> DataFrame:
    """Last positive price per (day, ticker) in file order ``position``."""
    return (records.where(F.col("price") > 0).groupBy("date", "ticker")
            .agg(F.max_by("price", position).alias("price")))


def codes_ever_seen(records: DataFrame) -> DataFrame:
    return records.groupBy("ticker").agg(F.sort_array(F.collect_set("bdi")).alias("codes"))


def classify_instrument(codes: DataFrame, etf_exceptions: Sequence[str] = ()) -> DataFrame:
    """Ordered rules: receipt suffix, ever a fund code, '11' with ETF code or listed exception, else share."""
    t = F.col("ticker")
    is_etf = t.endswith("11") & (F.array_contains("codes", ETF_CODE) | t.isin(list(etf_exceptions)))
    return codes.select(
        "ticker",
        F.when(t.rlike(BDR_SUFFIX), BDR).when(F.array_contains("codes", FUND_CODE), FUND)
        .when(is_etf, ETF).otherwise(SHARE).alias("classe"))


def shares_only(df: DataFrame, classes: DataFrame) -> DataFrame:
    return df.join(classes.where(F.col("classe") == SHARE), "ticker", "left_semi")


def universe_top_n(monthly: DataFrame, classes: DataFrame, n: int = 100) -> DataFrame:
    """Non-shares leave before the ranking. The filter on the rank is pushed into a per-task top-n."""
    w = Window.partitionBy("mes").orderBy(F.desc("volume_mes"), "ticker")
    return (shares_only(monthly, classes).withColumn("rank", F.row_number().over(w))
            .where(F.col("rank") <= n).select("mes", "ticker", "volume_mes", "rank"))


def removed_counts(monthly: DataFrame, classes: DataFrame) -> DataFrame:
    seen = monthly.select("ticker").distinct()
    return (classes.where(F.col("classe") != SHARE).join(seen, "ticker", "left_semi")
            .groupBy(F.col("classe").alias("motivo")).agg(F.count("ticker").alias("n_tickers")))


def adtv(daily: DataFrame, calendar: DataFrame, classes: DataFrame, window: int = 21, min_obs: int = 5) -> DataFrame:
    """Rolling mean of volume; a day without trades counts as zero, also before the first trade."""
    dense = densify(shares_only(daily, classes), calendar, {"volume": 0.0})
    return roll(dense, "volume", window, min_obs, "avg", "adtv").select("date", "idx", "ticker", "adtv")


def price_panel(prices: DataFrame, calendar: DataFrame, classes: DataFrame, value: str = "price") -> DataFrame:
    """Missing prices stay unknown: a zero would invent a -100 % return."""
    return densify(shares_only(prices, classes), calendar, {value: None})


def universe_span(universe: DataFrame) -> DataFrame:
    return universe.agg(F.min("mes").alias("primeiro"), F.max("mes").alias("ultimo"),
                        F.count_distinct("mes").alias("n_meses"), F.count_distinct("ticker").alias("n_tickers"))


def universe_edges(universe: DataFrame, top: int = 10) -> DataFrame:
    """Top names of the first and last month."""
    lo = universe.agg(F.min("mes").alias("m")).select("m").scalar()
    hi = universe.agg(F.max("mes").alias("m")).select("m").scalar()
    return (universe.where(F.col("rank") <= top)
            .withColumn("ponta", F.when(F.col("mes") == lo, "first").when(F.col("mes") == hi, "last"))
            .where(F.col("ponta").isNotNull()).select("ponta", "rank", "ticker", "volume_mes"))


def universe_leavers(universe: DataFrame) -> DataFrame:
    """Names of the first month that are absent in the last, and names still ending in 11."""
    lo = universe.agg(F.min("mes").alias("m")).select("m").scalar()
    hi = universe.agg(F.max("mes").alias("m")).select("m").scalar()
    first = universe.where(F.col("mes") == lo).select("ticker")
    last = universe.where(F.col("mes") == hi).select("ticker")
    left = first.join(last, "ticker", "left_anti").select(F.lit("left").alias("kind"), "ticker")
    units = universe.where(F.col("ticker").rlike("11$")).select(F.lit("suffix_11").alias("kind"), "ticker").distinct()
    return left.unionByName(units)


def compare_monthly(universe: DataFrame, official: DataFrame) -> DataFrame:
    """Per month: sizes, matched, surplus, missing and the sorted list of missing names (at most a month's official list).

    ``missing_monthly`` has the missing names as rows.
    """
    u = universe.select("mes", "ticker", F.lit(True).alias("u"))
    o = official.select("mes", "ticker", F.lit(True).alias("o"))
    return u.join(o, ["mes", "ticker"], "full").groupBy("mes").agg(
        F.count("u").alias("n_universo"), F.count("o").alias("n_oficial"),
        F.count_if(F.col("u").isNotNull() & F.col("o").isNotNull()).alias("n_comum"),
        F.count_if(F.col("o").isNull()).alias("n_sobra"), F.count_if(F.col("u").isNull()).alias("n_falta"),
        F.array_join(F.sort_array(F.collect_list(F.when(F.col("u").isNull(), F.col("ticker")))), ",").alias("faltam"))


def missing_monthly(universe: DataFrame, official: DataFrame) -> DataFrame:
    """(mes, falta), one row for each official name that a month's universe lacks."""
    return official.select("mes", "ticker").distinct().join(universe, ["mes", "ticker"], "left_anti").select("mes", F.col("ticker").alias("falta"))


def compare_consolidated(universe: DataFrame, official: DataFrame) -> DataFrame:
    """The same on the union of months."""
    u = universe.select("ticker").distinct().withColumn("u", F.lit(True))
    o = official.select("ticker").distinct().withColumn("o", F.lit(True))
    return u.join(o, "ticker", "full").agg(
        F.count("u").alias("n_universo"), F.count("o").alias("n_oficial"),
        F.count_if(F.col("u").isNotNull() & F.col("o").isNotNull()).alias("n_comum"),
        F.count_if(F.col("o").isNull()).alias("n_sobra"), F.count_if(F.col("u").isNull()).alias("n_falta"))


def ticker_life(universe: DataFrame) -> DataFrame:
    lo = universe.agg(F.min("mes").alias("m")).select("m").scalar()
    hi = universe.agg(F.max("mes").alias("m")).select("m").scalar()
    return universe.groupBy("ticker").agg(
        F.min("mes").alias("primeiro"), F.max("mes").alias("ultimo"), F.count("mes").alias("n_meses"),
    ).select("*", (F.col("primeiro") == lo).alias("desde_inicio"), (F.col("ultimo") < hi).alias("saiu"))


def liquid_in(universe: DataFrame, first_year: int, last_year: int, min_months: int = 6) -> DataFrame:
    """Names present at least ``min_months`` within [first-01, last-12], compared as text."""
    inside = F.col("mes").between(f"{first_year}-01", f"{last_year}-12")
    return (universe.where(inside).groupBy("ticker").agg(F.count("mes").alias("n_meses"))
            .where(F.col("n_meses") >= min_months))


def graph_nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("ticker")).distinct()


def graph_names_not_yet_liquid(edges: DataFrame, universe: DataFrame, year: int, min_months: int = 6) -> DataFrame:
    liquid = liquid_in(universe, year, year, min_months)
    life = ticker_life(universe).select("ticker", "primeiro")
    return (graph_nodes(edges).join(liquid, "ticker", "left_anti").join(life, "ticker", "left")
            .select("ticker", F.when(F.col("primeiro").isNull(), "never").otherwise("entered").alias("motivo"),
                    "primeiro"))


def large_names_that_left(universe: DataFrame, edges: DataFrame, year: int, rank: int = 60) -> DataFrame:
    """Large in the first year, gone before the end; flags whether the graph holds them."""
    big = universe.where((F.substring("mes", 1, 4) == str(year)) & (F.col("rank") <= rank)).select("ticker").distinct()
    nodes = graph_nodes(edges).withColumn("g", F.lit(True))
    return (ticker_life(universe).where("saiu").join(big, "ticker", "left_semi").join(nodes, "ticker", "left")
            .select("ticker", "ultimo", F.coalesce("g", F.lit(False)).alias("no_grafo")))


def graph_coverage(edges: DataFrame, universe: DataFrame, periods: Sequence[tuple[str, int, int]],
                   min_months: int = 6) -> DataFrame:
    """Share of the liquid names of each period that the graph holds."""
    parts = None
    for name, y0, y1 in periods:
        p = liquid_in(universe, y0, y1, min_months).select(F.lit(name).alias("periodo"), "ticker")
        parts = p if parts is None else parts.unionByName(p)
    nodes = graph_nodes(edges).withColumn("g", F.lit(1))
    return parts.join(nodes, "ticker", "left").groupBy("periodo").agg(
        F.count("ticker").alias("n_liquidos"), F.count("g").alias("n_no_grafo"),
        F.try_divide(F.count("g").cast("double"), F.count("ticker").cast("double")).alias("cobertura"))
