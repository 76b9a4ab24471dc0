"""Return construction, cleaning and agreement between price sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketripple.functions.expr import corr_agg, median, pair_count, rolling, series_window
from marketripple.operators.panel import pct_change

# Split and grouping factors recognised as corporate actions.
SPLIT_FACTORS = (2, 3, 4, 5, 6, 8, 10, 12, 15, 20, 25, 30, 40, 50, 100, 200, 500, 1000)
HEDGE_TICKER = "IBOV_SYNTHETIC"


def daily_returns(prices: DataFrame, value: str = "close", out: str = "r", keys: Sequence[str] = ()) -> DataFrame:
    return pct_change(prices, value, out, keys)


def clean_corporate_actions(prices: DataFrame, value: str = "close", jump: float = 0.35, tol: float = 0.12,
                            min_price: float = 1.0, cap: float = 0.50, keys: Sequence[str] = ()) -> DataFrame:
    """Returns of a dense price panel with split-like jumps set to 0, penny prices dropped and extremes capped."""
    w = series_window(keys, "ticker")
    p = F.when(F.col(value) >= min_price, F.col(value))
    df = prices.withColumn("_p", p)
    ratio = F.try_divide(F.col("_p"), F.lag("_p").over(w))
    df = df.withColumn("_q", ratio)
    fs = F.array(*[F.lit(float(f)) for f in SPLIT_FACTORS])
    near = F.exists(fs, lambda f: (F.abs(F.col("_q") / f - 1.0) <= tol) | (F.abs(F.col("_q") * f - 1.0) <= tol))
    raw = F.col("_q") - 1.0
    clean = F.when((F.abs(raw) > jump) & near, F.lit(0.0)).otherwise(F.greatest(F.lit(-cap), F.least(F.lit(cap), raw)))
    return df.withColumn("r", F.when(F.col("_q").isNotNull(), clean)).drop("_p", "_q")


def hybrid_union(primary: DataFrame, fallback: DataFrame, min_days: int = 250, value: str = "r") -> DataFrame:
    """Primary source per ticker; the fallback only for absent tickers with enough valid days."""
    have = primary.where(F.col(value).isNotNull()).select("ticker").distinct()
    ok = (fallback.join(have, "ticker", "left_anti").groupBy("ticker").agg(F.count(value).alias("n"))
          .where(F.col("n") >= min_days).select("ticker"))
    cols = ["date", "ticker", value]
    a = primary.select(*cols, F.lit("primary").alias("source"))
    b = fallback.join(ok, "ticker", "left_semi").select(*cols, F.lit("fallback").alias("source"))
    return a.unionByName(b)


def source_agreement(a: DataFrame, b: DataFrame, value: str = "r") -> DataFrame:
    """Per ticker: correlation, deviation of the difference, pairs and a flag below 0.90."""
    j = a.select("date", "ticker", F.col(value).alias("x")).join(
        b.select("date", "ticker", F.col(value).alias("y")), ["date", "ticker"])
    return j.groupBy("ticker").agg(
        corr_agg("x", "y").alias("corr"), F.stddev_samp(F.col("x") - F.col("y")).alias("sd_diff"),
        pair_count("x", "y").alias("n")).withColumn("abaixo_090", F.col("corr") < 0.90)


def session_coverage(returns: DataFrame, window: int, min_obs: int, floor: float = 0.60, min_names: int = 20,
                     keys: Sequence[str] = (), value: str = "r") -> DataFrame:
    """Names with a return per date, its moving-median reference and whether the date is a real session."""
    return session_flags(returns.groupBy(*keys, "date").agg(F.count(value).alias("n")), window, min_obs, floor, min_names, keys)


def session_flags(per_day: DataFrame, window: int, min_obs: int, floor: float = 0.60, min_names: int = 20, keys: Sequence[str] = ()) -> DataFrame:
    """Reference and session flag of counts ``n`` per (keys, date)."""
    w = series_window(keys, order="date")
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    ref = F.coalesce(rolling("n", w, window, min_obs, median), median("n").over(whole))
    return (per_day.withColumn("ref", ref)
            .withColumn("sessao", (F.col("n") >= F.greatest(F.col("ref") * floor, F.lit(1.0)))
                        | (F.col("ref") < min_names)))


def ghost_holiday_filter(returns: DataFrame, window: int = 252, min_obs: int = 20) -> DataFrame:
    """Drop the calendar rows that are not sessions."""
    good = session_coverage(returns, window, min_obs).where("sessao").select("date")
    return returns.join(F.broadcast(good), "date", "left_semi")


def inject_index_asset(returns: DataFrame, index: DataFrame, value: str = "r", index_value: str = "m",
                       ticker: str = HEDGE_TICKER) -> DataFrame:
    """Index return as one more ticker; days without an index return are dropped."""
    idx = index.where(F.col(index_value).isNotNull())
    kept = returns.join(F.broadcast(idx.select("date")), "date", "left_semi").select("date", "ticker", value)
    dates = returns.select("date").distinct()
    own = idx.join(dates, "date", "left_semi").select("date", F.lit(ticker).alias("ticker"), F.col(index_value).alias(value))
    return kept.unionByName(own)


def coverage_by_day(returns: DataFrame, value: str = "r") -> DataFrame:
    """Names with a return per date and their share of all names in the panel."""
    per = returns.groupBy("date").agg(F.count(value).alias("n"))
    total = returns.agg(F.count_distinct("ticker").alias("n")).select("n").scalar()
    return per.withColumn("cobertura", F.try_divide(F.col("n").cast("double"), total.cast("double")))
