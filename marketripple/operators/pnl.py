"""P&L and layered trading costs as one ledger of positions and one aggregation per date."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketripple.functions.expr import median, rolling, series_window
from marketripple.functions.quantiles import group_quantiles
from marketripple.operators.returns import HEDGE_TICKER


@dataclass(frozen=True)
class CostParams:
    """Liquidity bands (most liquid first) and the costs per band."""

    bands: tuple[float, ...] = (150e6, 50e6, 20e6)
    half_spread_bps: tuple[float, ...] = (2.0, 5.0, 11.0, 24.0)
    brokerage_bps: tuple[float, ...] = (3.0, 3.0, 3.5, 4.0)
    fees_bps: float = 2.3
    borrow_annual: tuple[float, ...] = (0.01, 0.02, 0.035, 0.06)
    hedge_bps: float = 2.2
    eta: float = 0.4
    max_participation: float = 0.25
    vol_window: int = 60
    vol_min: int = 20
    flat: float = 0.0005
    periods: int = 252


def liquidity_band(adtv: str | Column, bands: Sequence[float]) -> Column:
    """0 for the most liquid names; unknown ADTV falls into the least liquid band."""
    a = F.coalesce(F.col(adtv) if isinstance(adtv, str) else adtv, F.lit(0.0))
    out = F.lit(len(bands))
    for i in reversed(range(len(bands))):
        out = F.when(a >= bands[i], i).otherwise(out)
    return out


def per_band(band: Column, values: Sequence[float]) -> Column:
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), band + 1)


def impact_sigma(returns: DataFrame, p: CostParams = CostParams()) -> DataFrame:
    """Rolling deviation per name on the P&L calendar, with the median over days of daily medians as fallback."""
    return _deviation(returns, p).select("date", "ticker", F.coalesce("_s", impact_fallback(returns, p).select("m").scalar()).alias("sigma"))


def _deviation(returns: DataFrame, p: CostParams) -> DataFrame:
    return returns.select("date", "ticker", rolling("r", series_window((), "ticker"), p.vol_window, p.vol_min, F.stddev_samp).alias("_s"))


def impact_fallback(returns: DataFrame, p: CostParams = CostParams()) -> DataFrame:
    """One row ``m``: the median over days of the daily medians of the deviation."""
    return group_quantiles(_deviation(returns, p), ["date"], "_s", [0.5], ["_m"]).agg(median("_m").alias("m"))


def on_session_dates(df: DataFrame, index: DataFrame) -> DataFrame:
    """Rows on dates with an index return (one row per calendar day, so the date list is broadcast)."""
    return df.join(F.broadcast(index.select("date")), "date", "left_semi")


def ledger(weights: DataFrame, panel: DataFrame, index: DataFrame, p: CostParams = CostParams(),
           keys: Sequence[str] = ()) -> DataFrame:
    """One row per (keys, date, ticker): weight, |change|, return, ADTV, deviation. NULL weight is 0.

    ``panel`` gives (date, idx, ticker, r, adtv) of the book's names, ``index`` (date, idx, m) the hedge return.
    """
    w = on_session_dates(weights, index).withColumn("w", F.coalesce("w", F.lit(0.0)))
    change = F.abs(F.col("w") - F.lag("w").over(series_window(keys, "ticker")))
    w = w.withColumn("dw", F.coalesce(change, F.lit(0.0)))
    kept = on_session_dates(panel, index)
    info = kept.select("date", "ticker", "r", "adtv").join(impact_sigma(kept, p), ["date", "ticker"])
    hedge = index.select("date", F.lit(HEDGE_TICKER).alias("ticker"), F.col("m").alias("r"))
    info = info.unionByName(hedge, allowMissingColumns=True)
    return w.join(info, ["date", "ticker"], "left")


def daily_costs(led: DataFrame, aum: float | str, p: CostParams = CostParams(), keys: Sequence[str] = (),
                eta: float | str | None = None, impact: bool = True, borrow: bool = True) -> DataFrame:
    """Gross P&L, turnover and every cost layer per date in one aggregation."""
    size = F.col(aum) if isinstance(aum, str) else F.lit(float(aum))
    e = F.lit(p.eta) if eta is None else (F.col(eta) if isinstance(eta, str) else F.lit(float(eta)))
    share = F.col("ticker") != HEDGE_TICKER
    band = liquidity_band("adtv", p.bands)
    spread = F.col("dw") * (per_band(band, p.half_spread_bps) + p.fees_bps + per_band(band, p.brokerage_bps)) / 1e4
    part = F.coalesce(F.least(F.try_divide(F.col("dw") * size, F.col("adtv")), F.lit(p.max_participation)), F.lit(p.max_participation))
    hit = F.col("dw") * e * F.col("sigma") * F.sqrt(part) if impact else F.lit(0.0)
    loan = F.abs(F.least("w", F.lit(0.0))) * per_band(band, p.borrow_annual) / p.periods if borrow else F.lit(0.0)

    def tot(c: Column, only: Column) -> Column:
        return F.coalesce(F.sum(F.when(only, c)), F.lit(0.0))

    g = led.groupBy(*keys, "date").agg(
        F.coalesce(F.sum(F.col("w") * F.coalesce("r", F.lit(0.0))), F.lit(0.0)).alias("gross"),
        F.sum("dw").alias("turnover"),
        tot(spread, share).alias("spread"), tot(hit, share).alias("impact"), tot(loan, share).alias("borrow"),
        tot(F.col("dw") * p.hedge_bps / 1e4, ~share).alias("hedge"))
    total = F.col("spread") + F.col("impact") + F.col("borrow") + F.col("hedge")
    return g.withColumn("cost", total).withColumn("net", F.col("gross") - total).withColumn(
        "net_flat", F.col("gross") - F.col("turnover") * p.flat)


def turnover(led: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return led.groupBy(*keys, "date").agg(F.sum("dw").alias("turnover"))


def gross_pnl(led: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return led.groupBy(*keys, "date").agg(F.sum(F.col("w") * F.coalesce("r", F.lit(0.0))).alias("gross"))


def net_pnl_flat(pnl: DataFrame, cost: float = 0.0005) -> DataFrame:
    return pnl.withColumn("net_flat", F.col("gross") - F.col("turnover") * cost)


def net_pnl_layered(pnl: DataFrame, costs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Subtract a cost series; a date without a cost row costs nothing."""
    return pnl.join(costs.select(*keys, "date", F.col("cost").alias("_c")), [*keys, "date"], "left").withColumn(
        "net", F.col("gross") - F.coalesce("_c", F.lit(0.0))).drop("_c")


def fund_return(pnl: DataFrame, riskfree: DataFrame, value: str = "net") -> DataFrame:
    """Self-financed P&L plus cash."""
    return pnl.join(F.broadcast(riskfree), "date", "left").withColumn(  # one row per calendar day
        "fund", F.col(value) + F.coalesce("rf", F.lit(0.0)))


def cost_summary(pnl: DataFrame, periods: int = 252, keys: Sequence[str] = ()) -> DataFrame:
    """Annualised mean of each layer, turnover and cost in bps per unit of turnover."""
    parts = [(F.avg(c) * periods).alias(c) for c in ("spread", "impact", "borrow", "hedge", "cost")]
    return pnl.groupBy(*keys).agg(*parts, F.avg("turnover").alias("turnover"),
                                  (F.try_divide(F.avg("cost"), F.avg("turnover")) * 1e4).alias("bps_per_turnover"))


def breakeven_bps(pnl: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Cost per unit of turnover that removes the gross P&L; undefined without turnover."""
    be = F.try_divide(F.avg("gross"), F.avg("turnover")) * 1e4
    return pnl.groupBy(*keys).agg(F.when(F.avg("turnover") > 0, be).alias("breakeven_bps"))


def eta_sensitivity(led: DataFrame, aum: float, p: CostParams = CostParams(),
                    etas: Sequence[float] = (0.0, 0.2, 0.4, 0.7, 1.0)) -> DataFrame:
    """Annualised cost and net per impact coefficient. Cost is linear in eta, so one ledger pass serves all."""
    base = daily_costs(led, aum, p, eta=1.0)
    d = base.withColumn("eta", F.explode(F.array(*[F.lit(float(e)) for e in etas])))
    cost = F.col("spread") + F.col("borrow") + F.col("hedge") + F.col("eta") * F.col("impact")
    return d.groupBy("eta").agg((F.avg(cost) * p.periods).alias("cost_year"),
                                (F.avg(F.col("gross") - cost) * p.periods).alias("net_year"))


def turnover_by_band(led: DataFrame, p: CostParams = CostParams(), keys: Sequence[str] = ()) -> DataFrame:
    b = led.where(F.col("ticker") != HEDGE_TICKER).groupBy(*keys, liquidity_band("adtv", p.bands).alias("band")).agg(
        F.sum("dw").alias("turnover"))
    tot = led.where(F.col("ticker") != HEDGE_TICKER).groupBy(*keys).agg(F.sum("dw").alias("_t"))
    b = b.join(tot, list(keys)) if keys else b.withColumn("_t", tot.select("_t").scalar())
    return b.withColumn("share", F.try_divide("turnover", "_t")).drop("_t")
