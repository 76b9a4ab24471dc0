"""Performance metrics over keyed date series (keys..., date, value). Thousands of keys run as one job."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketripple.functions.expr import (
    known_class,
    compound_agg, corr_agg, kurt_agg, median, rolling, series_window, sharpe_agg, skew_agg, slope_agg,
)
from marketripple.operators.portfolio import exposures  # noqa: F401  (part of the report tables)
from marketripple.operators.returns import HEDGE_TICKER


def total_return(s: DataFrame, r: str = "r", keys: Sequence[str] = ()) -> DataFrame:
    return s.groupBy(*keys).agg(compound_agg(r).alias("total_return"))


def annualise(total: Column, n: Column, periods: int) -> Column:
    return F.pow(1.0 + total, F.lit(float(periods)) / n) - 1.0


def annualised_return(s: DataFrame, r: str = "r", periods: int = 252, keys: Sequence[str] = ()) -> DataFrame:
    return s.groupBy(*keys).agg(annualise(compound_agg(r), F.count(r), periods).alias("annual_return"))


def sharpe(s: DataFrame, r: str = "r", rf: str | float | None = None, periods: int = 252, min_obs: int = 0,
           keys: Sequence[str] = ()) -> DataFrame:
    """Mean over deviation of r, of r minus a daily series, or of r minus an annual constant."""
    if isinstance(rf, str):
        x = F.col(r) - F.coalesce(F.col(rf), F.lit(0.0))
    else:
        x = F.col(r) - (rf / periods if rf else 0.0)
    return s.groupBy(*keys).agg(sharpe_agg(x, periods, min_obs).alias("sharpe"))


def volatility(s: DataFrame, r: str = "r", periods: int = 252, keys: Sequence[str] = ()) -> DataFrame:
    return s.groupBy(*keys).agg((F.stddev_samp(r) * math.sqrt(periods)).alias("vol"))


def sortino_agg(x: Column, periods: int) -> Column:
    return F.try_divide(F.avg(x), F.stddev_samp(F.when(x < 0, x))) * math.sqrt(periods)


def sortino(s: DataFrame, r: str = "r", periods: int = 252, keys: Sequence[str] = ()) -> DataFrame:
    return s.groupBy(*keys).agg(sortino_agg(F.col(r), periods).alias("sortino"))


def drawdown(s: DataFrame, r: str = "r", keys: Sequence[str] = ()) -> DataFrame:
    """Curve and its distance to the running maximum. The curve starts at the first 1 + r."""
    w = series_window(keys, order="date").rowsBetween(Window.unboundedPreceding, 0)
    d = s.withColumn("curve", F.product(1.0 + F.coalesce(F.col(r), F.lit(0.0))).over(w))
    return d.withColumn("drawdown", F.try_divide(F.col("curve"), F.max("curve").over(w)) - 1.0)


def max_drawdown(s: DataFrame, r: str = "r", keys: Sequence[str] = ()) -> DataFrame:
    return drawdown(s, r, keys).groupBy(*keys).agg(F.min("drawdown").alias("max_drawdown"))


def performance(s: DataFrame, r: str = "r", rf: str | None = None, periods: int = 252, keys: Sequence[str] = (),
                min_obs: int = 20) -> DataFrame:
    """Total, annual return, volatility, Sharpe, Sortino, drawdown and Calmar per key with enough dates."""
    d = drawdown(s.where(F.col(r).isNotNull()), r, keys)
    x = F.col(r) - F.coalesce(F.col(rf), F.lit(0.0)) if rf else F.col(r)
    g = d.groupBy(*keys).agg(
        F.count(r).alias("n"), compound_agg(r).alias("total_return"), (F.stddev_samp(r) * math.sqrt(periods)).alias("vol"),
        sharpe_agg(x, periods).alias("sharpe"), sortino_agg(x, periods).alias("sortino"),
        F.min("drawdown").alias("max_drawdown")).where(F.col("n") >= min_obs)
    g = g.withColumn("annual_return", annualise(F.col("total_return"), F.col("n"), periods))
    return g.withColumn("calmar", F.when(F.col("max_drawdown") < 0, F.try_divide("annual_return", F.abs("max_drawdown"))))


def period_metrics(pnl: DataFrame, periods: int = 252, keys: Sequence[str] = (), min_obs: int = 20) -> DataFrame:
    """The 12-field row per key (a key includes ``period``): needs net, gross, turnover and rf per date."""
    rf = F.coalesce(F.col("rf"), F.lit(0.0))
    d = drawdown(pnl.where(F.col("net").isNotNull()), "net", keys)
    y = float(periods)
    return d.groupBy(*keys).agg(
        F.count("net").alias("n"), compound_agg("net").alias("total_return"),
        compound_agg(F.col("net") + rf).alias("fund_total"), (F.avg("net") * y).alias("net_year"),
        (F.avg(F.col("net") + rf) * y).alias("fund_year"), (F.avg("gross") * y).alias("gross_year"),
        (F.avg(rf) * y).alias("cash_year"), (F.stddev_samp("net") * math.sqrt(periods)).alias("vol_year"),
        sharpe_agg("net", periods).alias("sharpe"), F.avg("turnover").alias("turnover"),
        F.min("drawdown").alias("max_drawdown")).where(F.col("n") >= min_obs)


def variant_table(pnl: DataFrame, ic: DataFrame, positions: DataFrame, periods: int = 252,
                  keys: Sequence[str] = ("variant", "period"), order: Sequence[str] = ("IS", "OOS", "full")) -> DataFrame:
    """Metrics, information coefficient and mean open positions per (variant, period), in period order."""
    m = period_metrics(pnl, periods, keys)
    n = positions.groupBy(*keys).agg(F.avg("n_positions").alias("n_positions"))
    rank = F.coalesce(*[F.when(F.col("period") == p, i) for i, p in enumerate(order)], F.lit(len(order)))
    out = m.join(ic, list(keys), "left").join(n, list(keys), "left").withColumn("period_order", rank.cast("int"))
    return out.orderBy(*[k for k in keys if k != "period"], "period_order")


def annual_table(days: DataFrame, periods: int = 252, min_obs: int = 20, keys: Sequence[str] = ()) -> DataFrame:
    """Per year both cost regimes, fund, cash, index, ratio, drawdown, volatility, names and turnover."""
    k = [*keys, "year"]
    d = drawdown(days.withColumn("year", F.year("date")), "flat", k)
    return d.groupBy(*k).agg(
        F.count("flat").alias("n"), compound_agg("flat").alias("flat"), compound_agg("real").alias("real"),
        compound_agg("fund_real").alias("fund_real"), compound_agg("cash").alias("cash"), compound_agg("index").alias("index"),
        sharpe_agg("flat", periods).alias("sharpe"), F.min("drawdown").alias("max_drawdown"),
        (F.stddev_samp("flat") * math.sqrt(periods)).alias("vol"), F.avg("n_pos").alias("names"),
        F.avg("turnover").alias("turnover")).where((F.col("n") >= min_obs) & (F.col("names") >= 1))


def monthly_returns(s: DataFrame, r: str = "r", keys: Sequence[str] = ()) -> DataFrame:
    """Year x month grid of compounded returns."""
    m = s.groupBy(*keys, F.year("date").alias("year"), F.month("date").alias("month")).agg(compound_agg(r).alias("v"))
    g = m.groupBy(*keys, "year").pivot("month", list(range(1, 13))).agg(F.first("v"))
    return g.select(*keys, "year", *[F.col(f"`{i}`").alias(f"m{i:02d}") for i in range(1, 13)])


def rolling_risk(s: DataFrame, r: str = "r", n_sharpe: int = 252, n_vol: int = 63, periods: int = 252,
                 keys: Sequence[str] = ()) -> DataFrame:
    w = series_window(keys, order="date")
    y = math.sqrt(periods)
    mean, sd = rolling(r, w, n_sharpe, n_sharpe), rolling(r, w, n_sharpe, n_sharpe, F.stddev_samp)
    return s.select(*keys, "date", (F.try_divide(mean, sd) * y).alias("rolling_sharpe"),
                    (rolling(r, w, n_vol, n_vol, F.stddev_samp) * y).alias("rolling_vol"))


def rolling_risk_summary(rolled: DataFrame, ceiling: float = 0.12, keys: Sequence[str] = ()) -> DataFrame:
    v = F.col("rolling_vol")
    return rolled.groupBy(*keys).agg(
        F.avg(F.when(v.isNotNull(), (v > ceiling).cast("double"))).alias("share_above"), median(v).alias("median_vol"),
        F.max(v).alias("max_vol"), F.max_by("date", F.struct(v, -F.unix_date("date"))).alias("date_of_max"))


def moments(s: DataFrame, r: str = "r", keys: Sequence[str] = ()) -> DataFrame:
    return s.groupBy(*keys).agg(F.count(r).alias("n"), F.avg(r).alias("mean"), F.stddev_samp(r).alias("std"),
                                skew_agg(r).alias("skew"), kurt_agg(r).alias("kurtosis"))


def histogram(s: DataFrame, r: str = "r", bins: int = 70, keys: Sequence[str] = ()) -> DataFrame:
    """Counts in equal bins between minimum and maximum; the last bin is closed."""
    lim = s.groupBy(*keys).agg(F.min(r).alias("_lo"), F.max(r).alias("_hi"))
    d = s.where(F.col(r).isNotNull())
    d = d.join(lim, list(keys)) if keys else d.select(
        "*", lim.select("_lo").scalar().alias("_lo"), lim.select("_hi").scalar().alias("_hi"))
    pos = F.floor(F.try_divide(F.col(r) - F.col("_lo"), F.col("_hi") - F.col("_lo")) * bins)
    d = d.withColumn("bin", F.coalesce(F.least(pos, F.lit(bins - 1)), F.lit(0)).cast("int"))
    return d.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))


def market_neutrality(s: DataFrame, r: str = "r", m: str = "m", limit: float = 0.3, keys: Sequence[str] = ()) -> DataFrame:
    return s.groupBy(*keys).agg(corr_agg(m, r).alias("corr"), slope_agg(m, r).alias("slope")).withColumn(
        "alert", F.abs("corr") > limit)


def execution_diagnostic(pnl: DataFrame, periods: int = 252, flat: float = 0.0005, target: float = 0.12,
                         keys: Sequence[str] = ()) -> DataFrame:
    """Turnover, gross, cost, net, volatility p.a. under the flat cost, with two warnings."""
    y = float(periods)
    g = pnl.groupBy(*keys).agg(
        F.avg("turnover").alias("turnover"), (F.avg("turnover") * flat * y).alias("cost_year"),
        (F.avg("gross") * y).alias("gross_year"), (F.avg("net_flat") * y).alias("net_year"),
        (F.stddev_samp("net_flat") * math.sqrt(periods)).alias("vol_year"))
    return g.withColumn("cost_eats_gross", (F.col("gross_year") > 0) & (F.col("net_year") <= 0)).withColumn(
        "below_vol_target", F.col("vol_year") < 0.5 * target)


SERIES = ("flat", "real", "fund_flat", "fund_real", "index", "cash")


def report_days(pnl: DataFrame, index: DataFrame, riskfree: DataFrame, weights: DataFrame, floor: float = 1e-6,
                keys: Sequence[str] = ()) -> DataFrame:
    """Per active date every series of the report, on the single active window."""
    w = weights.where(F.col("w").isNotNull()).groupBy(*keys, "date").agg(
        F.sum(F.abs("w")).alias("g"),
        F.count_if((F.abs("w") > floor) & (F.col("ticker") != HEDGE_TICKER)).alias("n_pos"))
    return report_active_days(pnl, index, riskfree, w, keys)


def report_active_days(pnl: DataFrame, index: DataFrame, riskfree: DataFrame, active: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``report_days`` from the gross weight ``g`` and the positions ``n_pos`` per (keys, date)."""
    w = active.where(F.col("g") > 1e-9).select(*keys, "date", "g", "n_pos")
    per_day = index.select("date", "m").join(riskfree, "date", "left")
    d = pnl.join(w, [*keys, "date"]).join(F.broadcast(per_day), "date", "left")  # one row per calendar day
    rf = F.coalesce("rf", F.lit(0.0))
    return d.select(*keys, "date", F.col("net_flat").alias("flat"), F.col("net").alias("real"),
                    (F.col("net_flat") + rf).alias("fund_flat"), (F.col("net") + rf).alias("fund_real"),
                    F.coalesce("m", F.lit(0.0)).alias("index"), rf.alias("cash"), "turnover", "n_pos", "gross", "cost",
                    "spread", "impact", "borrow", "hedge")


def report_series(days: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The six series in long form with the cash rate alongside."""
    opts = F.array(*[F.struct(F.lit(s).alias("series"), F.col(s).alias("r")) for s in SERIES])
    return days.select(*keys, "date", F.col("cash").alias("rf"), F.explode(opts).alias("_s")).select(
        *keys, "date", "rf", "_s.series", "_s.r")


def period_comparison_table(days: DataFrame, periods: int = 252, keys: Sequence[str] = ()) -> DataFrame:
    """Six series by metric; Sharpe over cash for the funded ones and their excess over cash."""
    s = report_series(days, keys)
    k = [*keys, "series"]
    m = performance(s, periods=periods, keys=k)
    funded = F.col("series").isin("fund_flat", "fund_real", "index")
    over = s.where(funded).groupBy(*k).agg(sharpe_agg(F.col("r") - F.col("rf"), periods).alias("sharpe_over_cash"))
    cash = s.where(F.col("series") == "cash").groupBy(*keys).agg(compound_agg("r").alias("_c"))
    m = m.join(over, k, "left")
    m = m.join(cash, list(keys)) if keys else m.withColumn("_c", cash.select("_c").scalar())
    blank = lambda c: F.when(F.col("series") != "cash", F.col(c)).alias(c)
    return m.select(*k, "n", "total_return", "annual_return", "vol", "max_drawdown", blank("sharpe"), blank("sortino"),
                    blank("calmar"), "sharpe_over_cash", F.when(funded, F.col("total_return") - F.col("_c")).alias("excess"))


def signals_table(weights: DataFrame, sectors: DataFrame, since: str, top: int = 6) -> DataFrame:
    """Largest name of each subsector, the ``top`` of these, and their monthly mean weight with its side."""
    size = weights.where(F.col("ticker") != HEDGE_TICKER).groupBy("ticker").agg(
        F.round(F.sum(F.abs("w")), 9).alias("size")).join(sectors.where(known_class("subsector")).select("ticker", "subsector"), "ticker")
    best = size.groupBy("subsector").agg(F.min(F.struct((-F.col("size")).alias("ns"), "ticker")).alias("b"))
    chosen = best.orderBy("b.ns", "b.ticker").limit(top).select("b.ticker", "subsector")
    m = (weights.where(F.col("date") >= F.lit(since).cast("date")).join(F.broadcast(chosen), "ticker")  # at most `top` rows
         .groupBy("ticker", "subsector", F.last_day("date").alias("month_end")).agg(F.avg("w").alias("weight")))
    side = F.when(F.col("weight").isNull() | (F.abs("weight") < 1e-4), "HOLD").when(F.col("weight") > 0, "BUY").otherwise("SELL")
    return m.withColumn("side", side)


def best_years_concentration(s: DataFrame, r: str = "r", keys: Sequence[str] = ()) -> DataFrame:
    """Sum of the two best years against the total, number of negative years, best and worst year."""
    y = s.groupBy(*keys, F.year("date").alias("year")).agg(compound_agg(r).alias("v"))
    w = Window.partitionBy(*keys).orderBy(F.desc("v"), "year")  # one row per year
    y = y.withColumn("rk", F.row_number().over(w))
    return y.groupBy(*keys).agg(
        F.sum(F.when(F.col("rk") <= 2, F.col("v"))).alias("best_two"), (F.product(1.0 + F.col("v")) - 1.0).alias("total"),
        F.count_if(F.col("v") < 0).alias("negative_years"), F.max_by("year", "v").alias("best_year"),
        F.min_by("year", "v").alias("worst_year"))


def monthly_activity(days: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return days.groupBy(*keys, F.last_day("date").alias("month_end")).agg(
        F.avg("n_pos").alias("positions"), F.avg("turnover").alias("turnover"))


def cost_vs_alpha(days: DataFrame, periods: int = 252, keys: Sequence[str] = ()) -> DataFrame:
    """Layer shares of the cost, and cost and alpha per unit of turnover in bps."""
    per = lambda c: F.try_divide(F.avg(c), F.avg("turnover")) * 1e4
    shares = [F.try_divide(F.avg(c), F.avg("cost")).alias(f"share_{c}") for c in ("spread", "impact", "borrow", "hedge")]
    return days.groupBy(*keys).agg(*shares, (F.avg("cost") * periods).alias("cost_year"), per("cost").alias("cost_bps"),
                                   per("gross").alias("alpha_bps"))


def unit_alpha(days: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    per = lambda c: F.try_divide(F.avg(c), F.avg("turnover")) * 1e4
    return days.groupBy(*keys).agg(per("gross").alias("alpha_bps"), per("cost").alias("cost_bps"))


# ---- tail and path measures -------------------------------------------------------------------------------


def tail_risk(s: DataFrame, r: str = "r", keys: Sequence[str] = ()) -> DataFrame:
    """Value at risk and expected shortfall at 95 % and 99 % as positive losses; groups hold one row per date."""
    q = s.groupBy(*keys).agg(F.percentile(F.col(r), F.array(F.lit(0.05), F.lit(0.01))).alias("_q"))
    d = s.join(q, list(keys)) if keys else s.withColumn("_q", q.select("_q").scalar())
    x = F.col(r)
    return d.groupBy(*keys).agg(
        (-F.first(F.col("_q")[0])).alias("var95"), (-F.first(F.col("_q")[1])).alias("var99"),
        (-F.avg(F.when(x <= F.col("_q")[0], x))).alias("es95"), (-F.avg(F.when(x <= F.col("_q")[1], x))).alias("es99"))


def underwater_days(s: DataFrame, r: str = "r", keys: Sequence[str] = ()) -> DataFrame:
    """Longest run of dates below a previous peak: every peak starts a new island."""
    d = drawdown(s, r, keys)
    w = series_window(keys, order="date").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("island", F.sum((F.col("drawdown") >= 0).cast("int")).over(w))
    runs = d.groupBy(*keys, "island").agg(F.count_if(F.col("drawdown") < 0).alias("run"))
    return runs.groupBy(*keys).agg(F.max("run").alias("underwater_days"))


def top_names_pnl_share(ledger: DataFrame, top: int = 5, keys: Sequence[str] = ()) -> DataFrame:
    """Share of the absolute P&L in the ``top`` names."""
    by = ledger.groupBy(*keys, "ticker").agg(F.abs(F.sum(F.col("w") * F.coalesce("r", F.lit(0.0)))).alias("a"))
    total = by.groupBy(*keys).agg(F.sum("a").alias("_t"))
    w = Window.partitionBy(*keys, F.lit(0)).orderBy(F.desc("a"), "ticker")
    head = by.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= top).groupBy(*keys).agg(F.sum("a").alias("_h"))
    j = head.join(total, list(keys)) if keys else head.withColumn("_t", total.select("_t").scalar())
    return j.select(*keys, F.try_divide("_h", "_t").alias("top_share"))


def stress_windows(s: DataFrame, windows: Sequence[tuple[str, str, str]], r: str = "r", keys: Sequence[str] = ()) -> DataFrame:
    from marketripple.operators.panel import slice_period
    return slice_period(s, windows).groupBy(*keys, F.col("period").alias("window")).agg(
        F.count(r).alias("n"), compound_agg(r).alias("total_return"))


def rolling_beta(s: DataFrame, n: int = 63, r: str = "r", m: str = "m", keys: Sequence[str] = ()) -> DataFrame:
    """5 %, 50 % and 95 % of the rolling slope against the index."""
    w = series_window(keys, order="date").rowsBetween(-(n - 1), 0)
    b = F.when(F.count(r).over(w) >= n, F.try_divide(F.covar_pop(m, r).over(w), F.var_pop(m).over(w)))
    d = s.select(*keys, b.alias("b"))
    q = F.percentile(F.col("b"), F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    return d.groupBy(*keys).agg(q.alias("q")).select(
        *keys, F.col("q")[0].alias("p05"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p95"))
