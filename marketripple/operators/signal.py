"""Propagation of shocks over graphs and cross-sectional standardisation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketripple.functions.expr import NO_VARIANCE, rolling, salted_join, series_window
from marketripple.functions.quantiles import group_quantiles
from marketripple.operators.panel import small_by_date

def _spread(shocks: DataFrame, load: DataFrame) -> DataFrame:
    """Join shocks to edges on the trigger. A hub can own a third of all edges: its edges are cut by target."""
    return salted_join(shocks, load, ["src", *[c for c in shocks.columns if c in load.columns and c not in ("src",)]], "dst")


def propagate_static(shocks: DataFrame, edges: DataFrame, value: str = "x", keys: Sequence[str] = ()) -> DataFrame:
    """Sum over edges of shock x strength x direction; parallel edges add up; NULL shocks count 0."""
    load = edges.groupBy(*keys, "src", "dst").agg(F.sum(F.col("strength") * F.col("direction")).alias("_f"))
    s = shocks.select("date", F.col("ticker").alias("src"), F.coalesce(F.col(value), F.lit(0.0)).alias("_x"))
    return _spread(s, load).groupBy(*keys, "date", F.col("dst").alias("ticker")).agg(
        F.sum(F.col("_x") * F.col("_f")).alias("raw"))


def propagate_static_keyed(shocks: DataFrame, edges: DataFrame, value: str = "x", keys: Sequence[str] = ()) -> DataFrame:
    """The same edges for shocks that carry the scenario keys."""
    load = edges.groupBy("src", "dst").agg(F.sum(F.col("strength") * F.col("direction")).alias("_f"))
    s = shocks.select(*keys, "date", F.col("ticker").alias("src"), F.coalesce(F.col(value), F.lit(0.0)).alias("_x"))
    return _spread(s, load).groupBy(*keys, "date", F.col("dst").alias("ticker")).agg(
        F.sum(F.col("_x") * F.col("_f")).alias("raw"))


def propagate_temporal_ensemble(shocks: DataFrame, graph: DataFrame, value: str = "acc", keys: Sequence[str] = (),
                                n_variants=None) -> DataFrame:
    """Mean over the graph's variants of the propagated shock; an exact 0 is no signal (NULL).

    Edges valid in the month of the date apply. Variants collapse to one load per (month, src, dst) before the
    join, which merges: edges look small in their files. A head of a large group can hold a third of all edges, so its
    edges are cut by target.
    """
    if n_variants is None:
        n_variants = graph.agg(F.count_distinct("variant").alias("n")).select("n").scalar()
    load = graph.groupBy(*keys, "valid_month", "src", "dst").agg(
        F.sum(F.col("strength") * F.col("direction")).alias("_f"))
    s = shocks.where(F.col(value).isNotNull()).select(
        "date", F.last_day("date").alias("valid_month"), F.col("ticker").alias("src"), F.col(value).alias("_x"))
    out = salted_join(s, load, ["valid_month", "src"], "dst", merge=True).groupBy(*keys, "date", F.col("dst").alias("ticker")).agg(
        F.sum(F.col("_x") * F.col("_f")).alias("_r"))
    return out.select(*keys, "date", "ticker", F.nullif(F.try_divide("_r", n_variants.cast("double")), F.lit(0.0)).alias("raw")
                      ).where(F.col("raw").isNotNull())


def winsorize_xsec(panel: DataFrame, value: str = "raw", out: str = "clipped", total: float = 0.02,
                   keys: Sequence[str] = ()) -> DataFrame:
    """Clip to the total/2 and 1 - total/2 quantiles of each date; 0 is no signal."""
    by = [*keys, "date"]
    d = panel.withColumn("_v", F.nullif(F.col(value), F.lit(0.0)))
    q = group_quantiles(d, by, "_v", [total / 2, 1 - total / 2], ["_lo", "_hi"])
    return (d.join(small_by_date(q, keys), by, "left")
            .withColumn(out, F.when(F.col("_v").isNotNull(), F.greatest("_lo", F.least("_hi", "_v"))))
            .drop("_v", "_lo", "_hi"))


def zscore_xsec(panel: DataFrame, value: str = "clipped", out: str = "z", keys: Sequence[str] = (),
                fill: float | None = 0.0) -> DataFrame:
    """(v - mean) / std of each date; an undefined score is ``fill``.

    A std of 0 counts as 1, and so does one of at most 1e-12 (of the mean, where that is above 1): names fed by the same
    heads differ by the rounding of their sums, and dividing by that would make signals of it.
    """
    by = [*keys, "date"]
    st = panel.groupBy(*by).agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    sd = F.when(F.col("_s") <= NO_VARIANCE * F.greatest(F.lit(1.0), F.abs("_m")), 1.0).otherwise(F.col("_s"))
    z = F.try_divide(F.col(value) - F.col("_m"), sd)
    return (panel.join(small_by_date(st, keys), by, "left")
            .withColumn(out, z if fill is None else F.coalesce(z, F.lit(fill))).drop("_m", "_s"))


def standardise(raw: DataFrame, total: float = 0.02, keys: Sequence[str] = ()) -> DataFrame:
    """Winsorized z-score of a raw signal. Reads ``raw`` several times, so give it a written table."""
    return zscore_xsec(winsorize_xsec(raw, total=total, keys=keys), keys=keys)


def smooth(panel: DataFrame, value: str = "z", n: int = 21, out: str = "z_smooth", keys: Sequence[str] = ()) -> DataFrame:
    return panel.withColumn(out, rolling(value, series_window(keys, "ticker"), n, 1))


def neutralize_beta_xsec(panel: DataFrame, z: str = "z", beta: str = "beta", out: str = "z_neutral",
                         group: str | None = None, min_names: int = 5, keys: Sequence[str] = ()) -> DataFrame:
    """Per date residual of z on beta over active names (z not 0, beta known); demean below ``min_names``.

    With ``group`` z is demeaned inside (date, group) first.
    """
    by = [*keys, "date"]
    d = panel
    zc = F.col(z)
    if group:
        g = panel.where(zc != 0).groupBy(*by, group).agg(F.avg(zc).alias("_gm"))
        d = panel.join(g, [*by, group], "left").withColumn("_z", F.when(zc != 0, zc - F.col("_gm")))
    else:
        d = panel.withColumn("_z", F.when(zc != 0, zc))
    ok = F.col("_z").isNotNull() & F.col(beta).isNotNull()
    x, y = F.when(ok, F.col(beta)), F.when(ok, F.col("_z"))
    st = d.groupBy(*by).agg(F.count(x).alias("_n"), F.avg(x).alias("_mx"), F.avg(y).alias("_my"),
                            F.covar_pop(x, y).alias("_cxy"), F.var_pop(x).alias("_vx"))
    j = d.join(small_by_date(st, keys), by, "left")
    slope = F.when((F.col("_vx") * F.col("_n") > 1e-12) & (F.col("_n") >= min_names), F.try_divide("_cxy", "_vx")).otherwise(0.0)
    res = F.when(ok, F.col("_z") - F.col("_my") - slope * (F.col(beta) - F.col("_mx")))
    drop = ["_z", "_n", "_mx", "_my", "_cxy", "_vx"] + (["_gm"] if group else [])
    return j.withColumn(out, F.coalesce(res, F.lit(0.0))).drop(*drop)


def mask_untradable_signal(signal: DataFrame, returns: DataFrame, z: str = "z", r: str = "r") -> DataFrame:
    """Zero where the name has no return that day."""
    live = returns.where(F.col(r).isNotNull()).select("date", "ticker", F.lit(True).alias("_l"))
    return signal.join(live, ["date", "ticker"], "left").withColumn(z, F.when(F.col("_l"), F.col(z)).otherwise(0.0)).drop("_l")


def active_names_per_day(signal: DataFrame, z: str = "z", keys: Sequence[str] = ()) -> DataFrame:
    return signal.groupBy(*keys, "date").agg(F.count_if(F.abs(z) > 1e-9).alias("n_active"))


def factor_scores(panel: DataFrame, short: int = 21, mom: tuple[int, int] = (231, 22), rev: int = 5, vol: int = 60,
                  r: str = "r") -> DataFrame:
    """Momentum, 12-1 momentum, reversal and low-volatility scores in long form, z-scored per (factor, date).

    Windows demand every row (the mean of a gap is unknown).
    """
    w = series_window((), "ticker")
    n, lag = mom
    cols = {
        "mom21": rolling(r, w, short, short),
        "mom12_1": rolling(r, w, n, n, F.sum, lag),
        "rev5": -rolling(r, w, rev, rev),
        "lowvol": -rolling(r, w, vol, vol, F.stddev_samp),
    }
    wide = panel.select("date", "idx", "ticker", r, *[c.alias(k) for k, c in cols.items()])
    long = wide.select("date", "idx", "ticker", r, F.explode(F.array(
        *[F.struct(F.lit(k).alias("factor"), F.col(k).alias("score")) for k in cols])).alias("_f")).select(
        "date", "idx", "ticker", r, "_f.factor", "_f.score")
    return zscore_xsec(long, "score", "z", keys=("factor",), fill=None)
