"""Clean shocks: rolling regression residuals and their accumulation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketripple.functions.expr import known_class, series_window
from marketripple.functions.quantiles import group_quantiles


def _prefix(df: DataFrame, terms: dict[str, Column], w, n: int, lag: int = 0) -> DataFrame:
    """Moving sums over ``n`` rows as differences of running sums: constant work per row for any window.

    The running sums share one window stage and the lags another; both keep the ticker partitioning.
    """
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    df = df.select("*", *[F.sum(F.coalesce(c, F.lit(0.0))).over(run).alias(f"_c_{k}") for k, c in terms.items()])

    def at(k: str, back: int) -> Column:
        return F.coalesce(F.lag(f"_c_{k}", back).over(w), F.lit(0.0)) if back else F.col(f"_c_{k}")

    df = df.select("*", *[(at(k, lag) - at(k, lag + n)).alias(f"_{k}") for k in terms])
    return df.drop(*[f"_c_{k}" for k in terms])


def market_shock(panel: DataFrame, window: int = 252, min_obs: int = 200, r: str = "r", m: str = "m",
                 keys: Sequence[str] = ()) -> DataFrame:
    """Residual ``eps`` and slope ``beta`` of r = a + b m over the last ``window`` calendar rows.

    Needs a dense panel with the market return ``m`` on every row.
    """
    w = series_window(keys, "ticker")
    ok = F.col(r).isNotNull() & F.col(m).isNotNull()
    x, y = F.when(ok, F.col(m)), F.when(ok, F.col(r))
    terms = {"n": ok.cast("double"), "x": x, "y": y, "xx": x * x, "xy": x * y}
    d = _prefix(panel, terms, w, window)
    den = F.col("_n") * F.col("_xx") - F.col("_x") * F.col("_x")
    b = F.when(F.abs(den) > 1e-14, (F.col("_n") * F.col("_xy") - F.col("_x") * F.col("_y")) / F.nullif(den, F.lit(0.0)))
    d = d.withColumn("_b", b)
    a = F.try_divide(F.col("_y") - F.col("_b") * F.col("_x"), F.col("_n"))
    enough = F.col("_n") >= min_obs
    return d.select(
        *panel.columns,
        F.when(enough & ok, F.col(r) - (a + F.col("_b") * F.col(m))).alias("eps"),
        F.when(enough, F.col("_b")).alias("beta"))


def group_mean_of_others(panel: DataFrame, group: str, out: str = "g", r: str = "r",
                         keys: Sequence[str] = ()) -> DataFrame:
    """Mean return of the other names of the group on that date; NULL when there is none."""
    by = [*keys, "date", group]
    tot = panel.groupBy(*by).agg(F.sum(r).alias("_s"), F.count(r).alias("_n"))
    own, has = F.coalesce(F.col(r), F.lit(0.0)), F.col(r).isNotNull().cast("int")
    return (panel.join(tot, by, "left")
            .withColumn(out, F.try_divide(F.col("_s") - own, (F.col("_n") - has).cast("double"))).drop("_s", "_n"))


def peer_group_choice(members: DataFrame, min_pairs: int | None = 5, priced: DataFrame | None = None) -> DataFrame:
    """Narrow class when it is known and has enough peers, else the sector. One row per ticker.

    With ``priced`` (ticker) only names that occur there count as peers.
    """
    if min_pairs is None:
        return members.withColumn("peer_group", F.col("sector"))
    peers = members if priced is None else members.join(priced.select("ticker").distinct(), "ticker", "left_semi")
    size = peers.where(known_class("subsector")).groupBy("subsector").agg(F.count("ticker").alias("_n"))
    return (members.join(size, "subsector", "left")
            .withColumn("peer_group", F.when(F.col("_n") - 1 >= min_pairs, F.concat(F.lit("sub:"), "subsector"))
                        .otherwise(F.concat(F.lit("sec:"), "sector"))).drop("_n"))


def two_factor_shock(panel: DataFrame, window: int = 252, slack: int = 10, r: str = "r", m: str = "m", g: str = "g",
                     keys: Sequence[str] = ()) -> DataFrame:
    """Residual of r on (1, m, g) over the last ``window`` observed rows of each ticker.

    Only non-NULL rows of r count; NULL factors are 0; a ticker with fewer than window + slack rows is skipped.
    The 3x3 normal equations are solved with Cramer's rule inside generated code.
    """
    w = series_window(keys, "ticker")
    d = panel.where(F.col(r).isNotNull())
    d = d.withColumn("_rows", F.count(F.lit(1)).over(Window.partitionBy(*keys, "ticker")))
    d = d.where(F.col("_rows") >= window + slack).drop("_rows")
    d = d.withColumn("_m0", F.coalesce(F.col(m), F.lit(0.0))).withColumn("_g0", F.coalesce(F.col(g), F.lit(0.0)))
    x, z, y = F.col("_m0"), F.col("_g0"), F.col(r)
    terms = {"one": F.lit(1.0), "x": x, "z": z, "y": y, "xx": x * x, "zz": z * z, "xz": x * z, "xy": x * y, "zy": z * y}
    d = _prefix(d, terms, w, window)
    n, sx, sz, sy, sxx, szz, sxz, sxy, szy = (F.col(f"_{k}") for k in terms)
    # centred cross products reduce the system to two unknowns
    cxx, czz, cxz = sxx - sx * sx / n, szz - sz * sz / n, sxz - sx * sz / n
    cxy, czy = sxy - sx * sy / n, szy - sz * sy / n
    det = cxx * czz - cxz * cxz
    live = (n >= window) & (det > 1e-14 * cxx * czz) & (det > 0)
    d = d.withColumn("_b1", F.when(live, F.try_divide(cxy * czz - czy * cxz, det)))
    d = d.withColumn("_b2", F.when(live, F.try_divide(czy * cxx - cxy * cxz, det)))
    d = d.withColumn("_a", (sy - F.col("_b1") * sx - F.col("_b2") * sz) / n)
    return d.select(*panel.columns, (y - F.col("_a") - F.col("_b1") * x - F.col("_b2") * z).alias("eps2"),
                    F.col("_b1").alias("beta_m"), F.col("_b2").alias("beta_g"))


def accumulate_shock(panel: DataFrame, window: int = 231, lag: int = 22, min_obs: int = 120, value: str = "eps",
                     out: str = "acc", keys: Sequence[str] = ()) -> DataFrame:
    """Sum over the ``window`` rows that end ``lag`` rows ago, NULL below ``min_obs`` observations."""
    w = series_window(keys, "ticker")
    v = F.col(value)
    d = _prefix(panel, {"s": v, "k": v.isNotNull().cast("double")}, w, window, lag)
    return d.select(*panel.columns, F.when(F.col("_k") >= min_obs, F.col("_s")).alias(out))


def restrict_targets(shocks: DataFrame, tickers: DataFrame) -> DataFrame:
    """Keep only wanted names; peers have already used everyone."""
    return shocks.join(tickers.select("ticker").distinct(), "ticker", "left_semi")


def beta_summary(shocks: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Median beta and number of covered cells."""
    d = shocks.select(*keys, "beta", F.lit(1).alias("_all"))
    by = [*keys, "_all"]
    n = d.groupBy(*by).agg(F.count("beta").alias("n_beta"))
    return n.join(group_quantiles(d, by, "beta", [0.5], ["beta_mediana"]), by, "left").drop("_all")
