"""Portfolio construction. Weights are a table, limits are joins, scenario axes are key columns.

A ``book`` is a dense table (keys..., date, idx, ticker, w, r, adtv, beta, sector) over the signal's names.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketripple.functions.expr import clip, median, rolling, series_window
from marketripple.operators.panel import small_by_date
from marketripple.operators.returns import HEDGE_TICKER, session_coverage
from marketripple.session import materialise

ACTIVE = 1e-9


@dataclass(frozen=True)
class BookParams:
    aum: float | str = 1e8  # a number, or the name of a key column that carries it
    target_vol: float = 0.12
    max_name: float = 0.05
    max_sector: float = 0.25
    adtv_share: float = 0.10
    vol_window: int = 60
    max_leverage: float = 3.0
    min_leverage: float = 0.1
    iterations: int = 3
    smoothing: int = 63
    guard_window: int = 252
    guard_min: int = 20
    periods: int = 252
    smooth_in_loop: bool = False
    session_mask: bool = True

    @property
    def aum_col(self) -> Column:
        return F.col(self.aum) if isinstance(self.aum, str) else F.lit(float(self.aum))


def past_returns(book: DataFrame, window: int, keys: Sequence[str] = (), r: str = "r") -> DataFrame:
    """Attach ``past``: the returns of the previous ``window`` calendar rows (NULL as 0), a fixed-size array."""
    w = series_window(keys, "ticker").rowsBetween(-window, -1)
    return book.withColumn("past", F.collect_list(F.coalesce(F.col(r), F.lit(0.0))).over(w))


def _vol_from_past(df: DataFrame, weight: Column, window: int, periods: int, keys: Sequence[str]) -> DataFrame:
    """w'Cov w equals the sample variance over the past rows of the hypothetical book return sum_j w_j r_sj.

    The sums for each lag are plain aggregates that combine map-side, so no covariance matrix, no join on lags and
    no exploded rows: one partial row per task and date is shuffled.
    """
    live = df.where(F.col("idx") >= window)
    w = F.coalesce(weight, F.lit(0.0))
    g = live.groupBy(*keys, "date", "idx").agg(*[F.sum(w * F.col("past")[i]).alias(f"_p{i}") for i in range(window)])
    p = F.array(*[F.col(f"_p{i}") for i in range(window)])
    g = g.select(*keys, "date", "idx", p.alias("p"))
    mean = F.aggregate("p", F.lit(0.0), lambda a, x: a + x) / window
    g = g.withColumn("mu", mean)
    ss = F.aggregate(F.transform("p", lambda x: (x - F.col("mu")) * (x - F.col("mu"))), F.lit(0.0), lambda a, x: a + x)
    return g.select(*keys, "date", "idx", F.sqrt(ss / (window - 1) * periods).alias("vol"))


def portfolio_vol(book: DataFrame, window: int = 60, periods: int = 252, keys: Sequence[str] = (), w: str = "w",
                  r: str = "r") -> DataFrame:
    """Annualised ex-ante volatility per date over the previous ``window`` rows; none for the first rows."""
    return _vol_from_past(past_returns(book, window, keys, r), F.col(w), window, periods, keys)


def leverage_scalar(vol: DataFrame, p: BookParams, keys: Sequence[str] = ()) -> DataFrame:
    raw = F.coalesce(F.try_divide(F.lit(p.target_vol), F.col("vol")), F.lit(1.0))
    return vol.select(*keys, "date", F.greatest(F.lit(p.min_leverage), F.least(F.lit(p.max_leverage), raw)).alias("scalar"))


def vol_target(book: DataFrame, vol: DataFrame, p: BookParams = BookParams(), keys: Sequence[str] = ()) -> DataFrame:
    """Scale every date to the target volatility (unknown or zero volatility: scalar 1), within leverage bounds."""
    s = leverage_scalar(vol, p, keys)
    return (book.join(small_by_date(s, keys), [*keys, "date"], "left")
            .withColumn("w", F.col("w") * F.coalesce("scalar", F.lit(1.0))).drop("scalar"))


def liquidity_limit(book: DataFrame, p: BookParams = BookParams(), keys: Sequence[str] = ()) -> DataFrame:
    """Attach ``lim``: share of the last known ADTV over the fund size; never known means 0."""
    w = series_window(keys, "ticker").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last("adtv", ignorenulls=True).over(w)
    return book.withColumn("lim", F.coalesce(last * p.adtv_share / p.aum_col, F.lit(0.0)))


def cap_liquidity(book: DataFrame) -> DataFrame:
    return book.withColumn("w", clip(F.col("w"), -F.col("lim"), F.col("lim")))


def cap_name(book: DataFrame, p: BookParams = BookParams()) -> DataFrame:
    return book.withColumn("w", clip(F.col("w"), -p.max_name, p.max_name))


def sector_factor(df: DataFrame, weight: Column, p: BookParams, keys: Sequence[str]) -> DataFrame:
    """Pro-rata factor per (date, sector) that brings the sector's gross down to its limit."""
    g = df.groupBy(*keys, "date", "sector").agg(F.sum(F.abs(weight)).alias("_g"))
    f = F.when(F.col("_g") > p.max_sector, p.max_sector / F.col("_g")).otherwise(1.0)
    return g.select(*keys, "date", "sector", f.alias("factor"))


def cap_sector(book: DataFrame, p: BookParams = BookParams(), keys: Sequence[str] = ()) -> DataFrame:
    f = sector_factor(book, F.col("w"), p, keys)
    return book.join(f, [*keys, "date", "sector"], "left").withColumn("w", F.col("w") * F.col("factor")).drop("factor")


def apply_limits(book: DataFrame, p: BookParams = BookParams(), keys: Sequence[str] = ()) -> DataFrame:
    """Liquidity, then name, then sector."""
    return cap_sector(cap_name(cap_liquidity(book), p), p, keys)


def prepare_book(book: DataFrame, p: BookParams = BookParams(), keys: Sequence[str] = ()) -> DataFrame:
    """Book with sector default, liquidity limit and past returns, written once; the loop only reads it."""
    b = book.withColumn("sector", F.coalesce("sector", F.lit("Outros")))
    return materialise(past_returns(liquidity_limit(b, p, keys), p.vol_window, keys), "book")


def calibrate_loop(prepared: DataFrame, p: BookParams = BookParams(), keys: Sequence[str] = ()) -> DataFrame:
    """Alternate volatility targeting and limits, ending on limits.

    Every step of the loop is an elementwise rule plus one factor per date or per (date, sector). The state of the
    loop is therefore those small factor tables, not the panel: each step aggregates the prepared book with the
    factors so far and writes the next factors (lineage stays flat, and their file size tells the optimizer
    whether to broadcast them).
    """
    df = prepared
    for i in range(p.iterations):
        vol = _vol_from_past(df, F.col("w"), p.vol_window, p.periods, keys)
        s = materialise(leverage_scalar(vol, p, keys), "scalar")
        df = df.join(s, [*keys, "date"], "left").withColumn("w", F.col("w") * F.coalesce("scalar", F.lit(1.0))).drop("scalar")
        df = cap_name(cap_liquidity(df), p)
        f = materialise(sector_factor(df, F.col("w"), p, keys), "factor")
        df = df.join(f, [*keys, "date", "sector"], "left").withColumn("w", F.col("w") * F.col("factor")).drop("factor")
        if p.smooth_in_loop:  # the smoothed weights are a new panel, so this variant writes it
            df = materialise(smooth_weights(df, p.smoothing, keys).select(*prepared.columns), "book")
    return df.select(*prepared.columns)


def smooth_weights(book: DataFrame, n: int = 63, keys: Sequence[str] = ()) -> DataFrame:
    return book if n <= 1 else book.withColumn("w", rolling("w", series_window(keys, "ticker"), n, 1))


def mask_untradable(book: DataFrame, p: BookParams = BookParams(), keys: Sequence[str] = (),
                    days: DataFrame | None = None) -> DataFrame:
    """Zero where the name has no return that day, unless the whole day looks like a non-session.

    ``days``: the session flags, where a cheaper frame than ``book`` has the same returns.
    """
    if days is None:
        days = session_coverage(book, p.guard_window, p.guard_min, keys=keys)
    days = days.select(*keys, "date", "sessao")
    return (book.join(small_by_date(days, keys), [*keys, "date"], "left")
            .withColumn("w", F.when(F.col("r").isNull() & F.col("sessao"), 0.0).otherwise(F.col("w"))).drop("sessao"))


def beta_hedge(book: DataFrame, keys: Sequence[str] = (), ticker: str = HEDGE_TICKER) -> DataFrame:
    """(keys, date, idx, ticker, w) with positions of unknown beta closed and the index position -sum(w beta)."""
    open_ = book.withColumn("w", F.when(F.col("beta").isNull() & (F.abs("w") > 0), 0.0).otherwise(F.col("w")))
    cols = [*keys, "date", "idx", "ticker", "w"]
    hedge = open_.groupBy(*keys, "date", "idx").agg(
        (-F.coalesce(F.sum(F.col("w") * F.col("beta")), F.lit(0.0))).alias("w")).withColumn("ticker", F.lit(ticker))
    return open_.select(*cols).unionByName(hedge.select(*cols))


def execution_lag(weights: DataFrame, n: int = 1, keys: Sequence[str] = ()) -> DataFrame:
    return weights.withColumn("w", F.lag("w", n).over(series_window(keys, "ticker")))


def build_portfolio(book: DataFrame, p: BookParams = BookParams(), keys: Sequence[str] = (),
                    smoothings: Sequence[int] | None = None, keep: Sequence[dict] | None = None) -> DataFrame:
    """Signal book to executed weights (keys, date, idx, ticker, w).

    ``smoothings`` adds the key ``smooth``: all windows share the loop and one pass over the tickers; ``keep`` lists
    the wanted key combinations when not all are.
    """
    prepared = prepare_book(book, p, keys)
    looped = calibrate_loop(prepared, p, keys)
    slim = looped.drop("past")
    if smoothings is not None:
        w = series_window(keys, "ticker")
        opts = F.array(*[F.struct(F.lit(n).alias("smooth"), F.col(f"_w{n}").alias("w")) for n in smoothings])
        d = slim.select("*", *[(rolling("w", w, n, 1) if n > 1 else F.col("w")).alias(f"_w{n}") for n in smoothings])
        d = d.withColumn("_o", F.explode(opts)).drop("w").select(*[c for c in slim.columns if c != "w"], "_o.smooth", "_o.w")
        if keep is not None:
            d = d.where(reduce(or_, [reduce(and_, [F.col(k) == v for k, v in c.items()]) for c in keep]))
        keys = (*keys, "smooth")
    else:
        d = slim if p.smooth_in_loop else smooth_weights(slim, p.smoothing, keys)
    d = materialise(cap_name(cap_liquidity(d), p), "smoothed")
    days = session_coverage(d, p.guard_window, p.guard_min, keys=keys)
    d = cap_sector(d, p, keys)
    if p.session_mask:
        d = mask_untradable(d, p, keys, days)
    return execution_lag(beta_hedge(d, keys), keys=keys)


# ---- diagnostics ------------------------------------------------------------------------------------------


def verify_limits(weights: DataFrame, book: DataFrame, p: BookParams = BookParams(), keys: Sequence[str] = (),
                  tol: float = 1e-6) -> DataFrame:
    """Worst name, sector and liquidity use of executed weights and the number of violations.

    The liquidity limit is the one of the decision day (one row back); unknown means no limit.
    """
    w = series_window(keys, "ticker")
    lim = book.select(*keys, "date", "ticker", "sector",
                      F.lag(F.col("adtv") * p.adtv_share / p.aum_col).over(w).alias("lim"))
    j = (weights.where(F.col("ticker") != HEDGE_TICKER).withColumn("aw", F.abs(F.coalesce("w", F.lit(0.0))))
         .join(lim, [*keys, "date", "ticker"], "left"))
    by_name = j.groupBy(*keys, "date", "sector").agg(
        F.max("aw").alias("mx"), F.sum("aw").alias("sg"), F.max(F.col("aw") - F.col("lim")).alias("lx"),
        F.count_if(F.col("aw") - p.max_name > tol).alias("nv"), F.count_if(F.col("aw") - F.col("lim") > tol).alias("lv"))
    return by_name.groupBy(*keys).agg(
        F.max("mx").alias("max_name"), F.max("sg").alias("max_sector"), F.max("lx").alias("max_over_liquidity"),
        F.sum("nv").alias("n_name"), F.count_if(F.col("sg") - p.max_sector > tol).alias("n_sector"),
        F.sum("lv").alias("n_liquidity"))


def phantom_exposure(weights: DataFrame, returns: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean share of gross in names without a return today, and also without one on the decision day."""
    gone = returns.select("date", "ticker", F.col("r").isNull().alias("now"),
                          F.lag(F.col("r").isNull(), 1, True).over(series_window((), "ticker")).alias("before"))
    a = F.abs(F.coalesce("w", F.lit(0.0)))
    j = weights.where(F.col("ticker") != HEDGE_TICKER).withColumn("aw", a).join(gone, ["date", "ticker"], "left")
    day = j.groupBy(*keys, "date").agg(
        F.sum("aw").alias("g"), F.sum(F.when(F.col("now"), F.col("aw")).otherwise(0.0)).alias("t"),
        F.sum(F.when(F.col("now") & F.col("before"), F.col("aw")).otherwise(0.0)).alias("c"))
    return day.groupBy(*keys).agg(F.avg(F.try_divide("t", "g")).alias("share_total"),
                                  F.avg(F.try_divide("c", "g")).alias("share_by_construction"))


def stage_tables(prepared: DataFrame, p: BookParams, keys: Sequence[str] = ()) -> DataFrame:
    """The book after every stage of construction, tagged with ``stage``; each pass is written once."""
    stages, d = [prepared.withColumn("stage", F.lit("0_signal"))], prepared
    for i in range(p.iterations):
        vol = _vol_from_past(d, F.col("w"), p.vol_window, p.periods, keys)
        d = materialise(vol_target(d, vol, p, keys).select(*prepared.columns), "stage")
        stages.append(d.withColumn("stage", F.lit(f"{i + 1}a_vol")))
        d = materialise(apply_limits(d, p, keys).select(*prepared.columns), "stage")
        stages.append(d.withColumn("stage", F.lit(f"{i + 1}b_limits")))
    d = materialise(smooth_weights(d, p.smoothing, keys).select(*prepared.columns), "stage")
    stages.append(d.withColumn("stage", F.lit("4_smooth")))
    hedged = d.withColumn("w", F.when(F.col("beta").isNull() & (F.abs("w") > 0), 0.0).otherwise(F.col("w")))
    stages.append(hedged.withColumn("stage", F.lit("5_hedge")))
    out = stages[0]
    for s in stages[1:]:
        out = out.unionByName(s)
    return out


def stage_diagnostics(prepared: DataFrame, p: BookParams = BookParams(), keys: Sequence[str] = ()) -> DataFrame:
    """Mean estimated volatility, gross and open positions after every stage."""
    k = (*keys, "stage")
    st = stage_tables(prepared, p, keys)
    vol = _vol_from_past(st, F.col("w"), p.vol_window, p.periods, k).groupBy(*k).agg(F.avg("vol").alias("vol"))
    day = st.groupBy(*k, "date").agg(F.sum(F.abs("w")).alias("g"), F.count_if(F.abs("w") > ACTIVE).alias("n"))
    return day.groupBy(*k).agg(F.avg("g").alias("gross"), F.avg("n").alias("positions")).join(vol, list(k))


def limit_bite(prepared: DataFrame, p: BookParams = BookParams(), keys: Sequence[str] = ()) -> DataFrame:
    """Each limit alone on the same volatility-targeted book: mean gross and cut, and all together."""
    vol = _vol_from_past(prepared, F.col("w"), p.vol_window, p.periods, keys)
    d = materialise(vol_target(prepared, vol, p, keys).drop("past"), "bite")
    variants = {"none": d, "liquidity": cap_liquidity(d), "name": cap_name(d, p),
                "name_sector": cap_sector(cap_name(d, p), p, keys), "all": apply_limits(d, p, keys)}
    out = None
    for name, v in variants.items():
        t = v.groupBy(*keys, "date").agg(F.sum(F.abs("w")).alias("g")).withColumn("cap", F.lit(name))
        out = t if out is None else out.unionByName(t)
    g = out.groupBy(*keys, "cap").agg(F.avg("g").alias("gross"))
    base = g.where(F.col("cap") == "none").select(*keys, F.col("gross").alias("b"))
    g = g.join(base, list(keys)) if keys else g.withColumn("b", base.select("b").scalar())
    return g.select(*keys, "cap", "gross", (F.try_divide("gross", "b") - 1.0).alias("cut"))


def leverage_ceiling_share(vol: DataFrame, p: BookParams = BookParams(), keys: Sequence[str] = ()) -> DataFrame:
    """Median leverage asked for by the target and the share of days at the ceiling."""
    s = vol.select(*keys, F.try_divide(F.lit(p.target_vol), F.col("vol")).alias("s")).where(F.col("s").isNotNull())
    return s.groupBy(*keys).agg(median("s").alias("median_scalar"),
                                F.avg((F.col("s") >= p.max_leverage).cast("double")).alias("share_at_ceiling"))


def exposures(weights: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Monthly mean long, short, net, gross, hedge and total net exposure."""
    w = F.coalesce("w", F.lit(0.0))
    hedge = F.col("ticker") == HEDGE_TICKER
    day = weights.groupBy(*keys, "date").agg(
        F.sum(F.when(~hedge, F.greatest(w, F.lit(0.0))).otherwise(0.0)).alias("l"),
        F.sum(F.when(~hedge, F.least(w, F.lit(0.0))).otherwise(0.0)).alias("s"),
        F.sum(F.when(hedge, w).otherwise(0.0)).alias("h"))
    m = day.groupBy(*keys, F.last_day("date").alias("month_end")).agg(
        F.avg("l").alias("long"), F.avg("s").alias("short"), F.avg("h").alias("hedge"))
    return m.select("*", (F.col("long") + F.col("short")).alias("net"), (F.col("long") - F.col("short")).alias("gross"),
                    (F.col("long") + F.col("short") + F.col("hedge")).alias("total_net"))


def exposure_bands(monthly: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """5 % and 95 % bands of net and total net; groups hold one row per month."""
    q = lambda c, p: F.percentile(F.col(c), F.lit(p))
    return monthly.groupBy(*keys).agg(
        q("net", 0.05).alias("net_p05"), q("net", 0.95).alias("net_p95"), q("total_net", 0.05).alias("total_p05"),
        q("total_net", 0.95).alias("total_p95"), F.avg("total_net").alias("total_mean"), F.avg("gross").alias("gross_mean"))


def positions_count(weights: DataFrame, keys: Sequence[str] = (), floor: float = ACTIVE) -> DataFrame:
    return weights.where(F.col("ticker") != HEDGE_TICKER).groupBy(*keys, "date").agg(
        F.count_if(F.abs("w") > floor).alias("n_positions"))


# ---- planned controls -------------------------------------------------------------------------------------


def net_cap(book: DataFrame, limit: float = 0.10, keys: Sequence[str] = (), group: str | None = None) -> DataFrame:
    """Bring |net| per date (or per date and group) within the limit by scaling the heavier side pro rata."""
    by = [*keys, "date", *([group] if group else [])]
    st = book.groupBy(*by).agg(F.sum(F.greatest("w", F.lit(0.0))).alias("_l"), F.sum(F.least("w", F.lit(0.0))).alias("_s"))
    net = F.col("_l") + F.col("_s")
    cut_l = F.when(net > limit, F.try_divide(limit - F.col("_s"), F.col("_l"))).otherwise(1.0)
    cut_s = F.when(net < -limit, F.try_divide(-limit - F.col("_l"), F.col("_s"))).otherwise(1.0)
    st = st.select(*by, cut_l.alias("_cl"), cut_s.alias("_cs"))
    return book.join(st, by, "left").withColumn(
        "w", F.col("w") * F.when(F.col("w") > 0, F.col("_cl")).otherwise(F.col("_cs"))).drop("_cl", "_cs")


def order_participation_cap(book: DataFrame, share: float, p: BookParams = BookParams(), keys: Sequence[str] = ()) -> DataFrame:
    """Flag the order size of each row as a share of ADTV and the capped order."""
    dw = F.col("w") - F.coalesce(F.lag("w").over(series_window(keys, "ticker")), F.lit(0.0))
    d = book.withColumn("order", dw)
    room = F.coalesce(F.col("adtv"), F.lit(0.0)) * share / p.aum_col
    return d.withColumn("order_capped", clip(F.col("order"), -room, room)).withColumn(
        "over", F.abs("order") > room + 1e-12)


def validate_final(weights: DataFrame, book: DataFrame, p: BookParams = BookParams(), net_limit: float = 0.10, sector_net_limit: float = 0.05,
                   order_share: float = 0.02, keys: Sequence[str] = (), tol: float = 1e-6) -> DataFrame:
    """One report on final weights: (limit, worst, n_violations) for name, liquidity, sector, sector_net, net and order.

    ``worst`` is the largest exposure, and the largest excess over their own limits for liquidity and order. Both read the
    liquidity of the decision day (one row back); a row without one has no such limit. NULL weights are 0, the hedge is left out.
    """
    prev = F.lag("adtv").over(series_window(keys, "ticker"))
    info = book.select(*keys, "date", "ticker", "sector", (prev * p.adtv_share / p.aum_col).alias("lim"), (prev * order_share / p.aum_col).alias("room"))
    d = weights.where(F.col("ticker") != HEDGE_TICKER).withColumn("w", F.coalesce("w", F.lit(0.0)))
    d = d.withColumn("dw", F.abs(F.col("w") - F.coalesce(F.lag("w").over(series_window(keys, "ticker")), F.lit(0.0)))).join(info, [*keys, "date", "ticker"], "left")
    aw = F.abs("w")
    by_sector = d.groupBy(*keys, "date", "sector").agg(
        F.sum(aw).alias("gross"), F.sum("w").alias("net"), F.max(aw).alias("name"), F.max(aw - F.col("lim")).alias("liq"), F.max(F.col("dw") - F.col("room")).alias("ord"),
        F.count_if(aw - p.max_name > tol).alias("n_name"), F.count_if(aw - F.col("lim") > tol).alias("n_liq"), F.count_if(F.col("dw") - F.col("room") > tol).alias("n_ord"))
    by_date = by_sector.groupBy(*keys, "date").agg(
        F.max("name").alias("name"), F.max("liq").alias("liq"), F.max("ord").alias("ord"), F.sum("n_name").alias("n_name"), F.sum("n_liq").alias("n_liq"),
        F.sum("n_ord").alias("n_ord"), F.max("gross").alias("sector"), F.count_if(F.col("gross") - p.max_sector > tol).alias("n_sector"),
        F.max(F.abs("net")).alias("sector_net"), F.count_if(F.abs("net") - sector_net_limit > tol).alias("n_sector_net"), F.abs(F.sum("net")).alias("net"))
    rows = [("name", "name", F.sum("n_name")), ("liquidity", "liq", F.sum("n_liq")), ("order", "ord", F.sum("n_ord")), ("sector", "sector", F.sum("n_sector")),
            ("sector_net", "sector_net", F.sum("n_sector_net")), ("net", "net", F.count_if(F.col("net") - net_limit > tol))]
    one = by_date.groupBy(*keys).agg(*[F.struct(F.lit(n).alias("limit"), F.max(c).alias("worst"), k.alias("n_violations")).alias(n) for n, c, k in rows])
    return one.select(*keys, F.explode(F.array(*[n for n, _, _ in rows])).alias("x")).select(*keys, "x.*")


def no_trade_band(weights: DataFrame, band: float, keys: Sequence[str] = ()) -> DataFrame:
    """Keep the held weight while |target - held| < band (path-dependent).

    Rows are sorted by ticker and position; a task folds them one after another and carries one held weight, so the work is
    linear in the dates and a ticker's history is never in one row. NULL targets count as 0; the first held weight is 0.
    """
    by = [*keys, "ticker"]
    rows = weights.select(F.xxhash64(*by).alias("_group"), *by, "idx", "date", F.col("w").alias("target"))
    out = rows.drop("_group").withColumn("held", F.lit(0.0))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, 0.0
        for batch in batches:
            path = []
            for key, target in zip(zip(*[batch.column(c).to_pylist() for c in range(1, len(by) + 1)]), batch.column(len(by) + 3).to_pylist()):
                if key != now:
                    now, held = key, 0.0
                target = target or 0.0
                if abs(target - held) >= band:
                    held = target
                path.append(held)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(path, pa.float64())], names=[*batch.schema.names[1:], "held"])

    held = rows.repartition("_group").sortWithinPartitions("_group", *by, "idx").mapInArrow(fold, out.schema)
    return held.select(*keys, "date", "idx", "ticker", "target", "held")
