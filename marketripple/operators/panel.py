"""Panel kernel: operators on long (keys..., date, ticker, value) tables and per-date series.

A wide frame is dense on calendar x universe, and its windows count calendar rows. Every row-window operator
therefore runs on a densified panel that carries the calendar position ``idx``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketripple.functions.expr import median, rolling, series_window
from marketripple.functions.quantiles import group_quantiles


def small_by_date(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Per-date statistics: one row per calendar day, a proven bound (a century of days is under 5 MB).

    With scenario keys the bound depends on the scenario count, so the choice is left to the optimizer.
    """
    return df if keys else F.broadcast(df)


def trading_calendar(df: DataFrame) -> DataFrame:
    """Distinct dates with their position. The single-partition window sees one row per calendar day."""
    return df.select("date").distinct().select(
        "date", (F.row_number().over(Window.orderBy("date")) - 1).cast("int").alias("idx"))


def densify(panel: DataFrame, calendar: DataFrame, fill: Mapping[str, float | None],
            keys: Sequence[str] = ()) -> DataFrame:
    """Dense calendar x ticker grid; gaps get the declared fill (number or None).

    Each observed row emits the calendar positions up to the next observation of its ticker, so the grid needs
    one shuffle by ticker and no calendar x universe product; later windows by ticker reuse that partitioning.
    A second row of one ticker and date is an error: how to merge it (sum of volumes, last price) is the caller's rule.
    """
    values = list(fill)
    known = panel.join(small_by_date(calendar), "date").select(*keys, "ticker", "idx", *values)
    last = calendar.agg(F.max("idx").alias("m")).select("m").scalar()
    w = series_window(keys, "ticker")
    spans = known.select(
        "*", F.when(F.row_number().over(w) == 1, F.lit(0)).when(F.lag("idx").over(w) < F.col("idx"), F.col("idx")).otherwise(
            F.raise_error(F.concat(F.lit("two rows of one date for "), F.col("ticker"))).cast("int")).alias("_from"),
        F.coalesce(F.lead("idx").over(w) - 1, last).alias("_to"))
    grid = spans.select("*", F.explode(F.sequence("_from", "_to")).alias("_i"))
    here = F.col("_i") == F.col("idx")

    def filled(c: str) -> Column:
        gap = F.lit(fill[c]) if fill[c] is not None else F.lit(None)
        return F.when(here, F.coalesce(F.col(c), gap)).otherwise(gap).cast(panel.schema[c].dataType).alias(c)

    dense = grid.select(*keys, "ticker", F.col("_i").alias("idx"), *[filled(c) for c in values])
    return dense.join(small_by_date(calendar), "idx")


def align_right(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("date", "ticker")) -> DataFrame:
    """Rows of ``b`` with the values of ``a`` (NULL where absent)."""
    return b.select(*keys).join(a, list(keys), "left")


def align_inner(a: DataFrame, b: DataFrame, on: Sequence[str] = ("date",)) -> DataFrame:
    """Rows of ``a`` on the dates that ``b`` has too."""
    return a.join(b.select(*on).distinct(), list(on), "left_semi")


def shift(panel: DataFrame, value: str, k: int, out: str, keys: Sequence[str] = ()) -> DataFrame:
    """Lag (k > 0) or lead (k < 0) by calendar rows."""
    w = series_window(keys, "ticker")
    return panel.withColumn(out, F.lag(value, k).over(w) if k >= 0 else F.lead(value, -k).over(w))


def diff_abs(panel: DataFrame, value: str, out: str, keys: Sequence[str] = ()) -> DataFrame:
    w = series_window(keys, "ticker")
    return panel.withColumn(out, F.abs(F.col(value) - F.lag(value).over(w)))


def ffill(panel: DataFrame, value: str, out: str, keys: Sequence[str] = ()) -> DataFrame:
    w = series_window(keys, "ticker").rowsBetween(Window.unboundedPreceding, 0)
    return panel.withColumn(out, F.last(value, ignorenulls=True).over(w))


def roll(panel: DataFrame, value: str, n: int, min_obs: int, fn: str, out: str, keys: Sequence[str] = ()) -> DataFrame:
    """Rolling ``sum``/``avg``/``std``/``median`` over calendar rows."""
    fns = {"sum": F.sum, "avg": F.avg, "std": F.stddev_samp, "median": median}
    return panel.withColumn(out, rolling(value, series_window(keys, "ticker"), n, min_obs, fns[fn]))


def pct_change(panel: DataFrame, value: str, out: str, keys: Sequence[str] = ()) -> DataFrame:
    w = series_window(keys, "ticker")
    return panel.withColumn(out, F.try_divide(F.col(value), F.lag(value).over(w)) - 1.0)


def cumulate(series: DataFrame, value: str, out: str, keys: Sequence[str] = ()) -> DataFrame:
    """Equity curve of a return series, NULL counted as 0."""
    w = series_window(keys, order="date").rowsBetween(Window.unboundedPreceding, 0)
    return series.withColumn(out, F.product(1.0 + F.coalesce(F.col(value), F.lit(0.0))).over(w))


def rebase(series: DataFrame, value: str, out: str, keys: Sequence[str] = ()) -> DataFrame:
    w = series_window(keys, order="date").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return series.withColumn(out, F.try_divide(F.col(value), F.first(value, ignorenulls=True).over(w)))


def resample_month(panel: DataFrame, value: str, how: str, out: str, by: Sequence[str] = ("ticker",)) -> DataFrame:
    """Calendar month end; ``last`` is the last non-NULL value of the month."""
    v = F.col(value)
    fn = {
        "last": F.max_by(v, F.when(v.isNotNull(), F.col("date"))),
        "mean": F.avg(v),
        "sum": F.sum(v),
        "prod": F.product(1.0 + F.coalesce(v, F.lit(0.0))) - 1.0,
    }[how]
    return panel.groupBy(*by, F.last_day("date").alias("month_end")).agg(fn.alias(out))


def slice_period(df: DataFrame, periods: Sequence[tuple[str, str | None, str | None]], date: str = "date") -> DataFrame:
    """Attach ``period`` (a row belongs to every period whose inclusive bounds hold it). Narrow, no join."""
    tags = []
    for name, lo, hi in periods:
        cond = F.lit(True)
        if lo:
            cond = cond & (F.col(date) >= F.lit(lo).cast("date"))
        if hi:
            cond = cond & (F.col(date) <= F.lit(hi).cast("date"))
        tags.append(F.when(cond, F.lit(name)))
    return df.withColumn("period", F.explode(F.array_compact(F.array(*tags))))


def is_oos_full(cut: str, names: tuple[str, str, str] = ("IS", "OOS", "full")) -> list[tuple[str, str | None, str | None]]:
    """In-sample up to the cut date, out-of-sample after it, and the whole span."""
    from datetime import date, timedelta
    nxt = (date.fromisoformat(cut) + timedelta(days=1)).isoformat()
    return [(names[0], None, cut), (names[1], nxt, None), (names[2], None, None)]


def to_long(wide: DataFrame, value: str, ids: Sequence[str] = ("date",), name: str = "ticker") -> DataFrame:
    """Wide frame (one column per ticker or measure) to the long panel; NaN becomes NULL."""
    cols = [c for c in wide.columns if c not in ids]
    return wide.unpivot(list(ids), cols, name, value).withColumn(value, F.nanvl(F.col(value), F.lit(None)))


def to_wide(panel: DataFrame, value: str, names: Sequence[str], column: str = "ticker",
            ids: Sequence[str] = ("date",)) -> DataFrame:
    """Long panel to one column per name, for people; names are given so no pass over the data finds them."""
    return panel.groupBy(*ids).pivot(column, list(names)).agg(F.first(value))


def xsec_stat(panel: DataFrame, value: str, probs: Sequence[float] = (0.5,), names: Sequence[str] = ("median",),
              keys: Sequence[str] = ()) -> DataFrame:
    """Per-date count, mean, sample deviation and quantiles over the cross-section."""
    by = [*keys, "date"]
    base = panel.groupBy(*by).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
    return base.join(group_quantiles(panel, by, value, probs, names), by, "left")


def active_window(weights: DataFrame, keys: Sequence[str] = (), floor: float = 1e-9) -> DataFrame:
    """Dates with gross exposure, the single window of every report."""
    return (weights.groupBy(*keys, "date").agg(F.sum(F.abs("w")).alias("gross"))
            .where(F.col("gross") > floor))


