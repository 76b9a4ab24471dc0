"""Column expressions shared by the operators. All run inside JVM code generation."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from marketripple.session import materialise


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def series_window(keys: Sequence[str], *by: str, order: str = "idx") -> WindowSpec:
    """Window along the calendar of one series (``keys`` + ``by``)."""
    return Window.partitionBy(*keys, *by).orderBy(order)


def rows_back(w: WindowSpec, n: int, lag: int = 0) -> WindowSpec:
    """Frame of ``n`` calendar rows that ends ``lag`` rows before the current one."""
    return w.rowsBetween(-(n - 1 + lag), -lag)


def rolling(value: str | Column, w: WindowSpec, n: int, min_obs: int, fn=F.avg, lag: int = 0) -> Column:
    """``fn`` over ``n`` rows, NULL unless at least ``min_obs`` of them hold a value."""
    frame = rows_back(w, n, lag)
    v = col(value)
    return F.when(F.count(v).over(frame) >= min_obs, fn(v).over(frame))


def median(value: str | Column) -> Column:
    return F.percentile(col(value), F.lit(0.5))


def clip(v: Column, lo: Column | float, hi: Column | float) -> Column:
    """Bound ``v``; a NULL value stays NULL (greatest and least would skip it)."""
    lo = lo if isinstance(lo, Column) else F.lit(float(lo))
    hi = hi if isinstance(hi, Column) else F.lit(float(hi))
    return F.when(v.isNotNull(), F.greatest(lo, F.least(hi, v)))


def both(x: str | Column, y: str | Column) -> tuple[Column, Column]:
    """Mask a pair so that aggregates see only rows where both sides exist."""
    x, y = col(x), col(y)
    return F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)


# Names fed by the same heads carry equal signals up to rounding; a deviation this small is no variance.
NO_VARIANCE = 1e-12


def corr_agg(x: str | Column, y: str | Column) -> Column:
    """Pearson correlation aggregate that gives NULL (not an error) without variance."""
    xm, ym = both(x, y)
    sx, sy = F.stddev_pop(xm), F.stddev_pop(ym)
    return F.when((sx > NO_VARIANCE) & (sy > NO_VARIANCE), F.try_divide(F.covar_pop(xm, ym), sx * sy))


def slope_agg(x: str | Column, y: str | Column) -> Column:
    """OLS slope of y on x (with intercept), NULL without variance of x."""
    xm, ym = both(x, y)
    return F.when(F.stddev_pop(xm) > NO_VARIANCE, F.try_divide(F.covar_pop(xm, ym), F.var_pop(xm)))


def pair_count(x: str | Column, y: str | Column) -> Column:
    return F.count(both(x, y)[0])


def mean_t(x: str | Column, overlap: int | Column = 1) -> Column:
    """t of a mean with the sample size divided by the overlap horizon."""
    x = col(x)
    h = overlap if isinstance(overlap, Column) else F.lit(float(overlap))
    return F.try_divide(F.avg(x), F.try_divide(F.stddev_samp(x), F.sqrt(F.count(x) / h)))


def sharpe_agg(x: str | Column, periods: float, min_obs: int = 0) -> Column:
    x = col(x)
    s = F.try_divide(F.avg(x), F.stddev_samp(x)) * math.sqrt(periods)
    return F.when(F.count(x) > min_obs, s) if min_obs else s


def skew_agg(x: str | Column) -> Column:
    """Bias-corrected skewness (adjusted Fisher-Pearson)."""
    x = col(x)
    n = F.count(x).cast("double")
    return F.when(n > 2, F.try_divide(F.skewness(x) * F.sqrt(n * (n - 1)), n - 2))


def kurt_agg(x: str | Column) -> Column:
    """Bias-corrected excess kurtosis."""
    x = col(x)
    n = F.count(x).cast("double")
    g2 = F.kurtosis(x)
    return F.when(n > 3, F.try_divide((n - 1) * ((n + 1) * g2 + 6), (n - 2) * (n - 3)))


def compound_agg(r: str | Column) -> Column:
    return F.product(1.0 + F.coalesce(col(r), F.lit(0.0))) - 1.0


def normal_cdf(x: str | Column) -> Column:
    """Standard normal distribution function (Abramowitz-Stegun 26.2.17, |error| < 7.5e-8)."""
    x = col(x)
    t = F.lit(1.0) / (1.0 + 0.2316419 * F.abs(x))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-x * x / 2.0) / math.sqrt(2 * math.pi) * poly
    return F.when(x >= 0, 1.0 - tail).otherwise(tail)


ROWS_PER_SALT = 20_000
#: Hot keys up to which their list is broadcast; a longer one is joined like any table.
LISTED_KEYS = 100_000


def hot_keys(df: DataFrame, on: Sequence[str], rows: int = ROWS_PER_SALT) -> DataFrame:
    """(on, _salts): the keys with more than ``rows`` rows, at most one for each ``rows`` of the table, and the parts they are
    cut into. Counts are added up before they move."""
    return df.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > rows).select(*on, F.ceil(F.col("_n") / rows).cast("int").alias("_salts"))


def salted_join(small: DataFrame, large: DataFrame, on: Sequence[str], by: str, rows: int = ROWS_PER_SALT, merge: bool = False) -> DataFrame:
    """Inner join in which a key with more than ``rows`` rows in ``large`` is cut into parts by a hash of ``by``, and only the
    rows of ``small`` with such a key repeat per part.

    The list of hot keys is written and counted first: without any, this is a plain join; a short one is broadcast to both
    sides, so that no row moves by its bare key. With ``merge`` neither table is broadcast, for tables whose files pack so
    well that they look small.
    """
    on = list(on)
    joined = lambda s, b, keys: (s.hint("merge") if merge else s).join(b, keys)
    hot = materialise(hot_keys(large, on, rows), "hot_keys")
    n = hot.limit(LISTED_KEYS + 1).count()
    if not n:
        return joined(small, large, on)
    marks = F.broadcast(hot) if n <= LISTED_KEYS else hot
    parts = F.coalesce("_salts", F.lit(1))
    s = small.join(marks, on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_salts")
    big = large.join(marks, on, "left").withColumn("_salt", F.pmod(F.hash(by), parts)).drop("_salts")
    return joined(s, big, [*on, "_salt"]).drop("_salt")


def months_between_rule(d: str | Column, shift: int = 0) -> Column:
    """Month end of ``d`` moved by ``shift`` calendar months."""
    d = col(d)
    return F.last_day(F.add_months(F.trunc(d, "MM"), shift))


#: Fixed value: the class of names that have none yet.
UNKNOWN_CLASS = "A DEFINIR"


def known_class(c: str | Column) -> Column:
    """Whether a class is given; the marker of unknown ones is no class."""
    return F.coalesce(col(c) != UNKNOWN_CLASS, F.lit(False))
