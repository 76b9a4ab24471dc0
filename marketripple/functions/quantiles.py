"""Exact interpolated quantiles of groups that may be too large for one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F



def group_quantiles(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    probs: Sequence[float],
    names: Sequence[str],
    accuracy: int = 10_000,
) -> DataFrame:
    """One row per group with the linearly interpolated quantiles of ``value``.

    The built-in exact ``percentile`` holds every distinct value of a group in one task. Here a mergeable
    sketch first brackets each wanted rank (its rank error is at most n/accuracy), and only values inside the
    brackets are counted exactly; copies of one value collapse in the map-side combine. The result is exact
    and no task holds more than about 6n/accuracy values of a group
    (all of them where the group has at most ``accuracy`` rows).
    """
    d = df.where(F.col(value).isNotNull())
    by = list(by)
    eps = 3.0 / accuracy
    edges = [e for p in probs for e in (max(p - eps, 0.0), min(p + eps, 1.0))]
    lits = F.array(*[F.lit(e) for e in edges])
    sketch = d.groupBy(*by).agg(
        F.count(value).alias("_n"),
        F.percentile_approx(F.col(value), lits, F.lit(accuracy)).alias("_e"),
        F.min(value).alias("_min"),
        F.max(value).alias("_max"),
    )
    # A group of at most `accuracy` rows is its own bracket; beyond that one rank is less than 1/accuracy,
    # so sketch error (1/accuracy) plus the neighbour rank of position p(n-1) fit into 3/accuracy.
    small = F.col("_n") <= accuracy
    brackets = F.array(*[
        F.struct(
            F.lit(i).alias("i"),
            F.lit(float(p)).alias("p"),
            (F.col("_min") if edges[2 * i] == 0.0 else F.when(small, F.col("_min")).otherwise(F.col("_e")[2 * i])).alias("lo"),
            (F.col("_max") if edges[2 * i + 1] == 1.0 else F.when(small, F.col("_max")).otherwise(F.col("_e")[2 * i + 1])).alias("hi"),
        )
        for i, p in enumerate(probs)
    ])
    br = sketch.select(*by, "_n", F.explode(brackets).alias("_b")).select(*by, "_n", "_b.*")
    if by == ["date"]:  # one row per calendar day and wanted quantile
        br = F.broadcast(br)
    # rows below a bracket only add to its offset, rows above it are dropped
    hit = d.select(*by, value).join(br, by).where(F.col(value) <= F.col("hi"))
    inside = F.when(F.col(value) >= F.col("lo"), F.col(value))
    counted = hit.groupBy(*by, "i", "p", "_n", inside.alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*by, "i").orderBy(F.col("_v").asc_nulls_first())
    ranked = counted.select(
        *by, "i", "_v", (F.col("p") * (F.col("_n") - 1)).alias("_pos"),
        F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("_cum"),
    )
    at = F.floor("_pos")
    picked = ranked.where(F.col("_v").isNotNull()).groupBy(*by, "i").agg(
        F.min(F.when(F.col("_cum") > at, F.col("_v"))).alias("_a"),
        F.min(F.when(F.col("_cum") > F.ceil("_pos"), F.col("_v"))).alias("_z"),
        F.first(F.col("_pos") - at).alias("_f"),
    )
    q = F.col("_a") + (F.coalesce(F.col("_z"), F.col("_a")) - F.col("_a")) * F.col("_f")
    return picked.groupBy(*by).agg(*[F.max(F.when(F.col("i") == i, q)).alias(n) for i, n in enumerate(names)])
