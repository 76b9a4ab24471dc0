"""The question the engine answers first: which names carry the strongest propagated score on each date."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def strongest_names(signal: DataFrame, top: int = 3) -> DataFrame:
    """Top names per date by |z|; the rank filter keeps only ``top`` rows per task and date."""
    w = Window.partitionBy("date").orderBy(F.desc("az"), "ticker")
    return (signal.where(F.abs("z") > 1e-9).withColumn("az", F.round(F.abs("z"), 9))
            .withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
            .select("date", "ticker", "raw", "z", "rank"))
