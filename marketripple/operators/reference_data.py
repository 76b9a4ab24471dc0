"""Maintenance and audits of the ticker -> sector/subsector map."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNKNOWN = "A DEFINIR"


def fill_class(mapping: DataFrame, fill: DataFrame, column: str) -> DataFrame:
    """Fill only unknown entries (marker or NULL) from ``fill``; known entries are never overwritten."""
    unknown = F.col(column).isNull() | (F.col(column) == UNKNOWN)
    new = fill.select("ticker", F.col(column).alias("_new"))
    return (mapping.join(new, "ticker", "left")
            .withColumn(column, F.when(unknown, F.coalesce("_new", column)).otherwise(F.col(column))).drop("_new"))


def append_missing_keys(mapping: DataFrame, extra: DataFrame) -> DataFrame:
    return mapping.unionByName(extra.join(mapping, "ticker", "left_anti").select(*mapping.columns))


def class_conflicts(mapping: DataFrame, column: str) -> DataFrame:
    """Tickers that sit in more than one class."""
    return (mapping.groupBy("ticker").agg(F.count_distinct(column).alias("n_classes"))
            .where(F.col("n_classes") > 1))


def assert_single_class(mapping: DataFrame, column: str) -> DataFrame:
    """One row per ticker; raises inside the job when a ticker has two classes."""
    one = F.when(F.count_distinct(column) > 1, F.raise_error(F.concat(F.lit("two classes for "), F.col("ticker"))).cast("string"))
    return mapping.groupBy("ticker").agg(F.coalesce(one, F.min(column)).alias(column))


def class_sizes(mapping: DataFrame, usable_from: int) -> DataFrame:
    known = mapping.where(F.col("subsector").isNotNull() & (F.col("subsector") != UNKNOWN))
    return known.groupBy("subsector").agg(F.count("ticker").alias("n"), F.count_distinct("sector").alias("n_sectors")
                                          ).withColumn("usable", F.col("n") >= usable_from)


def taxonomy_orphans(taxonomy: DataFrame, mapping: DataFrame) -> DataFrame:
    return taxonomy.join(mapping, "ticker", "left_anti").select("ticker")


def classes_spanning_sectors(mapping: DataFrame) -> DataFrame:
    # the set of sectors per class is bounded by the taxonomy
    return (mapping.groupBy("subsector").agg(F.array_join(F.sort_array(F.collect_set("sector")), ",").alias("sectors"),
                                             F.count_distinct("sector").alias("n_sectors")).where(F.col("n_sectors") > 1))


def nodes_without_class(edges: DataFrame, mapping: DataFrame, column: str) -> DataFrame:
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("ticker")).distinct()
    return nodes.join(mapping.where(F.col(column).isNotNull() & (F.col(column) != UNKNOWN)), "ticker", "left_anti")


def distribution(before: DataFrame, after: DataFrame, column: str) -> DataFrame:
    a = before.groupBy(column).agg(F.count("ticker").alias("n_before"))
    b = after.groupBy(column).agg(F.count("ticker").alias("n_after"))
    return a.join(b, column, "full").na.fill(0, ["n_before", "n_after"])
