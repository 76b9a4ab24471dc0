"""Landed files in and contract files out: fixed-width exchange records, edge lists, rates, panels."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketripple.session import scratch_dir

# Fixed values of the 245-character record (1-based start, length).
WIDTH = 245
FIELDS = {
    "tipo": (1, 2), "data": (3, 8), "bdi": (11, 2), "ticker": (13, 12), "mercado": (25, 3), "close": (109, 13),
    "volume": (171, 18), "factor": (211, 7),
}
RECORD, CASH_MARKET = "01", "010"
EDGE_SCHEMA = "src string, dst string, kind string, strength double, direction int"


def raw_lines(spark: SparkSession, root: str) -> DataFrame:
    """(file, line) of every text file under ``root``, whatever the case of its extension, as it is or packed by gzip.

    Bytes are decoded as latin-1: as UTF-8 an accented record would not measure 245 characters.
    """
    raw = (spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[tT][xX][tT]{,.gz}").text(root))
    return raw.select(F.col("_metadata.file_path").alias("file"),
                      F.decode(F.col("value").cast("binary"), "ISO-8859-1").alias("line"))


def field(line: str | Column, name: str) -> Column:
    start, n = FIELDS[name]
    return F.substring(line, start, n)


def parse_records(lines: DataFrame, malformed: str = "zero") -> DataFrame:
    """Cash-market trade records. Width, type and market reject a line before its numbers are read.

    A close, volume or factor that is no number is 0 (``malformed="zero"``, see ``ingest_counters``) or ends the job with the
    field and the line's first characters (``malformed="fail"``); a field that no later step reads is not looked at.
    """
    if malformed not in ("zero", "fail"):
        raise ValueError(f"malformed must be zero or fail, not {malformed!r}")
    keep = ((F.length("line") == WIDTH) & (field("line", "tipo") == RECORD) & (field("line", "mercado") == CASH_MARKET))

    def num(n: str) -> Column:
        other = F.lit(0.0)
        if malformed == "fail":
            other = F.raise_error(F.concat(F.lit(f"{n} is no number: "), F.substring("line", 1, 30))).cast("double")
        return F.coalesce(F.try_to_number(F.trim(field("line", n)), F.lit("9" * FIELDS[n][1])).cast("double"), other)

    d = lines.where(keep).select(
        F.to_date(field("line", "data"), "yyyyMMdd").alias("date"), F.trim(field("line", "bdi")).alias("bdi"),
        F.trim(field("line", "ticker")).alias("ticker"), (num("close") / 100).alias("close"),
        (num("volume") / 100).alias("volume"), num("factor").alias("factor"))
    d = d.withColumn("factor", F.when(F.col("factor") == 0, 1.0).otherwise(F.col("factor")))
    price = F.col("close") / F.col("factor")
    return d.withColumn("price", F.when(price > 0, price))


def bad_number(line: str | Column) -> Column:
    """Whether a record's close, volume or factor is no number; ``parse_records`` reads it as 0."""
    return reduce(Column.__or__, [~F.trim(field(line, n)).rlike("^[0-9]+$") for n in ("close", "volume", "factor")])


def ingest_counters(lines: DataFrame, source: Column | None = None) -> DataFrame:
    """Per source file: lines, wrong width, trade records, cash-market records and those with a malformed number."""
    src = F.col("file") if source is None else source
    ok = F.length("line") == WIDTH
    rec = ok & (field("line", "tipo") == RECORD)
    return lines.groupBy(src.alias("source")).agg(
        F.count(F.lit(1)).alias("n_lines"), F.count_if(~ok).alias("n_wrong_width"), F.count_if(rec).alias("n_records"),
        F.count_if(rec & (field("line", "mercado") == CASH_MARKET)).alias("n_cash"),
        F.count_if(rec & (field("line", "mercado") == CASH_MARKET) & bad_number("line")).alias("n_bad_number"))


def path_exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.format("binaryFile").load(path).schema  # noqa: B018  resolves the path, reads nothing
    except AnalysisException:
        return False
    return True


def read_first(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Parquet panel at the first path that exists."""
    for p in paths:
        if path_exists(spark, p):
            return spark.read.parquet(p)
    raise FileNotFoundError(", ".join(paths))


def read_edges(spark: SparkSession, base: str, extra: str | None = None) -> DataFrame:
    """Edge list files with where each edge came from; nothing is dropped, duplicates included."""
    read = lambda p, s: spark.read.csv(p, header=True, schema=EDGE_SCHEMA).withColumn("source", F.lit(s))
    out = read(base, "base")
    if extra and path_exists(spark, extra):
        out = out.unionByName(read(extra, "historical"))
    return out


def read_riskfree(spark: SparkSession, path: str) -> DataFrame:
    """Daily rate from landed JSON rows {data: dd/MM/yyyy, valor: percent per day as text}."""
    raw = spark.read.schema("data string, valor string").json(path)
    return raw.select(F.to_date("data", "dd/MM/yyyy").alias("date"), (F.col("valor").cast("double") / 100).alias("rf"))


def read_membership(spark: SparkSession, path: str) -> DataFrame:
    """Index members; the trailing total line is recognised by its content, not by its position."""
    raw = spark.read.csv(path, header=True, schema="codigo string, participacao string")
    return raw.where(F.col("codigo").rlike("^[A-Z]{4,}[0-9]+$")).select(F.col("codigo").alias("ticker"))


def cached_table(spark: SparkSession, label: str, params: Mapping[str, object], build: Callable[[], DataFrame],
                 recompute: bool = False) -> DataFrame:
    """An expensive intermediate kept as a table per parameter set; only complete tables are reused."""
    tag = hashlib.sha256(json.dumps(dict(params), sort_keys=True, default=str).encode()).hexdigest()[:16]
    path = f"{scratch_dir(spark)}/cache/{label}-{tag}"
    if recompute or not path_exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


# ---- sinks ------------------------------------------------------------------------------------------------


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_json(df: DataFrame, path: str) -> None:
    """Nested evidence: columns become one document per row."""
    df.write.mode("overwrite").json(path)
