"""Text steps before edge extraction, and attention rules on the signal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketripple.functions.expr import series_window

# Stems of verbs and nouns of dependency between companies.
DEPENDENCY = "(?i)(^|[^a-z])(depend|fornec|suppl|client|customer|contrat|contract|provide|requir)"


def paragraphs(documents: DataFrame) -> DataFrame:
    """(doc_id, date, pos, paragraph) of every non-empty paragraph of the whole text."""
    p = documents.select("doc_id", "date", F.posexplode(F.split("text", "\n")).alias("pos", "paragraph"))
    return p.where(F.trim("paragraph") != "")


def dependency_prefilter(paras: DataFrame, pattern: str = DEPENDENCY) -> DataFrame:
    return paras.where(F.col("paragraph").rlike(pattern))


def paragraph_hash(c: str = "paragraph"):
    return F.sha2(F.trim(F.regexp_replace(F.lower(F.col(c)), "[ \\t\\r\\f]+", " ")), 256)


def paragraph_first_seen(paras: DataFrame) -> DataFrame:
    """One row per distinct normalised paragraph: first date and copies. Copies combine before the shuffle."""
    return paras.groupBy(paragraph_hash().alias("hash")).agg(F.min("date").alias("first_seen"), F.count(F.lit(1)).alias("copies"))


def attention_gate(signal: DataFrame, panel: DataFrame, window: int = 20, limit: float = 2.0) -> DataFrame:
    """Close the entry (signal 0) when the name's volume is abnormal against its previous ``window`` rows."""
    w = series_window((), "ticker").rowsBetween(-window, -1)
    z = F.try_divide(F.col("volume") - F.avg("volume").over(w), F.nullif(F.stddev_samp("volume").over(w), F.lit(0.0)))
    v = panel.select("date", "ticker", z.alias("volume_z"))
    closed = F.coalesce(F.col("volume_z") > limit, F.lit(False))
    return signal.join(v, ["date", "ticker"], "left").withColumn("gated", F.when(closed, 0.0).otherwise(F.col("z")))


def distraction_multiplier(documents: DataFrame) -> DataFrame:
    """(date, n_docs, multiplier): filings per date over their mean."""
    n = documents.groupBy("date").agg(F.count(F.lit(1)).alias("n_docs"))
    mean = n.agg(F.avg("n_docs").alias("m")).select("m").scalar()
    return n.withColumn("multiplier", F.try_divide(F.col("n_docs").cast("double"), mean))


def scale_by_distraction(signal: DataFrame, multiplier: DataFrame) -> DataFrame:
    """Signal times the multiplier of its date (1 without filings)."""
    return signal.join(F.broadcast(multiplier), "date", "left").withColumn(  # one row per calendar date
        "scaled", F.col("z") * F.coalesce("multiplier", F.lit(1.0)))
