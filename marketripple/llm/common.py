"""Helpers of the operators: tables, Arrow batches of bounded size, connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketripple.session import materialise

#: White space of the word definition used by all operators: words are ``[^\x20\x09-\x0D]+``. ``bytes.split`` cuts at
#: exactly these six bytes.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that a worker handles at once.
SLICE_BYTES = 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about ``most`` bytes of ``column`` (one row at least), so that memory is bounded by the longest text."""
    sizes = [0 if s is None else s for s in pa.compute.binary_length(batch.column(column)).to_pylist()]
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)


def per_text(df: DataFrame, make: Callable[[], Callable[[list], list]], keep: list[str], schema: str, column: str = "text") -> DataFrame:
    """Map ``column`` to new columns, keeping the columns ``keep``.

    ``make()`` runs once per task and gives a function from a list of texts (NULL is None) to a list of Arrow arrays or
    lists, one for each column of ``schema`` (DDL of the new columns).
    """
    kept = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{column}`").alias("__text"))
    out = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]], schema])
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType
    target = to_arrow_schema(StructType.fromDDL(out))
    n_keep = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            for part in slices(batch, "__text"):
                made = fn(part.column(n_keep).to_pylist())
                arrays = [part.column(i) for i in range(n_keep)]
                arrays += [x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x, target.field(n_keep + i).type) for i, x in enumerate(made)]
                yield pa.RecordBatch.from_arrays([a.cast(f.type) if a.type != f.type else a for a, f in zip(arrays, target)], names=target.names)

    return kept.mapInArrow(run, out)


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def _mark(df: DataFrame) -> tuple:
    """Row count and order-free checksum."""
    return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of the undirected ``links`` (src, dst), the component being its smallest node.

    Large-star and small-star steps in turn; the rounds grow with the logarithm of the diameter. Each step is a written
    table, so the joins of a hub's edges with its minimum have a plain exchange on either side and can be split by AQE,
    and a lost executor costs one step. Only a count and a checksum per round reach the driver.
    """
    cur = materialise(links.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), "cc")
    before = _mark(cur)
    if not before[0]:
        return cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
    for _ in range(max_rounds):
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialise(both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m")), "cc")
        large = materialise(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "cc")
        low2 = materialise(large.groupBy("u").agg(F.min("v").alias("m")), "cc")
        small = large.join(low2, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low2.select("u", F.col("m").alias("v")))
        cur = materialise(small.where("u <> v").distinct(), "cc")
        now = _mark(cur)
        if now == before:
            tops = cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(tops)
        before = now
    raise RuntimeError("components did not settle")
