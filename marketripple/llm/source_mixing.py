"""Mixing sources to target weights by Efraimidis-Spirakis sampling, with column expressions only.

A document's key is an exponential variate, drawn from a digest of its id and text, over its quality weight; documents in
order of their keys are a weighted sample without replacement. Rows with equal source, id and text have one key: they are
counted before they move and stand as one row with a number, whatever their share of the table. Each source first gives its whole epochs, then the documents with
the smallest keys until the prefix sum of their sizes fills the rest of the target.

No source is sorted whole: a monotone code of the key is cut in two digits of ten bits, sums by digit find the one code
at which the budget runs out, and only documents with that code are ordered. A window holds at most 1024 rows per source
and digit, or the different documents of one code (a millionth of a source).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketripple.llm.common import WORD, same
from marketripple.session import materialise

DIGIT = 1024
SYMBOLS = "#$%&*|!@^~<>"
#: Equal rows that are made again in one task.
CHUNK = 100_000


def quality_weight(text: Column) -> Column:
    """Share of the characters that are no symbols, a tenth at least; a tenth for empty and NULL texts."""
    return F.coalesce(F.greatest(F.lit(0.1), F.length(F.translate(text, SYMBOLS, "")) / F.when(F.length(text) > 0, F.length(text))), F.lit(0.1))


def row_digest(id_column: Column, text: Column) -> Column:
    """MD5 of id and text; NULLs are empty."""
    return F.md5(F.concat(F.coalesce(id_column.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit(""))))


def exponential_key(digest: Column, weight: Column) -> Column:
    """-ln(u) / weight with u from 52 bits of the row's digest: the same in every run."""
    bits = F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint")
    return -F.log((bits + F.lit(0.5)) / F.lit(float(1 << 52))) / weight


def source_targets(sizes: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Weights repeat along the sources by code point, NULL last. ``share`` of all sizes is dealt by weight; no target exceeds
    ``cap`` times its source's size, and what is above goes to the others by weight. A source is capped if its cap per
    weight is below the level that the sources with a smaller one leave. One row per source, so the windows are small.
    """
    every = Window.partitionBy(F.lit(0))
    by_name = every.orderBy(F.col("source").asc_nulls_last())
    by_level = every.orderBy("level", F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    d = sizes.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(cap)).withColumn("level", F.col("cap") / F.col("w"))
    goal = F.sum("source_size").over(every) * F.lit(share)
    left = (goal - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    d = d.withColumn("goal", goal).withColumn("capped", F.col("level") < left)
    used = F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0.0)).over(every)
    free = F.sum(F.when(F.col("capped"), 0.0).otherwise(F.col("w"))).over(every)
    level = (F.col("goal") - used) / F.when(free > 0, free)
    return d.select("source", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(F.least(F.col("cap"), level * F.col("w"))).alias("target"))


def _boundary(rows: DataFrame, digit: Column, base: str, name: str) -> DataFrame:
    """For each source the digit at which its budget runs out, and the sizes before it: (source, ``name``, ``base``)."""
    sums = rows.groupBy("source", "budget", F.col(base).alias("base") if base in rows.columns else F.lit(0).cast("bigint").alias("base"), digit.alias("digit")).agg(F.sum(F.col("size") * F.col("rows")).alias("n"))
    order = Window.partitionBy("source").orderBy("digit")
    run = sums.withColumn("upto", F.col("base") + F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    first = run.where("upto >= budget").groupBy("source").agg(F.min_by(F.struct("digit", (F.col("upto") - F.col("n")).alias("base")), "digit").alias("x"))
    return materialise(first.select("source", F.col("x.digit").alias(name), F.col("x.base").alias(base)), name)


def _code(key: Column) -> Column:
    return F.floor(F.lit(float(DIGIT * DIGIT)) * (key / (F.lit(1.0) + key))).cast("bigint")


def _shares(docs: DataFrame, weights: Sequence[int], share: float, cap: float, id_column: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(source, doc_id, digest, size, key, rows, code), one row per different document; (source, source_size, target, epochs,
    edge), one row per source, NULL where no budget ends; (source, digest, left) of the documents at the code ``edge``: the
    words that the budget still has for them after the documents before them, negative if none."""
    id_, text = F.col(f"`{id_column}`"), F.col("text")
    read = docs.select("source", id_.alias("doc_id"), row_digest(id_, text).alias("digest"), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"), quality_weight(text).alias("weight"))
    same_rows = read.groupBy("source", "doc_id", "digest", "size", "weight").agg(F.count(F.lit(1)).alias("rows"))
    key = exponential_key(F.col("digest"), F.col("weight"))
    narrow = materialise(same_rows.select("source", "doc_id", "digest", "size", "rows", key.alias("key")).withColumn("code", _code(F.col("key"))), "mix_docs")
    sums = materialise(narrow.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size")), "mix_sources")
    epochs = F.coalesce(F.floor(F.col("target") / F.when(F.col("source_size") > 0, F.col("source_size"))), F.lit(0)).cast("bigint")
    plan = materialise(source_targets(sums, weights, share, cap).withColumn("epochs", epochs).withColumn(
        "budget", F.floor(F.col("target") - F.col("epochs") * F.col("source_size")).cast("bigint")), "mix_plan")
    on = lambda a, b: same(a["source"], b["source"])
    rows = narrow.join(plan.where("budget > 0"), on(narrow, plan)).drop(plan["source"])
    high = _boundary(rows, F.expr(f"code div {DIGIT}"), "base1", "high")
    in_high = rows.join(high, on(rows, high)).drop(high["source"]).where(f"code div {DIGIT} = high")
    low = _boundary(in_high, F.expr(f"code % {DIGIT}"), "base1", "low").withColumnRenamed("base1", "base")
    edge = materialise(high.join(low, on(high, low)).select(high["source"], (F.col("high") * DIGIT + F.col("low")).alias("edge"), "base"), "mix_edge")
    at_edge = rows.join(edge, on(rows, edge)).drop(edge["source"]).where("code = edge")
    before = F.sum(F.col("size") * F.col("rows")).over(Window.partitionBy("source").orderBy("key", "doc_id", "digest").rowsBetween(Window.unboundedPreceding, -1))
    ends = at_edge.select("source", "digest", (F.col("budget") - F.col("base") - F.coalesce(before, F.lit(0))).alias("left"))
    plan = plan.join(edge, on(plan, edge), "left").drop(edge["source"]).select("source", "source_size", "target", "epochs", "edge")
    return narrow, materialise(plan, "mix_plan"), materialise(ends, "mix_ends")


def mix(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, id_column: str = "doc_id", chunk: int = CHUNK) -> DataFrame:
    """(doc_id, size, source_size, target, taken), one row per row of ``docs`` (doc_id, source, text).

    Size is the number of words (NULL text: 0). ``taken`` is the words that the mix takes, repeats counted: whole epochs of
    the size, and once more, or in part for the document at which the budget ends. It never exceeds ``cap`` times the size
    (``cap`` a whole number). Documents without words take nothing; of equal rows as many are taken as the budget has words
    for. Equal rows are made again from their number, at most ``chunk`` of them in a row's task.
    """
    narrow, plan, ends = _shares(docs, weights, share, cap, id_column)
    rows = narrow.join(plan, same(narrow["source"], plan["source"])).drop(plan["source"])
    rows = rows.join(ends, same(rows["source"], ends["source"]) & (rows["digest"] == ends["digest"]), "left").drop(ends["source"]).drop(ends["digest"])
    rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(rows - 1) div {chunk}"))))
    rows = rows.repartition("digest", "part")
    first = F.col("part") * chunk
    rows = rows.withColumn("i", F.explode(F.sequence(first, F.least(first + chunk, F.col("rows")) - 1)))
    at_edge = F.greatest(F.lit(0), F.least(F.col("size"), F.col("left") - F.col("i") * F.col("size")))
    once = F.when(F.col("left").isNotNull(), at_edge).when(F.col("code") < F.col("edge"), F.col("size")).otherwise(0)
    return rows.select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + once).cast("bigint").alias("taken"))


def _among_equals(rows: DataFrame) -> DataFrame:
    """(__row, __digest, __source, __n): the number, from 1, of each row among those with its source and digest, in the order of ``__row``.

    Rows are numbered within the part of the table they were written in; what the parts before hold is one row per part.
    """
    by = ["__source", "__digest"]
    slim = rows.select(*by, "__row", F.shiftright("__row", 33).alias("__part"))
    parts = slim.groupBy(*by, "__part").agg(F.count(F.lit(1)).alias("__m"))
    before = F.coalesce(F.sum("__m").over(Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(F.col("__source").alias("s"), F.col("__digest").alias("d"), F.col("__part").alias("p"), before.alias("__before"))
    own = slim.withColumn("__own", F.row_number().over(Window.partitionBy(*by, "__part").orderBy("__row")))
    met = own.join(parts, same(own["__source"], parts["s"]) & (own["__digest"] == parts["d"]) & (own["__part"] == parts["p"]))
    return met.select("__row", *by, (F.col("__before") + F.col("__own")).alias("__n"))


def copies(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, id_column: str = "doc_id") -> DataFrame:
    """The mixed corpus: each document as often as the mix takes it (a document taken in part counts as whole), all columns.

    A document's code says how often, but for those at the code where its source's budget ends, which are written and, if
    equal, numbered. Texts of others do not move. Rows without id, or with one id, count like any others.
    """
    _, plan, ends = _shares(docs, weights, share, cap, id_column)
    names = [f"`{c}`" for c in docs.columns]
    id_, text = F.col(f"`{id_column}`"), F.col("text")
    d = docs.select(*names, row_digest(id_, text).alias("__digest")).where(text.rlike(WORD))
    d = d.withColumn("__code", _code(exponential_key(F.col("__digest"), quality_weight(text))))
    p = plan.select(F.col("source").alias("__source"), F.col("epochs").alias("__epochs"), F.col("edge").alias("__edge"))
    d = d.join(p, same(F.col("source"), F.col("__source")))
    sure = d.where("__edge is null or __code <> __edge").select(*names, (F.col("__epochs") + F.coalesce((F.col("__code") < F.col("__edge")).cast("int"), F.lit(0))).alias("__n"))
    at_edge = materialise(d.where("__code = __edge").withColumn("__row", F.monotonically_increasing_id()), "mix_at_edge")
    numbers = _among_equals(at_edge)
    e = ends.select(F.col("source").alias("s"), F.col("digest").alias("d"), F.col("left").alias("__left"))
    numbers = numbers.join(e, same(numbers["__source"], e["s"]) & (numbers["__digest"] == e["d"])).select("__row", F.col("__n").alias("__i"), "__left")
    at_edge = at_edge.join(numbers, "__row")
    size = F.regexp_count(text, F.lit(WORD))
    some = at_edge.select(*names, (F.col("__epochs") + (F.col("__left") > (F.col("__i") - 1) * size).cast("int")).alias("__n"))
    rows = sure.unionByName(some).where("__n > 0")
    return rows.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("__n")))).select(*names)


#: DuckDB SQL of ``mix`` with the default parameters over ``documents``.
MIX_SQL = """
with d as (select doc_id, source, text, coalesce(length(regexp_replace(regexp_replace(text, '[^\\x20\\x09-\\x0D]+', 'w', 'g'), '[\\x20\\x09-\\x0D]+', '', 'g')), 0) as size from documents),
k as (select doc_id, source, size, -ln((cast(('0x' || substr(md5(coalesce(cast(doc_id as varchar), '') || ':' || coalesce(text, '')), 1, 13)) as bigint) + 0.5::double) / 4503599627370496.0::double)
   / coalesce(greatest(0.1::double, length(translate(text, '#$%&*|!@^~<>', ''))::double / nullif(length(text), 0)), 0.1::double) as key from d),
s as (select source, cast(sum(size) as bigint) as source_size, ([3.0, 1.0, 2.0]::double[])[cast((row_number() over (order by source nulls last) - 1) % 3 + 1 as integer)] as w from k group by source),
l as (select *, source_size * 2.0::double as cap, source_size * 2.0::double / w as level, sum(source_size) over () * 1.5::double as goal from s),
c as (select *, level < (goal - coalesce(sum(cap) over b, 0)) / (sum(w) over () - coalesce(sum(w) over b, 0)) as capped from l
   window b as (order by level, source nulls last rows between unbounded preceding and 1 preceding)),
t as (select source, source_size, case when capped then cap else least(cap, (goal - sum(case when capped then cap else 0 end) over ())
   / nullif(sum(case when capped then 0 else w end) over (), 0) * w) end as target from c),
p as (select *, cast(coalesce(floor(target / nullif(source_size, 0)), 0) as bigint) as epochs from t),
r as (select k.*, p.source_size, p.target, p.epochs, cast(floor(p.target - p.epochs * p.source_size) as bigint) as budget,
   coalesce(sum(k.size) over (partition by k.source order by k.key, k.doc_id rows between unbounded preceding and 1 preceding), 0) as before
   from k join p on k.source is not distinct from p.source)
select doc_id, cast(size as bigint) as size, source_size, target, cast(epochs * size + greatest(0, least(size, budget - before)) as bigint) as taken from r"""
