"""Phrase collocations by relational mining of sorted occurrence relations (SETM).

The occurrence relation R1 holds, per language, the words of every piece in the order of piece and position; it is written
once, in rows of about a megabyte of text whose pieces are whole, with the row's own vocabulary beside it. The loop
for lengths 2, 3, ... is that of relational association mining:

* **Merge join.** R(k) joined with itself on piece and adjacent position gives the phrases of k + 1 words. Both sides are
  sorted the same way and a piece never leaves its row, so the join is a step of one position inside a row: no shuffle.
* **Group count.** A row's equal phrases are added up before they leave it, then once per task, then by phrase.
* **Semi-join.** The frequent phrases C(k+1) mark their occurrences; what is left is R(k+1), written as chains of words in
  which every phrase of k + 1 words is frequent, with a gap wherever that ends. The marks come through a bit table of fixed
  size made of C(k+1). A phrase it lets through by chance is counted like any other and fails the count.

A word stands as a 64-bit hash of language and word; the dictionary proves that no two words share one, and takes another
seed if they do. Phrases are tuples of these, never hashes of hashes, so counts are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketripple.llm.common import slices
from marketripple.session import materialise

#: Piece ends and blanks, after which a text is lower-cased ASCII with line feeds between pieces and spaces between words.
_TABLE = bytes.maketrans(b".,;:!?\x0a\x0b\x0c\x0d\x09", b"\n" * 10 + b" ")
_LOWER = "abcdefghijklmnopqrstuvwxyz"
#: Bytes of text in a row of R1, and of all rows that a task holds open.
ROW_BYTES, HELD_BYTES = 1_000_000, 8_000_000
#: Bits of the table that marks frequent phrases (8 MB), and probes of a phrase in it. They change speed only.
FILTER_BITS, PROBES = 1 << 26, 2
#: Rows of R1 or R2 that stand in one Arrow batch.
BATCH_ROWS = 4
#: Parts of a language whose best phrases are found apart, before those of the language.
PARTS = 256
GAP = -1
_R1 = "lang string, n bigint, items binary, hashes array<bigint>, words array<string>, counts array<bigint>"


def pieces(text: str | None) -> list[bytes]:
    """Words of a text, with a line feed wherever a piece ends."""
    return [w for w in (text or "").encode().lower().translate(_TABLE).replace(b"\n", b" \n ").split(b" ") if w]


def _occurrences(seed: int):
    """(lang, text) to rows of R1."""
    def row(lang: str, texts: list) -> pa.RecordBatch:
        words: list[bytes] = [b"\n"]
        for t in texts:
            words += pieces(t)
            words.append(b"\n")
        coded = pa.array(words, pa.binary()).dictionary_encode()
        ids = coded.indices.to_numpy() - 1  # the line feed comes first, so it is the gap
        vocabulary = coded.dictionary.to_pylist()[1:]
        counts = np.bincount(ids + 1, minlength=1)[1:]
        head = lang.encode() + b"\n"
        hashes = [xxhash.xxh3_64_intdigest(head + w, seed) for w in vocabulary]
        return pa.RecordBatch.from_arrays(
            [pa.array([lang]), pa.array([int(counts.sum())], pa.int64()), pa.array([ids.astype(np.int32).tobytes()], pa.binary()),
             pa.array([np.array(hashes, np.uint64).view(np.int64)], pa.list_(pa.int64())), pa.array([[w.decode() for w in vocabulary]], pa.list_(pa.string())),
             pa.array([counts], pa.list_(pa.int64()))], names=["lang", "n", "items", "hashes", "words", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        size: dict[str, int] = {}
        for batch in batches:
            for part in slices(batch, most=ROW_BYTES):
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    held.setdefault(lang, []).append(text)
                    size[lang] = size.get(lang, 0) + len(text or "") + 1
                    if size[lang] > ROW_BYTES:
                        yield row(lang, held.pop(lang))
                        del size[lang]
                while sum(size.values()) > HELD_BYTES:
                    lang = max(size, key=size.get)
                    yield row(lang, held.pop(lang))
                    del size[lang]
        for lang, texts in held.items():
            yield row(lang, texts)
    return run


def _mixed(parts: list[np.ndarray]) -> np.ndarray:
    """One 64-bit word of several, for the bit table."""
    x = parts[0].copy()
    for p in parts[1:]:
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + p
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _probes(x: np.ndarray, bits: int) -> list[np.ndarray]:
    low, high = x & np.uint64(0xFFFFFFFF), x >> np.uint64(32)
    return [((low + np.uint64(i) * high) % np.uint64(bits)).astype(np.int64) for i in range(PROBES)]


def bit_table(frequent: DataFrame, columns: list[str], bits: int) -> np.ndarray:
    """The rows of ``frequent`` as a table of ``bits`` bits; at most bits / 64 rows reach the driver, whatever the input."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _mixed([c.to_numpy(zero_copy_only=False).view(np.uint64) for c in b.columns])
            at = np.unique(np.concatenate(_probes(x, bits)))
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array((np.uint64(1) << (at & 63).astype(np.uint64)).view(np.int64))], names=["at", "mask"])

    words = frequent.select(*columns).mapInArrow(run, "at bigint, mask bigint").groupBy("at").agg(F.bit_or("mask").alias("mask")).toArrow()
    table = np.zeros(bits // 64, np.uint64)
    table[words.column("at").to_numpy()] = words.column("mask").to_numpy().view(np.uint64)
    return table


def _marked(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    ok = np.ones(len(x), bool)
    for at in _probes(x, len(table) * 64):
        ok &= (table[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
    return ok


def _chains(items: np.ndarray, hashes: np.ndarray, k: int, table) -> np.ndarray:
    """The semi-join: words of ``items`` that lie in a phrase of ``k`` words that the table marks, with gaps between chains."""
    n = len(items) - k + 1
    if n < 1:
        return items[:0]
    ok = np.ones(n, bool)
    for i in range(k):
        ok &= items[i:i + n] >= 0
    if k == 1:
        ok[ok] = _marked(_mixed([hashes]), table)[items[ok]] if len(hashes) else False
        return np.where(ok, items, GAP)
    at = np.flatnonzero(ok)
    at = at[_marked(_mixed([hashes[items[at + i]] for i in range(k)]), table)]
    if not len(at):
        return items[:0]
    first = np.concatenate(([True], np.diff(at) != 1))  # a new chain: gap, its first k - 1 words, then one word a phrase
    lengths = 1 + first * k
    out = np.full(lengths.sum(), GAP, np.int32)
    last = np.cumsum(lengths) - 1
    out[last] = items[at + k - 1]
    for i in range(k - 1):
        out[last[first] - (k - 1) + i] = items[at[first] + i]
    return out


def _phrases(k: int, table):
    """Rows (items, hashes) to counted phrases of ``k`` words: the merge join on adjacent positions, each row added up."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = table.value if table is not None else None
        for batch in batches:
            for raw, vocabulary in zip(batch.column(0), batch.column(1)):
                items = np.frombuffer(raw.as_buffer(), np.int32)
                hashes = vocabulary.values.to_numpy(zero_copy_only=False).view(np.uint64)
                if bits is not None:
                    items = _chains(items, hashes, k - 1, bits)
                n = len(items) - k + 1
                if n < 1:
                    continue
                ok = np.ones(n, bool)
                for i in range(k):
                    ok &= items[i:i + n] >= 0
                at = np.flatnonzero(ok)
                if not len(at):
                    continue
                code, left = items[at].astype(np.int64), []
                for i in range(1, k):  # codes of two words at a time stay below 2^63
                    code = code * len(hashes) + items[at + i]
                    if i < k - 1:
                        both, code = np.unique(code, return_inverse=True)
                    else:
                        both, counts = np.unique(code, return_counts=True)
                    left.append(both)
                ids, at_code = [], np.arange(len(counts))
                for both in reversed(left):
                    ids.append(both[at_code] % len(hashes))
                    at_code = both[at_code] // len(hashes)
                ids.append(at_code)
                columns = [hashes[x].view(np.int64) for x in reversed(ids)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(counts.astype(np.int64))], names=[*names(k), "c"])
    return run


def _semi_join(k: int, before, table):
    """Rows of R(k - 1) to rows of R(k); ``before`` cleans the words of R1 on the way."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (raw, vocabulary) in enumerate(zip(batch.column(0), batch.column(1))):
                items = np.frombuffer(raw.as_buffer(), np.int32)
                hashes = vocabulary.values.to_numpy(zero_copy_only=False).view(np.uint64)
                if before is not None:
                    items = _chains(items, hashes, k - 1, before.value)
                items = _chains(items, hashes, k, table.value)
                used, items = np.unique(items, return_inverse=True)
                gap = int(len(used) and used[0] == GAP)
                yield pa.RecordBatch.from_arrays([pa.array([(items - gap).astype(np.int32).tobytes()], pa.binary()),
                                                  pa.array([hashes[used[gap:]].view(np.int64)], pa.list_(pa.int64()))], names=["items", "hashes"])
    return run


@contextmanager
def wide_rows(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """Arrow batches of few rows, for tables whose rows hold megabytes: a batch stands in the JVM and in Python at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def names(k: int) -> list[str]:
    return [f"w{i}" for i in range(1, k + 1)]


def occurrences(docs: DataFrame, attempts: int = 4) -> tuple[DataFrame, DataFrame]:
    """R1, and the dictionary (w1, f, lang, word) of all words; a seed at which two words share a hash is given up."""
    text = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    for seed in range(attempts):
        r1 = materialise(text.mapInArrow(_occurrences(seed), _R1), "setm_r1")
        each = r1.select("lang", F.explode(F.arrays_zip("hashes", "words", "counts")).alias("x")).select("lang", "x.*")
        words = materialise(each.groupBy(F.col("hashes").alias("w1")).agg(
            F.sum("counts").alias("f"), F.min(F.struct("lang", "words")).alias("low"), F.max(F.struct("lang", "words")).alias("high")), "setm_words")
        if words.where("low <> high").isEmpty():
            return r1, words.select("w1", "f", F.col("low.lang").alias("lang"), F.col("low.words").alias("word"))
    raise RuntimeError("words share a hash at every seed")


def frequent_phrases(docs: DataFrame, longest: int = 3, least: int = 10, filter_bits: int = FILTER_BITS) -> tuple[DataFrame, dict[int, DataFrame]]:
    """R1 and, by length, the phrases that occur at least ``least`` times: C(1) is (w1, f, lang, word), C(k) is (w1, .., wk, f)."""
    spark, context = docs.sparkSession, docs.sparkSession.sparkContext
    r1, words = occurrences(docs)
    found = {1: materialise(words.where(F.col("f") >= least), "setm_c1")}
    rows, table = r1.select("items", "hashes"), context.broadcast(bit_table(found[1], ["w1"], filter_bits))
    for k in range(2, longest + 1):
        counted = rows.mapInArrow(_phrases(k, table if k == 2 else None), ", ".join(f"{w} bigint" for w in [*names(k), "c"]))
        with wide_rows(spark):
            found[k] = materialise(counted.groupBy(*names(k)).agg(F.sum("c").alias("f")).where(F.col("f") >= least), f"setm_c{k}")
        if k < longest:
            before, table = (table if k == 2 else None), context.broadcast(bit_table(found[k], names(k), filter_bits))
            with wide_rows(spark):
                rows = materialise(rows.mapInArrow(_semi_join(k, before, table), "items binary, hashes array<bigint>"), f"setm_r{k}")
    return r1, found


def _score(a: str, left: str, right: str) -> Column:
    """floor(1000000 * a * a / (left * right)) in whole numbers of up to 38 digits."""
    d = lambda c: f"cast({c} as decimal(12,0))"
    return F.expr(f"cast({d(a)} * {d(a)} * cast(1000000 as decimal(7,0)) div ({d(left)} * {d(right)}) as bigint)")


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, inside: int = 50, top: int = 2000, filter_bits: int = FILTER_BITS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's best ``top`` phrases of 2 to ``longest`` words.

    A-Z are lower-cased; texts are cut into pieces at ``. , ; : ! ?`` and line ends, pieces into words at spaces and tabs.
    ``a`` counts a phrase's occurrences inside pieces, at least ``least``; of its cuts in two parts (counts l and r) the one
    with the lowest score floor(1000000 a a / (l r)) counts, the shortest first part among equals. A phrase inside a longer
    frequent one with at least ``inside`` percent of its occurrences is dropped. ``n`` is the language's words. NULL languages
    are ``und``, NULL texts empty; repeated rows count each; an empty table, or one without frequent phrases, gives no rows;
    other columns are ignored. Counts must stay below 10^12.
    """
    r1, found = frequent_phrases(docs, longest, least, filter_bits)
    totals = r1.groupBy("lang").agg(F.sum("n").alias("n"))
    scored = []
    for m in range(2, longest + 1):
        rows = found[m].withColumnRenamed("f", "a")
        if m < longest:
            longer = [found[j].select(*[F.col(f"w{i + s}").alias(f"w{i}") for i in range(1, m + 1)], "f")
                      for j in range(m + 1, longest + 1) for s in range(j - m + 1)]
            every = longer[0]
            for x in longer[1:]:
                every = every.unionByName(x)
            rows = rows.join(every.groupBy(*names(m)).agg(F.max("f").alias("longer")), names(m), "left").where(
                F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * inside)).drop("longer")
        word = [F.col("w1")]
        for i in range(1, m + 1):
            one = found[1].select(F.col("w1").alias(f"w{i}"), F.col("f").alias(f"f{i}"), F.col("word").alias(f"word{i}"), *([F.col("lang")] if i == 1 else []))
            rows = rows.join(one, f"w{i}")
        for k in range(2, m):  # counts of the longer parts
            rows = rows.join(found[k].select(*names(k), F.col("f").alias(f"head{k}")), names(k))
            tail = [f"w{i}" for i in range(m - k + 1, m + 1)]
            rows = rows.join(found[k].select(*[F.col(f"w{i}").alias(t) for i, t in enumerate(tail, 1)], F.col("f").alias(f"tail{k}")), tail)
        parts = [("f1" if k == 1 else f"head{k}", f"f{m}" if m - k == 1 else f"tail{m - k}") for k in range(1, m)]
        cuts = F.array_min(F.array(*[F.struct(_score("a", x, y).alias("score"), F.lit(k).alias("k"), F.col(x).alias("l"), F.col(y).alias("r")) for k, (x, y) in enumerate(parts, 1)]))
        phrase = F.concat_ws(" ", *[f"word{i}" for i in range(1, m + 1)])
        scored.append(rows.select("lang", phrase.alias("phrase"), "a", cuts.alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score"))
    every = scored[0]
    for x in scored[1:]:
        every = every.unionByName(x)
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    for by in (["lang", "part"], ["lang"]):  # a language's best are among those of its parts, so no task sorts all of a language
        every = every.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*best))).where(F.col("rank") <= top)
    ranked = every
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


#: DuckDB SQL of ``collocations`` with the default parameters over ``documents``.
COLLOCATION_SQL = f"""
with t as (select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), '{_LOWER.upper()}', '{_LOWER}') as text from documents),
p as (select lang, unnest(regexp_split_to_array(text, '[.,;:!?\\x0A-\\x0D]')) as piece from t),
s as (select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') as w from p),
o as (select lang, w, unnest(range(1, len(w) + 1)) as i from s where len(w) > 0),
c1 as (select lang, w[i] as w1, count(*) as f from o group by all),
c2 as (select lang, w[i] as w1, w[i + 1] as w2, count(*) as f from o where i + 1 <= len(w) group by all having count(*) >= 10),
c3 as (select lang, w[i] as w1, w[i + 1] as w2, w[i + 2] as w3, count(*) as f from o where i + 2 <= len(w) group by all having count(*) >= 10),
n as (select lang, cast(sum(f) as bigint) as n from c1 group by lang),
g as (select lang, w1, w2, max(f) as f from (select lang, w1, w2, f from c3 union all select lang, w2, w3, f from c3) group by all),
k2 as (select c2.lang, c2.w1 || ' ' || c2.w2 as phrase, c2.f as a, x.f as l, y.f as r, 1 as k from c2 join c1 x on x.lang = c2.lang and x.w1 = c2.w1
   join c1 y on y.lang = c2.lang and y.w1 = c2.w2 left join g on g.lang = c2.lang and g.w1 = c2.w1 and g.w2 = c2.w2 where g.f is null or 100 * g.f < 50 * c2.f),
k3 as (select c3.lang, c3.w1 || ' ' || c3.w2 || ' ' || c3.w3 as phrase, c3.f as a, x.f as l, y.f as r, 1 as k from c3 join c1 x on x.lang = c3.lang and x.w1 = c3.w1
   join c2 y on y.lang = c3.lang and y.w1 = c3.w2 and y.w2 = c3.w3
   union all select c3.lang, c3.w1 || ' ' || c3.w2 || ' ' || c3.w3, c3.f, x.f, y.f, 2 from c3 join c2 x on x.lang = c3.lang and x.w1 = c3.w1 and x.w2 = c3.w2
   join c1 y on y.lang = c3.lang and y.w1 = c3.w3),
e as (select *, cast(1000000 * a::hugeint * a // (l::hugeint * r) as bigint) as score from (select * from k2 union all select * from k3)),
m as (select * from e qualify row_number() over (partition by lang, phrase order by score, k) = 1),
z as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from m)
select z.lang, rank, phrase, a, l, r, n, score from z join n on n.lang = z.lang where rank <= 2000"""
