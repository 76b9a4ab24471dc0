"""Token counts behind a digest cache.

A text's count is stored under the digest of its normalised content and a digest of the tokenizer. Normalised content is
the text with white space runs as one space and none at the ends, which the tokenizer drops anyway. Texts whose digest the
cache lacks are encoded once per distinct digest, by the library, and appended to the cache.
"""

from __future__ import annotations

import hashlib
import json
import os
import re

import regex
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketripple.llm.common import per_text
from marketripple.session import materialise

#: Pieces that a worker remembers and the longest of them; these bound memory only.
MEMO, MEMO_PIECE = 400_000, 64
#: Below this code point no character has a combining form, so canonical composition changes nothing.
SIMPLE = re.compile("[^\x00-˿]")


class TokenCounter:
    """Counts of one tokenizer file of the tokenizers library, without added special tokens.

    Files that lower-case, drop white space and cut by a pattern are counted piece by piece with a memo, the library
    encoding each new piece; texts with special strings or characters from U+0300 on, and all texts of other files, go
    to the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_str(json.dumps(spec | {"truncation": None, "padding": None}))
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.cut, self.memo = None, {}
        steps = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        before = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        if steps == ["NFC", "Replace", "Lowercase"] and [p["type"] for p in before] == ["Split", "ByteLevel"] and before[0].get("invert") and before[0]["behavior"] == "Removed":
            self.cut = regex.compile(before[0]["pattern"]["Regex"])
            self.pieces = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "added_tokens": [], "post_processor": None, "truncation": None, "padding": None,
                                                                "pre_tokenizer": before[1]}))

    def _library(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def counts(self, texts: list[str]) -> list[int]:
        whole = [self.cut is None or SIMPLE.search(t) is not None or any(s in t or s in t.lower() for s in self.special) for t in texts]
        cut = [[] if w else self.cut.findall(t.lower()) for t, w in zip(texts, whole)]
        memo, fresh = self.memo, {}
        new = list({p for c in cut for p in c if p not in memo})
        for k in range(0, len(new), 4096):
            some = new[k:k + 4096]
            fresh.update(zip(some, (len(e.ids) for e in self.pieces.encode_batch_fast(some, add_special_tokens=False))))
        out = [self._library([t])[0] if w else sum([memo[p] if p in memo else fresh[p] for p in c]) for t, w, c in zip(texts, whole, cut)]
        if len(memo) > MEMO:
            memo.clear()
        memo.update((p, v) for p, v in fresh.items() if len(p) <= MEMO_PIECE)
        return out


def tokenizer_version(path: str) -> str:
    import tokenizers
    with open(path, "rb") as f:
        return hashlib.sha256(tokenizers.__version__.encode() + b"\0" + f.read()).hexdigest()


_CACHE = "digest string, n_tokens bigint, version string"
_BUILT: dict[str, TokenCounter] = {}


def _counter(path: str) -> TokenCounter:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _BUILT:
        _BUILT[path] = TokenCounter(path)
    return _BUILT[path]


def content_digest(text: Column) -> Column:
    """SHA-256 of the text with runs of the six ASCII blanks as one space, trimmed; NULL as the empty text."""
    return F.sha2(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")), 256)


def cached(spark, cache: str, version: str) -> DataFrame:
    """(digest, n_tokens) of the tokenizer version; a cache that does not exist yet is an empty table."""
    try:
        found = spark.read.schema(_CACHE).parquet(cache)
    except AnalysisException:
        found = spark.createDataFrame([], _CACHE)
    return found.where(F.col("version") == version).select("digest", "n_tokens")


def count_tokens(docs: DataFrame, path: str, cache: str, limit: int = 2048, id_column: str = "doc_id", column: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, cached), one row per row of ``docs``; NULL texts count as empty.

    ``cache`` is a folder that all executors share; it may be missing at first. Only narrow rows (id, digest) meet in the
    look-up; of the texts, those of one row per missing digest are encoded and their counts appended. Every count is then
    taken from the cache; ``cached`` tells whether it was there before. Ids may be NULL or repeated; an empty table gives no
    rows. Two runs that append the same digest at a time do no harm: a digest's count is the same.
    """
    spark, version = docs.sparkSession, tokenizer_version(path)
    marked = docs.select(F.col(id_column).alias("doc_id"), F.col(column).alias("text"), content_digest(F.col(column)).alias("digest"))
    row = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "digest")
    ids = materialise(marked.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("n_bytes"), "digest", row.alias("row")), "token_ids")
    wanted = ids.groupBy("digest").agg(F.min("row").alias("row"))
    before = cached(spark, cache, version).select("digest").distinct().withColumn("cached", F.lit(True))
    wanted = materialise(wanted.join(before, "digest", "left").select("digest", "row", F.coalesce("cached", F.lit(False)).alias("cached")), "token_wanted")
    misses = wanted.where("not cached").select(F.col("digest").alias("__digest"), F.col("row").alias("__row"))
    # equal texts under other rows are left behind here, so no key holds more than repeats of one row
    chosen = marked.withColumn("row", row).join(misses, (F.col("row") == F.col("__row")) & (F.col("digest") == F.col("__digest"))).select("digest", "text")

    def make():
        counter = _counter(path)
        return lambda texts: [counter.counts([t or "" for t in texts])]

    made = per_text(chosen, make, ["digest"], "n_tokens bigint")
    made.groupBy("digest").agg(F.min("n_tokens").alias("n_tokens")).withColumn("version", F.lit(version)).write.mode("append").parquet(cache)
    counts = cached(spark, cache, version).join(wanted.select("digest", "cached"), "digest").groupBy("digest", "cached").agg(F.min("n_tokens").alias("n_tokens"))
    return ids.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "cached")
