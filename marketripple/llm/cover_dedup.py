"""Substring dedup by difference-cover anchors.

Word windows of 20 words are hashed only where the position modulo 31 is in a difference cover of six residues. Any two
matching windows of 50 words hold, at some common offset, such an anchor in both: every residue is a difference of two of
the cover, and the anchor still fits. So anchors that occur in one document only rule out all windows around them, and a
shared anchor is extended to the windows of 50 words that hold it; their first documents decide the removal.

Anchors, windows and removals move as narrow rows. A shared anchor with more than ``hot`` documents marks its windows as
hot. Ordinary windows meet in one sorted pass; hot ones are pre-aggregated to their first document and joined back, which
AQE can split. A window with anchors of both kinds goes both ways, so that two windows that share an anchor always meet.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketripple.llm.common import slices
from marketripple.session import materialise

#: A perfect difference cover of 31.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
WINDOW = 50
ANCHOR = WINDOW - PERIOD + 1
HOT = 2_000
#: Words that a worker remembers the hashes of; bounds memory only.
MEMO = 500_000
FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


class Hasher:
    """Hashes of words and of their windows: sums of word hashes times powers of an odd factor, modulo 2^64."""

    def __init__(self):
        self.memo: dict[bytes, int] = {}
        self.powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def words(self, words: list[bytes]) -> np.ndarray:
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        h = xxhash.xxh3_64_intdigest
        return np.fromiter([memo[w] if w in memo else memo.setdefault(w, h(w)) for w in words], np.uint64, len(words))

    def _powers(self, factor: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        have = self.powers.get(factor)
        if have is None or len(have[0]) < n:
            size = 1 << max(12, n.bit_length())
            up, down = np.full(size, factor, np.uint64), np.full(size, pow(factor, -1, 1 << 64), np.uint64)
            up[0] = down[0] = 1
            have = self.powers[factor] = (np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64))
        return have[0][:n], have[1][:n]

    def windows(self, h: np.ndarray, width: int, factor: int = FACTORS[0]) -> np.ndarray:
        n = len(h)
        if n < width:
            return np.zeros(0, np.uint64)
        up, down = self._powers(factor, n)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * up, dtype=np.uint64)))
        return (total[width:] - total[:-width]) * down[: n - width + 1]


_IN_COVER = np.isin(np.arange(PERIOD), COVER)


def anchors(hasher: Hasher, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of a document's anchors; none for documents without a whole window."""
    if len(h) < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    all_of = hasher.windows(h, ANCHOR)
    at = np.flatnonzero(np.resize(_IN_COVER, len(all_of)))
    return at, all_of[at]


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = Hasher()
    for batch in batches:
        for part in slices(batch):
            ids, hashes = [], []
            for i, text in enumerate(part.column(1).to_pylist()):
                u = np.unique(anchors(hasher, hasher.words(text.encode().split()))[1])
                hashes.append(u)
                ids.append(np.full(len(u), i))
            take = pa.array(np.concatenate(ids))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hashes).view(np.int64)), part.column(0).take(take)], names=["anchor", "doc_id"])


def _spread(at: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` windows hold one of the anchors ``at``."""
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, np.maximum(0, at - (WINDOW - ANCHOR)), 1)
    np.add.at(d, np.minimum(n, at + 1), -1)
    return np.cumsum(d[:n]) > 0


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, shared anchors of the document) to its candidate windows, each once."""
    hasher = Hasher()
    for batch in batches:
        for part in slices(batch, "text"):
            for i, (text, shared) in enumerate(zip(part.column(1).to_pylist(), part.column(2).to_pylist())):
                if not shared:
                    continue
                h = hasher.words((text or "").encode().split())
                at, values = anchors(hasher, h)
                pos = np.flatnonzero(_spread(at[np.isin(values, np.array(shared, np.int64).view(np.uint64))], len(h) - WINDOW + 1))
                one, two = (hasher.windows(h, WINDOW, f)[pos] for f in FACTORS)
                order = np.lexsort((pos, two, one))  # a document's first window of each kind stands for the others
                order = order[np.concatenate(([True], (np.diff(one[order]) != 0) | (np.diff(two[order]) != 0)))]
                one, two, pos = one[order], two[order], pos[order]
                yield pa.RecordBatch.from_arrays([
                    pa.array(one.view(np.int64)), pa.array((two >> np.uint64(32)).astype(np.uint32).view(np.int32)),
                    part.column(0).take(pa.array(np.full(len(pos), i))), pa.array(pos.astype(np.int32))], names=["h1", "h2", "doc_id", "pos"])


def _merged(fn: Callable) -> Callable:
    """Joins small record batches to larger ones."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for b in fn(batches):
            held.append(b)
            rows += b.num_rows
            if rows > 50_000:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, rows = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
    return run


def _later_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (h1, h2, doc_id) to (doc_id, pos) of those that follow another document's."""
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        h1, h2 = (np.asarray(b.column(i)) for i in (0, 1))
        docs = np.asarray(b.column(2))
        new = np.ones(len(h1), bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        if last is not None and last[:2] == (h1[0], h2[0]):
            new[0] = False
        starts = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        first = np.where(group >= 0, docs[starts[np.maximum(group, 0)]] if len(starts) else docs, last[2] if last is not None else docs[0])
        later = np.flatnonzero(docs > first)
        last = (h1[-1], h2[-1], first[-1])
        if len(later):
            yield pa.RecordBatch.from_arrays([b.column(2).take(pa.array(later)), b.column(3).take(pa.array(later))], names=["doc_id", "pos"])


def kept_words(words: list[bytes], starts: list[int] | None, hasher: Hasher) -> tuple[list[bytes], int]:
    """The words that no window equal to one at ``starts`` covers, and how many such windows cover."""
    if not starts:
        return words, 0
    d = np.zeros(len(words) + 1, np.int64)
    h = hasher.words(words)
    one, two = (hasher.windows(h, WINDOW, f) for f in FACTORS)
    kind = one ^ (two << np.uint64(1))
    s = np.flatnonzero(np.isin(kind, kind[np.array([x for x in starts if x < len(kind)], np.int64)]))
    np.add.at(d, s, 1)
    np.add.at(d, np.minimum(len(words), s + WINDOW), -1)
    gone = np.cumsum(d[:-1]) > 0
    return [w for w, g in zip(words, gone.tolist()) if not g], int(gone.sum())


def removals(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """(doc_id, starts): where a document's windows begin first that also start in a document with a smaller id."""
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.where("doc_id is not null and text is not null").select("doc_id", "text").mapInArrow(_merged(_anchor_rows), f"anchor bigint, doc_id {kind}")
    shared = materialise(rows.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor", (F.col("n") > hot).alias("is_hot")), "anchors_shared")
    own = rows.join(shared, "anchor").groupBy("doc_id").agg(F.collect_set(F.when(~F.col("is_hot"), F.col("anchor"))).alias("plain"), F.collect_set(F.when(F.col("is_hot"), F.col("anchor"))).alias("hot"))
    own = materialise(own, "anchors_of")
    columns = f"h1 bigint, h2 int, doc_id {kind}, pos int"
    plain = docs.join(own, "doc_id", "left").select("doc_id", "text", "plain").mapInArrow(_merged(_window_rows), columns)
    later = plain.repartition("h1", "h2").sortWithinPartitions("h1", "h2", "doc_id").mapInArrow(_later_windows, f"doc_id {kind}, pos int")
    if not shared.where("is_hot").isEmpty():
        many = materialise(docs.join(own.where("size(hot) > 0"), "doc_id").select("doc_id", "text", "hot").mapInArrow(_merged(_window_rows), columns), "windows_hot")
        first = materialise(many.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last"), "windows_first")
        later = later.unionByName(many.join(first, ["h1", "h2"]).where("doc_id > first").select("doc_id", "pos"))
    return later.groupBy("doc_id").agg(F.collect_set("pos").alias("starts"))


def remove_repeats(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept), one row per row of ``docs`` (doc_id, text); ``kept`` is the text left.

    A word goes if a window of 50 words that covers it also starts in a document with a smaller id; windows are those of the
    input. Words are cut at ASCII white space and kept unchanged, joined by one space. NULL texts have no words. Rows without
    id lose nothing and count for no one. Rows that repeat an id share what is removed, by position, from equal texts; ids
    are meant to be unique. Documents under 50 words lose nothing; an empty table gives no rows.
    """
    kind = dict(docs.dtypes)["doc_id"]
    docs = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            for part in slices(batch):
                n, gone, sha, kept = [], [], [], []
                for text, starts in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    words = (text or "").encode().split()
                    left, removed = kept_words(words, starts, hasher)
                    joined = b" ".join(left)
                    n.append(len(words)), gone.append(removed), sha.append(hashlib.sha256(joined).hexdigest()), kept.append(joined.decode())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.string())],
                                                 names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return docs.join(removals(docs, hot), "doc_id", "left").select("doc_id", "text", "starts").mapInArrow(
        run, f"doc_id {kind}, n_words bigint, n_removed bigint, kept_sha256 string, kept string")
