"""Periodic runs of words, found through string synchronising sets.

A run is a maximal stretch of words with smallest period q that holds its period twice at least. Periods are searched scale
by scale, t = 4, 8, 16, ... for q from 3t - 1 to 6t - 2; smaller periods (up to 10) are compared word by word.

* **Synchronising set.** Position i is in the set of scale t if the smallest hash among the t-word windows that start at
  i .. i + t, leaving out windows with a period of t / 3 or less, is that of the first or the last of them. Membership
  depends only on the 2t words from i on. So if a run has a position of the set early in its first period, the position one
  period later is in the set as well and its 2t words are equal: **equal contexts propose the period**. Equal contexts are
  over t / 3 apart, so a position meets at most 18 others in reach.
* **Highly periodic regions.** A run without such a position has a first period that itself has a period of t / 3 or less.
  Then two shorter runs of that period, one after the other, make it up. Shorter runs are known from smaller scales, and
  each end of one where another begins proposes the omitted periods.
* **Extension.** A proposal is extended both ways over hashes of windows of 1, 2, 4, ... words and kept if it reaches two
  periods; equal stretches keep their smallest period.

Word numbers are exact (a dictionary); windows stand as 64-bit hashes. All documents of a batch are one sequence with a word
of its own after each, which no run can cross; so the steps are array operations over many documents at once.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from marketripple.llm.common import slices

#: The smallest scale, and the periods below it, which are compared directly: 3 * SCALE - 2.
SCALE = 4
DIRECT = 3 * SCALE - 2
#: Bytes of text that are searched as one sequence; a longer text is one by itself.
SEQUENCE_BYTES = 1_000_000
_OUT = ("n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, "
        "collapsed_sha256 string, runs string, collapsed string")
_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mix(x: np.ndarray) -> np.ndarray:
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


class Windows:
    """Hashes of all windows of 1, 2, 4, ... words of a sequence, and common extensions of two positions by them."""

    def __init__(self, ids: np.ndarray, longest: int):
        self.n = len(ids)
        self.levels = [_mix(ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))]
        while 2 << (len(self.levels) - 1) <= max(longest, 2 * SCALE):
            h, w = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(_mix(h[:-w] * np.uint64(0xC2B2AE3D27D4EB4F) + h[w:]) if len(h) > w else h[:0])

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from ``i`` and ``j`` on are equal."""
        i, j, start = i.copy(), j.copy(), i
        for k in range(len(self.levels) - 1, -1, -1):
            h = self.levels[k]
            go = np.flatnonzero(np.maximum(i, j) < len(h))
            go = go[h[i[go]] == h[j[go]]]
            i[go] += 1 << k
            j[go] += 1 << k
        return i - start

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words before ``i`` and ``j`` are equal."""
        i, j, start = i.copy(), j.copy(), i
        for k in range(len(self.levels) - 1, -1, -1):
            h, w = self.levels[k], 1 << k
            go = np.flatnonzero(np.minimum(i, j) >= w)
            go = go[h[i[go] - w] == h[j[go] - w]]
            i[go] -= w
            j[go] -= w
        return start - i


def _stretches(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], same, [False])).astype(np.int8)))
    return edge[::2], edge[1::2]


def _sync(h: np.ndarray, t: int, runs: np.ndarray) -> np.ndarray:
    """The synchronising set of scale ``t``; ``h`` are the hashes of t-word windows, ``runs`` (start, end, period) so far."""
    n = len(h) - t
    if n < 1:
        return np.zeros(0, np.int64)
    part = runs[(runs[:, 2] * 3 <= t) & (runs[:, 1] - runs[:, 0] >= t)]
    d = np.zeros(len(h) + 1, np.int64)
    np.add.at(d, part[:, 0], 1)
    np.add.at(d, part[:, 1] - t + 1, -1)
    ids = np.where(np.cumsum(d[:-1]) > 0, _ONES, h)
    low, w = ids, 1
    while w < t:  # smallest of t windows, by doubling
        low = np.minimum(low[:-w], low[w:])
        w *= 2
    low = np.minimum(low[:n], ids[t:])
    return np.flatnonzero((low != _ONES) & ((low == ids[:n]) | (low == ids[t:])))


def _equal_contexts(at: np.ndarray, context: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of positions with equal contexts whose distance is a period of the scale."""
    order = np.lexsort((at, context))
    at, context = at[order], context[order]
    first, second = [], []
    live, step = np.arange(len(at)), 1
    while len(live):
        live = live[live + step < len(at)]
        far = at[np.minimum(live + step, len(at) - 1)] - at[live]
        go = (context[live] == context[np.minimum(live + step, len(at) - 1)]) & (far <= 6 * t - 2)
        live, far = live[go], far[go]
        hit = live[far >= 3 * t - 1]
        first.append(at[hit])
        second.append(at[hit + step])
        step += 1
    return (np.concatenate(first), np.concatenate(second)) if first else (at[:0], at[:0])


def _joined_regions(runs: np.ndarray, windows: Windows, t: int) -> tuple[np.ndarray, np.ndarray]:
    """Proposals where a run with a period of t / 3 or less ends and another of that period begins."""
    some = runs[(runs[:, 2] * 3 <= t) & (runs[:, 1] - runs[:, 0] >= 3 * t - 1)]
    some = some[np.lexsort((some[:, 0], some[:, 2]))]
    a, b = some[:-1], some[1:]
    meet = (a[:, 2] == b[:, 2]) & (b[:, 0] <= a[:, 1]) & (b[:, 0] > a[:, 1] - a[:, 2])
    a, b = a[meet], b[meet]
    most = np.minimum(6 * t - 2, np.minimum(a[:, 1] - a[:, 0], b[:, 1] - b[:, 0]))
    count = np.maximum(0, most - (3 * t - 1) + 1)
    end = np.repeat(a[:, 1], count)
    q = 3 * t - 1 + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    h = windows.levels[t.bit_length() - 1]
    ok = (end < len(h)) & (end - q >= 0)
    end, q = end[ok], q[ok]
    ok = h[end] == h[end - q]
    return end[ok] - q[ok], end[ok]


def find_runs(ids: np.ndarray, longest: int | None = None) -> np.ndarray:
    """(start, end, period) of all runs that hold their period twice, sorted by start, then period.

    ``ids`` are word numbers; ``longest`` bounds the length of a run (the longest document).
    """
    n = len(ids)
    longest = n if longest is None else longest
    windows = Windows(ids, longest)
    found = []

    def distinct(rows: list[np.ndarray]) -> np.ndarray:
        r = np.concatenate(rows) if rows else np.zeros((0, 3), np.int64)
        r = r[np.lexsort((r[:, 2], r[:, 1], r[:, 0]))]
        new = np.ones(len(r), bool)
        new[1:] = (np.diff(r[:, 0]) != 0) | (np.diff(r[:, 1]) != 0)
        return r[new]  # the smallest period of each stretch

    for q in range(1, min(DIRECT, longest // 2) + 1):
        s, e = _stretches(ids[q:] == ids[:-q])
        ok = e - s >= q
        found.append(np.column_stack((s[ok], e[ok] + q, np.full(ok.sum(), q))).astype(np.int64))
    runs, t = distinct(found), SCALE
    while 2 * (3 * t - 1) <= longest:
        k = t.bit_length() - 1
        context = windows.levels[k + 1]
        at = _sync(windows.levels[k], t, runs)
        i, j = _equal_contexts(at, context[at], t)
        i2, j2 = _joined_regions(runs, windows, t)
        i, j = np.concatenate((i, i2)), np.concatenate((j, j2))
        if len(i):
            q = j - i
            s = i - windows.backward(i, j)
            e = j + windows.forward(i, j)
            ok = e - s >= 2 * q
            runs = distinct([runs, np.column_stack((s[ok], e[ok], q[ok]))])
        t *= 2
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def turned(words: list, key: str | None) -> list:
    """The words of a document, one in ten of which repeats a stretch to its end: CRC-32 of the id decides which and how."""
    h = zlib.crc32(key.encode()) if key is not None else 1
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a:a + p] * (1 + (n - a) // p))[:n - a]


def document_runs(documents: list[list[bytes]], least: int = 12) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each document its runs of ``least`` words or more (start, end, period) and which words collapsing keeps."""
    sizes = np.fromiter(map(len, documents), np.int64, len(documents))
    at = np.cumsum(sizes + 1) - sizes - 1
    flat = pa.array([w for d in documents for w in d], pa.binary()).dictionary_encode()
    ids = np.zeros(int((sizes + 1).sum()), np.int64)
    ends = at + sizes
    place = np.ones(len(ids), bool)
    place[ends] = False
    ids[place] = flat.indices.to_numpy()
    ids[ends] = len(flat.dictionary) + np.arange(len(documents))
    runs = find_runs(ids, int(sizes.max(initial=0)))
    runs = runs[runs[:, 1] - runs[:, 0] >= least]
    d = np.zeros(len(ids) + 1, np.int64)
    np.add.at(d, runs[:, 0] + runs[:, 2], 1)
    np.add.at(d, runs[:, 1], -1)
    kept = np.cumsum(d[:-1]) == 0
    cut = np.searchsorted(runs[:, 0], np.append(at, len(ids)))
    return [(runs[a:b] - np.array([s, s, 0]), kept[s:s + n]) for a, b, s, n in zip(cut[:-1], cut[1:], at.tolist(), sizes.tolist())]


def _sequences(texts: list[list]) -> Iterator[list[list]]:
    held, size = [], 0
    for words in texts:
        n = sum(map(len, words)) + len(words)
        if held and size + n > SEQUENCE_BYTES:
            yield held
            held, size = [], 0
        held.append(words)
        size += n
    if held:
        yield held


def _described(words: list[bytes], runs: np.ndarray, kept: np.ndarray) -> tuple:
    start, length, period = runs[:, 0].tolist(), (runs[:, 1] - runs[:, 0]).tolist(), runs[:, 2].tolist()
    lines = "".join([f"{s},{n},{q}\n" for s, n, q in zip(start, length, period)])
    left = b" ".join(words if kept.all() else [w for w, k in zip(words, kept.tolist()) if k])
    i = length.index(max(length)) if length else None
    top = (None,) * 4 if i is None else (start[i], length[i], period[i], 1000 * length[i] // period[i])
    return (len(runs), *top, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(left).hexdigest(), lines, left.decode())


def periodic_runs(docs: DataFrame, prepare: Callable[[list, str | None], list] = turned, least: int = 12, id_column: str = "doc_id", column: str = "text") -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256, runs, collapsed), one row a row.

    Words are cut at ASCII white space; ``prepare(words, id as text)`` may change them before the search (the contract's
    turned stretches; pass ``lambda words, key: words`` for texts as they are). A run is a maximal stretch with smallest period q and
    at least max(``least``, 2 q) words. The longest run is reported, the first and then the one with the smallest period among
    equals. ``runs`` lists all as ``start,length,period`` lines; ``collapsed`` is the text without words that a run holds after
    its first period. NULL, empty and wordless texts have no runs (NULLs) and collapse to the empty text; rows without id are
    searched as they are; repeated rows each get a row; an empty table gives no rows; other columns are ignored. Memory grows
    with the longest single text.
    """
    rows = docs.select(F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{id_column}`").cast("string").alias("key"), F.col(f"`{column}`").alias("text"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {_OUT}"
    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                words = [prepare((t or "").encode().split(), key) for key, t in zip(part.column(1).to_pylist(), part.column(2).to_pylist())]
                made = [_described(d, runs, kept) for some in _sequences(words) for d, (runs, kept) in zip(some, document_runs(some, least))]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(target.field(0).type), *[pa.array(c, f.type) for c, f in zip(zip(*made), list(target)[1:])]], names=target.names)

    return rows.mapInArrow(run, schema)
