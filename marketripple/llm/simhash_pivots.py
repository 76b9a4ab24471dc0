"""SimHash near-duplicates by pivot distance tables.

Every distinct fingerprint gets its Hamming distances to ``PIVOTS`` reference fingerprints, rows of a Hadamard matrix, once;
the table is written. The triangle inequality bounds a pair's distance from below by its largest coordinate difference, and
the table is used twice:

* **Bands.** Distances to a reference are cut in bands of eight. Fingerprints within three bits lie in one band, or in
  neighbouring ones near their border, so a fingerprint joins its own band and, within three of its upper border, the next.
  Bands alone would be too wide for a shuffle key. They are refined by blocks of bits: of six blocks three agree whole, so
  each of the 20 triples of blocks, with the band of a reference of its own, is a key; every link shares one.
* **Filter.** Inside a key's rows, pairs whose distances to any reference differ by more than three are discarded, and the
  survivors are verified on the fingerprints themselves.

A key with more than ``most`` rows is split by the triples of its free bits, exactly and at most twice, after which at most
512 fingerprints can share a key. A key's rows give a spanning forest (one link per reached fingerprint), never all pairs.
Exact copies are one fingerprint from the start.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketripple.llm.common import components, per_text
from marketripple.session import materialise

BITS, FAMILIES, SEED = 64, 6, 42


def fingerprint(text: str | None, width: int = 3, seed: int = SEED) -> bytes:
    """Eight bytes, most significant first; zero for a text without words (or NULL)."""
    words = (text or "").encode().lower().split()
    n = len(words)
    if not n:
        return bytes(8)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    w = min(width, n)
    digest = xxhash.xxh64_digest
    a, b = starts[: n - w + 1].tolist(), ends[w - 1:].tolist()
    counts, step = np.zeros(BITS, np.int64), 1 << 16
    for k in range(0, len(a), step):  # long texts in blocks
        h = b"".join([digest(joined[i:j], seed) for i, j in zip(a[k:k + step], b[k:k + step])])
        counts += np.unpackbits(np.frombuffer(h, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > len(a)).tobytes()


def fingerprints(docs: DataFrame, keep: list[str], column: str = "text") -> DataFrame:
    """Adds ``fingerprint`` (16 hex digits) and ``fp`` (the same bits as a signed long)."""
    def make():
        def run(texts: list) -> list:
            f = [fingerprint(t) for t in texts]
            return [[x.hex() for x in f], [int.from_bytes(x, "big", signed=True) for x in f]]
        return run
    return per_text(docs, make, keep, "fingerprint string, fp bigint", column)


#: Reference fingerprints and the width of a band of distances to one of them.
PIVOTS, BAND = 16, 8
REFERENCES = np.array([sum(1 << j for j in range(BITS) if (i & j).bit_count() & 1) for i in range(1, PIVOTS + 1)], np.uint64)


def distances(fp: np.ndarray) -> np.ndarray:
    """(fingerprints x references); one byte each."""
    return np.bitwise_count(fp[:, None] ^ REFERENCES[None, :]).astype(np.int8)


def pivot_table(distinct: DataFrame) -> DataFrame:
    """(fp, d): the distances of each fingerprint as ``PIVOTS`` bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = distances(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            yield pa.RecordBatch.from_arrays([b.column(0), _packed(d)], names=["fp", "d"])
    return materialise(distinct.select("fp").mapInArrow(run, "fp bigint, d binary"), "fp_pivots")


def _packed(d: np.ndarray) -> pa.Array:
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(PIVOTS), len(d), [None, pa.py_buffer(np.ascontiguousarray(d).tobytes())]).cast(pa.binary())


def _unpacked(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int8).reshape(-1, PIVOTS)


def _triples(free: list[int]) -> list[list[int]]:
    """The bits of every three of six runs of ``free``."""
    runs = [list(map(int, r)) for r in np.array_split(free, FAMILIES)]
    return [sum(t, []) for t in combinations(runs, 3)]


def pattern(path: tuple[int, ...]) -> list[int]:
    """Bits that are compared after choosing triple path[0], then triple path[1] of those left, and so on."""
    chosen: list[int] = []
    for step in path:
        chosen = chosen + _triples([i for i in range(BITS) if i not in chosen])[step]
    return chosen


N_TRIPLES = 20


def _keys(level: int, most_bits: int):
    """Rows (path, fp, d) of a level to rows (path, key, band, fp, d) of the next: each triple's bits, each band in reach."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks: dict[int, list[np.uint64]] = {}
        for batch in batches:
            path = batch.column(0).to_numpy(zero_copy_only=False)
            for p in np.unique(path).tolist():
                if p not in masks:
                    steps = tuple((p // N_TRIPLES ** i) % N_TRIPLES for i in range(level))
                    masks[p] = [np.uint64(sum(1 << i for i in pattern((*steps, k)))) for k in range(N_TRIPLES)]
                mine = np.flatnonzero(path == p)
                fp = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)[mine]
                packed = batch.column(2).take(pa.array(mine))
                d = _unpacked(packed)
                for k, mask in enumerate(masks[p]):
                    own = d[:, (k + level) % PIVOTS].astype(np.int32)
                    for at, band in ((np.arange(len(fp)), own // BAND), (near := np.flatnonzero((own + most_bits) // BAND > own // BAND), own[near] // BAND + 1)):
                        yield pa.RecordBatch.from_arrays([
                            pa.array(np.full(len(at), p + k * N_TRIPLES ** level, np.int32)), pa.array((fp[at] & mask).view(np.int64)), pa.array(band.astype(np.int32)),
                            pa.array(fp[at].view(np.int64)), packed.take(pa.array(at))], names=["path", "key", "band", "fp", "d"])
    return run


def survivors(d: np.ndarray, i: int, left: np.ndarray, most_bits: int) -> np.ndarray:
    """Which of ``left`` no reference tells from ``i``: no coordinate differs by more than ``most_bits``."""
    at = np.arange(len(left))
    for some in (slice(0, 4), slice(4, PIVOTS)):  # a few references discard most
        at = at[(np.abs(d[left[at], some] - d[i, some]) <= most_bits).all(axis=1)]
    return at


def forest(fp: np.ndarray, d: np.ndarray, most_bits: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Links (a, b) that connect what is connected by pairs of at most ``most_bits`` differing bits, one per reached word,
    and the number of pairs that were verified."""
    left, a, b, verified = np.arange(1, len(fp)), [], [], 0
    queue = [0]
    while len(left):
        i = queue.pop() if queue else None
        if i is None:
            i, left = left[0], left[1:]
        near = survivors(d, i, left, most_bits)
        verified += len(near)
        near = near[np.bitwise_count(fp[left[near]] ^ fp[i]) <= most_bits]
        if len(near):
            found = left[near]
            a.append(np.full(len(found), fp[i])), b.append(fp[found])
            queue.extend(found.tolist())
            left = np.delete(left, near)
    return (np.concatenate(a), np.concatenate(b), verified) if a else (fp[:0], fp[:0], verified)


def _links(most_bits: int):
    """Rows (path, key, band, fp, d) sorted by path, key and band to links; a key's rows may span batches."""
    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        rest = None
        for batch in batches:
            cols = [*[batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)], _unpacked(batch.column(4))]
            if rest is not None:
                cols = [np.concatenate(x) for x in zip(rest, cols)]
            if not len(cols[0]):
                continue
            cut = np.flatnonzero((np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0) | (np.diff(cols[2]) != 0)) + 1
            last = cut[-1] if len(cut) else 0
            if last:
                yield cols[3][:last].view(np.uint64), cols[4][:last], np.concatenate(([0], cut))
            rest = [x[last:] for x in cols]
        if rest is not None and len(rest[0]):
            yield rest[3].view(np.uint64), rest[4], np.array([0, len(rest[3])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for fp, d, cuts in groups(batches):
            sizes = np.diff(cuts)
            two = cuts[:-1][sizes == 2]
            two = two[(np.abs(d[two] - d[two + 1]) <= most_bits).all(axis=1)]
            two = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= most_bits]
            found = [(fp[two], fp[two + 1])] + [forest(fp[s:s + n], d[s:s + n], most_bits)[:2] for s, n in zip(cuts[:-1][sizes > 2], sizes[sizes > 2])]
            a, b = (np.concatenate(z).view(np.int64) for z in zip(*found))
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["src", "dst"])
    return run


def fingerprint_links(distinct: DataFrame, most_bits: int = 3, most: int = 4096) -> DataFrame:
    """Links (src, dst) among distinct fingerprints ``fp`` that connect the same words as all pairs within ``most_bits`` (3 at most)."""
    assert 0 <= most_bits <= 3, "three of six blocks agree only up to three differing bits"
    assert most_bits < BAND
    rows, parts, group = pivot_table(distinct).select(F.lit(0).alias("path"), "fp", "d"), [], ["path", "key", "band"]
    for level in range(3):
        keyed = rows.mapInArrow(_keys(level, most_bits), "path int, key bigint, band int, fp bigint, d binary")
        hot = materialise(keyed.groupBy(*group).count().where(F.col("count") > most).select(*group), "hot_keys") if level < 2 else None
        more = hot is not None and not hot.isEmpty()
        even = keyed.join(hot, group, "left_anti") if more else keyed
        parts.append(even.repartition(*group).sortWithinPartitions(*group).mapInArrow(_links(most_bits), "src bigint, dst bigint"))
        if not more:
            break
        rows = materialise(keyed.join(hot, group, "left_semi").select("path", "fp", "d").distinct(), "hot_rows")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def near_duplicates(docs: DataFrame, most_bits: int = 3, id_column: str = "doc_id", column: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per row of ``docs``.

    Words are cut at ASCII white space with A-Z lower-cased; a fingerprint bit is set if over half of the XXH64 of the
    3-word shingles have it. Fingerprints within ``most_bits`` are linked; ``component_id`` is the smallest id reachable.
    NULL and wordless texts have fingerprint zero and link as any other. Repeated rows each get a row. A row without id
    gets the smallest id of its component (NULL if that has none). An empty table gives no rows; other columns are ignored.
    """
    fps = materialise(fingerprints(docs, [id_column], column), "fingerprints")
    low = materialise(fps.groupBy("fp").agg(F.min(id_column).alias("low")), "fp_low")
    comps = components(materialise(fingerprint_links(low.select("fp"), most_bits), "fp_links"))
    named = materialise(low.join(comps.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("component", "fp").alias("component")), "fp_named")
    least = materialise(named.groupBy("component").agg(F.min("low").alias("component_id")), "fp_least")
    of_fp = materialise(named.join(least, "component").select("fp", "component_id"), "fp_component")
    return fps.join(of_fp, "fp", "left").select(id_column, "fingerprint", "component_id")

