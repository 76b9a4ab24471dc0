"""Document fingerprints by content-defined chunks.

A gear hash rolls over a text's UTF-8 bytes; a chunk ends where the hash has its mask bits zero, with a strict mask up to
the normal size and a loose one beyond it (normalised chunking), so sizes gather around the normal size and an edit moves
only the boundaries near it. A fingerprint is the sorted set of chunk records, ten hex digits of the chunk's XXH3 and two
of its length. Containment of one fingerprint in another is the length of the shared chunks over its own.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketripple.llm.common import slices

LEAST, NORMAL, MOST = 16, 64, 256
WINDOW = 32
STRICT, LOOSE = np.uint32(0xFF << 24), np.uint32(0xF << 28)
GEAR = np.array([xxhash.xxh32_intdigest(bytes([b]), 0x9E37) for b in range(256)], np.uint32)
RECORD = 12
#: Bytes hashed at once.
BLOCK = 1 << 20


def _cut_points(data: bytes, start: int) -> tuple[list[int], list[int]]:
    """Ends after which the gear hash fits the strict and the loose mask, from ``start`` on."""
    strict, loose = [], []
    for at in range(start, len(data), BLOCK):
        low = max(0, at - WINDOW + 1)
        h = GEAR[np.frombuffer(data, np.uint8, min(len(data), at + BLOCK) - low, low)]
        width = 1
        while width < WINDOW:  # h covers ``width`` bytes; twice as many in each step
            h[width:] += h[:-width] << np.uint32(width) if len(h) > width else h[:0]
            width *= 2
        h = h[at - low:]
        hit = np.flatnonzero(h & LOOSE == 0)
        loose += (hit + at + 1).tolist()
        strict += (hit[h[hit] & STRICT == 0] + at + 1).tolist()
    return strict, loose


def chunk_ends(data: bytes, known: list[int] | None = None) -> list[int]:
    """Ends of the chunks; ``known`` are leading ends that hold already."""
    ends = list(known or [])
    start, n = (ends[-1] if ends else 0), len(data)
    strict, loose = _cut_points(data, start) if start < n else ([], [])
    while start < n:
        i = bisect_left(strict, start + LEAST)
        if i < len(strict) and strict[i] < start + NORMAL:
            end = strict[i]
        else:
            j = bisect_left(loose, start + NORMAL)
            end = min(loose[j] if j < len(loose) else n, start + MOST, n)
        ends.append(end)
        start = end
    return ends


def records(data: bytes, ends: list[int]) -> set[str]:
    return {xxhash.xxh3_64_hexdigest(data[a:b])[:RECORD - 2] + f"{b - a - 1:02x}" for a, b in zip([0, *ends], ends)}


def fingerprint(text: str | None) -> str:
    """Sorted chunk records in one string; empty for an empty text or NULL."""
    data = (text or "").encode()
    return "".join(sorted(records(data, chunk_ends(data))))


def split_records(fp: str) -> set[str]:
    return {fp[i:i + RECORD] for i in range(0, len(fp), RECORD)}


def containment(a: set[str], b: set[str]) -> float:
    """Share of ``a``'s length that ``b`` has too; two empty sets are alike, an empty and another are not."""
    if not a:
        return float(not b)
    return sum(int(r[-2:], 16) + 1 for r in a & b) / sum(int(r[-2:], 16) + 1 for r in a)


OUT = "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


class _Doc:
    def __init__(self, bucket: int, tail: int, key, text: str | None):
        self.bucket, self.tail, self.key, self.text = bucket, tail, key, text or ""
        self.data = self.text.encode()
        self.ends = chunk_ends(self.data)
        self.set = records(self.data, self.ends)

    def row(self, other: "_Doc") -> tuple:
        n = len(self.text)
        head = self.text[: n - n // 3]
        stem = head.encode()
        data = stem + other.text[: n // 3].encode()
        edited = records(data, chunk_ends(data, self.ends[: bisect_left(self.ends, len(stem) + 1)]))
        return (self.key, n, hashlib.sha256(data).hexdigest(), "".join(sorted(self.set)), "".join(sorted(edited)),
                containment(self.set, edited), containment(self.set, other.set))


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of sorted (bucket, tail, doc_id, text): each document with the one that follows it in its bucket."""
    first = last = None
    for batch in batches:
        for part in slices(batch):
            for values in zip(*(part.column(i).to_pylist() for i in range(4))):
                now = _Doc(*values)
                if last is not None and last.bucket == now.bucket:
                    if not last.tail:
                        yield last.row(now)
                else:
                    if last is not None and not last.tail:
                        yield last.row(first)
                    first = now
                last = now
    if last is not None and not last.tail:
        yield last.row(first)


def compare_with_next(docs: DataFrame, id_column: str = "doc_id", ranges_per_partition: int = 8) -> DataFrame:
    """Fingerprints of every text and of its edit with the next document in descending id order (after the last: the first).

    The edit replaces the last floor(n_chars / 3) code points by the first as many, or all, of the next text. Rows without
    id come last; equal ids are ordered by text. NULL texts are empty. One document alone is its own next; an empty table
    gives no rows; other columns are ignored. ``near_edited`` and ``near_next`` are containments of the document's own
    fingerprint.

    Ids are cut into ranges at quantiles, and texts move once, to their range; the first document of a range goes to the
    range before it as well, as the end of that one's chain.
    """
    spark = docs.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) * ranges_per_partition)
    kind = dict(docs.select(F.col(f"`{id_column}`").alias("doc_id")).dtypes)["doc_id"]
    share = [i / n for i in range(1, n)]
    got = docs.select(F.col(f"`{id_column}`").alias("doc_id")).agg(F.percentile_approx("doc_id", share or [0.5], 20 * n).alias("q"), F.max("doc_id").alias("top")).first()
    tops = np.unique(np.array([*(got.q or []), got.top], np.int64)) if got.top is not None else np.zeros(0, np.int64)  # the largest id of each range

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0)
            null = np.asarray(ids.is_null())
            v = np.asarray(ids.fill_null(0)).astype(np.int64)
            bucket = np.where(null, 0, np.searchsorted(tops, v, "left")).astype(np.int32)
            ends = np.flatnonzero(~null & np.isin(v, tops))  # first of its range: ends the chain of the range above
            yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(np.zeros(len(v), np.int32)), ids, b.column(1)], names=["bucket", "tail", "doc_id", "text"])
            if len(ends):
                take = b.take(pa.array(ends))
                up = ((bucket[ends] + 1) % len(tops)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(up), pa.array(np.ones(len(ends), np.int32)), take.column(0), take.column(1)], names=["bucket", "tail", "doc_id", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for r in _pairs(batches):
            rows.append(r)
            size += len(r[3]) + len(r[4]) + 200
            if size > 8_000_000:
                yield pack(rows)
                rows, size = [], 0
        if rows:
            yield pack(rows)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType
    out = f"doc_id {kind}, {OUT}"
    target = to_arrow_schema(StructType.fromDDL(out))

    def pack(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), target)], names=target.names)

    dealt = docs.select(F.col(f"`{id_column}`").alias("doc_id"), F.col("text")).mapInArrow(deal, f"bucket int, tail int, doc_id {kind}, text string")
    ordered = dealt.repartition("bucket").sortWithinPartitions("bucket", "tail", F.col("doc_id").desc_nulls_last(), "text")
    return ordered.mapInArrow(run, out)
