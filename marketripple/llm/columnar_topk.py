"""Exact top-k inner products by branch and bound over vertical blocks of dimensions.

Vectors are packed into tiles of a few thousand; a tile holds its vectors column by column, cut into blocks of dimensions,
and for every block boundary each vector's remaining mass, the norm of the components that are still to come. A query adds
up its partial scores block by block. What is left of a score lies within plus or minus the product of the two remaining
masses, so after each block

* the k-th largest lower bound, or the best score known before, is a bar that the result cannot fall below, and
* candidates whose upper bound is below the bar are gone: the survivors are compacted before the next block is read.

Queries are packed with the tile that holds them. Each tile is first searched by its own queries, which gives them a bar;
then every block of queries visits all other tiles, a tile meeting the query blocks of a range of tiles in one task. So
traffic is blocks against tiles, never rows against rows, and a task holds one tile and one block of queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketripple.session import materialise

#: Vectors of a tile, dimensions of a block, tiles whose queries visit a tile in one task.
TILE, BLOCK, RANGE = 8192, 8, 64
#: Queries whose first block is multiplied at once.
AT_ONCE = 256


class Tile:
    """Vectors (n x dimensions, whole numbers) in vertical blocks with their remaining masses."""

    def __init__(self, vectors: np.ndarray, block: int = BLOCK):
        n, dims = vectors.shape
        self.n, self.cuts = n, list(range(0, dims, block)) or [0]
        v = vectors.T.astype(float)
        self.blocks = [np.ascontiguousarray(v[c:c + block]) for c in self.cuts]
        squares = np.array([(b * b).sum(axis=0) for b in self.blocks])
        left = np.cumsum(squares[::-1], axis=0)[::-1]  # from a block on
        self.left = np.sqrt(np.concatenate((left, np.zeros((1, n))))) * (1 + 1e-9)
        self.rows_met = 0  # candidates read by all blocks together, for tests


def search(tile: Tile, queries: np.ndarray, own: np.ndarray, bars: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, positions, scores) of each query's candidates that can be among its ``k`` best.

    ``own`` is the query's position in the tile, or -1; ``bars`` are scores that the k-th best is known to reach.
    """
    q = queries.astype(float)
    parts = [q[:, c:c + b.shape[0]] for c, b in zip(tile.cuts, tile.blocks)]
    squares = np.array([(p * p).sum(axis=1) for p in parts])
    left = np.sqrt(np.concatenate((np.cumsum(squares[::-1], axis=0)[::-1], np.zeros((1, len(q)))))) * (1 + 1e-9)
    for start in range(0, len(q), AT_ONCE):
        first = parts[0][start:start + AT_ONCE] @ tile.blocks[0]
        for i, part in enumerate(first, start):
            alive, bar = np.arange(tile.n), bars[i]
            if own[i] >= 0:
                alive, part = np.delete(alive, own[i]), np.delete(part, own[i])
            for b in range(1, len(tile.blocks) + 1):
                tile.rows_met += len(alive)
                slack = left[b, i] * tile.left[b, alive] + (b < len(tile.blocks)) * 1e-6
                if len(part) >= k:
                    bar = max(bar, np.partition(part - slack, len(part) - k)[len(part) - k])
                keep = part + slack >= bar
                if not keep.all():
                    alive, part = alive[keep], part[keep]
                if b == len(tile.blocks) or not len(alive):
                    break
                part = part + parts[b][i] @ (tile.blocks[b] if len(alive) == tile.n else tile.blocks[b][:, alive])
            if len(alive):
                yield i, alive, part.astype(np.int64)


def _exact(vectors: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The same without bounds, in whole numbers of any length; scores stop at the ends of a long."""
    big = vectors.astype(object)
    for i, q in enumerate(queries.astype(object)):
        score = np.array([max(-(1 << 63), min((1 << 63) - 1, s)) for s in (big @ q if big.shape[1] else [0] * len(big))], np.int64)
        alive = np.delete(np.arange(len(big)), own[i]) if own[i] >= 0 else np.arange(len(big))
        if len(alive) > k:
            alive = alive[score[alive] >= np.partition(score[alive], len(alive) - k)[len(alive) - k]]
        yield i, alive, score[alive]


def _best(tile: Tile, vectors: np.ndarray, queries: np.ndarray, own: np.ndarray, bars: np.ndarray, k: int):
    top = [float(np.abs(x.astype(float)).max(initial=0)) for x in (vectors, queries)]
    if top[0] * top[1] * max(1, vectors.shape[1]) >= 2 ** 52:  # beyond whole numbers of a double
        return _exact(vectors, queries, own, k)
    return search(tile, queries, own, bars, k)


def _leading(at: np.ndarray, score: np.ndarray, ids: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and scores of the ``k`` best by score, then by id (NULL last)."""
    order = pa.compute.sort_indices(pa.table({"s": score, "i": ids.take(pa.array(at))}), sort_keys=[("s", "descending"), ("i", "ascending")], null_placement="at_end")
    order = order.to_numpy()[:k]
    return at[order], score[order]


def _whole_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by (tile, dims) to one table for each pair."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        tile, dims = (batch.column(i).to_numpy() for i in (0, 1))
        cuts = [0, *(np.flatnonzero((np.diff(tile) != 0) | (np.diff(dims) != 0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            part = batch.slice(a, b - a)
            if held and (held[-1].column(0)[0], held[-1].column(1)[0]) != (part.column(0)[0], part.column(1)[0]):
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def _matrix(column: pa.Scalar, n: int, dims: int) -> np.ndarray:
    return np.frombuffer(column.as_buffer(), np.int64).reshape(n, dims)


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, id_column: str = "vec_id", column: str = "embedding",
          tile: int = TILE, block: int = BLOCK, span: int = RANGE) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by ``every`` the ``k`` rows with the highest scores.

    A component x becomes floor(scale * x) and the score is the inner product of these whole numbers, exact; beyond the range
    of a long it stays at the end of the range. Every row but the query's own is a candidate; ties go to the smaller id, NULL
    last, so a row that repeats a query's id is a candidate of it, and each such row is a query. Vectors that are NULL or hold
    NULL or non-finite components take no part, and only vectors with as many components as the query meet it. Fewer than
    ``k`` candidates give as many rows; an empty table gives no rows; other columns are ignored.
    """
    usable = F.forall(F.col("v"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col(f"`{id_column}`").alias("vec_id"), F.col(f"`{column}`").cast("array<double>").alias("v")).where(F.col("v").isNotNull() & usable)
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", F.size("v").alias("dims"), F.transform("v", lambda x: F.floor(x * F.lit(float(scale))).cast("bigint")).alias("v"))
    rows = materialise(rows, "topk_rows")
    kind = rows.schema["vec_id"].dataType.simpleString()
    tiles = max(1, -(-rows.count() // tile))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_tiles(batches):
            t = t.combine_chunks()
            flat = t.column("v").chunk(0).flatten() if t.num_rows else pa.array([], pa.int64())
            yield pa.RecordBatch.from_arrays([t.column(0).chunk(0).slice(0, 1), t.column(1).chunk(0).slice(0, 1), pa.array([t.column("row").to_pylist()], pa.list_(pa.int64())),
                                              pa.ListArray.from_arrays([0, t.num_rows], t.column("vec_id").chunk(0)), pa.array([flat.to_numpy().tobytes()], pa.binary())],
                                             names=["tile", "dims", "rows", "ids", "v"])

    placed = rows.select(F.pmod(F.xxhash64("row"), F.lit(tiles)).cast("int").alias("tile"), "dims", "row", "vec_id", "v")
    packed = materialise(placed.repartition("tile").sortWithinPartitions("tile", "dims").mapInArrow(
        pack, f"tile int, dims int, rows array<bigint>, ids array<{kind}>, v binary"), "topk_tiles")

    def at_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A tile's own queries: (tile, dims, rows, v, bars) of the block and (query, vec_id, score) of what they find."""
        for batch in batches:
            for i in range(batch.num_rows):
                ids, row = batch.column(3)[i].values, batch.column(2)[i].values.to_numpy()
                n, dims = len(row), batch.column(1)[i].as_py()
                v = _matrix(batch.column(4)[i], n, dims)
                numbers = np.array([x is not None and int(x) % every == 0 for x in ids.to_pylist()], bool)
                own = np.flatnonzero(numbers)
                if not len(own):
                    continue
                bars, query, found, scores = np.full(len(own), -np.inf), [], [], []
                for j, at, score in _best(Tile(v, block), v, v[own], own, bars, k):
                    at, score = _leading(at, score, ids, k)
                    if len(at) == k:
                        bars[j] = score[-1]
                    query.append(np.full(len(at), row[own[j]])), found.append(at), scores.append(score)
                joined = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), pa.array([row[own]], pa.list_(pa.int64())), pa.ListArray.from_arrays([0, len(own)], ids.take(pa.array(own))),
                     pa.array([v[own].tobytes()], pa.binary()), pa.array([bars], pa.list_(pa.float64())), pa.array([joined(query)], pa.list_(pa.int64())),
                     pa.ListArray.from_arrays([0, sum(map(len, found))], ids.take(pa.array(joined(found).astype(np.int64)))), pa.array([joined(scores)], pa.list_(pa.int64()))],
                    names=["tile", "dims", "rows", "ids", "v", "bars", "query", "found", "score"])

    home = materialise(packed.mapInArrow(at_home, f"tile int, dims int, rows array<bigint>, ids array<{kind}>, v binary, bars array<double>, "
                                                  f"query array<bigint>, found array<{kind}>, score array<bigint>"), "topk_home")

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by (tile, part, dims, kind): a tile, then the query blocks that visit it."""
        key, here = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                now = tuple(batch.column(c)[i].as_py() for c in range(3))
                row = batch.column(4)[i].values.to_numpy()
                v = _matrix(batch.column(6)[i], len(row), now[2])
                if batch.column(3)[i].as_py() == 0:
                    key, here = now, (Tile(v, block), v, batch.column(5)[i].values)
                    continue
                if key != now:
                    continue  # no vector of the tile has as many components
                made = []
                for j, at, score in _best(here[0], here[1], v, np.full(len(row), -1), batch.column(7)[i].values.to_numpy(), k):
                    made.append((row[j], *_leading(at, score, here[2], k)))
                if made:
                    n = [len(a) for _, a, _ in made]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array([r for r, _, _ in made]), n)), here[2].take(pa.array(np.concatenate([a for _, a, _ in made]))),
                                                      pa.array(np.concatenate([s for _, _, s in made]))], names=["query", "vec_id", "score"])

    parts = -(-tiles // span)
    there = packed.select("tile", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "dims", F.lit(0).alias("kind"), "rows", "ids", "v", F.lit(None).cast("array<double>").alias("bars"))
    come = home.select(F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("to"), "tile", "dims", "rows", "v", "bars").where("`to` <> tile").select(
        F.col("to").alias("tile"), F.expr(f"tile div {span}").cast("int").alias("part"), "dims", F.lit(1).alias("kind"), "rows", F.lit(None).cast(f"array<{kind}>").alias("ids"), "v", "bars")
    met = there.unionByName(come).repartition("tile", "part").sortWithinPartitions("tile", "part", "dims", "kind").mapInArrow(visit, f"query bigint, vec_id {kind}, score bigint")
    found = home.select(F.explode(F.arrays_zip("query", "found", "score")).alias("x")).select(F.col("x.query").alias("query"), F.col("x.found").alias("vec_id"), F.col("x.score").alias("score"))
    ranked = found.unionByName(met).withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id")))).where(F.col("rank") <= k)
    names = home.select(F.explode(F.arrays_zip("rows", "ids")).alias("x")).select(F.col("x.rows").alias("query"), F.col("x.ids").alias("query_id"))
    return ranked.join(names, "query").select("query_id", "rank", "vec_id", "score")


#: DuckDB SQL of ``top_k`` with the default parameters over ``embeddings``.
TOP_SQL = """
with v as (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as e from embeddings
   where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.r, q.vec_id as query_id, c.vec_id, cast(list_dot_product(q.e, c.e) as bigint) as score from v q join v c on c.r <> q.r and len(c.e) = len(q.e) where q.vec_id % 50 = 0)
select query_id, cast(rank as int) as rank, vec_id, score from (select *, row_number() over (partition by r order by score desc, vec_id nulls last) as rank from s) where rank <= 5"""
