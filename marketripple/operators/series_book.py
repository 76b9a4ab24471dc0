"""Many books over the same names: one row per name holds its whole calendar, scenarios are read from it.

``portfolio.build_portfolio`` and ``pnl.ledger`` carry every scenario as rows, so each window and join moves
(scenarios x names x dates) rows. Here the dense panel is packed once, by one shuffle: returns, liquidity, beta and the
signals of a name are arrays over the calendar. Every step of the construction is an elementwise rule on these arrays plus
sums per date or per (date, sector), so a step is one scan that leaves one row per task, scenario and date. What reaches
the driver is bounded by scenarios x calendar x sectors. A name's arrays have the length of the calendar, which does not
grow with the names. NULL is NaN inside the arrays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketripple.functions.expr import NO_VARIANCE
from marketripple.operators.pnl import CostParams
from marketripple.operators.portfolio import ACTIVE, BookParams
from marketripple.operators.returns import session_flags
from marketripple.session import materialise

FACTS = ("r", "adtv", "beta")
#: Names that are worked on at once.
SLICE = 256


@dataclass(frozen=True)
class Loop:
    """One calibration: a signal column, smoothed over ``window`` rows, zero without a return if ``masked``."""

    column: str
    aum: float
    window: int = 1
    masked: bool = False


@dataclass(frozen=True)
class Packed:
    """(ticker, sector, r, adtv, beta, a column per signal): arrays over the calendar as bytes; a signal is NULL without the name."""

    rows: DataFrame
    length: int
    sectors: int
    signals: tuple[str, ...]


def pack(facts: DataFrame, sectors: DataFrame, calendar: DataFrame, signals: Mapping[str, tuple[DataFrame, DataFrame]]) -> Packed:
    """One row per name of ``facts`` (idx, ticker, r, adtv, beta; every calendar row) that a signal holds.

    ``signals``: per column its names (ticker) and its values (idx, ticker, z); absent values are 0. ``sectors`` gives
    (ticker, sector); names without one share one sector.
    """
    length = calendar.agg(F.max("idx")).first()[0] + 1
    known = sorted(r.sector for r in sectors.select("sector").where("sector is not null").distinct().collect())
    code = F.coalesce(F.array_position(F.array(*[F.lit(s) for s in known]).cast("array<string>"), F.col("sector")), F.lit(0)).cast("int")
    none = F.lit(None).cast("double")
    tagged = lambda d, of, idx, *v: d.select("ticker", F.lit(of).alias("of"), idx.cast("int").alias("idx"), *[c.cast("double").alias(n) for c, n in zip((*v, none, none, none)[:3], "abc")])
    parts = [tagged(facts, -1, F.col("idx"), *[F.col(c) for c in FACTS]), tagged(sectors, -2, code)]
    for i, (names, values) in enumerate(signals.values()):
        parts += [tagged(names.select("ticker").distinct(), i, F.lit(-1)), tagged(values, i, F.col("idx"), F.col("z"))]
    rows = reduce(DataFrame.unionByName, parts).repartition("ticker").sortWithinPartitions("ticker")
    columns, n = [*FACTS, *signals], len(signals)

    def name(ticker: str, t: pa.Table) -> list | None:
        of, idx = t.column("of").to_numpy(), t.column("idx").to_numpy()
        v = [t.column(c).to_numpy() for c in "abc"]
        own = np.flatnonzero(of == -1)
        if not len(own) or not (of >= 0).any():
            return None
        if len(own) != length or len(np.unique(idx[own])) != length:
            raise ValueError(f"{ticker} has {len(own)} rows for {length} dates")
        at = own[np.argsort(idx[own])]
        out = [x[at].astype(np.float64).tobytes() for x in v]
        for i in range(n):
            mine = np.flatnonzero(of == i)
            z = np.zeros(length)
            mine_at = mine[idx[mine] >= 0]
            z[idx[mine_at]] = np.nan_to_num(v[0][mine_at].astype(np.float64), nan=0.0)
            out.append(z.tobytes() if len(mine) else None)
        sector = idx[of == -2]
        return [ticker, int(sector[0]) if len(sector) else 0, *out]

    schema = pa.schema([("ticker", pa.string()), ("sector", pa.int32()), *[(c, pa.binary()) for c in columns]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def finish(t: pa.Table) -> Iterator[pa.RecordBatch]:
            codes = t.column("ticker").combine_chunks().dictionary_encode().indices.to_numpy()
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(codes)) + 1, [len(codes)]))
            done = [name(t.column("ticker")[int(a)].as_py(), t.slice(a, b - a)) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
            done = [d for d in done if d is not None]
            for k in range(0, len(done), SLICE):
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, d)) for d in done[k:k + SLICE]], schema=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            t = pa.Table.from_batches(held).combine_chunks()
            last = t.column("ticker")[-1].as_py()
            if t.column("ticker")[0].as_py() == last:
                continue
            whole = int(np.flatnonzero(pc.equal(t.column("ticker"), last).to_numpy())[0])
            yield from finish(t.slice(0, whole))
            held = t.slice(whole).combine_chunks().to_batches()
        if held:
            yield from finish(pa.Table.from_batches(held).combine_chunks())

    spec = "ticker string, sector int, " + ", ".join(f"`{c}` binary" for c in columns)
    return Packed(materialise(rows.mapInArrow(run, spec), "series"), length, len(known) + 1, tuple(signals))


def mean_back(x: np.ndarray, n: int) -> np.ndarray:
    """Mean over the last ``n`` columns, fewer at the start."""
    if n <= 1:
        return x
    out, length = x.copy(), x.shape[1]
    for k in range(1, min(n, length)):
        out[:, k:] += x[:, : length - k]
    return out / np.minimum(np.arange(length) + 1, n)


def _clip(w: np.ndarray, lim: np.ndarray | float) -> np.ndarray:
    return np.maximum(-lim, np.minimum(lim, w))


def _signal(names: dict, loop: Loop) -> np.ndarray:
    z = mean_back(names[loop.column], loop.window)
    return np.where(np.isnan(names["r"]), 0.0, z) if loop.masked else z


def _limit(adtv: np.ndarray, p: BookParams, aum: float) -> np.ndarray:
    at = np.maximum.accumulate(np.where(np.isnan(adtv), -1, np.arange(adtv.shape[1])), axis=1)
    last = np.where(at >= 0, np.take_along_axis(adtv, np.maximum(at, 0), axis=1), 0.0)
    return last * p.adtv_share / aum


def _looped(names: dict, loop: Loop, lim: np.ndarray, p: BookParams, state: list[tuple]) -> np.ndarray:
    """Weights after the factors found so far: (scalar per date, factor per date and sector or None)."""
    w = _signal(names, loop)
    for scalar, factor in state:
        w = _clip(_clip(w * scalar, lim), p.max_name)
        if factor is not None:
            w = w * factor.T[names["sector"]]
    return w


def _by_sector(w: np.ndarray, sector: np.ndarray, sectors: int) -> np.ndarray:
    return np.abs(w).T @ (sector[:, None] == np.arange(sectors)[None, :]).astype(np.float64)


def _slices(batches: Iterator[pa.RecordBatch], column: int | None = None) -> Iterator[dict]:
    """Columns of at most ``SLICE`` names as matrices; a signal that a name does not have is a row of NaN."""
    for batch in batches:
        for k in range(0, batch.num_rows, SLICE):
            part = batch.slice(k, SLICE)
            out = {"sector": part.column(1).to_numpy()}
            length = len(part.column(2)[0].as_buffer()) // 8
            for i in range(2, part.num_columns):
                gone = np.full(length, np.nan)
                out[part.schema.names[i]] = np.stack([np.frombuffer(x.as_buffer(), np.float64) if x.is_valid else gone for x in part.column(i)])
            yield out


def _of(names: dict, column: str) -> dict | None:
    """The names that have a signal."""
    here = ~np.isnan(names[column][:, 0])
    return names if here.all() else {k: v[here] for k, v in names.items()} if here.any() else None


def _sums(packed: Packed, units: int, width: int, fn: Callable[[dict, np.ndarray], None]) -> DataFrame:
    """(unit, idx, v0, v1, ...): what ``fn(names, out)`` adds to ``out`` (units x dates x width), one row per task before it moves."""
    length = packed.length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, any_ = np.zeros((units, length, width)), False
        for names in _slices(batches):
            fn(names, out)
            any_ = True
        if any_:
            unit, idx = np.divmod(np.arange(units * length, dtype=np.int32), np.int32(length))
            yield pa.RecordBatch.from_arrays([pa.array(unit, pa.int32()), pa.array(idx, pa.int32()), *[pa.array(out[:, :, i].ravel()) for i in range(width)]],
                                             names=["unit", "idx", *[f"v{i}" for i in range(width)]])

    rows = packed.rows.mapInArrow(run, "unit int, idx int, " + ", ".join(f"v{i} double" for i in range(width)))
    return rows.groupBy("unit", "idx").agg(*[F.sum(f"v{i}").alias(f"v{i}") for i in range(width)])


def _grid(sums: DataFrame, units: int, length: int, width: int) -> np.ndarray:
    t = sums.toArrow()
    out = np.zeros((units, length, width))
    out[t.column("unit").to_numpy(), t.column("idx").to_numpy()] = np.column_stack([t.column(f"v{i}").to_numpy() for i in range(width)])
    return out


def _scalar(past: np.ndarray, p: BookParams) -> np.ndarray:
    """Leverage per date from the sums of the book's hypothetical past returns (dates x lags)."""
    n = p.vol_window
    dev = past - past.sum(axis=1, keepdims=True) / n
    vol = np.sqrt((dev * dev).sum(axis=1) / (n - 1) * p.periods)
    raw = np.where(vol > 0, p.target_vol / np.where(vol > 0, vol, 1.0), 1.0)
    return np.where(np.arange(len(vol)) >= n, np.clip(raw, p.min_leverage, p.max_leverage), 1.0)


def _factor(gross: np.ndarray, p: BookParams) -> np.ndarray:
    return np.where(gross > p.max_sector, p.max_sector / np.where(gross > 0, gross, 1.0), 1.0)


def calibrate(packed: Packed, loops: Sequence[Loop], p: BookParams) -> list[list[tuple]]:
    """Factors of the alternation of volatility targeting and limits, per loop."""
    n, sectors, state = p.vol_window, packed.sectors, [[] for _ in loops]
    for _ in range(p.iterations):
        def past(names: dict, out: np.ndarray) -> None:
            for i, loop in enumerate(loops):
                own = _of(names, loop.column)
                if own is None:
                    continue
                w, r = _looped(own, loop, _limit(own["adtv"], p, loop.aum), p, state[i]), np.nan_to_num(own["r"], nan=0.0)
                for k in range(n):  # lag n - k
                    out[i, n:, k] += np.einsum("jt,jt->t", w[:, n:], r[:, k: k + w.shape[1] - n])

        scalars = [_scalar(x, p) for x in _grid(_sums(packed, len(loops), n, past), len(loops), packed.length, n)]

        def sector(names: dict, out: np.ndarray) -> None:
            for i, loop in enumerate(loops):
                own = _of(names, loop.column)
                if own is not None:
                    w = _looped(own, loop, _limit(own["adtv"], p, loop.aum), p, [*state[i], (scalars[i], None)])
                    out[i] += _by_sector(w, own["sector"], sectors)

        gross = _grid(_sums(packed, len(loops), sectors, sector), len(loops), packed.length, sectors)
        state = [[*s, (scalars[i], _factor(gross[i], p))] for i, s in enumerate(state)]
    return state


def _labels(units: Sequence[Mapping], unit: Column) -> list[Column]:
    return [F.element_at(F.array(*[F.lit(u[k]) for u in units]), unit + 1).alias(k) for k in units[0]]


def _sigma(r: np.ndarray, c: CostParams, fallback: float) -> np.ndarray:
    """Deviation over the last rows; ``fallback`` where too few hold a value."""
    padded = np.concatenate((np.full((len(r), c.vol_window - 1), np.nan), r), axis=1)
    x = np.lib.stride_tricks.sliding_window_view(padded, c.vol_window, axis=1)
    here = ~np.isnan(x)
    n = here.sum(axis=2)
    mean = np.where(here, x, 0.0).sum(axis=2) / np.maximum(n, 1)
    ss = (np.where(here, x - mean[:, :, None], 0.0) ** 2).sum(axis=2)
    return np.where(n >= c.vol_min, np.sqrt(ss / np.maximum(n - 1, 1)), fallback)


def books(packed: Packed, loops: Sequence[Loop], wanted: Sequence[tuple[int, int, Mapping]], index: DataFrame, fallback: float | None,
          p: BookParams, c: CostParams, floor: float = 1e-6) -> tuple[DataFrame, DataFrame]:
    """(keys, date, P&L and cost layers) and (keys, idx, n_positions, n_pos, g) of books (loop, smoothing window, keys):
    open positions, those above ``floor``, and the gross weight with the hedge.

    ``fallback`` is the deviation of names with too few returns (NULL: they have no impact cost). As ``pnl.daily_costs`` over
    ``pnl.ledger`` of ``portfolio.build_portfolio``, with a fund size per loop in the limits; costs take the size ``aum`` of
    the keys, else that of the loop.
    """
    state, units, sectors = calibrate(packed, loops, p), len(wanted), packed.sectors
    width = sectors + 1
    session = np.array(sorted(r.idx for r in index.select("idx").collect()), np.int64)

    def smoothed(names: dict, u: int) -> tuple[dict, np.ndarray] | None:
        loop = loops[wanted[u][0]]
        own = _of(names, loop.column)
        if own is None:
            return None
        lim = _limit(own["adtv"], p, loop.aum)
        return own, _clip(_clip(mean_back(_looped(own, loop, lim, p, state[wanted[u][0]]), wanted[u][1]), lim), p.max_name)

    def sector(names: dict, out: np.ndarray) -> None:
        for u in range(units):
            got = smoothed(names, u)
            if got is not None:
                out[u, :, :-1] += _by_sector(got[1], got[0]["sector"], sectors)
                out[u, :, -1] += (~np.isnan(got[0]["r"])).sum(axis=0)

    sums = materialise(_sums(packed, units, width, sector), "sector_sums")
    factors = _factor(_grid(sums, units, packed.length, width)[:, :, :-1], p)
    sessions = np.zeros((units, packed.length), bool)
    if p.session_mask:
        flags = session_flags(sums.select("unit", F.col("idx").alias("date"), F.col(f"v{width - 1}").cast("long").alias("n")), p.guard_window, p.guard_min, keys=("unit",))
        t = flags.select("unit", "date", "sessao").toArrow()
        sessions[t.column("unit").to_numpy(), t.column("date").to_numpy()] = t.column("sessao").to_numpy()
    half, broker, loan = (np.array(x) for x in (c.half_spread_bps, c.brokerage_bps, c.borrow_annual))
    unknown = np.nan if fallback is None else fallback

    def day(names: dict, out: np.ndarray) -> None:
        for u in range(units):
            got = smoothed(names, u)
            if got is None:
                continue
            own, w = got
            w = w * factors[u].T[own["sector"]]
            w = np.where(np.isnan(own["r"]) & sessions[u], 0.0, w)
            w = np.where(np.isnan(own["beta"]), 0.0, w)
            out[u, :, 5] += (w * np.nan_to_num(own["beta"], nan=0.0)).sum(axis=0)
            w = np.concatenate((np.zeros((len(w), 1)), w[:, :-1]), axis=1)
            for i, v in enumerate((np.abs(w) > ACTIVE, np.abs(w) > floor, np.abs(w))):
                out[u, :, 6 + i] += v.sum(axis=0)
            r, adtv, w = own["r"][:, session], own["adtv"][:, session], w[:, session]
            dw = np.abs(np.diff(w, axis=1, prepend=w[:, :1]))
            known = np.nan_to_num(adtv, nan=0.0)
            band = sum((known < b).astype(np.int64) for b in c.bands)
            size = float(wanted[u][2].get("aum", loops[wanted[u][0]].aum))
            part = np.where(known != 0, np.minimum(dw * size / np.where(known != 0, known, 1.0), c.max_participation), c.max_participation)
            out[u, session, 0] += (w * np.nan_to_num(r, nan=0.0)).sum(axis=0)
            out[u, session, 1] += dw.sum(axis=0)
            out[u, session, 2] += (dw * (half[band] + c.fees_bps + broker[band]) / 1e4).sum(axis=0)
            out[u, session, 3] += np.nansum(dw * c.eta * _sigma(r, c, unknown) * np.sqrt(part), axis=0)
            out[u, session, 4] += (np.abs(np.minimum(w, 0.0)) * loan[band] / c.periods).sum(axis=0)

    s = materialise(_sums(packed, units, 9, day), "day_sums")
    along, zero = Window.partitionBy("unit").orderBy("idx"), F.lit(0.0)
    keys = _labels([k for _, _, k in wanted], F.col("unit")) if wanted[0][2] else []
    s = s.withColumn("_h", F.coalesce(F.lag(-F.col("v5")).over(along), zero))
    d = s.join(F.broadcast(index.select("idx", "date", "m")), "idx")
    d = d.withColumn("_dh", F.coalesce(F.abs(F.col("_h") - F.lag("_h").over(along)), zero))
    d = d.select(*keys, "date", (F.col("v0") + F.col("_h") * F.col("m")).alias("gross"), (F.col("v1") + F.col("_dh")).alias("turnover"),
                 F.col("v2").alias("spread"), F.col("v3").alias("impact"), F.col("v4").alias("borrow"), (F.col("_dh") * c.hedge_bps / 1e4).alias("hedge"))
    total = F.col("spread") + F.col("impact") + F.col("borrow") + F.col("hedge")
    d = d.withColumn("cost", total).withColumn("net", F.col("gross") - total).withColumn("net_flat", F.col("gross") - F.col("turnover") * c.flat)
    return materialise(d, "pnl"), s.select(
        *keys, "idx", F.col("v6").cast("long").alias("n_positions"), F.col("v7").cast("long").alias("n_pos"), (F.col("v8") + F.abs("_h")).alias("g"))


def signal_ic(packed: Packed, loops: Sequence[Loop], labels: Sequence[Mapping]) -> DataFrame:
    """(keys, idx, ic): correlation of each loop's signal with the next row's return; dates without variance are left out.

    Tasks leave centred moments, which add up without loss: raw ones would make variance of rounding.
    """
    length, units = packed.length, len(loops)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names in _slices(batches):
            for u, loop in enumerate(loops):
                own = _of(names, loop.column)
                if own is None:
                    continue
                x, y = _signal(own, loop)[:, :-1], own["r"][:, 1:]
                here = ~np.isnan(y)
                n = here.sum(axis=0)
                at = np.flatnonzero(n)
                mean = lambda v: np.where(here, v, 0.0).sum(axis=0) / np.maximum(n, 1)
                mx, my = mean(x), mean(y)
                dx, dy = np.where(here, x - mx, 0.0), np.where(here, y - my, 0.0)
                cols = [n.astype(np.float64), mx, my, (dx * dx).sum(axis=0), (dy * dy).sum(axis=0), (dx * dy).sum(axis=0)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), u, np.int32)), pa.array(at.astype(np.int32)), *[pa.array(v[at]) for v in cols]],
                                                 names=["unit", "idx", "n", "mx", "my", "xx", "yy", "xy"])

    if length < 2:
        raise ValueError("an IC needs two calendar rows")
    part = materialise(packed.rows.mapInArrow(run, "unit int, idx int, n double, mx double, my double, xx double, yy double, xy double"), "moments")
    mid = part.groupBy("unit", "idx").agg((F.sum(F.col("n") * F.col("mx")) / F.sum("n")).alias("gx"), (F.sum(F.col("n") * F.col("my")) / F.sum("n")).alias("gy"))
    a, b = F.col("mx") - F.col("gx"), F.col("my") - F.col("gy")
    m = part.join(mid, ["unit", "idx"]).groupBy("unit", "idx").agg(
        F.sum("n").alias("n"), F.sum(F.col("xx") + F.col("n") * a * a).alias("xx"), F.sum(F.col("yy") + F.col("n") * b * b).alias("yy"),
        F.sum(F.col("xy") + F.col("n") * a * b).alias("xy"))
    sx, sy = F.sqrt(F.col("xx") / F.col("n")), F.sqrt(F.col("yy") / F.col("n"))
    ic = F.when((sx > NO_VARIANCE) & (sy > NO_VARIANCE), F.col("xy") / F.col("n") / (sx * sy))
    return m.select(*_labels(labels, F.col("unit")), "idx", ic.alias("ic")).where(F.col("ic").isNotNull())
