"""Inference: information coefficients, robust errors, placebo, attribution, selection protocols."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketripple.functions.expr import (
    NO_VARIANCE, compound_agg, corr_agg, known_class, kurt_agg, mean_t, normal_cdf, series_window, sharpe_agg, skew_agg, slope_agg,
)
from marketripple.session import materialise

EULER = 0.5772156649


# ---- information coefficient ------------------------------------------------------------------------------


def forward_returns(panel: DataFrame, horizons: Sequence[int], r: str = "r") -> DataFrame:
    """(h, date, ticker, y): sum of the next h returns, NULL if any is missing. One window stage for all h."""
    w = series_window((), "ticker")
    cols = []
    for h in horizons:
        f = w.rowsBetween(1, h)
        cols.append(F.struct(F.lit(h).alias("h"), F.when(F.count(r).over(f) == h, F.sum(r).over(f)).alias("y")))
    d = panel.select("date", "idx", "ticker", F.array(*cols).alias("_a"))
    return d.select("date", "ticker", F.explode("_a").alias("_f")).select("_f.h", "date", "ticker", "_f.y")


def ic_daily(signal: DataFrame, fwd: DataFrame, z: str = "z", y: str = "y", keys: Sequence[str] = (),
             fwd_keys: Sequence[str] = ()) -> DataFrame:
    """Per-date Pearson correlation of signal and forward return; dates without variance are dropped.

    A merge join: equal signals pack so well that their file looks small enough to be broadcast.
    """
    j = signal.select(*keys, "date", "ticker", z).hint("merge").join(fwd.select(*fwd_keys, "date", "ticker", y), ["date", "ticker"])
    g = j.groupBy(*keys, *fwd_keys, "date").agg(corr_agg(z, y).alias("ic"))
    return g.where(F.col("ic").isNotNull())


def ic_summary(ic: DataFrame, keys: Sequence[str] = (), overlap: int = 1) -> DataFrame:
    """Mean, t and size; with an overlap the sample size is divided by it and must exceed it."""
    g = ic.groupBy(*keys).agg(F.avg("ic").alias("ic"), mean_t("ic", overlap).alias("t"), F.count("ic").alias("n"))
    return g.withColumn("t", F.when(F.col("n") > max(overlap, 1), F.col("t")))


def ic_by_horizon(signal: DataFrame, panel: DataFrame, horizons: Sequence[int] = (1, 5, 10, 21, 42, 63, 126)) -> DataFrame:
    """IC, t and IC per root horizon, with the decay of a one-day effect and of perfect diffusion."""
    ic = ic_daily(signal, forward_returns(panel, horizons), fwd_keys=("h",))
    h = F.col("h").cast("double")
    g = ic.groupBy("h").agg(F.avg("ic").alias("ic"), F.try_divide(F.avg("ic"), F.stddev_samp("ic")).alias("_q"),
                            F.count("ic").alias("n"))
    g = g.select("h", "ic", "n", (F.col("_q") * F.sqrt(F.col("n") / h)).alias("t"), (F.col("ic") / F.sqrt(h)).alias("ic_root_h"))
    first = F.first("ic_root_h").over(Window.orderBy("h").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return g.select("*", (1 - F.try_divide("ic_root_h", first)).alias("decay"), (1 - 1 / F.sqrt(h)).alias("decay_one_day"))


# ---- robust errors ----------------------------------------------------------------------------------------


def clustered_t_by_kind(pairs: DataFrame, min_pairs: int = 100, threshold: float = 2.0) -> DataFrame:
    """Pooled y ~ 1 + x per kind with errors clustered by date.

    ``pairs`` is (kind, src, dst, date, x, y). It is read twice: for the edges with enough pairs, and for the sums of
    their products by (kind, date), which give the line and each date's score.
    """
    k = materialise(pairs.groupBy("kind", "src", "dst").agg(F.count("x").alias("_k")).where(F.col("_k") >= min_pairs), "edge_counts")
    d = pairs.join(k.select("kind", "src", "dst"), ["kind", "src", "dst"], "left_semi")
    x, y = F.col("x"), F.col("y")
    sums = {"n": F.count(x), "sx": F.sum(x), "sy": F.sum(y), "sxx": F.sum(x * x), "sxy": F.sum(x * y), "syy": F.sum(y * y)}
    day = materialise(d.groupBy("kind", "date").agg(*[v.alias(c) for c, v in sums.items()]), "kind_dates")
    tot = day.groupBy("kind").agg(*[F.sum(c).alias(c) for c in sums])
    n, mx, my = F.col("n").cast("double"), F.col("sx") / F.col("n"), F.col("sy") / F.col("n")
    vx, vy, cxy = F.col("sxx") / n - mx * mx, F.col("syy") / n - my * my, F.col("sxy") / n - mx * my
    flat = NO_VARIANCE * NO_VARIANCE
    fit = tot.select("kind", "n", mx.alias("mx"), my.alias("my"), F.when(vx > flat, cxy / vx).alias("b"),
                     F.when((vx > flat) & (vy > flat), cxy / F.sqrt(vx * vy)).alias("corr"), (vx * n).alias("sxx"))
    fit = fit.join(k.groupBy("kind").agg(F.count(F.lit(1)).alias("n_edges")), "kind")
    # with x centred at its mean the slope's bread is 1/Sxx and a date's score the sum of (x - mx)(y - my - b (x - mx))
    m = day.join(fit.select("kind", "mx", "my", "b"), "kind")
    nd, mx, my = F.col("n"), F.col("mx"), F.col("my")
    xy = F.col("sxy") - mx * F.col("sy") - my * F.col("sx") + nd * mx * my
    xx = F.col("sxx") - 2 * mx * F.col("sx") + nd * mx * mx
    s = m.select("kind", (xy - F.col("b") * xx).alias("s"))
    meat = s.groupBy("kind").agg(F.sum(F.col("s") * F.col("s")).alias("meat"), F.count("s").alias("n_dates"))
    r = fit.join(meat, "kind")
    n, g, c = F.col("n").cast("double"), F.col("n_dates").cast("double"), F.col("corr")
    corr_factor = g / (g - 1) * (n - 1) / (n - 2)
    r = r.withColumn("t_naive", F.try_divide(c * F.sqrt(n - 2), F.sqrt(F.greatest(1 - c * c, F.lit(1e-12)))))
    r = r.withColumn("t_cluster", F.try_divide(F.col("b"), F.sqrt(corr_factor * F.col("meat")) / F.col("sxx")))
    r = r.withColumn("inflation", F.try_divide(F.abs("t_naive"), F.abs("t_cluster")))
    return r.select("kind", "n_edges", "n", "n_dates", "corr", "t_naive", "t_cluster", "inflation",
                    F.try_divide(n, F.col("inflation") * F.col("inflation")).alias("n_effective"),
                    (F.abs("t_naive") >= threshold).alias("passes_naive"), (F.abs("t_cluster") >= threshold).alias("passes_cluster"))


def newey_west_mean(ic: DataFrame, max_lags: int = 21, keys: Sequence[str] = (), min_obs: int = 30,
                    auto_cap: int = 40) -> DataFrame:
    """t of a mean with Bartlett weights at a fixed and at the rule-of-thumb lag, and autocorrelations.

    Lags are window offsets of a per-date series; the rule 4(n/100)^(2/9) stays below ``auto_cap`` for any
    series up to three million dates, and a longer one is an error.
    """
    lags = range(1, max(max_lags, auto_cap) + 1)
    w = series_window(keys, order="date")
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    d = ic.select(*keys, "date", "ic", (F.col("ic") - F.avg("ic").over(whole)).alias("e"))
    d = d.select("*", *[F.lag("e", k).over(w).alias(f"e{k}") for k in lags], *[F.lag("ic", k).over(w).alias(f"y{k}") for k in range(1, max_lags + 1)])
    g = d.groupBy(*keys).agg(
        F.count("ic").alias("n"), F.avg("ic").alias("ic"), F.stddev_samp("ic").alias("std_ic"), F.sum(F.col("e") * F.col("e")).alias("g0"),
        F.array(*[F.coalesce(F.sum(F.col("e") * F.col(f"e{k}")), F.lit(0.0)) for k in lags]).alias("g"),
        F.array(*[corr_agg("ic", f"y{k}") for k in range(1, max_lags + 1)]).alias("rho"))
    g = g.where(F.col("n") >= min_obs)
    n = F.col("n").cast("double")

    def t_with(lag: Column) -> Column:
        terms = F.transform("g", lambda x, i: F.when(i < lag, (1 - (i + 1) / (lag + 1)) * x).otherwise(0.0))
        var = (F.col("g0") + 2 * F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)) / (n * n)
        return F.when(var > 0, F.try_divide(F.col("ic"), F.sqrt(F.greatest(var, F.lit(0.0)))))

    rule = F.floor(4 * F.pow(n / 100, F.lit(2.0 / 9.0))).cast("double")
    auto = F.when(rule <= len(lags), rule).otherwise(F.raise_error(F.lit("the lag rule exceeds auto_cap")).cast("double"))
    rho_sum = F.aggregate(F.transform("rho", lambda x: F.coalesce(x, F.lit(0.0))), F.lit(0.0), lambda a, x: a + x)
    g = g.select(
        *keys, "n", "ic", "std_ic", F.try_divide(F.col("ic"), F.col("std_ic") / F.sqrt(n)).alias("t_naive"),
        t_with(F.lit(float(max_lags))).alias("t_hac"), t_with(auto).alias("t_hac_auto"), auto.cast("int").alias("lags_auto"),
        F.col("rho")[0].alias("rho1"), F.col("rho")[min(4, max_lags - 1)].alias("rho5"), F.col("rho")[max_lags - 1].alias("rho_last"),
        F.sqrt(F.greatest(1 + 2 * rho_sum, F.lit(1e-12))).alias("inflation_theoretical"))
    return g.withColumn("inflation_measured", F.try_divide(F.abs("t_naive"), F.abs("t_hac")))


# ---- breadth arithmetic -----------------------------------------------------------------------------------


def scale_check(hac: DataFrame, positions: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Measured against predicted deviation of the IC and the effective cross-section 3 + 1/std^2."""
    j = hac.join(positions, list(keys)) if keys else hac.withColumn("n_positions", positions.select("n_positions").scalar())
    pred = 1.0 / F.sqrt(F.greatest(F.col("n_positions") - 3, F.lit(1)).cast("double"))
    s = F.col("std_ic")
    return j.select(*keys, "n_positions", "std_ic", pred.alias("std_predicted"), F.try_divide(s, pred).alias("ratio"),
                    F.when(s > 0, 3.0 + F.try_divide(F.lit(1.0), s * s)).alias("n_ic_effective"), F.abs("t_hac").alias("t_now"), "ic")


def required_positions(scale: DataFrame, t_target: float = 2.0, keys: Sequence[str] = ()) -> DataFrame:
    """Positions for t >= target when t grows with the root of the effective positions."""
    mult = F.pow(F.try_divide(F.lit(t_target), F.col("t_now")), F.lit(2.0))
    return scale.where(F.col("t_now") > 1e-9).select(*keys, "t_now", "n_ic_effective", mult.alias("multiplier"),
                                                     (F.col("n_ic_effective") * mult).alias("n_required"))


def breadth_for_ir(ic: DataFrame, breadth: DataFrame, targets: Sequence[float] = (0.75, 1.0, 1.5), periods: int = 252,
                   keys: Sequence[str] = ()) -> DataFrame:
    """Breadth for each information ratio by IR = IC sqrt(breadth periods); only for a positive IC."""
    j = ic.join(breadth, list(keys)) if keys else ic.select(
        "ic", breadth.select("n_eff").scalar().alias("n_eff"), breadth.select("n_names").scalar().alias("n_names"))
    d = j.where(F.col("ic") > 0).withColumn("ir_target", F.explode(F.array(*[F.lit(float(t)) for t in targets])))
    need = F.pow(F.try_divide(F.col("ir_target"), F.col("ic") * math.sqrt(periods)), F.lit(2.0))
    return d.select(*keys, "ir_target", need.alias("breadth_needed"), F.try_divide(need, F.col("n_eff")).alias("factor_vs_now"),
                    F.try_divide(need * F.col("n_names"), F.col("n_eff")).alias("positions_at_ratio"),
                    (F.col("ic") * F.sqrt("n_eff") * math.sqrt(periods)).alias("ir_now"))


# ---- placebo ----------------------------------------------------------------------------------------------


def _blocked(graph: DataFrame, subsectors: DataFrame) -> DataFrame:
    """Edges with the subsector of their target as ``block``; NULL where it is unknown.

    A merge join at every size: edges pack so well that their files look small enough to be broadcast, through the driver.
    """
    sub = subsectors.where(known_class("subsector")).select(F.col("ticker").alias("dst"), F.col("subsector").alias("block"))
    return graph.hint("merge").join(sub, "dst", "left")


BLOCK_KEYS = ["valid_month", "variant", "block"]
HASHES_PER_TASK = 2_000_000


def _drawn_heads(known: DataFrame, draws: int, seed: int, spare: int = 40) -> DataFrame:
    """(draw, block keys, src, new_src): for each head the member that takes its place.

    The draw is the order of a hash of (seed, draw, block, member), so it is reproducible and needs no random state. Of a
    block with n members only those are ranked whose hash lies in the first (heads + ``spare``) / n of its range; a block
    in which these are too few is ranked whole. Written tables pack well, so they are joined by merging at every size.
    """
    by = BLOCK_KEYS
    heads = known.select(*by, "src").distinct().withColumn("rk", F.row_number().over(Window.partitionBy(*by).orderBy("src")))
    most = heads.agg(F.max("rk")).first()[0] or 0  # one number
    members = known.select(*by, F.explode(F.array("src", "dst")).alias("member")).distinct()
    members = materialise(members, "members")
    sizes = members.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    every = F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))
    parts = max(1, math.ceil(members.count() * draws / HASHES_PER_TASK))  # the members are few rows in few files, their hashes many
    drawn = members.join(F.broadcast(sizes), by).repartition(parts).withColumn("draw", every)  # one size per month, variant and subsector
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), "draw", F.date_format("valid_month", "yyyy-MM"), "variant", "block", "member"))
    low = F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * F.col("n") < F.lit((most + spare) << 32)
    w = Window.partitionBy("draw", *by).orderBy("key", "member")

    def ranked(rows: DataFrame) -> DataFrame:
        return rows.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= most).select("draw", *by, "rk", F.col("member").alias("new_src"))

    first = materialise(ranked(drawn.withColumn("key", key).where(low)), "drawn")
    got = first.groupBy("draw", *by).agg(F.max("rk").alias("got"))
    short = sizes.withColumn("draw", every).hint("merge").join(got, ["draw", *by], "left").where(F.coalesce("got", F.lit(0)) < F.least(F.lit(most), "n"))
    short = materialise(short.select("draw", *by), "short")
    if not short.isEmpty():
        again = members.hint("merge").join(short, by).withColumn("key", key)
        first = first.hint("merge").join(short, ["draw", *by], "left_anti").unionByName(ranked(again))
    return first.hint("merge").join(heads, [*by, "rk"]).select("draw", *by, "src", "new_src")


def placebo_graphs(graph: DataFrame, subsectors: DataFrame, draws: int, seed: int = 42) -> DataFrame:
    """``draws`` copies of the graph whose heads are replaced, inside each (month, variant, target subsector), by a
    random choice of distinct members; strengths travel with the head and self-edges disappear.

    The edges are joined by merging at every size: they pack so well that their files look small enough to be broadcast.
    """
    e = _blocked(graph, subsectors)
    known = e.where(F.col("block").isNotNull())
    mapping = _drawn_heads(known, draws, seed)
    moved = known.hint("merge").join(mapping, [*BLOCK_KEYS, "src"]).select(
        "draw", "valid_month", "variant", F.col("new_src").alias("src"), "dst", "strength", "direction")
    fixed = e.where(F.col("block").isNull()).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).select(*moved.columns)
    return moved.unionByName(fixed).where(F.col("src") != F.col("dst"))


def placebo_sizes(graph: DataFrame, subsectors: DataFrame, draws: int, seed: int = 42) -> DataFrame:
    """(draw, valid_month, variant, n_edges, strength, n_triggers, first_src, last_src) of ``placebo_graphs``.

    A drawn head has all edges of the head it replaces but the one to itself, so counts and sums per head and the single
    edges that disappear are enough: the draws are rows per head, never per edge.
    """
    e = _blocked(graph, subsectors)
    known = e.where(F.col("block").isNotNull())
    n, s = F.count("dst").alias("n"), F.sum(F.col("strength") * F.col("direction")).alias("s")
    heads = known.groupBy(*BLOCK_KEYS, "src").agg(n, s)
    lost = known.groupBy(*BLOCK_KEYS, "src", F.col("dst").alias("new_src")).agg(n, s).withColumnsRenamed({"n": "n0", "s": "s0"})
    moved = _drawn_heads(known, draws, seed).join(heads, [*BLOCK_KEYS, "src"])
    moved = moved.hint("merge").join(lost, [*BLOCK_KEYS, "src", "new_src"], "left").select(
        "draw", "valid_month", "variant", F.col("new_src").alias("src"), (F.col("n") - F.coalesce("n0", F.lit(0))).alias("n"),
        (F.col("s") - F.coalesce("s0", F.lit(0.0))).alias("s"))
    fixed = e.where(F.col("block").isNull() & (F.col("src") != F.col("dst"))).groupBy("valid_month", "variant", "src").agg(n, s)
    fixed = fixed.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).select(*moved.columns)
    by = ["draw", "valid_month", "variant"]
    each = moved.where("n > 0").unionByName(fixed).groupBy(*by, "src").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    return each.groupBy(*by).agg(F.sum("n").alias("n_edges"), F.sum("s").alias("strength"), F.count("src").alias("n_triggers"),
                                 F.min("src").alias("first_src"), F.max("src").alias("last_src"))


def placebo_ic(panel: DataFrame, graph: DataFrame, subsectors: DataFrame, draws: int, seed: int = 42, total: float = 0.02) -> DataFrame:
    """(draw, date, ic): the IC of the standardised ensemble signal over every graph of ``placebo_graphs``, without its edges.

    ``panel`` is (date, ticker, acc, y). Targets with the same heads and strengths in a month form a class and have one signal
    in every draw; only a target that is drawn as its own head differs, by that one term. So a draw is rows per class and per
    drawn head, and names enter by their class's size and sums of y, whatever their number. A graph without such
    targets has a class per target and stays as large as it is. A row holds the heads of one target in one month.
    """
    e = _blocked(graph, subsectors)
    e = e.where(F.col("block").isNotNull() | (F.col("src") != F.col("dst"))).groupBy(*BLOCK_KEYS, "src", "dst").agg(
        F.sum(F.col("strength") * F.col("direction")).alias("f"))
    heads = F.sort_array(F.collect_list(F.struct("variant", "block", "src", "f")))
    targets = e.groupBy("valid_month", "dst").agg(heads.alias("heads")).withColumn("same", F.sha2(F.to_json("heads"), 256))
    classes = materialise(targets.groupBy("valid_month", "same").agg(
        F.min("dst").alias("cls"), F.count("dst").alias("size"), F.first("heads").alias("heads")), "classes")
    members = materialise(targets.select("valid_month", "dst", "same").hint("merge").join(
        classes.select("valid_month", "same", "cls"), ["valid_month", "same"]).drop("same"), "class_members")

    edges = classes.select("valid_month", "cls", F.explode("heads").alias("h")).select("valid_month", "cls", "h.*")
    moved = edges.where(F.col("block").isNotNull()).hint("merge").join(_drawn_heads(_blocked(graph, subsectors).where(F.col("block").isNotNull()), draws, seed),
                                                         [*BLOCK_KEYS, "src"]).select("draw", "valid_month", "cls", F.col("new_src").alias("src"), "f")
    fixed = edges.where(F.col("block").isNull()).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).select(*moved.columns)
    load = moved.unionByName(fixed).groupBy("draw", "valid_month", "cls", "src").agg(F.sum("f").alias("f"))
    own = members.select("valid_month", "cls", F.col("dst").alias("src"), F.lit(True).alias("own"))
    load = materialise(load.hint("merge").join(own, ["valid_month", "cls", "src"], "left").withColumn("own", F.coalesce("own", F.lit(False))), "class_load")

    # one value per class and date; a target drawn as its own head loses that term and stands alone
    rows = materialise(panel.select("date", F.last_day("date").alias("valid_month"), "ticker", "acc", "y"), "placebo_panel")
    shocks = rows.where(F.col("acc").isNotNull()).select("date", "valid_month", F.col("ticker").alias("src"), "acc", "y")
    term = F.col("f") * F.col("acc")
    live = (term != 0).cast("int")
    value = load.hint("merge").join(shocks, ["valid_month", "src"]).groupBy("draw", "valid_month", "date", "cls").agg(
        F.sum(term).alias("s"), F.sum(live).alias("k"), F.collect_list(F.when(F.col("own"), F.struct(term.alias("t"), live.alias("k"), "y"))).alias("alone"))
    by_class = rows.hint("merge").join(members.withColumnRenamed("dst", "ticker"), ["valid_month", "ticker"]).groupBy("valid_month", "date", "cls").agg(
        F.count("y").alias("ny"), F.coalesce(F.sum("y"), F.lit(0.0)).alias("sy"))
    by_class = by_class.hint("merge").join(classes.select("valid_month", "cls", "size"), ["valid_month", "cls"])
    value = value.join(by_class, ["valid_month", "date", "cls"])
    item = lambda raw, k, w, ny, sy: F.struct(
        raw.alias("raw"), k.cast("long").alias("k"), w.cast("long").alias("w"), ny.cast("long").alias("ny"), sy.alias("sy"))
    known_y = lambda x: x["y"].isNotNull().cast("int")
    rest = item(F.col("s"), F.col("k"), F.col("size") - F.size("alone"), F.col("ny") - F.aggregate("alone", F.lit(0), lambda a, x: a + known_y(x)),
                F.col("sy") - F.aggregate("alone", F.lit(0.0), lambda a, x: a + F.coalesce(x["y"], F.lit(0.0))))
    alone = F.transform("alone", lambda x: item(F.col("s") - x["t"], F.col("k") - x["k"], F.lit(1), known_y(x), F.coalesce(x["y"], F.lit(0.0))))
    n_variants = graph.agg(F.count_distinct("variant").alias("n")).select("n").scalar()
    d = value.select("draw", "date", F.explode(F.concat(F.array(rest), alone)).alias("i")).select("draw", "date", "i.*").where("w > 0 and k > 0 and raw <> 0")
    d = d.select("draw", "date", (F.col("raw") / n_variants.cast("double")).alias("raw"), "w", "ny", "sy")

    # quantiles, mean and deviation of a date count a class as often as it has names
    whole = Window.partitionBy("draw", "date")
    d = d.select("*", F.sum("w").over(whole).alias("n"), F.sum("w").over(whole.orderBy("raw").rowsBetween(Window.unboundedPreceding, 0)).alias("cum"))
    for name, p in (("lo", total / 2), ("hi", 1 - total / 2)):
        pos = F.lit(p) * (F.col("n") - 1)
        d = d.select("*", F.min(F.when(F.col("cum") > F.floor(pos), F.col("raw"))).over(whole).alias("_a"), F.min(F.when(F.col("cum") > F.ceil(pos), F.col("raw"))).over(whole).alias("_z"))
        d = d.withColumn(name, F.col("_a") + (F.coalesce("_z", "_a") - F.col("_a")) * (pos - F.floor(pos))).drop("_a", "_z")
    d = d.withColumn("v", F.greatest("lo", F.least("hi", "raw")))
    d = d.withColumn("m", F.sum(F.col("w") * F.col("v")).over(whole) / F.col("n"))
    d = d.withColumn("sd", F.sqrt(F.try_divide(F.sum(F.col("w") * (F.col("v") - F.col("m")) * (F.col("v") - F.col("m"))).over(whole), F.col("n") - 1)))
    sd = F.when(F.col("sd") <= NO_VARIANCE * F.greatest(F.lit(1.0), F.abs("m")), 1.0).otherwise(F.col("sd"))
    d = d.withColumn("z", F.coalesce(F.try_divide(F.col("v") - F.col("m"), sd), F.lit(0.0)))
    z = d.groupBy("draw", "date").agg(F.sum(F.col("z") * F.col("ny")).alias("sx"), F.sum(F.col("z") * F.col("z") * F.col("ny")).alias("sxx"), F.sum(F.col("z") * F.col("sy")).alias("sxy"))

    # the other side: every name the draw's graph ever targets
    sums = [F.count("y").alias("n"), F.sum("y").alias("sy"), F.sum(F.col("y") * F.col("y")).alias("syy")]
    months = members.groupBy(F.col("dst").alias("ticker")).agg(F.count(F.lit(1)).alias("months"))
    base = materialise(rows.hint("merge").join(months, "ticker").groupBy("date").agg(*sums), "placebo_dates")
    bare = load.groupBy("draw", "valid_month", "cls").agg(F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("own"), F.col("src"))).alias("ticker")).where("n = 1 and ticker is not null")
    gone = bare.groupBy("draw", "ticker").agg(F.count(F.lit(1)).alias("bare")).join(months, "ticker").where("bare = months").select("draw", "ticker")
    less = rows.hint("merge").join(gone, "ticker").groupBy("draw", "date").agg(*sums).withColumnsRenamed({"n": "n0", "sy": "sy0", "syy": "syy0"})
    j = z.join(F.broadcast(base), "date").join(less, ["draw", "date"], "left")  # one row per date
    n, sy, syy = (F.col(c) - F.coalesce(f"{c}0", F.lit(0)) for c in ("n", "sy", "syy"))
    j = j.select("draw", "date", n.cast("double").alias("n"), "sx", "sxx", "sxy", sy.alias("sy"), syy.alias("syy"))
    mean = lambda c: F.col(c) / F.col("n")
    vx, vy = mean("sxx") - mean("sx") * mean("sx"), mean("syy") - mean("sy") * mean("sy")
    # a variance that is only the rounding of its sums is none
    some = lambda v, square: (v > NO_VARIANCE * NO_VARIANCE) & (v > 1e-14 * mean(square))
    ic = F.when((F.col("n") > 0) & some(vx, "sxx") & some(vy, "syy"), (mean("sxy") - mean("sx") * mean("sy")) / F.sqrt(vx * vy))
    return j.select("draw", "date", ic.alias("ic")).where(F.col("ic").isNotNull())


def placebo_summary(real: DataFrame, fake: DataFrame) -> DataFrame:
    """Per period: real mean IC, placebo mean and deviation, one-sided p and percentile.

    ``real`` is (period, ic), ``fake`` is (period, draw, ic), both means over dates.
    """
    j = fake.where(F.col("ic").isNotNull()).join(F.broadcast(real.withColumnRenamed("ic", "ic_real")), "period")  # one row per period
    return j.groupBy("period").agg(
        F.first("ic_real").alias("ic_real"), F.avg("ic").alias("placebo_mean"), F.stddev_pop("ic").alias("placebo_sd"),
        F.avg((F.col("ic") >= F.col("ic_real")).cast("double")).alias("p_one_sided"),
        F.avg((F.col("ic") < F.col("ic_real")).cast("double")).alias("percentile"), F.count("ic").alias("n_draws"))


# ---- controls and attribution -----------------------------------------------------------------------------


def persistence_control(y: DataFrame, x: DataFrame, periods: int = 252, keys: Sequence[str] = ()) -> DataFrame:
    """P&L ``y`` against the own-persistence P&L ``x``: both Sharpes, correlation, slope, alpha and its t."""
    j = y.select(*keys, "date", F.col("net").alias("y")).join(x.select(*keys, "date", F.col("net").alias("x")), [*keys, "date"])
    b = j.groupBy(*keys).agg(slope_agg("x", "y").alias("beta"))
    j = j.join(b, list(keys)) if keys else j.withColumn("beta", b.select("beta").scalar())
    e = F.col("y") - F.col("beta") * F.col("x")
    return j.groupBy(*keys).agg(
        sharpe_agg("y", periods, 20).alias("sharpe_signal"), sharpe_agg("x", periods, 20).alias("sharpe_persistence"),
        corr_agg("x", "y").alias("corr"), F.first("beta").alias("beta"), (F.avg(e) * periods).alias("alpha_year"),
        mean_t(e).alias("t_alpha"))


def factor_books(scores: DataFrame) -> DataFrame:
    """Daily P&L of each factor: w = z / sum |z| held one row later. (factor, date, pnl)"""
    tot = scores.groupBy("factor", "date").agg(F.sum(F.abs("z")).alias("_t"))
    d = scores.join(tot, ["factor", "date"]).withColumn("w", F.coalesce(F.try_divide("z", "_t"), F.lit(0.0)))
    lagged = F.lag("w").over(series_window(("factor",), "ticker"))
    return d.select("factor", "date", (lagged * F.col("r")).alias("c")).groupBy("factor", "date").agg(
        F.coalesce(F.sum("c"), F.lit(0.0)).alias("pnl"))


def industry_momentum_scores(scores: DataFrame, sectors: DataFrame, base: str = "mom12_1") -> DataFrame:
    """One more factor: the mean past return of the name's subsector, z-scored per date."""
    from marketripple.operators.signal import zscore_xsec
    s = scores.where(F.col("factor") == base).drop("z").join(sectors.select("ticker", "subsector"), "ticker")
    g = s.groupBy("date", "subsector").agg(F.avg("score").alias("_g"))
    d = s.join(g, ["date", "subsector"]).select("date", "idx", "ticker", "r", F.lit("industry_mom").alias("factor"), F.col("_g").alias("score"))
    return zscore_xsec(d, "score", "z", keys=("factor",), fill=None)


def solved(rows: DataFrame, m: int, prefix: str = "a") -> DataFrame:
    """Gauss-Jordan steps over the columns a_i_j of an m x 2m system, one projection per pivot; the right half ends as the inverse
    of a symmetric positive left half. A column that adds nothing to those before it (its pivot is a 1e-12th of ``d_k``,
    what its diagonal was, or less) gets zeros."""
    name = lambda i, j: f"{prefix}_{i}_{j}"
    rest = [c for c in rows.columns if not c.startswith(prefix + "_")]
    for k in range(m):
        step = []
        for i in range(m):
            for j in range(2 * m):
                head = F.when(F.col(name(k, k)) > 1e-12 * F.col(f"d_{k}"), F.col(name(k, j)) / F.col(name(k, k))).otherwise(0.0)
                step.append((head if i == k else F.col(name(i, j)) - F.col(name(i, k)) * head).alias(name(i, j)))
        rows = rows.select(*rest, *step)
    return rows


def factor_attribution(pnl: DataFrame, factors: DataFrame, names: Sequence[str], lags: int = 21, periods: int = 252,
                       value: str = "net") -> DataFrame:
    """(term, coef, t, n) of the P&L on the factor books with intercept; errors with Bartlett weights.

    The cross products are one aggregate, their inverse a chain of projections of one row. A coefficient's error is the
    long-run variance of its own score series (inverse row times regressors times residual), so it needs lagged products
    of one series per term and no matrix of them. One row per date, so the date windows are small.
    """
    names, m = list(names), len(names) + 1
    wide = factors.groupBy("date").pivot("factor", names).agg(F.first("pnl"))
    d = pnl.select("date", F.col(value).alias("y")).join(wide, "date").dropna().withColumn("_1", F.lit(1.0))
    x = [F.col("_1"), *map(F.col, names)]
    cross = d.agg(*[F.sum(x[i] * x[j]).alias(f"a_{i}_{j}") for i in range(m) for j in range(m)], *[F.sum(x[i] * F.col("y")).alias(f"b_{i}") for i in range(m)])
    cross = cross.select("*", *[F.lit(float(i == j)).alias(f"a_{i}_{m + j}") for i in range(m) for j in range(m)], *[F.col(f"a_{i}_{i}").alias(f"d_{i}") for i in range(m)])
    inv = solved(cross, m).select(*[f"a_{i}_{m + j}" for i in range(m) for j in range(m)], *[f"b_{i}" for i in range(m)])
    dot = lambda a: sum(a[1:], a[0])
    coef = [dot([F.col(f"a_{i}_{m + j}") * F.col(f"b_{j}") for j in range(m)]).alias(f"c_{i}") for i in range(m)]
    one = inv.select(*[f"a_{i}_{m + j}" for i in range(m) for j in range(m)], *coef).withColumn("_k", F.lit(1))
    d = d.withColumn("_k", F.lit(1)).join(F.broadcast(one), "_k")  # one row
    u = F.col("y") - dot([F.col(f"c_{i}") * x[i] for i in range(m)])
    terms = ["alpha_year", *names]
    score = [F.struct(F.lit(t).alias("term"), F.col(f"c_{i}").alias("c"), (dot([F.col(f"a_{i}_{m + j}") * x[j] for j in range(m)]) * u).alias("v")) for i, t in enumerate(terms)]
    s = d.select("date", F.explode(F.array(*score)).alias("s")).select("date", "s.*")
    w = Window.partitionBy("term").orderBy("date")
    s = s.select("*", *[F.lag("v", k).over(w).alias(f"v{k}") for k in range(1, lags + 1)])
    lagged = [2 * (1 - k / (lags + 1)) * F.coalesce(F.sum(F.col("v") * F.col(f"v{k}")), F.lit(0.0)) for k in range(1, lags + 1)]
    g = s.groupBy("term").agg(F.first("c").alias("c"), F.count("v").alias("n"), (F.sum(F.col("v") * F.col("v")) + dot(lagged)).alias("var"))
    year = F.when(F.col("term") == "alpha_year", F.col("c") * periods).otherwise(F.col("c"))
    return g.select("term", year.alias("coef"), F.when(F.col("var") > 0, F.col("c") / F.sqrt("var")).alias("t"), "n")


def deflated_sharpe(s: DataFrame, r: str = "r", n_configs: int = 294, sd_sharpes: float = 0.42, periods: int = 252,
                    keys: Sequence[str] = ()) -> DataFrame:
    """Probability that the Sharpe beats the best of ``n_configs`` lucky ones, adjusted for skew and kurtosis."""
    root = math.sqrt(2 * math.log(max(n_configs, 2)))
    z = (1 - EULER) * root + EULER / root
    thr = sd_sharpes * z / math.sqrt(periods)
    g = s.groupBy(*keys).agg(F.count(r).alias("n"), sharpe_agg(r, periods, 20).alias("sharpe"), skew_agg(r).alias("skew"),
                             (kurt_agg(r) + 3.0).alias("kurtosis"))
    sd = F.col("sharpe") / math.sqrt(periods)
    den = F.sqrt(F.greatest(1 - F.col("skew") * sd + (F.col("kurtosis") - 1) / 4 * sd * sd, F.lit(1e-9)))
    g = g.withColumn("stat", (sd - thr) * F.sqrt(F.col("n").cast("double") - 1) / den)
    return g.select(*keys, "sharpe", F.lit(n_configs).alias("n_configs"), F.lit(thr * math.sqrt(periods)).alias("sharpe_threshold"),
                    normal_cdf("stat").alias("dsr"), "skew", "kurtosis")


# ---- selection protocols ----------------------------------------------------------------------------------


def walk_forward_choice(pnl: DataFrame, param: str, first_year: int, periods: int = 252, min_train: int = 60) -> DataFrame:
    """(year, chosen): for every test year the parameter with the best Sharpe on all earlier years.

    A row feeds every later test year, so one aggregation gives all expanding windows. Ties take the smallest
    parameter; too little history scores -9.
    """
    last = pnl.agg(F.max(F.year("date")).alias("m")).select("m").scalar()
    d = pnl.withColumn("year", F.explode(F.sequence(F.lit(first_year), F.greatest(last, F.lit(first_year)))))
    d = d.withColumn("x", F.when(F.year("date") < F.col("year"), F.col("net")))
    score = F.when(F.count("x") > min_train, F.coalesce(sharpe_agg("x", periods, 20), F.lit(-9.0))).otherwise(-9.0)
    g = d.groupBy("year", param).agg(score.alias("score"))
    return g.groupBy("year").agg(F.max_by(param, F.struct("score", (-F.col(param)).alias("p"))).alias(param))


def walk_forward_curve(pnl: DataFrame, choice: DataFrame, param: str, min_days: int = 20) -> DataFrame:
    """Daily net P&L of the chosen parameter in each test year with enough days."""
    d = pnl.withColumn("year", F.year("date")).join(F.broadcast(choice), ["year", param])  # one row per year
    n = d.groupBy("year").agg(F.count("net").alias("_n")).where(F.col("_n") >= min_days)
    return d.join(F.broadcast(n), "year", "left_semi").select("year", F.col(param).alias("chosen"), "date", "net")


def walk_forward(pnl: DataFrame, param: str, first_year: int, periods: int = 252, min_train: int = 60,
                 min_days: int = 20) -> DataFrame:
    c = walk_forward_curve(pnl, walk_forward_choice(pnl, param, first_year, periods, min_train), param, min_days)
    return c.groupBy("year", "chosen").agg(sharpe_agg("net", periods, 20).alias("sharpe"), compound_agg("net").alias("total_return"),
                                           F.count("net").alias("n"))


def frozen_choice(scores: DataFrame, param: str, criterion: str = "ic") -> DataFrame:
    """The parameter with the largest in-sample criterion; ties take the smallest parameter."""
    return scores.agg(F.max_by(param, F.struct(criterion, (-F.col(param)).alias("p"))).alias(param))


def frozen_decision(base: DataFrame, winner: DataFrame, min_sharpe: float = 0.05, min_breadth: float = 1.0) -> DataFrame:
    """Compare the frozen winner with the baseline out of sample and apply the decision rule."""
    b = base.select(F.col("sharpe").alias("sharpe_base"), F.col("n_eff").alias("breadth_base"), F.lit(1).alias("_k"))
    w = winner.select(F.col("sharpe").alias("sharpe_winner"), F.col("n_eff").alias("breadth_winner"), F.lit(1).alias("_k"))
    j = b.join(w, "_k").drop("_k")
    ds, db = F.col("sharpe_winner") - F.col("sharpe_base"), F.col("breadth_winner") - F.col("breadth_base")
    rule = F.when((ds > min_sharpe) & (db > min_breadth), "adopt").when(ds > min_sharpe, "sharpe_only").otherwise("reject")
    return j.select("*", ds.alias("d_sharpe"), db.alias("d_breadth"), rule.alias("decision"))


# ---- resampling -------------------------------------------------------------------------------------------


def block_bootstrap(s: DataFrame, r: str = "r", block: int = 21, draws: int = 1000, seed: int = 42, periods: int = 252) -> DataFrame:
    """(draw, sharpe) of resampled blocks of consecutive dates. Block starts come from a hash of (seed, draw, block).

    The sums of a block are differences of prefix sums of the series (less its mean) and of its square, so draws x blocks are
    rows that look up two positions each. NULL returns take no part; a draw without variance has NULL.
    """
    order = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)  # one row per date
    mean = s.agg(F.avg(r).alias("m")).select("m").scalar()
    c = s.select("date", (F.col(r) - mean).alias("c"))
    ends = c.select(F.row_number().over(Window.orderBy("date")).alias("pos"), F.count("c").over(order).alias("n"), F.sum(F.coalesce("c", F.lit(0.0))).over(order).alias("s"),
                    F.sum(F.coalesce(F.col("c") * F.col("c"), F.lit(0.0))).over(order).alias("q"))
    prefix = ends.unionByName(s.sparkSession.range(1).select(F.lit(0).alias("pos"), F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("s"), F.lit(0.0).alias("q")))
    d = s.agg(F.count(F.lit(1)).alias("size")).select("size", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    d = d.repartition("draw").select("size", "draw", F.explode(F.sequence(F.lit(0), F.expr(f"cast(ceil(size / {block}) as int) - 1"))).alias("b"))
    h = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), "draw", "b")), 1, 8), 16, 10).cast("long")
    d = d.withColumn("start", h % F.greatest(F.col("size") - block + 1, F.lit(1)))
    d = d.select("draw", "start", (F.col("start") + F.least(F.lit(block), F.col("size") - F.col("b") * block)).alias("end"))
    low, high = (F.broadcast(prefix.select(F.col("pos").alias(at), F.struct("n", "s", "q").alias(x))) for at, x in (("start", "low"), ("end", "high")))  # one row per date
    sums = d.join(low, "start").join(high, "end").groupBy("draw").agg(*[F.sum(F.col(f"high.{x}") - F.col(f"low.{x}")).alias(x) for x in "nsq"])
    var = F.try_divide(F.col("q") - F.try_divide(F.col("s") * F.col("s"), F.col("n").cast("double")), (F.col("n") - 1).cast("double"))
    sharpe = (mean + F.try_divide(F.col("s"), F.col("n").cast("double"))) / F.sqrt(var) * math.sqrt(periods)
    return sums.select("draw", F.when(var > NO_VARIANCE ** 2, sharpe).alias("sharpe"))


def bootstrap_summary(draws: DataFrame) -> DataFrame:
    q = F.percentile(F.col("sharpe"), F.array(F.lit(0.025), F.lit(0.975)))
    return draws.agg(q[0].alias("ci_low"), q[1].alias("ci_high"), F.avg((F.col("sharpe") > 0).cast("double")).alias("p_positive"),
                     F.count("sharpe").alias("n_draws"))


# ---- documented cuts --------------------------------------------------------------------------------------


def ic_by_band(signal: DataFrame, fwd: DataFrame, bands: DataFrame, overlap: int) -> DataFrame:
    """Mean IC per liquidity band of the target; ``bands`` is (date, ticker, band)."""
    s = signal.join(bands, ["date", "ticker"])
    return ic_summary(ic_daily(s.select("band", "date", "ticker", "z"), fwd, keys=("band",)), ("band",), overlap)


def leader_vs_sector(data: DataFrame, overlap: int) -> DataFrame:
    """Per-date slopes of y on the leader signal and on the sector mean, alone and together, averaged over dates.

    ``data`` is (date, ticker, leader, sector_mean, y).
    """
    ok = F.col("leader").isNotNull() & F.col("sector_mean").isNotNull() & F.col("y").isNotNull()
    d = data.where(ok)
    g = d.groupBy("date").agg(
        F.count("y").alias("n"), F.var_pop("leader").alias("v1"), F.var_pop("sector_mean").alias("v2"),
        F.covar_pop("leader", "sector_mean").alias("c12"), F.covar_pop("leader", "y").alias("c1y"), F.covar_pop("sector_mean", "y").alias("c2y"))
    det = F.col("v1") * F.col("v2") - F.col("c12") * F.col("c12")
    live = (F.col("n") >= 5) & (det > 1e-9 * F.col("v1") * F.col("v2"))
    g = g.where(live).select(
        F.explode(F.array(
            F.struct(F.lit("leader_alone").alias("term"), F.try_divide("c1y", "v1").alias("b")),
            F.struct(F.lit("sector_alone").alias("term"), F.try_divide("c2y", "v2").alias("b")),
            F.struct(F.lit("leader_joint").alias("term"), F.try_divide(F.col("c1y") * F.col("v2") - F.col("c2y") * F.col("c12"), det).alias("b")),
            F.struct(F.lit("sector_joint").alias("term"), F.try_divide(F.col("c2y") * F.col("v1") - F.col("c1y") * F.col("c12"), det).alias("b")))).alias("x")).select("x.*")
    return g.groupBy("term").agg(F.avg("b").alias("slope"), mean_t("b", overlap).alias("t"), F.count("b").alias("n"))
