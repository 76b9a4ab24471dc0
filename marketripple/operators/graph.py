"""Rule-built temporal graphs, static edge lists and graph statistics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketripple.functions.expr import corr_agg, known_class, months_between_rule, pair_count, salted_join
from marketripple.operators.panel import resample_month
from marketripple.session import materialise


def ticker_root(t: str | Column) -> Column:
    return F.regexp_replace(F.col(t) if isinstance(t, str) else t, "[0-9]+$", "")


def lagged_month_end(adtv: DataFrame) -> DataFrame:
    """Last known ADTV of each month, valid in the following month that the panel also has."""
    last = resample_month(adtv, "adtv", "last", "v")
    months = adtv.select(F.last_day("date").alias("valid_month")).distinct()
    moved = last.select("ticker", months_between_rule("month_end", 1).alias("valid_month"), "v")
    return moved.join(F.broadcast(months), "valid_month", "left_semi")  # one row per calendar month


def eligible_members(adtv: DataFrame, sectors: DataFrame, min_adtv: float) -> DataFrame:
    """(valid_month, subsector, ticker, root, v) of liquid names with a known subsector."""
    known = sectors.where(known_class("subsector")).select("ticker", "subsector")
    return (lagged_month_end(adtv).where(F.col("v") >= min_adtv).join(known, "ticker")
            .withColumn("root", ticker_root("ticker")))


def group_heads(members: DataFrame, ks: Sequence[int], min_members: int) -> DataFrame:
    """Heads per (month, subsector, k): the most liquid name of each of the k most liquid roots, in groups of at
    least ``min_members`` members (counted before roots merge).

    Ranks run over per-root maxima and are cut at max(ks), so the ranking keeps only the top rows per task.
    """
    best = members.groupBy("valid_month", "subsector", "root").agg(
        F.min(F.struct((-F.col("v")).alias("nv"), F.col("ticker"))).alias("h"), F.count("ticker").alias("c"))
    size = best.groupBy("valid_month", "subsector").agg(F.sum("c").alias("n_members"))
    best = best.select("valid_month", "subsector", "root", F.col("h.ticker").alias("head"), (-F.col("h.nv")).alias("hv"))
    w = Window.partitionBy("valid_month", "subsector").orderBy(F.desc("hv"), "head")
    top = best.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= max(ks))
    byk = top.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).where(F.col("rk") <= F.col("k"))
    tot = byk.groupBy("valid_month", "subsector", "k").agg(
        F.collect_list(F.struct("head", "root", "hv")).alias("heads"),  # at most max(ks) entries
        F.count("head").alias("n_heads"), F.sum("hv").alias("sum_hv"))
    return tot.where(F.col("n_heads") >= 2).join(
        size.where(F.col("n_members") >= min_members), ["valid_month", "subsector"], "left_semi")


def build_rule_graph(adtv: DataFrame, sectors: DataFrame, ks: Sequence[int] = (2, 3, 5),
                     weights: Sequence[str] = ("equal", "adtv"), min_adtv: float = 1e5, min_members: int = 4,
                     max_satellites: int | None = None) -> DataFrame:
    """Monthly edges head -> member inside each subsector, one variant per (k, weighting).

    The heads of a (month, subsector) travel as one short array, so the join adds one row per member and k and
    the edges unfold without a shuffle of heads x members.
    """
    members = eligible_members(adtv, sectors, min_adtv)
    heads = group_heads(members, ks, min_members)
    sat = members.select("valid_month", "subsector", "ticker", "root", "v")
    # a subsector may hold a third of all names: such members are cut by name, the few head rows repeat
    j = salted_join(heads, sat, ["valid_month", "subsector"], "ticker")
    if max_satellites is not None:
        j = cap_satellites(j, max_satellites)
    e = j.select("valid_month", "k", "n_heads", "sum_hv", F.col("ticker").alias("dst"), F.col("root").alias("dst_root"),
                 F.explode("heads").alias("h")).where(F.col("h.root") != F.col("dst_root"))
    kinds = {"equal": 1.0 / F.col("n_heads"), "adtv": F.try_divide(F.col("h.hv"), F.col("sum_hv"))}
    opts = F.array(*[F.struct(F.lit(wn).alias("wn"), kinds[wn].alias("f")) for wn in weights])
    return e.select("valid_month", "k", "dst", F.col("h.head").alias("src"), F.explode(opts).alias("o")).select(
        "valid_month", F.concat(F.lit("K"), F.col("k").cast("string"), F.lit("_"), F.col("o.wn")).alias("variant"),
        "src", "dst", F.col("o.f").alias("strength"), F.lit(1).alias("direction"))


def cap_satellites(joined: DataFrame, n: int) -> DataFrame:
    """Keep heads plus the ``n`` most liquid other members of each (month, subsector, k)."""
    is_head = F.array_contains(F.transform("heads", lambda h: h["head"]), F.col("ticker"))
    w = Window.partitionBy("valid_month", "subsector", "k").orderBy(F.desc("v"), "ticker")
    others = joined.where(~is_head).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")
    return joined.where(is_head).unionByName(others)


def graph_stats(graph: DataFrame) -> DataFrame:
    """Per variant: edges, edges per month, triggers, satellites. Each distinct count is two plain aggregates."""
    out = graph.groupBy("variant").agg(F.count("src").alias("n_edges"))
    for c, name in (("valid_month", "n_months"), ("src", "n_triggers"), ("dst", "n_satellites")):
        out = out.join(graph.select("variant", c).distinct().groupBy("variant").agg(F.count(c).alias(name)), "variant")
    return out.withColumn("edges_per_month", F.try_divide(F.col("n_edges").cast("double"), F.col("n_months").cast("double")))


def graph_stats_by_year(graph: DataFrame) -> DataFrame:
    e = graph.select(F.year("valid_month").alias("year"), "src", "dst")
    names = e.select("year", F.explode(F.array("src", "dst")).alias("t")).groupBy("year").agg(
        F.count_distinct("t").alias("n_names"))
    pairs = e.groupBy("year").agg(F.count("src").alias("n_edges"),
                                  F.count_distinct("src", "dst").alias("n_pairs"))
    return pairs.join(names, "year")


def reverse_graph(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"),
                        F.concat("kind", F.lit("_rev")).alias("kind"), "strength", "direction")


def bidirectional(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", "kind", "strength", "direction").unionByName(reverse_graph(edges))


def append_edges(base: DataFrame, extra: DataFrame) -> DataFrame:
    """Union of edge lists that keeps where each edge came from."""
    return base.withColumn("source", F.lit("base")).unionByName(extra.withColumn("source", F.lit("historical")))


def split_by_provenance(edges: DataFrame, base: DataFrame) -> DataFrame:
    """Edges tagged base or historical by membership of (src, dst) in ``base``, with a duplicate flag."""
    b = base.groupBy("src", "dst").agg(F.lit(True).alias("in_base"))
    dup = edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("copies"))
    return (edges.join(b, ["src", "dst"], "left").join(dup, ["src", "dst"])
            .select("src", "dst", "kind", F.when(F.col("in_base"), "base").otherwise("historical").alias("source"), "copies"))


def edge_reproduction(rule: DataFrame, manual: DataFrame, sectors: DataFrame) -> DataFrame:
    """Share of the manual edges inside one subsector that the rule graph has, as written and reversed."""
    sub = sectors.select("ticker", "subsector")
    m = (manual.select("src", "dst").distinct()
         .join(sub.withColumnsRenamed({"ticker": "src", "subsector": "s1"}), "src")
         .join(sub.withColumnsRenamed({"ticker": "dst", "subsector": "s2"}), "dst")
         .where(F.col("s1") == F.col("s2")).select("src", "dst"))
    pairs = rule.groupBy("src", "dst").agg(F.lit(1).alias("hit"))
    back = pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("hit").alias("rev"))
    return m.join(pairs, ["src", "dst"], "left").join(back, ["src", "dst"], "left").agg(
        F.count("src").alias("n_manual"), F.count("hit").alias("n_found"), F.count("rev").alias("n_reversed"),
        F.try_divide(F.count("hit").cast("double"), F.count("src").cast("double")).alias("share_found"),
        F.try_divide(F.count("rev").cast("double"), F.count("src").cast("double")).alias("share_reversed"))


def out_degree(edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return edges.groupBy(*keys, "src").agg(F.count("dst").alias("degree"))


def degree_stats(edges: DataFrame) -> DataFrame:
    d = out_degree(edges).agg(F.count("src").alias("n_triggers"), F.max("degree").alias("max_degree"),
                              F.avg("degree").alias("mean_degree"), F.sum("degree").alias("n_edges"))
    sats = edges.agg(F.count_distinct("dst").alias("n")).select("n").scalar()
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("t")).agg(F.count_distinct("t").alias("n")).select("n").scalar()
    return d.select("*", sats.alias("n_satellites"), nodes.alias("n_nodes"))


def top_degree(edges: DataFrame, n: int = 8) -> DataFrame:
    return out_degree(edges).orderBy(F.desc("degree"), "src").limit(n)


def effective_triggers(edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Inverse Herfindahl index of out-degree shares, from two moments of the degrees."""
    d = out_degree(edges, keys)
    deg = F.col("degree").cast("double")
    return d.groupBy(*keys).agg(F.try_divide(F.sum(deg) * F.sum(deg), F.sum(deg * deg)).alias("effective_triggers"))


def merge_parallel_edges(edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return edges.groupBy(*keys, "src", "dst").agg(F.sum("strength").alias("strength"), F.count(F.lit(1)).alias("n_merged"))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) with the smallest node name of each undirected component.

    Alternating large-star and small-star steps rewire edges towards the component minimum; the number of rounds
    grows with the logarithm of the component diameter. Each round is written to the shared folder, which cuts
    the lineage and survives lost executors; only one count per round reaches the driver.
    """
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    cur = materialise(edges.where(F.col("src") != F.col("dst")).select(
        F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), "cc")
    for _ in range(max_rounds):
        # large star: every neighbour above u points to the minimum of u's closed neighbourhood
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where(F.col("u") != F.col("v")).distinct()
        # small star: u and its smaller neighbours point to the minimum smaller neighbour
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low2.select("u", F.col("m").alias("v"))).where(F.col("u") != F.col("v")).distinct()
        nxt = materialise(small, "cc")
        moved = nxt.join(cur, ["u", "v"], "left_anti").limit(1).count() + cur.join(nxt, ["u", "v"], "left_anti").limit(1).count()
        cur = nxt
        if moved == 0:
            break
    else:
        raise RuntimeError("components did not settle")
    return nodes.join(cur.select(F.col("u").alias("node"), F.col("v").alias("m")), "node", "left").select(
        "node", F.coalesce("m", "node").alias("component"))


def bridges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).intersect(edges.select(F.col("dst").alias("node")))


def density(edges: DataFrame) -> DataFrame:
    e = edges.select("src", "dst").distinct()
    n = e.select(F.explode(F.array("src", "dst")).alias("t")).agg(F.count_distinct("t").alias("n")).select("n").scalar()
    return e.agg(F.count("src").alias("n_edges")).select("n_edges", n.alias("n_nodes")).withColumn(
        "density", F.try_divide(F.col("n_edges").cast("double"), (F.col("n_nodes") * (F.col("n_nodes") - 1)).cast("double")))


def degree_centrality(edges: DataFrame) -> DataFrame:
    e = edges.select("src", "dst").distinct()
    ends = e.select(F.explode(F.array("src", "dst")).alias("node"))
    n = ends.agg(F.count_distinct("node").alias("n")).select("n").scalar()
    return ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree")).withColumn(
        "centrality", F.try_divide(F.col("degree").cast("double"), (n - 1).cast("double")))


def edge_pairs(edges: DataFrame, shocks: DataFrame, fwd: DataFrame, until: str | None = None) -> DataFrame:
    """(kind, src, dst, date, x = shock of src at t, y = return of dst at the next row) where both exist.

    ``fwd`` holds the next-row return ``y`` per (date, ticker); the cut-off bounds t, not t + 1.
    """
    s = shocks.where(F.col("x").isNotNull()).select("date", F.col("ticker").alias("src"), "x")
    r = fwd.where(F.col("y").isNotNull()).select("date", F.col("ticker").alias("dst"), "y")
    if until:
        s = s.where(F.col("date") <= F.lit(until).cast("date"))
    e = edges.select("kind", "src", "dst")
    return salted_join(s, e, ["src"], "dst").join(r, ["date", "dst"])


def direction_by_kind(edges: DataFrame, shocks: DataFrame, fwd: DataFrame, until: str | None = None,
                      min_pairs: int = 100) -> DataFrame:
    """Pooled correlation, t, size and sign per kind over edges with enough observations.

    Per-edge counts join back on the edge, whose rows are bounded by the calendar.
    """
    p = edge_pairs(edges, shocks, fwd, until)
    enough = p.groupBy("kind", "src", "dst").agg(F.count("x").alias("_k")).where(F.col("_k") >= min_pairs)
    d = p.join(enough.select("kind", "src", "dst"), ["kind", "src", "dst"], "left_semi")
    r = d.groupBy("kind").agg(corr_agg("x", "y").alias("corr"), pair_count("x", "y").alias("n"),
                              F.count_distinct("src", "dst").alias("n_edges"))
    c = F.col("corr")
    return r.withColumn("t", F.try_divide(c * F.sqrt((F.col("n") - 2).cast("double")), F.sqrt(1 - c * c))).withColumn(
        "sign", F.when(c >= 0, 1).otherwise(-1))


def freeze_directions(edges: DataFrame, measured: DataFrame, prior: Mapping[str, int], rule: str = "sign",
                      t_min: float = 2.0) -> DataFrame:
    """Replace only ``direction``: measured sign, or the prior unless |t| >= ``t_min`` (conservative), or the prior."""
    pr = F.coalesce(*[F.when(F.col("kind") == k, v) for k, v in prior.items()], F.col("direction"))
    if rule == "prior":
        return edges.withColumn("direction", pr.cast("int"))
    j = edges.join(F.broadcast(measured.select("kind", "sign", "t")), "kind", "left")  # one row per edge kind
    new = {"sign": F.coalesce("sign", "direction"),
           "conservative": F.when(F.abs("t") >= t_min, F.col("sign")).otherwise(pr)}[rule]
    return j.withColumn("direction", new.cast("int")).drop("sign", "t").select(*edges.columns)


def graph_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("src", "dst", "kind", F.col("direction").alias("direction_a")).join(
        b.select("src", "dst", "kind", F.col("direction").alias("direction_b")), ["src", "dst", "kind"]).where(
        F.col("direction_a") != F.col("direction_b"))


def direction_stability(first: DataFrame, second: DataFrame) -> DataFrame:
    """Per kind both signs and whether they agree."""
    return first.select("kind", F.col("corr").alias("corr_a"), F.col("sign").alias("sign_a")).join(
        second.select("kind", F.col("corr").alias("corr_b"), F.col("sign").alias("sign_b")), "kind").withColumn(
        "same_sign", F.col("sign_a") == F.col("sign_b"))


def two_hop_paths(edges: DataFrame) -> DataFrame:
    """src -> mid -> dst with multiplied strengths, summed over the middle names."""
    a = edges.select("src", F.col("dst").alias("mid"), F.col("strength").alias("f1"))
    b = edges.select(F.col("src").alias("mid"), "dst", F.col("strength").alias("f2"))
    return salted_join(b, a, ["mid"], "src").where(F.col("src") != F.col("dst")).groupBy("src", "dst").agg(
        F.count("mid").alias("n_paths"), F.sum(F.col("f1") * F.col("f2")).alias("strength"))


def overlay_graphs(rule: DataFrame, manual: DataFrame) -> DataFrame:
    """Rule pairs plus the manual edges whose pair the rule graph never has."""
    r = rule.groupBy("src", "dst").agg(F.avg("strength").alias("strength"))
    extra = manual.join(r, ["src", "dst"], "left_anti").groupBy("src", "dst").agg(F.sum("strength").alias("strength"))
    return r.withColumn("layer", F.lit("rule")).unionByName(extra.withColumn("layer", F.lit("manual")))


def liquidity_gap_strength(graph: DataFrame, month_adtv: DataFrame) -> DataFrame:
    """Strength as the log ratio of head to target liquidity in the valid month, floored at 0.

    Both joins are merge joins at every size: the graph's few values pack so well that its files look small enough to be
    broadcast when its rows are not.
    """
    m = month_adtv.select("valid_month", "ticker", "v")
    return (graph.select("valid_month", "variant", "src", "dst").hint("merge")
            .join(m.withColumnsRenamed({"ticker": "src", "v": "v_src"}), ["valid_month", "src"]).hint("merge")
            .join(m.withColumnsRenamed({"ticker": "dst", "v": "v_dst"}), ["valid_month", "dst"])
            .withColumn("strength", F.greatest(F.lit(0.0), F.ln(F.try_divide("v_src", "v_dst")))))
