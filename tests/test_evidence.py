import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketripple.functions.expr import kurt_agg, normal_cdf, skew_agg
from marketripple.operators import breadth as BR
from marketripple.operators import evidence as O
from tests.helpers import day


def test_normal_cdf(spark):
    xs = [-5.0, -1.96, -0.3, 0.0, 0.7, 2.5]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select(normal_cdf("x").alias("p")).collect()
    for x, r in zip(xs, got):
        assert r["p"] == pytest.approx(0.5 * (1 + math.erf(x / math.sqrt(2))), abs=1e-7)


def test_moments_are_bias_corrected(spark):
    import pandas as pd
    v = np.random.default_rng(0).gamma(2, size=60)
    r = spark.createDataFrame([(float(x),) for x in v], "x double").agg(skew_agg("x"), kurt_agg("x")).first()
    assert r[0] == pytest.approx(pd.Series(v).skew()) and r[1] == pytest.approx(pd.Series(v).kurt())


def test_clustered_errors(spark):
    rng = np.random.default_rng(1)
    rows, data = [], []
    for d in range(40):
        common = rng.normal()
        for e in range(5):
            x = rng.normal() + common
            y = 0.3 * x + common + rng.normal()
            rows.append(("k", f"a{e}", f"b{e}", day(d), float(x), float(y)))
            data.append((d, x, y))
    g = O.clustered_t_by_kind(spark.createDataFrame(rows, "kind string, src string, dst string, date date, x double, y double"), 10).first()
    d, x, y = np.array(data).T
    n, k = len(x), 40
    X = np.column_stack([np.ones(n), x])
    inv = np.linalg.inv(X.T @ X)
    b = inv @ X.T @ y
    u = (y - X @ b)[:, None] * X
    s = np.array([u[d == i].sum(axis=0) for i in range(k)])
    v = k / (k - 1) * (n - 1) / (n - 2) * inv @ (s.T @ s) @ inv
    assert g["t_cluster"] == pytest.approx(b[1] / math.sqrt(v[1, 1]), rel=1e-9)
    c = np.corrcoef(x, y)[0, 1]
    assert g["t_naive"] == pytest.approx(c * math.sqrt(n - 2) / math.sqrt(1 - c * c), rel=1e-9)


def test_newey_west_mean(spark):
    import pandas as pd
    rng = np.random.default_rng(2)
    e = rng.normal(size=120)
    v = 0.1 + e[1:] + 0.5 * e[:-1]
    g = O.newey_west_mean(spark.createDataFrame([(day(i), float(x)) for i, x in enumerate(v)], "date date, ic double"), 6).first()
    n, u = len(v), v - v.mean()

    def t(lags):
        var = (u @ u + 2 * sum((1 - k / (lags + 1)) * (u[k:] @ u[:-k]) for k in range(1, lags + 1))) / n ** 2
        return v.mean() / math.sqrt(var)

    assert g["t_hac"] == pytest.approx(t(6)) and g["lags_auto"] == 4 and g["t_hac_auto"] == pytest.approx(t(4))
    assert g["rho1"] == pytest.approx(pd.Series(v).autocorr(1))


def test_factor_attribution_by_hand(spark):
    """y = 2 + 3 f on f = -1, 0, 1, 0 with residuals 1, -1, 1, -1: the fit keeps (2, 3); errors by hand."""
    f, e = [-1.0, 0.0, 1.0, 0.0], [1.0, -1.0, 1.0, -1.0]
    fac = spark.createDataFrame([(k, day(i), v) for i, x in enumerate(f) for k, v in (("a", x), ("none", 0.0))], "factor string, date date, pnl double")
    pnl = spark.createDataFrame([(day(i), 2 + 3 * f[i] + e[i]) for i in range(4)], "date date, net double")
    got = {r["term"]: r for r in O.factor_attribution(pnl, fac, ("a", "none"), 1, 10).collect()}
    assert got["alpha_year"]["coef"] == pytest.approx(20) and got["a"]["coef"] == pytest.approx(3)
    # score of the intercept: e / 4 = 1/4, -1/4, 1/4, -1/4: sum of squares 4/16, lag one -3/16, weight 1 - 1/2, twice
    assert got["alpha_year"]["t"] == pytest.approx(2 / math.sqrt(4 / 16 - 3 / 16))
    # score of the slope: f e / 2 = -1/2, 0, 1/2, 0: squares 1/2, no lag
    assert got["a"]["t"] == pytest.approx(3 / math.sqrt(0.5))
    # a factor that never trades takes no part
    assert got["none"]["coef"] == 0 and got["none"]["t"] is None and all(r["n"] == 4 for r in got.values())


def test_breadth_of_known_cases(spark):
    """k identical names are one bet, k orthogonal ones are k; a constant name counts for nothing."""
    waves = {"A": [1, -1, 1, -1], "B": [1, 1, -1, -1], "C": [1, -1, -1, 1]}
    rows = lambda names: [(day(i), t, float(v)) for t, w in names.items() for i, v in enumerate(w)]
    schema = "date date, ticker string, z double"
    got = lambda names: BR.dense_breadth(spark.createDataFrame(rows(names), schema)).first()
    g = got(waves | {"flat": [5, 5, 5, 5]})
    assert g["n_names"] == 3 and g["n_eff"] == pytest.approx(3) and g["ratio"] == pytest.approx(1)
    assert got({"A": waves["A"], "A2": [10 * v for v in waves["A"]], "A3": [-v for v in waves["A"]]})["n_eff"] == pytest.approx(1)
    # two names with correlation 1/2: 4 / (2 + 2/4)
    assert got({"A": [1, -1, 0, 0, 1, -1, 0, 0], "B": [1, -1, 0, 0, 0, 0, 1, -1]})["n_eff"] == pytest.approx(4 / 2.5)
    pairs = BR.effective_breadth(spark.createDataFrame(rows(waves | {"flat": [5, 5, 5, 5]}), schema)).first()
    assert pairs["n_names"] == 3 and pairs["n_eff"] == pytest.approx(3)


@pytest.mark.parametrize("tile,block", [(256, 64), (4, 3)])
def test_pairwise_breadth_equals_pandas(spark, monkeypatch, tile, block):
    import numpy as np
    import pandas as pd
    monkeypatch.setattr(BR, "BLOCK", block)
    r = np.random.default_rng(3)
    common, rows, want = r.normal(size=40), [], {}
    for key in ("a", "b"):
        z = 0.7 * common[:, None] + r.normal(size=(40, 17))
        z[r.random(z.shape) < 0.4] = 0  # no signal
        z[:, 3] = 0
        z[:, 4] = np.where(np.arange(40) < 5, 2.5, 0)  # no variance
        z[:, 5] = np.where(np.arange(40) == 9, 1.0, 0)  # one signal
        z[:20, 6], z[20:, 7] = 0, 0  # no date in common
        f = pd.DataFrame(z).replace(0.0, np.nan).dropna(axis=1, how="all")
        f = f.loc[:, f.std() > 1e-12]
        c = np.nan_to_num(f.corr().to_numpy(), nan=0.0)
        np.fill_diagonal(c, 1.0)
        want[key] = (len(c), len(c) ** 2 / (c * c).sum())
        rows += [(key, day(i), f"N{j:02d}", float(z[i, j])) for i in range(40) for j in range(17)]
    rows += [("one", day(i), "N00", float(i)) for i in range(5)]
    got = BR.effective_breadth(spark.createDataFrame(rows, "key string, date date, ticker string, z double"), ("key",), tile=tile).collect()
    assert {g["key"]: g["n_names"] for g in got} == {k: v[0] for k, v in want.items()}
    assert all(g["n_eff"] == pytest.approx(want[g["key"]][1], rel=1e-9) for g in got)


@pytest.mark.parametrize("tile", [256, 9])
def test_positive_eigenvalues_equal_numpy(spark, tile):
    """One tile in a task and a matrix of tiles give the same, with negative eigenvalues in the matrix."""
    import pandas as pd
    r = np.random.default_rng(8)
    common, rows, want, least = r.normal(size=30), [], {}, 0.0
    for key, share in (("a", 0.9), ("b", 0.2)):
        z = share * common[:, None] + r.normal(size=(30, 14))
        z[r.random(z.shape) < 0.6] = 0
        f = pd.DataFrame(z).replace(0.0, np.nan)
        c = np.nan_to_num(f.corr().to_numpy(), nan=0.0)
        np.fill_diagonal(c, 1.0)
        ev = np.linalg.eigvalsh(c)
        least, ev = min(least, ev[0]), ev[ev > 0]
        want[key] = (14, ev.sum() ** 2 / (ev ** 2).sum(), ev[-1] / ev.sum())
        rows += [(key, day(i), f"N{j:02d}", float(z[i, j])) for i in range(30) for j in range(14)]
    assert least < -0.1
    rows += [("one", day(i), "N00", float(i)) for i in range(5)]
    got = BR.spectral_breadth(spark.createDataFrame(rows, "key string, date date, ticker string, z double"), ("key",), tile=tile).collect()
    assert {g["key"] for g in got} == set(want)
    for g in got:
        n, n_eff, share = want[g["key"]]
        assert g["n_names"] == n and g["n_eff"] == pytest.approx(n_eff, rel=1e-6) and g["pc1_share"] == pytest.approx(share, rel=1e-6)
        assert g["ratio"] == pytest.approx(n_eff / n, rel=1e-6)


def _gappy_signal(spark, names=23, dates=30):
    r = np.random.default_rng(5)
    z = 0.6 * r.normal(size=dates)[:, None] + r.normal(size=(dates, names))
    z[r.random(z.shape) < 0.5] = 0
    rows = [("a", day(i), f"N{j:02d}", float(z[i, j])) for i in range(dates) for j in range(names)]
    return spark.createDataFrame(rows, "key string, date date, ticker string, z double")


def test_tiles_of_a_matrix_are_solved_in_one_task(spark, monkeypatch):
    signal = _gappy_signal(spark)
    want = BR.spectral_breadth(signal, ("key",), tile=6, whole=22).first()  # by products of tiles

    def never(*args, **named):
        raise AssertionError("23 names need no products of tiles")
    monkeypatch.setattr(BR, "_spectrum", never)
    got = BR.spectral_breadth(signal, ("key",), tile=6).first()
    assert got["n_names"] == want["n_names"] == 23
    assert all(got[c] == pytest.approx(want[c], rel=1e-6) for c in ("n_eff", "ratio", "pc1_share"))


def test_a_date_of_a_tile_moves_as_one_row(spark, monkeypatch):
    import pyarrow as pa

    def counted(names, give, out):
        def run(batches):
            for b in batches:
                if b.num_rows:
                    yield pa.RecordBatch.from_pylist([{"key": "a", "energy": float(b.num_rows)}], out)
        return run
    monkeypatch.setattr(BR, "_tile_pairs", counted)
    got = BR.effective_breadth(_gappy_signal(spark), ("key",)).first()
    assert got["n_names"] ** 2 / got["n_eff"] == pytest.approx(2 * 30)  # both halves of the one tile, 30 dates


@pytest.mark.parametrize("held", [4, 1])
def test_dense_breadth_adds_up_tasks_and_explodes_no_pair_of_dates(spark, monkeypatch, held):
    monkeypatch.setattr(BR, "HELD", held)
    r = np.random.default_rng(4)
    rows, want = [], {}
    for key in ("a", "b"):
        z = r.normal(size=(25, 40))
        z[r.random(z.shape) < 0.5] = 0
        z[:, 7] = 3.0  # no variance
        c = np.corrcoef(np.delete(z, 7, axis=1).T)
        want[key] = (39, 39 ** 2 / (c * c).sum())
        rows += [(key, day(i), f"N{j:02d}", float(z[i, j])) for i in range(25) for j in range(40)]
    rows += [("a", day(30), "N03", None), (None, day(0), "N00", 1.0), (None, day(1), "N00", 2.0)]
    got = BR.dense_breadth(spark.createDataFrame(rows, "key string, date date, ticker string, z double").repartition(5), ("key",))
    assert "Generate" not in _plan(got)
    assert {g["key"]: (g["n_names"], pytest.approx(g["n_eff"], rel=1e-9)) for g in got.collect()} == want


def test_tiles_meet_without_moving_once_per_other_tile(spark):
    plan = _plan(BR.effective_breadth(_gappy_signal(spark), ("key",), tile=4))
    assert "CartesianProduct" in plan and "Generate" not in plan


def test_half_of_a_symmetric_matrix_is_written(spark, monkeypatch):
    written, write = {}, BR.materialise

    def kept(df, label):
        written[label] = write(df, label)
        return written[label]
    monkeypatch.setattr(BR, "materialise", kept)
    BR.spectral_breadth(_gappy_signal(spark), ("key",), tile=6)
    places = [(r["i"], r["j"]) for r in written["br_tiles"].collect()]
    assert len(places) == len(set(places)) > 3 and all(i <= j for i, j in places)


def test_lag_rule_beyond_the_lags_is_an_error(spark):
    ic = spark.range(200).selectExpr("date_add(date'2000-01-01', cast(id as int)) as date", "cast(id % 7 as double) as ic")
    with pytest.raises(Exception, match="auto_cap"):
        O.newey_west_mean(ic, 2, auto_cap=3).collect()


def test_placebo_keeps_structure(spark):
    import datetime as dt
    mth = dt.date(2020, 1, 31)
    names = [f"N{i}" for i in range(8)]
    g = spark.createDataFrame([(mth, "v", h, t, 0.5, 1) for h in ("N0", "N1") for t in names if t != h] + [(mth, "v", "N0", "X", 0.5, 1)],
                              "valid_month date, variant string, src string, dst string, strength double, direction int")
    sub = spark.createDataFrame([(n, "S") for n in names], "ticker string, subsector string")
    out = O.placebo_graphs(g, sub, 6, seed=7).toPandas()
    assert (out["src"] != out["dst"]).all() and set(out["draw"]) == set(range(6))
    assert (out[out["dst"] == "X"]["src"] == "N0").all()  # targets without a subsector keep their trigger
    marked = O.placebo_graphs(g, sub.withColumn("subsector", F.lit("A DEFINIR")), 3).toPandas()
    assert set(marked["src"]) == {"N0", "N1"}  # the unknown class is no block to draw from
    inside = out[out["dst"] != "X"]
    assert (inside.groupby("draw")["src"].nunique() == 2).all() and inside["src"].nunique() > 2
    again = O.placebo_graphs(g, sub, 6, seed=7).toPandas()
    key = ["draw", "src", "dst"]
    assert out.sort_values(key)[key].values.tolist() == again.sort_values(key)[key].values.tolist()


def _big_block(spark):
    import datetime as dt
    mth = dt.date(2020, 1, 31)
    rows = [(mth, v, h, f"N{i:03d}", 0.25 * (1 + (h == "N000")), 1 if i % 7 else -1) for v, hs in (("K2", ("N000", "N001")), ("K3", ("N000", "N001", "N002")))
            for h in hs for i in range(150) if h != f"N{i:03d}"] + [(mth, "K2", "N000", "X", 0.5, 1)]
    g = spark.createDataFrame(rows, "valid_month date, variant string, src string, dst string, strength double, direction int")
    return g, spark.createDataFrame([(f"N{i:03d}", "S") for i in range(150)], "ticker string, subsector string")


@pytest.mark.parametrize("spare", [40, 0])
def test_drawn_heads_are_the_first_of_the_hash_order(spark, spare):
    import hashlib
    g, sub = _big_block(spark)
    known = O._blocked(g, sub).where("block is not null")
    got = {(r["draw"], r["variant"], r["src"]): r["new_src"] for r in O._drawn_heads(known, 20, 42, spare).collect()}
    for draw in range(20):
        for v, hs in (("K2", ("N000", "N001")), ("K3", ("N000", "N001", "N002"))):
            order = sorted((hashlib.md5(f"42|{draw}|2020-01|{v}|S|N{i:03d}".encode()).hexdigest(), f"N{i:03d}") for i in range(150))
            assert [got[draw, v, h] for h in hs] == [m for _, m in order[:len(hs)]]
    assert len(got) == 20 * 5


def test_placebo_sizes_equal_the_drawn_graphs(spark):
    g, sub = _big_block(spark)
    by = ["draw", "valid_month", "variant"]
    drawn = O.placebo_graphs(g, sub, 20)
    want = drawn.groupBy(*by).agg(F.count("dst").alias("n_edges"), F.sum(F.col("strength") * F.col("direction")).alias("strength"),
                                  F.count_distinct("src").alias("n_triggers"), F.min("src").alias("first_src"), F.max("src").alias("last_src"))
    got = O.placebo_sizes(g, sub, 20)
    assert "BroadcastHashJoin Inner BuildLeft" not in drawn._jdf.queryExecution().executedPlan().toString().replace(",", "")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_drawn_heads_broadcast_no_edges_or_draws(spark):
    g, sub = _big_block(spark)
    known = O._blocked(g, sub).where("block is not null")
    assert "BroadcastHashJoin" not in _plan(known) and "BroadcastHashJoin" not in _plan(O._drawn_heads(known, 5, 42))


def test_packed_tables_of_the_placebo_are_not_broadcast(spark, monkeypatch):
    import datetime as dt
    from marketripple.functions.expr import salted_join
    g, sub = _big_block(spark)
    p = spark.createDataFrame([(dt.date(2020, 1, 3), f"N{i:03d}", float(i), 0.1 * i) for i in range(150)], "date date, ticker string, acc double, y double")
    plans, write = {}, O.materialise
    monkeypatch.setattr(O, "materialise", lambda df, label: (plans.update({label: _plan(df)}), write(df, label))[1])
    O.placebo_ic(p, g, sub, 3)
    assert all("BroadcastHashJoin" not in plans[label] for label in ("class_members", "class_load", "placebo_dates"))
    assert "BroadcastHashJoin" not in _plan(O.ic_daily(p.withColumn("z", F.col("acc")), p))
    assert "BroadcastHashJoin" not in _plan(salted_join(p, p.select("date", "ticker"), ["date", "ticker"], "ticker", merge=True))


def test_placebo_ic_equals_the_signal_over_drawn_edges(spark):
    import datetime as dt
    from marketripple.operators import signal as S
    g, sub = _big_block(spark)
    g = g.where(~F.col("dst").isin("N004") | (F.col("src") == "N001"))  # another class
    last = dt.date(2020, 2, 29)  # a month with two targets, which lose all their edges in some draws
    lone = [(last, "K2", "L0", "L1", 1.0, 1), (last, "K2", "L1", "L0", 1.0, 1), (last, "K2", "L2", "L1", 0.5, 1)]
    g = g.unionByName(spark.createDataFrame(lone, g.schema))
    sub = sub.unionByName(spark.createDataFrame([(f"L{i}", "T") for i in range(3)], sub.schema))
    rng = np.random.default_rng(3)
    names = [f"N{i:03d}" for i in range(150)] + ["X", "L0", "L1", "L2"]
    rows = [(dt.date(2020, mth, 3 + 7 * k), n, None if rng.random() < .2 else float(rng.normal()), None if rng.random() < .2 else float(rng.normal(.1, 1)))
            for mth in (1, 2) for k in range(3) for n in names]
    p = spark.createDataFrame(rows, "date date, ticker string, acc double, y double")
    drawn = O.placebo_graphs(g, sub, 12).localCheckpoint()
    raw = S.propagate_temporal_ensemble(p, drawn, keys=("draw",), n_variants=g.agg(F.count_distinct("variant").alias("n")).select("n").scalar()).localCheckpoint()
    dense = p.select("date", "ticker").join(drawn.select("draw", F.col("dst").alias("ticker")).distinct(), "ticker").join(
        S.standardise(raw, keys=("draw",)).select("draw", "date", "ticker", "z"), ["draw", "date", "ticker"], "left").withColumn("z", F.coalesce("z", F.lit(0.0)))
    want = {(r["draw"], r["date"]): r["ic"] for r in O.ic_daily(dense, p.select("date", "ticker", "y"), keys=("draw",)).collect()}
    got = {(r["draw"], r["date"]): r["ic"] for r in O.placebo_ic(p, g, sub, 12).collect()}
    assert len({t for t in drawn.select("draw", "dst").distinct().groupBy("dst").count().toPandas()["count"]}) > 1  # some draw lacks a target
    assert got.keys() == want.keys() and len(got) > 40
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_walk_forward_uses_only_the_past(spark):
    import datetime as dt
    rng = np.random.default_rng(5)
    rows = []
    for y in (2018, 2019, 2020):
        for d in range(100):
            rows.append((1, dt.date(y, 1, 1) + dt.timedelta(d), float(rng.normal(0.01 if y == 2018 else -0.01, .01))))
            rows.append((2, dt.date(y, 1, 1) + dt.timedelta(d), float(rng.normal(0.0 if y == 2018 else 0.02, .01))))
    pnl = spark.createDataFrame(rows, "p int, date date, net double")
    got = {r["year"]: r["p"] for r in O.walk_forward_choice(pnl, "p", 2019).collect()}
    assert got == {2019: 1, 2020: 2}


def test_ic_drops_dates_without_variance(spark):
    s = spark.createDataFrame([(day(0), "A", 1.0), (day(0), "B", 1.0), (day(1), "A", 1.0), (day(1), "B", 2.0)], "date date, ticker string, z double")
    f = spark.createDataFrame([(day(d), t, v) for d in (0, 1) for t, v in (("A", .1), ("B", .2))], "date date, ticker string, y double")
    ic = O.ic_daily(s, f).collect()
    assert len(ic) == 1 and ic[0]["date"] == day(1) and ic[0]["ic"] == pytest.approx(1.0)


def test_bootstrap_draws_whole_blocks(spark):
    s = spark.createDataFrame([(day(i), float(i % 7) - 3) for i in range(50)], "date date, r double")
    b = O.block_bootstrap(s, "r", 10, 20)
    assert b.count() == 20 and b.where(F.col("sharpe").isNull()).count() == 0


def test_bootstrap_equals_resampled_rows(spark):
    import hashlib

    import numpy as np
    r = [0.01 * math.sin(3 * i) + 5.0 if i % 7 else None for i in range(50)]
    s = spark.createDataFrame([(day(i), v) for i, v in enumerate(r)], "date date, r double")
    got = {x["draw"]: x["sharpe"] for x in O.block_bootstrap(s, "r", 8, 30).collect()}
    for draw in range(30):
        rows = []
        for b in range(7):
            start = int(hashlib.md5(f"42|{draw}|{b}".encode()).hexdigest()[:8], 16) % 43
            rows += r[start:start + 8][:50 - 8 * b]
        rows = [x for x in rows if x is not None]
        assert got[draw] == pytest.approx(np.mean(rows) / np.std(rows, ddof=1) * math.sqrt(252), rel=1e-6)
    flat = O.block_bootstrap(s.selectExpr("date", "1.0D as r"), "r", 8, 2).collect()
    assert [x["sharpe"] for x in flat] == [None, None]


def test_thresholds_that_choose_alike_are_worked_out_once(spark):
    from types import SimpleNamespace

    from marketripple.catalog import q_evidence as Q
    names = [(f"A{i:02d}", "A") for i in range(13)] + [(f"B{i:02d}", "B") for i in range(15)] + [(f"U{i:02d}", "A DEFINIR") for i in range(40)]
    m = SimpleNamespace(names=spark.createDataFrame(names, "ticker string, subsector string"),
                        panel=spark.createDataFrame([(t, 1.0) for t, _ in names], "ticker string, close double"))
    assert Q._k_classes(m) == {0: 0, 12: 12, 14: 14, 16: 0, 18: 0, 19: 0, 20: 0, 22: 0}
    got = Q._for_all_k(m, spark.createDataFrame([(0, "x"), (12, "y"), (14, "z")], "k int, v string")).collect()
    assert sorted(map(tuple, got)) == [(k, {12: "y", 14: "z"}.get(k, "x")) for k in Q.KGRID]
