import datetime as dt
import shutil
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from marketripple.operators import graph as G
from marketripple.operators import metrics as M
from marketripple.operators import reference_data as R
from marketripple.operators import returns as RET
from marketripple.operators import signal as S
from marketripple.operators import universe as U
from marketripple.plans.market import market
from marketripple.sources import files as FS
from tests.helpers import day

EDGE = "src string, dst string, kind string, strength double, direction int"


def edges(spark, pairs):
    return spark.createDataFrame([(a, b, "k", 1.0, 1) for a, b in pairs], EDGE)


def test_components_long_chain_and_islands(spark):
    chain = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(40)]
    got = {r["node"]: r["component"] for r in G.connected_components(edges(spark, chain + [("x", "y"), ("z", "y"), ("s", "s")])).collect()}
    assert {got[n] for n in got if n[0] == "c"} == {"c000"} and len(got) == 45
    assert got["x"] == got["y"] == got["z"] == "x" and got["s"] == "s"


def test_rule_graph_roots_and_lag(spark):
    rows = []
    for t, v in {"AAAA3": 9e5, "AAAA4": 8e5, "BBBB3": 7e5, "CCCC3": 2e5, "DDDD3": 1e4}.items():
        rows += [(dt.date(2020, 1, 10), t, v), (dt.date(2020, 2, 10), t, v / 2)]
    adtv = spark.createDataFrame(rows, "date date, ticker string, adtv double")
    sec = spark.createDataFrame([(t, "S") for t in ("AAAA3", "AAAA4", "BBBB3", "CCCC3", "DDDD3")], "ticker string, subsector string")
    g = G.build_rule_graph(adtv, sec, ks=(2,), min_members=4).toPandas()
    assert set(g["valid_month"]) == {dt.date(2020, 2, 29)}  # January values, valid in February only
    eq = g[g["variant"] == "K2_equal"]
    assert set(eq["src"]) == {"AAAA3", "BBBB3"} and "DDDD3" not in set(eq["dst"])
    assert set(eq[eq["src"] == "AAAA3"]["dst"]) == {"BBBB3", "CCCC3"}  # same root excluded
    assert set(eq[eq["src"] == "BBBB3"]["dst"]) == {"AAAA3", "AAAA4", "CCCC3"}
    w = g[(g["variant"] == "K2_adtv") & (g["src"] == "AAAA3")]["strength"].iloc[0]
    assert w == pytest.approx(9 / 16)
    assert G.build_rule_graph(adtv, sec, ks=(2,), min_members=5).count() == 0


def test_parallel_edges_add_and_missing_variant_dilutes(spark):
    sh = spark.createDataFrame([(dt.date(2020, 2, 3), "A", 2.0)], "date date, ticker string, acc double")
    g = spark.createDataFrame([(dt.date(2020, 2, 29), "v1", "A", "B", 1.0, 1), (dt.date(2020, 2, 29), "v1", "A", "B", 0.5, 1),
                               (dt.date(2020, 3, 31), "v2", "A", "B", 1.0, 1)],
                              "valid_month date, variant string, src string, dst string, strength double, direction int")
    got = S.propagate_temporal_ensemble(sh, g).collect()
    assert len(got) == 1 and got[0]["raw"] == pytest.approx(2.0 * 1.5 / 2)


def test_zero_is_no_signal(spark):
    raw = spark.createDataFrame([(day(0), "A", 0.0), (day(0), "B", 1.0), (day(0), "C", 3.0), (day(1), "A", 5.0)], "date date, ticker string, raw double")
    z = {(r["date"], r["ticker"]): r["z"] for r in S.standardise(raw).collect()}
    assert z[(day(0), "A")] == 0 and z[(day(0), "B")] == pytest.approx(-z[(day(0), "C")]) and z[(day(1), "A")] == 0


def test_monthly_comparison_lists_the_missing_names(spark):
    u = spark.createDataFrame([("2020-01", "A"), ("2020-02", "A")], "mes string, ticker string")
    o = spark.createDataFrame([("2020-01", "C"), ("2020-01", "B"), ("2020-01", "A"), ("2020-02", "A")], "mes string, ticker string")
    got = {r["mes"]: (r["n_comum"], r["n_falta"], r["faltam"]) for r in U.compare_monthly(u, o).collect()}
    assert got == {"2020-01": (1, 2, "B,C"), "2020-02": (1, 0, "")}


def test_gap_strength_never_broadcasts_the_graph(spark):
    rows = [("2020-01-31", "K2_equal", f"H{i % 3}", f"T{i}") for i in range(30)]
    g = spark.createDataFrame(rows, "m string, variant string, src string, dst string").select(F.col("m").cast("date").alias("valid_month"), "variant", "src", "dst")
    v = g.select("valid_month", F.explode(F.array("src", "dst")).alias("ticker")).distinct().withColumn("v", F.length("ticker") * 1.5)
    out = G.liquidity_gap_strength(g, v)
    assert out.count() == 30 and "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


def test_classify_rules_in_order(spark):
    c = spark.createDataFrame([("AAAA34", ["12"]), ("BBBB11", ["12", "14"]), ("CCCC11", ["14"]), ("DDDD11", ["02"]), ("EEEE11", ["02"])],
                              "ticker string, codes array<string>")
    got = {r["ticker"]: r["classe"] for r in U.classify_instrument(c, ("EEEE11",)).collect()}
    assert got == {"AAAA34": "bdr", "BBBB11": "fii", "CCCC11": "etf", "DDDD11": "acao", "EEEE11": "etf"}


def test_single_class_is_enforced(spark):
    bad = spark.createDataFrame([("A", "x"), ("A", "y")], "ticker string, sector string")
    with pytest.raises(Exception, match="two classes for A"):
        R.assert_single_class(bad, "sector").collect()


def test_split_is_neutralised(spark):
    p = [100.0, 101.0, 50.5, 50.0, 70.0]
    df = spark.createDataFrame([(day(i), i, "A", x) for i, x in enumerate(p)], "date date, idx int, ticker string, close double")
    r = [x["r"] for x in RET.clean_corporate_actions(df).orderBy("idx").collect()]
    assert r[0] is None and r[1] == pytest.approx(.01) and r[2] == 0.0 and r[4] == pytest.approx(0.4)


def test_drawdown_has_no_implicit_start(spark):
    s = spark.createDataFrame([(day(0), -0.5), (day(1), 0.1), (day(2), -0.2)], "date date, r double")
    assert M.max_drawdown(s).first()["max_drawdown"] == pytest.approx(-0.2)


def test_fixed_width_bytes(spark, tmp_path):
    def rec(tipo="01", market="010", width=245, factor=1):
        line = tipo + "20200131" + "02" + "PETR4".ljust(12) + market + "AÇÃO".ljust(81) + "0000000012345" + "0" * 49 + "000000000000067890" + " " * 22 + f"{factor:07d}"
        return line.ljust(245)[:width]

    root = tmp_path / "y" / "2020"
    root.mkdir(parents=True)
    lines = [rec(), rec(factor=10), rec(factor=0), rec(tipo="00"), rec(market="020"), rec(width=240)]
    (root / "A.TXT").write_bytes("\n".join(lines).encode("latin-1") + b"\n")
    (root / "b.csv").write_text("ignored\n")
    raw = FS.raw_lines(spark, str(tmp_path))
    got = sorted((r["ticker"], r["close"], r["volume"], r["price"]) for r in FS.parse_records(raw).collect())
    assert got == [("PETR4", 123.45, 678.9, 12.345), ("PETR4", 123.45, 678.9, 123.45), ("PETR4", 123.45, 678.9, 123.45)]
    c = FS.ingest_counters(raw).first()
    assert (c["n_lines"], c["n_wrong_width"], c["n_records"], c["n_cash"]) == (6, 1, 4, 3)


def test_malformed_number_fails_on_request(spark):
    good = ("01" + "20200131" + "02" + "PETR4".ljust(12) + "010" + " " * 81 + "0000000012345" + "0" * 49 + "000000000000067890" + " " * 22 + "0000001").ljust(245)
    bad = good.replace("0000000012345", "00000000X2345")
    lines = spark.createDataFrame([(good,), (bad,), ("02" + bad[2:],)], "line string")
    assert sorted(r["close"] for r in FS.parse_records(lines).collect()) == [0.0, 123.45]
    assert [r["close"] for r in FS.parse_records(lines.where(F.col("line") != bad), malformed="fail").collect()] == [123.45]
    with pytest.raises(Exception, match="close is no number"):
        FS.parse_records(lines, malformed="fail").collect()
    with pytest.raises(ValueError):
        FS.parse_records(lines, malformed="skip")


def test_landed_lines_are_packed_and_sorted_once(spark, tmp_path):
    import gzip

    from marketripple.catalog import q_sources as Q
    from marketripple.plans.market import Market
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "DAY.TXT.gz").write_bytes(gzip.compress("AÇÃO\nB\n".encode("latin-1")))
    (tmp_path / "plain.Txt").write_bytes(b"C\n")
    (tmp_path / "note.md").write_bytes(b"D\n")
    assert sorted(r["line"] for r in FS.raw_lines(spark, str(tmp_path)).collect()) == ["AÇÃO", "B", "C"]
    m = Market(spark, "/root/testdata/sf0.001")
    landed = Q._landed(m)
    assert landed.count() == m.records.count()
    files = list(Path(m.__dict__["landed_root"]).rglob("part-*"))
    assert files and all(f.name.endswith(".txt.gz") for f in files)
    assert sum(f.stat().st_size for f in files) < 245 * landed.count() / 4


def test_market_sees_rewritten_table(spark, tmp_path):
    for f in Path("/root/testdata/sf0.001").glob("*.parquet"):
        shutil.copyfile(f, tmp_path / f.name)
    first = market(spark, str(tmp_path))
    n = first.obs.count()
    assert market(spark, str(tmp_path)) is first
    path = tmp_path / "lineitem.parquet"
    pq.write_table(pq.read_table(path).slice(0, 500), path)
    second = market(spark, str(tmp_path))
    assert second is not first and 0 < second.obs.count() < n
    assert market(spark, str(tmp_path)) is second


def test_fallback_and_cache(spark, tmp_path):
    df = spark.range(3)
    FS.write_table(df, str(tmp_path / "b"))
    assert FS.read_first(spark, [str(tmp_path / "a"), str(tmp_path / "b")]).count() == 3
    with pytest.raises(FileNotFoundError):
        FS.read_first(spark, [str(tmp_path / "a")])
    calls = []

    def build():
        calls.append(1)
        return df

    for _ in range(2):
        assert FS.cached_table(spark, "t", {"k": str(tmp_path)}, build).agg(F.sum("id")).first()[0] == 3
    assert len(calls) == 1
