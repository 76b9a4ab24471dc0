"""Engine inputs derived from the star-schema test tables, and the contract tables built on them.

A market is a set of lazily built tables. The stages that many operators share (dense panel with shocks, graph,
signal, weights, P&L) are written once per market, like the contract files between production stages.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketripple.operators import evidence, graph, metrics, panel, pnl, portfolio, returns, series_book, shock, signal, universe
from marketripple.session import materialise

# Scaled parameters for weekly data.
REG, REG_MIN = 52, 24
ACC, ACC_LAG, ACC_MIN = 40, 4, 20
ADTV, ADTV_MIN = 4, 2
VOL = 12
SMOOTH = 12
GUARD, GUARD_MIN = 52, 8
YEAR = 52
TOP_N = 20
MIN_ADTV, MIN_MEMBERS = 20_000.0, 2
CUT = "1998-12-31"
AUM = 300_000.0
BANDS = (115_000.0, 85_000.0, 60_000.0)
PERIODS = panel.is_oos_full(CUT)

FACTOR_WINDOWS = dict(short=4, mom=(40, 4), rev=2, vol=6)
GRID = (4, 8, 12, 24)
AUMS = (60_000.0, 300_000.0, 900_000.0)
BOOK = portfolio.BookParams(aum=AUM, vol_window=VOL, smoothing=SMOOTH, guard_window=GUARD, guard_min=GUARD_MIN, periods=YEAR)
COST = pnl.CostParams(bands=BANDS, vol_window=12, vol_min=4, periods=YEAR)

KINDS = ("concorrente", "cliente", "imob_logistica", "fornecedor", "holding", "substituto")


def ticker_of(key: Column) -> Column:
    """Base-26 letters of key div 2, four or as many as it takes, plus a class suffix, so neighbours can share a root."""
    digits = F.translate(F.conv(F.floor(key / 2).cast("string"), 10, 26), "0123456789ABCDEFGHIJKLMNOP", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    letters = F.when(F.length(digits) < 4, F.lpad(digits, 4, "A")).otherwise(digits)
    suffix = (F.when(key % 20 == 19, "34").when(key % 20 == 17, "11").when(key % 2 == 0, "3").otherwise("4"))
    return F.concat(letters, suffix)


def bdi_of(key: Column) -> Column:
    return F.when(key % 40 == 17, "14").when(key % 50 == 13, "12").otherwise("02")


def cents(c: str) -> Column:
    """Money and rates as whole hundredths, so sums do not depend on row order."""
    return F.round(F.col(c) * 100).cast("long")


class Market:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    # ---- raw inputs -----------------------------------------------------------------------------------

    @cached_property
    def records(self) -> DataFrame:
        """One trade record per line item."""
        k = F.col("l_suppkey")
        return self.table("lineitem").select(
            F.date_trunc("week", "l_shipdate").cast("date").alias("date"), k.alias("k"), ticker_of(k).alias("ticker"),
            bdi_of(k).alias("bdi"), cents("l_extendedprice").alias("vol_c"), cents("l_discount").alias("disc_c"),
            cents("l_tax").alias("tax_c"), F.col("l_orderkey").alias("file_no"), F.col("l_linenumber").alias("line_no"))

    @cached_property
    def obs(self) -> DataFrame:
        """Observed (date, ticker): volume and close. Groups by the numeric key; names are made afterwards."""
        g = self.records.groupBy("date", "k").agg(
            (F.sum("vol_c").cast("double") / 100.0).alias("volume"),
            (F.sum(100 - F.col("disc_c")).cast("double") / F.count(F.lit(1)).cast("double")).alias("close"))
        return g.select("date", ticker_of(F.col("k")).alias("ticker"), "volume", "close")

    @cached_property
    def names(self) -> DataFrame:
        """ticker, suppkey, bdi, sector (nation) and subsector (region)."""
        s, n, r = self.table("supplier"), self.table("nation"), self.table("region")
        k = F.col("s_suppkey")
        return (s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
                .select(k.alias("k"), ticker_of(k).alias("ticker"), F.col("n_name").alias("sector"),
                        F.col("r_name").alias("subsector")))

    @cached_property
    def calendar(self) -> DataFrame:
        return materialise(panel.trading_calendar(self.obs), "calendar")

    @cached_property
    def classes(self) -> DataFrame:
        seen = self.records.select("k", "bdi").distinct().select(ticker_of(F.col("k")).alias("ticker"), "bdi")
        return universe.classify_instrument(universe.codes_ever_seen(seen))

    @cached_property
    def index(self) -> DataFrame:
        """Index return per date; dates without one are absent."""
        wk = self.table("orders").groupBy(F.date_trunc("week", "o_orderdate").cast("date").alias("date")).agg(
            (F.sum(cents("o_totalprice")).cast("double") / 100.0).alias("v"))
        j = self.calendar.join(F.broadcast(wk), "date", "left")  # one row per calendar week
        m = F.try_divide(F.col("v"), F.lag("v").over(Window.orderBy("idx"))) - 1.0
        return j.select("date", "idx", m.alias("m")).where(F.col("m").isNotNull())

    @cached_property
    def riskfree(self) -> DataFrame:
        return self.records.groupBy("date").agg(
            (F.sum("tax_c").cast("double") / F.count(F.lit(1)).cast("double") / 100.0 / YEAR).alias("rf"))

    @cached_property
    def monthly(self) -> DataFrame:
        day = self.records.groupBy("date", "k").agg(F.sum("vol_c").alias("volume"))
        rec = day.select("date", ticker_of(F.col("k")).alias("ticker"), "volume")
        return universe.traded_volume_monthly(rec).withColumn("volume_mes", F.col("volume_mes") / 100.0)

    @cached_property
    def universe(self) -> DataFrame:
        return universe.universe_top_n(self.monthly, self.classes, TOP_N)

    @cached_property
    def official(self) -> DataFrame:
        """A second membership list: the top 20 by number of trades among all names."""
        m = self.records.groupBy(F.date_format("date", "yyyy-MM").alias("mes"), "ticker").agg(
            F.count(F.lit(1)).alias("n"))
        w = Window.partitionBy("mes").orderBy(F.desc("n"), "ticker")
        return m.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= TOP_N).select("mes", "ticker")

    @cached_property
    def edges(self) -> DataFrame:
        """Static edges between consecutive suppliers of one region.

        Successors come from blocks of 1000 keys plus the first key of the next block, so a region with a third
        of all suppliers is not sorted in one task.
        """
        k = F.col("k")
        n = self.names.withColumn("blk", F.floor(k / 1000))
        nxt_in = F.lead("k").over(Window.partitionBy("subsector", "blk").orderBy("k"))
        firsts = n.groupBy("subsector", "blk").agg(F.min("k").alias("first_k"))
        nxt_blk = firsts.select("subsector", "blk", F.lead("first_k").over(
            Window.partitionBy("subsector").orderBy("blk")).alias("next_first"))
        e = (n.withColumn("nxt", nxt_in).join(nxt_blk, ["subsector", "blk"])
             .withColumn("nxt", F.coalesce("nxt", "next_first")).where(F.col("nxt").isNotNull()))
        kind = F.element_at(F.array(*[F.lit(x) for x in KINDS]), (k % 6 + 1).cast("int"))
        return materialise(e.select(
            F.col("ticker").alias("src"), ticker_of(F.col("nxt")).alias("dst"), kind.alias("kind"),
            (0.5 + (k % 5).cast("double") / 10.0).alias("strength"),
            F.when(k % 6 == 5, -1).otherwise(1).alias("direction")), "edges")

    # ---- contract tables ------------------------------------------------------------------------------

    @cached_property
    def prices(self) -> DataFrame:
        """Dense panel of shares: volume 0 in gaps, close NULL in gaps, ADTV, return and market return."""
        d = panel.densify(universe.shares_only(self.obs, self.classes), self.calendar, {"volume": 0.0, "close": None})
        d = panel.roll(d, "volume", ADTV, ADTV_MIN, "avg", "adtv")
        d = returns.daily_returns(d)
        return d.join(F.broadcast(self.index.select("date", "m")), "date", "left")

    @cached_property
    def panel(self) -> DataFrame:
        """Prices with shocks, betas and accumulated shocks."""
        d = shock.market_shock(self.prices, REG, REG_MIN)
        return materialise(shock.accumulate_shock(d, ACC, ACC_LAG, ACC_MIN), "panel")

    @cached_property
    def graph(self) -> DataFrame:
        return materialise(graph.build_rule_graph(
            self.panel.select("date", "ticker", "adtv"), self.names, min_adtv=MIN_ADTV, min_members=MIN_MEMBERS), "graph")

    @cached_property
    def month_adtv(self) -> DataFrame:
        return graph.lagged_month_end(self.panel)

    @cached_property
    def raw_signal(self) -> DataFrame:
        return materialise(signal.propagate_temporal_ensemble(self.panel, self.graph), "raw")

    @cached_property
    def signal(self) -> DataFrame:
        """Dense (date, idx, ticker) signal over every name the graph ever targets; 0 is no signal."""
        dst = self.graph.select(F.col("dst").alias("ticker")).distinct()
        z = signal.standardise(self.raw_signal).select("date", "ticker", "raw", "z")
        grid = self.panel.join(dst, "ticker", "left_semi").select("date", "idx", "ticker")
        grid = grid.hint("merge")  # equal signals pack so well that their file looks small enough to be broadcast
        return materialise(grid.join(z, ["date", "ticker"], "left").withColumn("z", F.coalesce("z", F.lit(0.0))), "signal")

    # ---- books ----------------------------------------------------------------------------------------

    def book_of(self, sig: DataFrame) -> DataFrame:
        """Book input of a dense signal (date, idx, ticker, z)."""
        facts = self.panel.select("date", "ticker", "r", "adtv", "beta")
        sectors = self.names.select("ticker", "sector")
        return (sig.select("date", "idx", "ticker", F.col("z").alias("w")).join(facts, ["date", "ticker"])
                .join(sectors, "ticker", "left"))

    @cached_property
    def book(self) -> DataFrame:
        return materialise(self.book_of(self.signal), "bookin")

    @cached_property
    def prepared(self) -> DataFrame:
        return portfolio.prepare_book(self.book, BOOK)

    @cached_property
    def weights(self) -> DataFrame:
        return materialise(portfolio.build_portfolio(self.book, BOOK), "weights")

    @cached_property
    def weights_grid(self) -> DataFrame:
        """Weights per smoothing window (key ``smooth``)."""
        return materialise(portfolio.build_portfolio(self.book, BOOK, smoothings=GRID), "weights")

    @cached_property
    def weights_aum(self) -> DataFrame:
        """Weights per fund size (key ``aum``)."""
        p = portfolio.BookParams(**{**BOOK.__dict__, "aum": "aum"})
        b = self.book.withColumn("aum", F.explode(F.array(*[F.lit(a) for a in AUMS])))
        return materialise(portfolio.build_portfolio(b, p, keys=("aum",)), "weights")

    @cached_property
    def names_panel(self) -> DataFrame:
        """Panel of the signal's names."""
        return self.book.select("date", "idx", "ticker", "r", "adtv")

    @cached_property
    def packed(self) -> series_book.Packed:
        """The signal's names, one row each."""
        return self.packed_of(self.book.select("ticker"), self.book.select("idx", "ticker", F.col("w").alias("z")))

    def packed_of(self, names: DataFrame, values: DataFrame) -> series_book.Packed:
        return series_book.pack(self.book.select("idx", "ticker", "r", "adtv", "beta"), self.names, self.calendar, {"z": (names, values)})

    @cached_property
    def fallback(self) -> float | None:
        """Deviation of the signal's names with too few returns."""
        return pnl.impact_fallback(pnl.on_session_dates(self.names_panel, self.index), COST).first()[0]

    @cached_property
    def fallback_all(self) -> float | None:
        """The same over all names."""
        return pnl.impact_fallback(pnl.on_session_dates(self.panel.select("date", "idx", "ticker", "r"), self.index), COST).first()[0]

    def books(self, packed: series_book.Packed, loops: list, wanted: list) -> DataFrame:
        return series_book.books(packed, loops, wanted, self.index, self.fallback, BOOK, COST)[0]

    def ledger_of(self, weights: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
        return pnl.ledger(weights, self.names_panel, self.index, COST, keys)

    @cached_property
    def ledger(self) -> DataFrame:
        return materialise(self.ledger_of(self.weights), "ledger")

    @cached_property
    def pnl(self) -> DataFrame:
        """Per date: gross, turnover, cost layers, net and net_flat of the production book."""
        return self.production[0]

    @cached_property
    def production(self) -> tuple[DataFrame, DataFrame]:
        """P&L of the production book, and its positions and gross weight per date."""
        day, held = series_book.books(self.packed, [series_book.Loop("z", AUM)], [(0, SMOOTH, {})], self.index, self.fallback, BOOK, COST)
        return day, materialise(held.join(F.broadcast(self.calendar.select("date", "idx")), "idx"), "positions")

    def pnl_rf(self, p: DataFrame) -> DataFrame:
        """P&L with the cash rate (one row per calendar day) alongside."""
        return p.join(F.broadcast(self.riskfree), "date", "left")

    @cached_property
    def days(self) -> DataFrame:
        return materialise(metrics.report_active_days(self.pnl, self.index, self.riskfree, self.production[1]), "days")

    @cached_property
    def series(self) -> DataFrame:
        return metrics.report_series(self.days)

    @cached_property
    def pnl_grid(self) -> DataFrame:
        return self.books(self.packed, [series_book.Loop("z", AUM)], [(0, n, {"smooth": n}) for n in GRID])

    @cached_property
    def pnl_aum(self) -> DataFrame:
        return self.books(self.packed, [series_book.Loop("z", a) for a in AUMS], [(i, SMOOTH, {"aum": a}) for i, a in enumerate(AUMS)])

    @cached_property
    def pnl_own(self) -> DataFrame:
        """P&L of the book built on each name's own persistence."""
        own = self.own_signal
        return self.books(self.packed_of(own.select("ticker"), own), [series_book.Loop("z", AUM)], [(0, SMOOTH, {})])

    @cached_property
    def own_signal(self) -> DataFrame:
        """Each name's own accumulated shock, standardised over the signal's names."""
        names = self.signal.select("ticker").distinct()
        own = self.panel.join(names, "ticker", "left_semi").select("date", "idx", "ticker", F.col("acc").alias("raw"))
        return signal.standardise(own).select("date", "idx", "ticker", F.nullif("raw", F.lit(0.0)).alias("raw"), "z")

    @cached_property
    def ic1(self) -> DataFrame:
        """Per-date IC of the signal against the next row's return."""
        return evidence.ic_daily(self.signal, self.forward)

    def once(self, label: str, build) -> DataFrame:
        """Write an intermediate that several queries share once per market."""
        if label not in self.__dict__:
            self.__dict__[label] = materialise(build(), label)
        return self.__dict__[label]

    @cached_property
    def universe_dates(self) -> DataFrame:
        return self.obs.select("date", "ticker")

    @cached_property
    def forward(self) -> DataFrame:
        """Panel with the return of the next calendar row ``y``."""
        return panel.shift(self.panel, "r", -1, "y")


_MARKETS: dict[tuple[str, str], tuple[tuple, Market]] = {}


def files_state(spark: SparkSession, sf_dir: str) -> tuple:
    """Number, bytes and newest time of the folder's table files, and a checksum of them; only file metadata are read."""
    files = spark.read.format("binaryFile").load(f"{sf_dir}/*.parquet").select("path", "length", "modificationTime")
    return tuple(files.agg(F.count(F.lit(1)), F.sum("length"), F.max("modificationTime"), F.bit_xor(F.xxhash64(*files.columns))).first())


def market(spark: SparkSession, sf_dir: str, fresh: bool = False) -> Market:
    """One market per session and folder, so its contract tables are built once; changed files, or ``fresh``, start over."""
    key, state = (spark.sparkContext.applicationId, sf_dir), files_state(spark, sf_dir)
    if fresh or key not in _MARKETS or _MARKETS[key][0] != state:
        _MARKETS[key] = (state, Market(spark, sf_dir))
    return _MARKETS[key][1]
