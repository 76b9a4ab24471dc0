"""P&L and cost queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketripple.catalog import base_sql as B
from marketripple.catalog.registry import cte, query
from marketripple.operators import pnl as O
from marketripple.plans import market as P

ALL = "gross turnover spread impact borrow hedge cost net net_flat"
query("bt_01_turnover", lambda m: O.turnover(m.ledger), "select date, sum(dw) as turnover from t_led group by date", d="turnover")
query("bt_02_gross_pnl", lambda m: O.gross_pnl(m.ledger), "select date, sum(w * coalesce(r, 0)) as gross from t_led group by date", d="gross")
query("bt_03_net_pnl_flat", lambda m: O.net_pnl_flat(m.pnl.select("date", "gross", "turnover")),
      "select date, gross, turnover, net_flat from t_pnl", d="gross turnover net_flat")
query("bt_04_net_pnl_layered", lambda m: O.net_pnl_layered(m.pnl.select("date", "gross"), m.pnl), "select date, gross, net from t_pnl", d="gross net")
cte("t_fund", "select p.*, p.net + coalesce(rf, 0) as fund, coalesce(rf, 0) as rf from t_pnl p left join t_rf on t_rf.date = p.date")
query("bt_05_fund_return", lambda m: O.fund_return(m.pnl, m.riskfree).select("date", "net", "fund"), "select date, net, fund from t_fund", d="net fund")
query("cst_01_liquidity_band", lambda m: m.panel.select("date", "ticker", O.liquidity_band("adtv", P.BANDS).alias("band")),
      f"select date, ticker, {B.band_sql()}::integer as band from t_panel")
for layer in ("spread", "impact", "borrow", "hedge"):
    n = {"spread": "cst_02_spread_fee_cost", "impact": "cst_03_impact_cost", "borrow": "cst_04_borrow_cost", "hedge": "cst_05_hedge_cost"}[layer]
    query(n, lambda m, layer=layer: O.daily_costs(m.ledger, P.AUM, P.COST).select("date", layer), f"select date, {layer} from t_pnl", d=layer)
query("cst_03_impact_sigma", lambda m: O.impact_sigma(O.on_session_dates(m.names_panel, m.index), P.COST),
      "select date, ticker, sigma from t_sigma", d="sigma")
query("cst_06_cost_breakdown", lambda m: O.daily_costs(m.ledger_of(m.weights), P.AUM, P.COST), "select * from t_pnl", d=ALL)
query("cst_06_cost_without_impact_borrow", lambda m: O.daily_costs(m.ledger, P.AUM, P.COST, impact=False, borrow=False).select("date", "cost", "net"),
      "select date, spread + hedge as cost, gross - (spread + hedge) as net from t_pnl", d="cost net")
query("cst_07_cost_summary", lambda m: O.cost_summary(m.pnl, P.YEAR), f"""
select avg(spread) * {P.YEAR} as spread, avg(impact) * {P.YEAR} as impact, avg(borrow) * {P.YEAR} as borrow, avg(hedge) * {P.YEAR} as hedge,
 avg(cost) * {P.YEAR} as cost, avg(turnover) as turnover, avg(cost) / avg(turnover) * 10000 as bps_per_turnover from t_pnl""",
      d="spread impact borrow hedge cost turnover bps_per_turnover")
query("cst_08_breakeven_bps", lambda m: O.breakeven_bps(m.pnl), "select avg(gross) / avg(turnover) * 10000 as breakeven_bps from t_pnl", d="breakeven_bps")
query("cst_09_eta_sensitivity", lambda m: O.eta_sensitivity(m.ledger, P.AUM, P.COST), f"""
select eta::double as eta, avg(spread + borrow + hedge + eta * impact / 0.4) * {P.YEAR} as cost_year,
 avg(gross - (spread + borrow + hedge + eta * impact / 0.4)) * {P.YEAR} as net_year
from t_pnl, (values (0.0), (0.2), (0.4), (0.7), (1.0)) as e(eta) group by 1""", d="eta cost_year net_year")
query("cst_10_turnover_by_band", lambda m: O.turnover_by_band(m.ledger, P.COST), """
select cast(band as integer) as band, sum(dw) as turnover, sum(dw) / (select sum(dw) from t_led where ticker <> 'IBOV_SYNTHETIC') as share
from t_led where ticker <> 'IBOV_SYNTHETIC' group by 1""", d="turnover share")
query("pf_18_capacity_pnl", lambda m: m.pnl_aum, " union all ".join(
    f"select {a}::double as aum, * from t_pnl_{'main' if a == P.AUM else f'a{int(a)}'}_{P.SMOOTH}" for a in P.AUMS), d="aum " + ALL)
