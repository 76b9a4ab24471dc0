"""Registered queries: each is a Spark plan over the test tables with, where SQL can say it, its SQL twin."""

from marketripple.catalog import registry  # noqa: F401
from marketripple.catalog import (  # noqa: F401
    q_panel, q_universe, q_returns, q_graph, q_signal, q_portfolio, q_pnl, q_metrics, q_evidence, q_text, q_sources,
)
