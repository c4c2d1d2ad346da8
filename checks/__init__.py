"""Queries on the driver's tables, each with the DuckDB SQL it must agree with."""

from __future__ import annotations

import importlib

MODULES = ["q_marts", "q_text", "q_insights", "q_prices", "q_portfolio", "q_reports", "q_sources", "q_streams", "q_run", "q_orders"]


def load():
    """(queries, oracle SQL) of all modules."""
    from checks import registry

    for module in MODULES:
        importlib.import_module(f"checks.{module}")
    return registry.QUERIES, registry.ORACLES
