"""Registered queries, one module per group of the operator inventory."""

from importlib import import_module

GROUPS = ("q_sources", "q_columns", "q_flows", "q_profile", "q_alerts", "q_metrics",
          "q_rebalance", "q_models", "q_streaming")


def load_all() -> None:
    for group in GROUPS:
        import_module(f"netloom.plans.{group}")
