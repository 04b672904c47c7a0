"""Registered queries; importing the modules fills the registry."""

from importlib import import_module

from .registry import ORACLE, QUERIES

for _name in ("q_sources", "q_contracts", "q_panel", "q_features", "q_metrics", "q_reports", "q_models"):
    import_module(f".{_name}", __name__)

__all__ = ["ORACLE", "QUERIES"]
