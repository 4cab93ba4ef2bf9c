"""Registered queries, grouped as in the operator inventory."""

import importlib

_MODULES = ("q_sources", "q_portraits", "q_rules", "q_screens", "q_network", "q_ml", "q_ensemble", "q_reports", "q_validation")


def load_all() -> None:
    for name in _MODULES:
        importlib.import_module(f"tendersift.plans.{name}")
