"""Registered queries, grouped by the kind of work."""
from __future__ import annotations

import importlib

MODULES = ["storage", "groups", "tokens", "correction", "mixing", "records", "scores", "reports", "streams"]


def load_all():
    from rollstat.plans import registry

    for name in MODULES:
        importlib.import_module(f"rollstat.plans.{name}")
    return registry.QUERIES, registry.ORACLES
