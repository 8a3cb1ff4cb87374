"""Registered queries, one module per area of the inventory."""

from __future__ import annotations

import importlib

MODULES = (
    "scalars", "topics", "alignment", "clusters", "telemetry", "catalog", "reports", "files", "streams",
)


def load_all():
    from palaver.queries import registry

    for module in MODULES:
        importlib.import_module(f"palaver.queries.{module}")
    return registry.QUERIES, registry.ORACLES
