"""Queries over the test tables, each beside its SQL check."""

from __future__ import annotations

import importlib

from .catalog import PLANS, SQL

MODULES = (
    "agreement", "records", "items", "sampling", "mining", "storage",
    "tokens", "vectors", "ranking", "evaluation",
)


def load_catalog():
    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
    return PLANS, SQL
