"""Registered queries with their independent SQL twins."""

from __future__ import annotations

import importlib
import pkgutil


def load_catalog():
    """Import every query module once and return the catalog ordered by key."""
    from tessella.plans import registry

    importlib.import_module("tessella.plans.domain_sql")
    for m in pkgutil.iter_modules(__path__):
        if m.name.startswith("q_"):
            importlib.import_module(f"tessella.plans.{m.name}")
    return dict(sorted(registry.CATALOG.items()))
