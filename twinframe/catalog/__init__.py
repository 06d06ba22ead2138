"""All registered queries."""

from __future__ import annotations

import importlib

MODULES = ("tables", "measures", "scoring", "sampling", "generation", "diagnostics")


def load():
    """(queries, SQL twins)."""
    from twinframe.catalog import base
    for name in MODULES:
        importlib.import_module(f"twinframe.catalog.{name}")
    return dict(base.QUERIES), dict(base.SQL)
