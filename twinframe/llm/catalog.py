"""All corpus queries: one for each operator, and the pipeline."""

from __future__ import annotations

import importlib

from twinframe.llm import base

MODULES = ("tokens", "packing", "quality", "simhash", "decontaminate", "pii", "language", "secrets", "syncmers", "suffixes", "mixing", "resampling", "middle")


def load(pipeline=None):
    """(queries, SQL twins); pipeline is the module with STAGES, run and ORACLE_SQL."""
    for name in MODULES:
        importlib.import_module(f"twinframe.llm.{name}")
    queries, sql = dict(base.QUERIES), dict(base.SQL)
    if pipeline is not None:
        queries["pipeline"] = pipeline.run
        if pipeline.ORACLE_SQL:
            sql["pipeline"] = pipeline.ORACLE_SQL
    return queries, sql
