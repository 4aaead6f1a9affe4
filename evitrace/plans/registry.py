"""All registered queries and the SQL each is compared with."""

from __future__ import annotations

import importlib

_FAMILIES = ("retrieval", "profiling", "lifecycle", "relations", "evidence", "records", "maintenance", "folds")


def _collect(attribute: str) -> dict:
    merged: dict = {}
    for family in _FAMILIES:
        for name, value in getattr(importlib.import_module(f"evitrace.plans.{family}"), attribute).items():
            if name in merged:
                raise ValueError(f"query {name!r} is registered twice")
            merged[name] = value
    return merged


def queries() -> dict:
    return _collect("QUERIES")


def oracle_sql() -> dict:
    return _collect("ORACLE")
