"""The registered queries of each area, and their SQL."""

from __future__ import annotations

from importlib import import_module

AREAS = ("analytics", "access", "maintenance", "search", "texts", "streams", "chunks", "more", "extensions", "rest", "structure", "rules")


def registered() -> tuple[dict, dict]:
    queries, oracles = {}, {}
    for area in AREAS:
        module = import_module(f"{__name__}.{area}")
        queries |= module.QUERIES
        oracles |= module.ORACLES
    return queries, oracles
