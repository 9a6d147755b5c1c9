"""The named queries and their checking SQL."""

from __future__ import annotations

from importlib import import_module

AREAS = ("queries_rows", "queries_meta", "queries_shapes", "queries_sql", "queries_dialects", "queries_jobs")


def all_queries() -> tuple[dict, dict]:
    from ledgerlift.plans import registry

    for area in AREAS:
        import_module(f"ledgerlift.plans.{area}")
    return registry.QUERIES, registry.ORACLES
