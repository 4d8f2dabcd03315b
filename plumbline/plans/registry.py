"""All core queries and their oracle SQL, by name."""

from __future__ import annotations

from importlib import import_module

MODULES = ("orphan_queries", "graph_queries", "data_queries", "structure_queries", "analytics_queries")


def collect(attribute: str) -> dict:
    found: dict = {}
    for name in MODULES:
        found |= getattr(import_module(f"plumbline.plans.{name}"), attribute)
    return found
