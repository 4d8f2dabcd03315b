"""All queries of the subpackage and their oracle SQL, by name."""

from __future__ import annotations

from importlib import import_module

MODULES = ("queries_records", "queries_text", "queries_vectors", "queries_documents", "queries_files")


def collect(attribute: str) -> dict:
    found: dict = {}
    for name in MODULES:
        found |= getattr(import_module(f"plumbline.llm.{name}"), attribute)
    return found


def queries() -> dict:
    return collect("QUERIES")


def oracle_sql() -> dict:
    return collect("ORACLE")
