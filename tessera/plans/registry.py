"""The queries of the core, by name, and their SQL twins."""

from __future__ import annotations

from importlib import import_module

MODULES: tuple[str, ...] = ("measures", "evaluation", "validation", "search", "traces", "review", "episodes", "p6")


def _collect(attribute: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out |= getattr(import_module(f"tessera.plans.{name}"), attribute)
    return out


def queries() -> dict:
    return _collect("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _collect("ORACLES")
