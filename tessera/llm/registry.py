"""The queries of this subpackage, by name, and their SQL twins."""

from __future__ import annotations

from importlib import import_module

MODULES = ("p1", "p2", "p3", "p4", "p5", "p7", "p8", "p9", "p10")


def _collect(attribute: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out |= getattr(import_module(f"tessera.llm.{name}"), attribute)
    return out


def queries() -> dict:
    return _collect("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _collect("ORACLES")
