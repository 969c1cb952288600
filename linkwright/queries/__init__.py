"""Registered queries of the reference operators, each with equivalent SQL where SQL can express it."""

from __future__ import annotations

from importlib import import_module

MODULES = ("scored", "linkage", "learned")


def load() -> tuple[dict, dict]:
    """(queries, oracles) of every module."""
    found: dict = {}
    oracles: dict = {}
    for name in MODULES:
        for key, (run, sql) in import_module(f"{__name__}.{name}").QUERIES.items():
            found[key] = run
            if sql:
                oracles[key] = sql
    return found, oracles
