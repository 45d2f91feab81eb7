"""Registered queries, each with the SQL that must give the same rows."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("relations", "functions", "joins", "reports", "catalogue", "rollups")


def all_checks():
    for name in _MODULES:
        import_module(f"checks.{name}")
    return import_module("checks.base").CHECKS
