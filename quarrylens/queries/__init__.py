"""Runnable queries, one per operator, each with its SQL counterpart where SQL can say it."""

from __future__ import annotations

from importlib import import_module

from quarrylens.queries.registry import ORACLES, QUERIES

FAMILIES = "loading cleaning profiling dashboards statistics learning series text sqls".split()


def load_all():
    for family in FAMILIES:
        import_module(f"quarrylens.queries.{family}")
    return QUERIES, ORACLES
