"""Query plans over the driver's tables, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

_MODULES = ("data", "retrieval", "reranking", "evaluation", "inference", "graphs", "models", "runs")


def _load() -> None:
    for name in _MODULES:
        import_module(f"stagewise.plans.{name}")


def queries() -> dict[str, Callable]:
    from stagewise.plans.base import QUERIES

    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from stagewise.plans.base import ORACLES

    _load()
    return dict(ORACLES)
