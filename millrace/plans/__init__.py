"""Registered queries over the driver tables, one per operator."""

from __future__ import annotations

from importlib import import_module

from .registry import ORACLES, QUERIES, Query

FAMILIES = ("sources", "catalog", "scalars", "preparation", "retrieval", "preference", "reward", "runs")


def _load() -> None:
    from importlib.util import find_spec
    for name in FAMILIES:
        if find_spec(f"{__name__}.{name}"):
            import_module(f"{__name__}.{name}")


def all_queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def all_oracles() -> dict[str, str]:
    _load()
    return dict(ORACLES)
