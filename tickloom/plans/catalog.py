"""All registered queries; importing a plan module registers its queries."""

from __future__ import annotations

import importlib

from tickloom.plans.registry import ORACLES, QUERIES

MODULES = (
    "scans",
    "hygiene",
    "state",
    "features",
    "windows",
    "labels",
    "joins",
    "stats_base",
    "stats_signal",
    "stats_trading",
    "selection",
    "folds",
    "streams",
)


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"tickloom.plans.{name}")


def queries() -> dict:
    _load()
    return dict(QUERIES)


def oracles() -> dict:
    _load()
    return dict(ORACLES)
