"""Collects every registered query."""

from __future__ import annotations

import importlib

from pixelmill.plans import registry

MODULES = ("check_layers", "check_grid", "check_scalars", "check_time", "check_space", "check_context",
           "check_sampling", "check_tables", "check_scores", "check_calibration", "check_models", "check_links")


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"pixelmill.plans.{name}")


def queries():
    _load()
    return dict(registry.QUERIES)


def oracles():
    _load()
    return dict(registry.ORACLES)
