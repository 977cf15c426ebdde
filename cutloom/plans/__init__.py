"""Registered queries: each family gives ``QUERIES`` and ``ORACLE``."""

from __future__ import annotations

import importlib

FAMILIES = ("speech", "timeline", "scalars", "raster", "geometry", "masks", "config", "sessions", "extras", "regions", "features", "tracking", "topology")


def _families():
    return [importlib.import_module(f"cutloom.plans.{name}") for name in FAMILIES]


def queries() -> dict:
    return {k: v for m in _families() for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _families() for k, v in m.ORACLE.items()}
