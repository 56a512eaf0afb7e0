"""All registered queries."""

from __future__ import annotations

import importlib

MODULES = ("reports", "scalars", "linkage", "stores", "discovery", "memory", "whole_runs", "files")


def load_all():
    for m in MODULES:
        importlib.import_module(f"leadspan.catalog.{m}")
    from leadspan.catalog.registry import ORACLES, QUERIES

    return dict(QUERIES), dict(ORACLES)
