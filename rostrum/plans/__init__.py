"""Query plans over the given tables, and the ordered building blocks they share."""

from __future__ import annotations

import importlib


def load_all() -> None:
    """Import every module that registers queries."""
    for area in ("speech", "index", "score", "corpus"):
        importlib.import_module(f"rostrum.plans.{area}_queries")
