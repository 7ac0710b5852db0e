"""Import every module that registers a query, and hand out what they registered."""

from __future__ import annotations

import importlib

from rostrum.llm.common import ORACLES, QUERIES

MODULES = ("url_rules", "near_dups", "toxicity", "passages", "warc", "packing", "main_text", "decontaminate", "pii", "repetition",
           "collocations", "rule_ensemble", "filter_audit")

for _name in MODULES:
    importlib.import_module(f"rostrum.llm.{_name}")

__all__ = ["ORACLES", "QUERIES"]
