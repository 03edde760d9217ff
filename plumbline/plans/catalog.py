"""All registered queries."""

from __future__ import annotations

import importlib

from plumbline.plans.registry import ORACLES, QUERIES

MODULES = (
    "artifacts", "scopes", "audits", "relational", "comparison", "rollups", "claim_checks", "observation", "streams", "evaluation",
)

for _name in MODULES:
    importlib.import_module(f"plumbline.plans.{_name}")

__all__ = ["ORACLES", "QUERIES"]
