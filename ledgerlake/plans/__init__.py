"""The registered queries of the business-table engine and their SQL twins."""

from __future__ import annotations

from ledgerlake.plans import catalog_plans, change_plans, gate_plans, query_plans, recipe_plans, register_plans, search_plans  # noqa: F401
from ledgerlake.plans.registry import ORACLE, QUERIES

ENTRY = "query_orders"
__all__ = ["ENTRY", "ORACLE", "QUERIES"]
