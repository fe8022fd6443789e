"""All registered queries of the engine's own operators."""

from __future__ import annotations

from paperglass.plans import answer_plans, batch_plans, exchange_plans, file_plans, language_plans, listing_plans, manifest_plans, more_plans, region_plans, relation_plans, report_plans, rule_plans, search_plans, shape_plans, text_plans  # noqa: F401  they register themselves
from paperglass.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
