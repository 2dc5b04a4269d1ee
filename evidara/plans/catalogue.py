"""The registered queries and their SQL twins, gathered from the themed modules of this package."""

from __future__ import annotations

from evidara.plans import archive_queries, evidence_queries, page_queries, report_queries, sourcing_queries, timeline_queries, upkeep_queries, verification_queries

MODULES = (archive_queries, evidence_queries, page_queries, report_queries, sourcing_queries, timeline_queries, upkeep_queries, verification_queries)

QUERIES = {name: run for module in MODULES for name, run in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
