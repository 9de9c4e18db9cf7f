"""All registered queries of the lead engine and their SQL counterparts."""

from __future__ import annotations

from leadloom.plans import activity_queries, evidence_queries, identity_queries, label_queries, lead_queries, output_queries, prompt_queries, table_queries, text_queries, verdict_queries

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _module in (lead_queries, evidence_queries, text_queries, activity_queries, verdict_queries, label_queries, identity_queries, table_queries, prompt_queries, output_queries):
    QUERIES.update(_module.QUERIES)
    ORACLES.update(_module.ORACLES)
