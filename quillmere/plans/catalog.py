"""All registered queries and the SQL that each is checked against."""

from __future__ import annotations

from quillmere.plans import activity, connectors, documents, drafts, forecasting, guards, ingestion, knowledge, landed, metering, retrieval  # noqa: F401  they register themselves
from quillmere.plans.registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
