"""All queries over the driver's tables, with their SQL."""

from __future__ import annotations

from folio.plans import administration, conversations, datasets, evaluation, lexical, monitoring, retrieval, segments, similarity, sources, streams, text  # noqa: F401
from folio.plans.registry import QUERIES, SQL

FLAGSHIP = "r03_hybrid_rrf"


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)
