"""All registered queries."""

from leadrank.plans import (  # noqa: F401
    entity_queries,
    evidence_queries,
    job_queries,
    ranking_queries,
    text_queries,
)
from leadrank.plans.registry import ORACLES, QUERIES  # noqa: F401
