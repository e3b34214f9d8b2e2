"""Schemas of the stored tables. They are fixed: a table is created with them and never inferred."""

from __future__ import annotations

from leadrank.functions.fixed import DIMENSION_WEIGHTS
from leadrank.functions.records import CANDIDATE_DDL, EVALUATION_DDL, STRATEGY_DDL

_CONFIG_DDL = "string"

TABLES = {
    "runs": (
        "id long, started_at timestamp, finished_at timestamp, status string, candidate_count int, "
        f"scored_count int, strategy_count int, error_message string, config_json {_CONFIG_DDL}"
    ),
    "companies": (
        "id long, name string, normalized_name string, website string, website_domain string, "
        "location string, first_seen_at timestamp, last_seen_at timestamp"
    ),
    "triggers": (
        "id long, company_id long, trigger_type string, title string, summary string, source_url string, "
        "source_title string, published_at timestamp, discovered_at timestamp, run_id long, "
        "fingerprint string, possible_video_need string, model string, prompt_version string, "
        "evidence_urls array<string>"
    ),
    "scores": (
        "id long, company_id long, trigger_id long, "
        + "".join(f"{name} double, " for name in DIMENSION_WEIGHTS)
        + "total_score double, reason string, risks_json array<string>, model string, "
        "prompt_version string, created_at timestamp, run_id long, selected_rank int"
    ),
    "strategies": (
        f"id long, company_id long, trigger_id long, content_json {STRATEGY_DDL}, model string, "
        "prompt_version string, created_at timestamp, run_id long, evidence_urls array<string>"
    ),
    "human_ratings": (
        "id long, company_id long, run_id long, rating string, comment string, created_at timestamp"
    ),
    "processing_errors": (
        "id long, run_id long, stage string, subject string, error_type string, model string, "
        "prompt_version string, created_at timestamp"
    ),
    "research_scores": (
        f"id long, company_id long, trigger_id long, run_id long, candidate_json {CANDIDATE_DDL}, "
        f"evaluation_json {EVALUATION_DDL}, total_score double, model string, prompt_version string, "
        "selected_rank int, created_at timestamp"
    ),
}

# Tables whose rows belong to one run, stored in one folder per run.
RUN_SCOPED = ("triggers", "scores", "strategies", "human_ratings", "processing_errors", "research_scores")
