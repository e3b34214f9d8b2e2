"""Shapes of the JSON records and the Spark types they become."""

from __future__ import annotations

from leadrank.functions.fixed import (
    COVERAGE_LEVELS,
    DIMENSION_WEIGHTS,
    FACT_TOPICS,
    MAX_CANDIDATES_PER_RESPONSE,
    STAGES,
)
from leadrank.functions.shape import AnyObject, Closed, Items, Number, Rating, Text

FACT = Closed(
    {
        "topic": Text(choices=FACT_TOPICS),
        "fact": Text(min_len=1, max_len=400),
        "source_url": Text(form="url"),
    }
)

CANDIDATE = Closed(
    {
        "company_name": Text(min_len=1),
        "website": Text(form="url", nullable=True),
        "trigger_type": Text(min_len=1),
        "trigger_title": Text(min_len=1),
        "trigger_summary": Text(),
        "published_at": Text(form="date", nullable=True),
        "source_url": Text(form="url"),
        "source_title": Text(),
        "location": Text(),
        "possible_video_need": Text(),
        "discovered_at": Text(form="timestamp", nullable=True),
        "research_facts": Items(FACT, max_len=12),
        "research_unknowns": Items(Text(), max_len=6),
    },
    optional=frozenset({"discovered_at", "research_facts", "research_unknowns"}),
)

DISCOVERY = Closed({"candidates": Items(AnyObject(), max_len=MAX_CANDIDATES_PER_RESPONSE)})

_COVERAGE = Closed({"coverage": Text(choices=COVERAGE_LEVELS), "reason": Text(min_len=1, max_len=400)})

EVALUATION = Closed(
    {
        **{stage: Closed({name: Rating() for name in names}) for stage, names in STAGES.items()},
        "scope_hypothesis": Text(min_len=1, max_len=300),
        "evidence_coverage": Closed({stage: _COVERAGE for stage in STAGES}),
        "reason": Text(min_len=1, max_len=600),
        "strongest_signals": Items(Text(), max_len=3),
        "risks": Items(Text(), max_len=3),
        "research_needed": Items(Text(), max_len=2),
    }
)

LEGACY_SCORES = Closed(
    {**{name: Number() for name in DIMENSION_WEIGHTS}, "reason": Text(), "risks": Items(Text())}
)

STRATEGY = Closed(
    {
        "why_now": Text(),
        "business_context": Text(),
        "video_problem_hypothesis": Text(),
        "proposal": Closed({"title": Text(), "description": Text(), "deliverables": Items(Text())}),
        "estimated_budget": Text(),
        "target_department": Text(),
        "target_role": Text(),
        "first_contact_method": Text(),
        "sales_angle": Text(),
        "risks": Items(Text()),
        "research_notes": Items(Text()),
    }
)

FACT_DDL = "struct<topic:string,fact:string,source_url:string>"

CANDIDATE_DDL = (
    "struct<company_name:string,website:string,trigger_type:string,trigger_title:string,"
    "trigger_summary:string,published_at:date,source_url:string,source_title:string,location:string,"
    f"possible_video_need:string,discovered_at:timestamp,research_facts:array<{FACT_DDL}>,"
    "research_unknowns:array<string>>"
)

CANDIDATE_FIELDS = tuple(CANDIDATE.fields)

_STAGE_DDL = ",".join(
    f"{stage}:struct<{','.join(f'{name}:int' for name in names)}>" for stage, names in STAGES.items()
)
_COVERAGE_DDL = ",".join(f"{stage}:struct<coverage:string,reason:string>" for stage in STAGES)

EVALUATION_DDL = (
    f"struct<{_STAGE_DDL},scope_hypothesis:string,evidence_coverage:struct<{_COVERAGE_DDL}>,reason:string,"
    "strongest_signals:array<string>,risks:array<string>,research_needed:array<string>>"
)

STRATEGY_DDL = (
    "struct<why_now:string,business_context:string,video_problem_hypothesis:string,"
    "proposal:struct<title:string,description:string,deliverables:array<string>>,estimated_budget:string,"
    "target_department:string,target_role:string,first_contact_method:string,sales_angle:string,"
    "risks:array<string>,research_notes:array<string>>"
)

# A raw model response. Only the parts that carry evidence or text are declared.
RESPONSE_DDL = (
    "struct<status:string,output_text:string,output:array<struct<type:string,status:string,"
    "action:struct<type:string,url:string,sources:array<struct<url:string>>>,"
    "content:array<struct<type:string,text:string,annotations:array<struct<type:string,url:string>>>>>>>"
)
