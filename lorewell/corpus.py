"""The corpus: notes, edges, events, vectors and paths as DataFrames, with an explicit clock."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame

NOTES = """
id STRING, type STRING, statement STRING, body STRING, created_ms BIGINT, body_hash STRING, schema_version INT, tags ARRAY<STRING>,
source STRING, superseded_by STRING, revision INT, edges ARRAY<STRUCT<kind: STRING, to: STRING>>,
outcomes ARRAY<STRUCT<status: STRING, recorded_ms: BIGINT, notes: STRING, duration: BIGINT, agent: STRING>>,
classification STRING, anchors ARRAY<STRING>, status STRING, scope STRING, checks ARRAY<STRING>, evidence MAP<STRING, STRING>,
claims ARRAY<STRUCT<subject: STRING, relation: STRING, object: STRING>>,
provenance STRUCT<entity: STRING, activity: STRING, agent: STRING, agent_id: STRING, agent_role: STRING, parent_agent_id: STRING>,
_corrupt STRING, _origin STRING
"""

#: Statuses that are shown unless asked otherwise.
VISIBLE = ["active", "in_progress", "blocked", "closed"]
OPEN = ["active", "in_progress", "blocked"]
WORK_KINDS = ["task", "error", "question", "risk", "decision"]


@dataclass(frozen=True)
class Settings:
    """Defaults of every tunable; ``Settings.of`` overlays project over global settings."""

    create_below: float = 0.75
    merge_below: float = 0.92
    limit: int = 5
    preview_chars: int = 280
    rrf_k: int = 60
    confirmation: float = 0.1
    max_term_ratio: float = 0.9
    lexical: float = 1.0
    anchor: float = 2.0
    semantic: float = 30.0
    ppr: float = 0.0
    semantic_top_k: int = 50
    link_low: float = 0.4
    link_high: float = 0.75
    promote_confidence: float = 0.7
    max_promoted: int = 15
    ttl: tuple[int, int, int] = (0, 365, 30)
    growth_percent: int = 50
    renew_on_use: bool = False
    retired_days: int = 30
    anchor_threshold: float = 0.5
    grace_days: int = 30
    min_volume: int = 10
    cluster_similarity: float = 0.8
    batch: int = 32
    max_pending: int = 1000
    budget: int = 4000

    @classmethod
    def of(cls, *layers: dict) -> Settings:
        known = cls.__dataclass_fields__
        merged = {k: v for layer in layers for k, v in layer.items() if k in known}
        return replace(cls(), **merged)


@dataclass(frozen=True)
class Corpus:
    """notes: as NOTES plus successes, failures, reviews, last_ms. edges: src, kind, dst. events: event_id, op, note_id, at, action, kind, dst."""

    notes: DataFrame
    edges: DataFrame
    now_ms: int
    events: DataFrame | None = None
    vectors: DataFrame | None = None
    paths: DataFrame | None = None
    settings: Settings = field(default_factory=Settings)
