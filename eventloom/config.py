"""Thresholds of the rules, passed to functions; nothing here reads the environment."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class ClusterThresholds:
    title: float = 0.78
    text: float = 0.70
    overlap: float = 0.65
    simhash: int = 6
    common: int = 5


@dataclass(frozen=True)
class HistoryThresholds:
    title: float = 0.88
    text: float = 0.82
    overlap: float = 0.65
    simhash: int = 6
    common: int = 4


@dataclass(frozen=True)
class BriefingConfig:
    """What a run needs; a section's own value goes before the configuration's, that before these."""

    briefing_name: str
    subject_prefix: str
    receiver_env: str
    recent_hours: int = 24
    history_days: int = 3
    history_scope: str = "briefing"
    max_groups: int = 100
    candidate_groups: int = 35
    selected: int = 10
    min_importance: int = 3
    bucket_hours: int = 4
    max_total: int = 100
    min_per_bucket: int = 0
    exclude_low_quality: bool = True


CLUSTER, HISTORY = ClusterThresholds(), HistoryThresholds()
