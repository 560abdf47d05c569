"""Configurations, validated when they are made."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field
from pathlib import Path

WEIGHTS_V1 = ("historical_experience", "cross_brand_experience", "selection_history", "view_performance", "budget_headroom", "operational_reliability", "data_confidence")
WEIGHTS_V2 = ("audience_gender_fit", "audience_age_fit", "theme_experience_fit", "persona_experience_fit", "content_style_experience_fit", *WEIGHTS_V1)


def load_json(path: str | Path, default: object = None) -> object:
    """The document in a file; the default where there is none."""
    p = Path(path)
    if not p.exists():
        if default is None:
            raise FileNotFoundError(path)
        return default
    return json.loads(p.read_text(encoding="utf-8-sig"))


def check_weights(weights: Mapping[str, float], names: tuple[str, ...]) -> None:
    if set(weights) != set(names):
        raise ValueError(f"weights must be exactly {', '.join(names)}")
    if min(weights.values()) < 0:
        raise ValueError("weights must not be negative")
    if abs(sum(weights.values()) - 1) > 1e-9:
        raise ValueError("weights must add up to 1")


def _off(guardrails: Mapping[str, object], name: str, value: object) -> None:
    if guardrails.get(name) is not value and guardrails.get(name) != value or isinstance(guardrails.get(name), int) and not isinstance(guardrails.get(name), bool):
        raise ValueError(f"guardrail {name} must be {value!r}")


@dataclass(frozen=True)
class MatchingConfig:
    """Global ranking. A falsy shortlist size or neutral score means the default."""

    weights: Mapping[str, float]
    max_fee: float
    scenario_id: str = "scenario"
    config_version: str = "v1"
    platform: str = "tiktok"
    minimum_campaign_count: int = 1
    require_fee_history: bool = True
    reject_campaign_history_dq_warn: bool = False
    campaign_count_cap: float = 5
    brand_count_cap: float = 3
    neutral_missing_score: float = 50.0
    shortlist_size: int = 30
    guardrails: Mapping[str, object] = field(default_factory=lambda: {"machine_learning": False, "fuzzy": False})

    def __post_init__(self) -> None:
        check_weights(self.weights, WEIGHTS_V1)
        if self.max_fee <= 0:
            raise ValueError("max_fee must be positive")
        for name in ("machine_learning", "fuzzy"):
            _off(self.guardrails, name, False)
        object.__setattr__(self, "neutral_missing_score", self.neutral_missing_score or 50.0)
        object.__setattr__(self, "shortlist_size", self.shortlist_size or 30)


@dataclass(frozen=True)
class MatchingV2Config:
    """Replay by target campaign, whose own evidence is left out."""

    weights: Mapping[str, float]
    config_version: str = "v2"
    individual_budget_scopes: tuple[str, ...] = ("influencer_tiktok",)
    campaign_count_cap: float = 5
    brand_count_cap: float = 3
    neutral_missing_score: float = 50.0
    shortlist_size: int = 30
    guardrails: Mapping[str, object] = field(default_factory=lambda: {"machine_learning": False, "fuzzy": False, "target_leakage": "forbidden", "requirement_inheritance": False})

    def __post_init__(self) -> None:
        check_weights(self.weights, WEIGHTS_V2)
        for name, value in (("machine_learning", False), ("fuzzy", False), ("target_leakage", "forbidden"), ("requirement_inheritance", False)):
            _off(self.guardrails, name, value)
        if not self.individual_budget_scopes:
            raise ValueError("individual_budget_scopes must not be empty")
        object.__setattr__(self, "neutral_missing_score", self.neutral_missing_score or 50.0)
        object.__setattr__(self, "shortlist_size", self.shortlist_size or 30)


def campaign_map(rows: list[dict]) -> list[dict]:
    """A campaign map, which must have rows and name each source once."""
    if not rows:
        raise ValueError("the campaign map is empty")
    keys = [(r["source_filename"], r["source_sheet_name"]) for r in rows]
    if len(set(keys)) < len(keys):
        raise ValueError("the campaign map names a source twice")
    return rows


def sheet_rules(rules: dict, overrides: dict | None = None) -> dict:
    """Classification rules with the overrides' entries added."""
    return rules | {"sheet_overrides": [*rules.get("sheet_overrides", []), *(overrides or {}).get("sheet_overrides", [])]}
