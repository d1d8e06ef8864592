"""Query parameters with their defaults and ranges."""

from __future__ import annotations

from dataclasses import dataclass


def _check(name: str, value, low=None, high=None) -> None:
    if (low is not None and value < low) or (high is not None and value > high):
        raise ValueError(f"{name} must be within {low} and {high}: {value}")


@dataclass(frozen=True)
class SearchParams:
    max_results: int = 10
    vector_weight: float = 0.7
    text_weight: float = 0.3
    half_life_days: float = 30.0
    decay: bool = True
    diversity: bool = True
    diversity_lambda: float = 0.7
    canonical_ratio: float = 0.6
    content_similarity: float = 0.85

    def __post_init__(self):
        _check("max_results", self.max_results, 1, 100)
        _check("canonical_ratio", self.canonical_ratio, 0, 1)
        _check("diversity_lambda", self.diversity_lambda, 0, 1)

    def quotas(self, layers: list[str]) -> dict[str, int]:
        """Results of each layer: the canonical share, the rest for each of the others; all for a single layer."""
        if len(layers) == 1:
            return {layers[0]: self.max_results}
        canonical = max(1, int(self.max_results * self.canonical_ratio))
        return {name: canonical if name == "canonical" else max(1, self.max_results - canonical) for name in layers}


@dataclass(frozen=True)
class SensoryParams:
    pre_compress: bool = True
    messages_use: str = "all"
    topic_segment: bool = True
    max_input_tokens: int = 4096
    topic_token_threshold: int = 800
    topic_similarity: float = 0.18
    message_chars: int = 320
    segment_chars: int = 900


@dataclass(frozen=True)
class StateParams:
    embedding_dimensions: int = 1536
    min_confidence: float = 0.5
    conflict_similarity: float = 0.85
    cluster_similarity: float = 0.90
    dedup_similarity: float = 0.95
    max_cluster: int = 10
    working_messages: int = 20
    drain_every: int = 8
    consolidation_threshold: int = 20
    session_timeout_hours: float = 2.0
    cleanup_days: int = 30
    stale_confidence: float = 0.7
    stale_days: int = 180
    promotion_days: int = 90
    daily_budget: int = 100_000
    rate_rpm: int = 60

    def __post_init__(self):
        _check("embedding_dimensions", self.embedding_dimensions, 64, 4096)
        _check("drain_every", self.drain_every, 2)
