"""Scoring weights and thresholds of one run."""

from __future__ import annotations

from dataclasses import dataclass

DIMENSIONS = ("semantic", "technical", "experience", "behavior", "trust")


@dataclass(frozen=True)
class EngineConfig:
    """Defaults are the published ones; weights are relative and normalised on use."""

    weight_semantic: float = 0.35
    weight_technical: float = 0.30
    weight_experience: float = 0.15
    weight_behavior: float = 0.12
    weight_trust: float = 0.08
    risk_penalty_scale: float = 0.40
    half_life_days: float = 90.0
    notice_preferred_days: int = 30
    notice_max_days: int = 150
    embedding_batch_size: int = 256
    top_k: int = 100

    def __post_init__(self) -> None:
        raw = self.raw_weights()
        if any(w < 0 for w in raw.values()):
            raise ValueError("weights must not be negative")
        if sum(raw.values()) <= 0:
            raise ValueError("the weights must sum to more than 0")
        if not 0 <= self.risk_penalty_scale <= 1:
            raise ValueError("risk_penalty_scale must lie in [0, 1]")
        if self.half_life_days <= 0:
            raise ValueError("half_life_days must be positive")
        if self.notice_preferred_days < 0 or self.notice_max_days < 0:
            raise ValueError("notice bounds must not be negative")
        if self.top_k < 1 or self.embedding_batch_size < 1:
            raise ValueError("top_k and embedding_batch_size must be at least 1")

    def raw_weights(self) -> dict[str, float]:
        return {d: float(getattr(self, f"weight_{d}")) for d in DIMENSIONS}

    def weights(self) -> dict[str, float]:
        """Weights scaled to sum to 1."""
        raw = self.raw_weights()
        total = sum(raw.values())
        return {d: w / total for d, w in raw.items()}
