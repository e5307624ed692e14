"""Knobs of ingest, search and recommendation. All are plain driver-side values that end up as plan literals."""

from __future__ import annotations

from dataclasses import dataclass

# Product-wide limits and defaults of the data contract.
MAX_BUDGET_INR = 1_000_000
MAX_TOP_K = 12
DEFAULT_TOP_K = 10


@dataclass(frozen=True)
class IngestConfig:
    """How raw listing rows become canonical rows."""

    dataset_name: str = "listings"
    split: str = "train"
    revision: str | None = None
    cost_low_max_inr: int = 400
    cost_medium_max_inr: int = 1000
    max_rows: int | None = None
    strict_columns: bool = False


@dataclass(frozen=True)
class SearchConfig:
    """Relaxation ladder and output size of the constrained search."""

    k_min: int = 5
    max_candidates: int = 30
    min_rating_floor: float = 2.5
    rating_relax_step: float = 0.5
    budget_relax_step_inr: int = 400
    budget_relax_ceiling_inr: int = 250_000

    def __post_init__(self) -> None:
        if not self.rating_relax_step > 0:
            raise ValueError("rating_relax_step must be positive, or the ladder never ends")
        if self.max_candidates < 0:
            raise ValueError("max_candidates must not be negative")
        if not 0 <= self.budget_relax_ceiling_inr < 2**62:
            raise ValueError("budget_relax_ceiling_inr is out of range")


@dataclass(frozen=True)
class AnswerConfig:
    """Defaults of the model-answer stage."""

    model: str = "llama-3.3-70b-versatile"
    temperature: float = 0.5
    max_tokens: int = 1200
    top_k: int = DEFAULT_TOP_K
