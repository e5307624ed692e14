from .display import display_area, display_cost, display_rating
from .parse import classify_cost_tier, parse_cost_inr, parse_rating, parse_votes, stable_id
from .text import (
    lower_tokens,
    normalize_city,
    normalize_whitespace,
    split_cuisines,
    split_free_text,
    strip,
    title_case,
)

__all__ = [
    "classify_cost_tier",
    "display_area",
    "display_cost",
    "display_rating",
    "lower_tokens",
    "normalize_city",
    "normalize_whitespace",
    "parse_cost_inr",
    "parse_rating",
    "parse_votes",
    "split_cuisines",
    "split_free_text",
    "stable_id",
    "strip",
    "title_case",
]
