"""The four listing predicates as column expressions, for scans with one known profile.

Literal caps and minimum ratings reach the Parquet scan as pushed filters. Many profiles at once go through
``search``, which never pairs profiles with listings.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..sources.listings import has_required_fields


def location_matches(query: str | None) -> Column:
    """Query inside city, neighborhood or address, or city or neighborhood inside the query; case does not count.

    An empty neighborhood lies inside every query and so matches it.
    """
    if query is None:
        return F.lit(True)
    q = F.lower(text.squeeze(F.lit(query)))
    city, hood = F.lower("city"), F.lower("neighborhood")
    address = F.lower(F.coalesce(F.col("raw_fields.address"), F.lit("")))
    return (
        F.contains(city, q) | F.contains(hood, q) | F.contains(address, q) | F.contains(q, city) | F.contains(q, hood)
    )


def cuisine_matches(wanted: Sequence[str]) -> Column:
    """Any wanted token inside a listed one, or the other way round; nothing wanted matches all."""
    if not wanted:
        return F.lit(True)

    def hit(w: str) -> Column:
        return F.exists("cuisines", lambda c: F.contains(c, F.lit(w)) | F.contains(F.lit(w), c))

    any_hit = F.lit(False)
    for w in wanted:
        if w:
            any_hit = any_hit | hit(w)
    return any_hit


def budget_matches(cap: int) -> Column:
    return F.col("cost_for_two") <= F.lit(cap)


def rating_matches(floor: float) -> Column:
    return F.col("rating") >= F.lit(float(floor))


def filter_listings(
    listings: DataFrame, location: str | None, cuisines: Sequence[str], cap: int, min_rating: float
) -> DataFrame:
    """Strict search for one normalised profile."""
    return listings.where(
        has_required_fields()
        & budget_matches(cap)
        & rating_matches(min_rating)
        & location_matches(location)
        & cuisine_matches(cuisines)
    )


def rank_order() -> list[Column]:
    """Rating, then votes, then name; corpus order settles the rest."""
    return [
        F.coalesce("rating", F.lit(-1.0)).desc(),
        F.coalesce("votes", F.lit(0)).desc(),
        F.lower("name"),
        F.col("pos"),
    ]


def top_listings(listings: DataFrame, limit: int) -> DataFrame:
    """First ``limit`` listings in rank order; plans a distributed top-k, not a full sort."""
    return listings.orderBy(*rank_order()).limit(limit)
