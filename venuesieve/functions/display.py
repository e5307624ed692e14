"""Columns formatted for people."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NOTHING = "—"


def display_area(neighborhood: Column, city: Column) -> Column:
    """The non-empty ones of neighborhood and city."""
    return F.concat_ws(", ", F.nullif(neighborhood, F.lit("")), F.nullif(city, F.lit("")))


def display_cost(cost: Column) -> Column:
    """Rupees with Indian digit grouping (three, then twos)."""
    digits = cost.cast("string")
    head = F.regexp_replace(digits, "[0-9]{3}$", "")
    grouped = F.when(
        F.length(digits) > 3,
        F.concat_ws(",", F.regexp_replace(head, "(?<=[0-9])(?=([0-9]{2})+$)", ","), F.right(digits, F.lit(3))),
    ).otherwise(digits)
    return F.coalesce(F.concat(F.lit("₹"), grouped, F.lit(" for two")), F.lit(NOTHING))


def display_rating(rating: Column) -> Column:
    return F.when(rating.isNotNull(), F.format_string("%.1f", rating)).otherwise(NOTHING)
