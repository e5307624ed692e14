"""Dirty strings -> numbers, tiers and ids. ``try_cast`` throughout: bad input is NULL, never a failed job."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE, has_non_ascii, strip

# Rating spellings that mean "no rating".
NO_RATING = ("", "nan", "new", "-", "none")

_OUT_OF_FIVE = rf"^([0-9]+(?:\.[0-9]+)?){SPACE}*/{SPACE}*5"
_FLOAT = r"(?i)^[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?|inf(inity)?)$"
_GROUPED_DIGITS = "^[+-]?[0-9]+(_[0-9]+)+$"


@lru_cache(maxsize=None)
def _digit_map() -> tuple[str, str]:
    """All non-ASCII decimal digits and their ASCII values, from the Unicode tables."""
    digits = [chr(c) for c in range(0x80, sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Nd"]
    return "".join(digits), "".join(str(unicodedata.digit(d)) for d in digits)


def ascii_digits(text: Column) -> Column:
    source, target = _digit_map()
    return F.when(has_non_ascii(text), F.translate(text, source, target)).otherwise(text)


def number_text(value: Column) -> Column:
    """Stripped text with ASCII digits, ready for ``float_of`` and ``rating_of``."""
    return ascii_digits(strip(value.cast("string")))


def float_of(s: Column) -> Column:
    return F.when(s.rlike(_FLOAT), s.try_cast("double"))


def rating_of(s: Column) -> Column:
    return F.when(
        ~F.lower(s).isin(*NO_RATING),
        F.coalesce(F.nullif(F.regexp_extract(s, _OUT_OF_FIVE, 1), F.lit("")).try_cast("double"), float_of(s)),
    )


def parse_float(text: Column) -> Column:
    """Decimal or scientific notation and infinities; no type suffixes, no hex, no NaN."""
    return float_of(number_text(text))


def parse_rating(text: Column) -> Column:
    """``x/5`` (prefix, no range check) or a plain number; placeholders and junk -> NULL."""
    return rating_of(number_text(text))


def parse_cost_inr(text: Column) -> Column:
    """All digits of the string, read as one whole number (``1,200`` -> 1200, ``800.0`` -> 8000)."""
    return F.regexp_replace(ascii_digits(text.cast("string")), "[^0-9]", "").try_cast("bigint")


def parse_int(text: Column) -> Column:
    s = ascii_digits(strip(text.cast("string")))
    return F.when(s.contains("_") & s.rlike(_GROUPED_DIGITS), F.replace(s, F.lit("_"), F.lit(""))).otherwise(s).try_cast("bigint")


def parse_votes(value: Column, numeric: bool = False) -> Column:
    """Whole number or NULL; a fractional *string* is junk, a fractional *number* is cut."""
    return value.try_cast("bigint") if numeric else parse_int(value)


def classify_cost_tier(cost: Column, low_max: int, medium_max: int) -> Column:
    """Inclusive upper bounds; unknown cost counts as medium."""
    return (
        F.when(cost.isNull(), "medium")
        .when(cost <= low_max, "low")
        .when(cost <= medium_max, "medium")
        .otherwise("high")
    )


def stable_id(name: Column, city: Column, neighborhood: Column, cuisines: Column) -> Column:
    """Content id over already normalised columns."""
    payload = F.concat_ws("|", name, city, neighborhood, F.array_join(F.sort_array(cuisines), ","))
    return F.substring(F.sha2(payload, 256), 1, 16)
