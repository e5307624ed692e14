"""Preference profiles: normalise every field and name the first broken rule per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import MAX_BUDGET_INR, MAX_TOP_K
from ..functions import parse, text


def _empty() -> Column:
    return F.array().cast("array<string>")


def _kind(df: DataFrame, name: str) -> T.DataType | None:
    return df.schema[name].dataType if name in df.columns else None


def _text(df: DataFrame, name: str) -> Column:
    return F.col(name).cast("string") if name in df.columns else F.lit(None).cast("string")


def _budget(df: DataFrame) -> tuple[Column, Column]:
    """(given, whole number) of the budget; the second spelling only counts where the first is absent."""
    given = F.coalesce(_text(df, "budget_for_two_inr"), _text(df, "budget_max_inr"))
    numbers = []
    for name in ("budget_for_two_inr", "budget_max_inr"):
        kind = _kind(df, name)
        if kind is None:
            numbers.append((F.lit(None).cast("string"), F.lit(None).cast("bigint")))
        elif isinstance(kind, T.NumericType):
            numbers.append((F.col(name), F.col(name).try_cast("bigint")))
        else:
            numbers.append((F.col(name), parse.parse_int(F.col(name))))
    (first, first_number), (_, second_number) = numbers
    return given, F.when(first.isNotNull(), first_number).otherwise(second_number)


def validate_preferences(prefs: DataFrame) -> DataFrame:
    """All rows, normalised, with ``error``: NULL, or the code of the first broken rule.

    Rule order: budget, cuisines, minimum rating, result size. A location never fails; blank means none.
    """
    given_budget, budget = _budget(prefs)
    cuisine_kind = _kind(prefs, "cuisines")
    is_list = isinstance(cuisine_kind, T.ArrayType) and isinstance(cuisine_kind.elementType, T.StringType)
    tokens = text.lower_tokens(F.col("cuisines")) if is_list else _empty()
    given_rating = _text(prefs, "min_rating")
    if isinstance(_kind(prefs, "min_rating"), T.NumericType):
        rating = F.nanvl(F.col("min_rating").cast("double"), F.lit(None).cast("double"))
    else:
        rating = parse.parse_float(given_rating)

    steps = prefs.select(
        "pref_id",
        text.normalize_whitespace(_text(prefs, "location")).alias("_place"),
        given_budget.alias("_given_budget"),
        budget.alias("_budget"),
        (F.col("cuisines") if cuisine_kind is not None else F.lit(None).cast("string")).alias("_given_cuisines"),
        F.coalesce(tokens, _empty()).alias("_tokens"),
        given_rating.alias("_given_rating"),
        rating.alias("_rating"),
        text.strip(F.coalesce(_text(prefs, "extras"), F.lit(""))).alias("extras"),
        (F.col("top_k") if "top_k" in prefs.columns else F.lit(None)).cast("int").alias("top_k"),
    )
    if is_list:
        bad_cuisines = F.when(
            F.exists("_given_cuisines", lambda x: x.isNull()), F.lit("cuisine_not_string")
        )
    else:
        bad_cuisines = F.when(F.col("_given_cuisines").isNotNull(), F.lit("cuisines_not_list"))
    error = F.coalesce(
        F.when(F.col("_given_budget").isNull(), "budget_missing")
        .when(F.col("_budget").isNull(), "budget_not_whole_number")
        .when(F.col("_budget") <= 0, "budget_not_positive")
        .when(F.col("_budget") > MAX_BUDGET_INR, "budget_too_large"),
        bad_cuisines,
        F.when(F.col("_given_rating").isNull(), "min_rating_missing")
        .when(F.col("_rating").isNull(), "min_rating_not_number")
        .when(~F.col("_rating").between(0.0, 5.0), "min_rating_out_of_range"),
        F.when(~F.col("top_k").between(1, MAX_TOP_K), "top_k_out_of_range"),
    )
    return steps.select(
        "pref_id",
        F.when(F.col("_place") != "", text.city_of(F.col("_place"))).alias("location"),
        F.col("_budget").alias("max_cost_for_two_inr"),
        F.col("_tokens").alias("cuisines"),
        F.col("_rating").alias("min_rating"),
        "extras",
        "top_k",
        error.alias("error"),
    )


def split_preferences(prefs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable profiles without ``error``, rejected rows as ``pref_id, error``)."""
    checked = validate_preferences(prefs)
    return (
        checked.where(F.col("error").isNull()).drop("error"),
        checked.where(F.col("error").isNotNull()).select("pref_id", "error"),
    )
