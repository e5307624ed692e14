"""An evaluation set as data: what must hold of profiles' results, one row each, and one plan that finds what does not."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What an expectation may be about: numbers of a profile's candidates, search and outcome.
FACTS = (
    "n_candidates",
    "max_cost",
    "min_rating",
    "n_relaxations",
    "after_location",
    "after_cuisine",
    "after_budget",
    "after_rating",
)
_SIDES = {"<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b, "=": lambda a, b: a == b}
SCHEMA = "pref_id bigint, fact string, side string, bound double, other_id bigint"


def facts(candidates: DataFrame, report: DataFrame) -> DataFrame:
    """(pref_id, fact, value) of ``ProfileSearch.candidates`` and ``report``; a fact without a value has no row."""
    found = candidates.groupBy("pref_id").agg(
        F.count(F.lit(1)).alias("n_candidates"),
        F.max("cost_for_two").alias("max_cost"),
        F.min("rating").alias("min_rating"),
    )
    steps = report.select(
        "pref_id",
        F.size("relaxations").alias("n_relaxations"),
        *[F.col(f"total_{c}").alias(c) for c in FACTS if c.startswith("after_")],
    )
    wide = steps.join(found, "pref_id", "left").fillna(0, ["n_candidates"])
    doubles = wide.select("pref_id", *[F.col(c).cast("double").alias(c) for c in FACTS])
    long = doubles.unpivot("pref_id", list(FACTS), "fact", "value")
    return long.where(F.col("value").isNotNull())


def violations(expected: DataFrame, told: DataFrame) -> DataFrame:
    """Rows of ``expected`` that ``told`` (pref_id, fact, value) does not meet, with ``value`` and ``against``.

    A row wants its profile's fact to be ``side`` (<=, >= or =) its ``bound`` or, with ``other_id``, the same fact of that
    profile plus ``bound`` (NULL: 0), so that "a higher cap never finds fewer" is a row like any other. A fact that is not
    there, of either profile, a NULL bound where there is no other profile, and an unknown fact or side are violations:
    nothing passes by being absent. Repeated rows are judged one by one. Two joins, whatever the number of rows.
    """
    own = told.select("pref_id", "fact", "value")
    theirs = told.select(F.col("pref_id").alias("other_id"), "fact", F.col("value").alias("theirs"))
    judged = expected.join(own, ["pref_id", "fact"], "left").join(theirs, ["other_id", "fact"], "left")
    alone = F.col("other_id").isNull()
    against = F.when(alone, F.col("bound")).otherwise(F.col("theirs") + F.coalesce("bound", F.lit(0.0)))
    judged = judged.withColumn("against", against)
    holds = reduce(
        lambda so_far, name: so_far.when(F.col("side") == name, _SIDES[name](F.col("value"), F.col("against"))),
        _SIDES,
        F.when(F.lit(False), F.lit(False)),
    )
    failed = judged.where(~F.coalesce(holds, F.lit(False)))
    return failed.select("pref_id", "fact", "side", "bound", "other_id", "value", "against")
