"""What operators of the service watch: outcome counts, places asked for, venues listed more than once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dominance import keep_first


def outcomes(report: DataFrame, no_model: str) -> DataFrame:
    """One row: profiles in a recommendation report, and how many came out empty, fell back, were relaxed or cut.

    Counts, not rates, so that runs can be added up. ``no_model`` is the model id of empty results.
    """
    return report.agg(
        F.count(F.lit(1)).alias("n_profiles"),
        F.count_if(F.col("model_id") == no_model).alias("n_empty"),
        F.count_if(F.col("fallback_used") & (F.col("model_id") != no_model)).alias("n_fallback"),
        F.count_if(F.size("relaxations_applied") > 0).alias("n_relaxed"),
        F.count_if("truncated").alias("n_truncated"),
    )


def places_asked(prefs: DataFrame) -> DataFrame:
    """``location, n_profiles``; profiles without a location count under NULL."""
    return prefs.groupBy("location").agg(F.count(F.lit(1)).alias("n_profiles"))


def unique_venues(listings: DataFrame) -> DataFrame:
    """The first listing (by ``pos``) of each content id. Nothing else drops repeated listings.

    The rank is a group limit: repeated ids are cut in each task before the shuffle, so a chain with a third of all
    rows sends one row per task.
    """
    return keep_first(listings, ["id"], [F.col("pos")], 1)
