"""Ground model answers in the candidates: resolve, drop strangers and repeats, fill up, or fall back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text

# Explanations used where the model gave none.
WHY_PICKED = "Matches your preferences among the shortlisted venues."
WHY_FILLED = "High rating and match for your filters among the shortlisted venues."
WHY_FALLBACK = "Ranked using ratings and votes on your shortlist (LLM unavailable or parse error)."


def _ids(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy("pref_id", "id").agg(
        F.max("cand_pos").alias("last_pos"), F.min("cand_pos").alias("first_pos")
    )


def resolve(entries: DataFrame, candidates: DataFrame) -> DataFrame:
    """``entries`` with ``id`` and ``cand_pos`` of the candidate they name, by id or else by name; NULL for strangers."""
    names = (
        candidates.withColumn("key", F.lower(text.strip(F.col("name"))))
        .where(F.col("key") != "")
        .groupBy("pref_id", "key")
        .agg(F.min_by("id", "cand_pos").alias("named_id"), F.min("cand_pos").alias("named_pos"))
    )
    by_id = _ids(candidates).select("pref_id", F.col("id").alias("restaurant_id"), "last_pos")
    own = F.when(F.col("last_pos").isNotNull(), F.col("restaurant_id")).otherwise(F.col("named_id"))
    return (
        entries.withColumn("key", F.lower(F.col("restaurant_id")))
        .join(by_id, ["pref_id", "restaurant_id"], "left")
        .join(names, ["pref_id", "key"], "left")
        .select(*entries.columns, own.alias("id"), F.coalesce("last_pos", "named_pos").alias("cand_pos"))
    )


def reconcile(entries: DataFrame, candidates: DataFrame, limits: DataFrame) -> DataFrame:
    """``pref_id, rank, cand_pos, explanation`` for every profile in ``limits`` (``pref_id, top_k``).

    An entry names a candidate by id or, failing that, by name. Several candidates may share an id: an entry then
    means the last of them, while filling up takes the first. Each id is used once.
    """
    candidates = candidates.join(limits, "pref_id", "left_semi")
    ids = _ids(candidates)
    why = F.coalesce(F.nullif("explanation", F.lit("")), F.lit(WHY_PICKED))
    resolved = resolve(entries, candidates).where(F.col("id").isNotNull())
    resolved = resolved.select("pref_id", "id", "cand_pos", "rank", "arr_pos", why.alias("explanation"))
    once = F.row_number().over(W.partitionBy("pref_id", "id").orderBy("rank", "arr_pos"))
    picked = resolved.withColumn("nth", once).where(F.col("nth") == 1).drop("nth")
    filled = ids.join(picked, ["pref_id", "id"], "left_anti").select(
        "pref_id",
        "id",
        F.col("first_pos").alias("cand_pos"),
        F.lit(None).cast("bigint").alias("rank"),
        F.col("first_pos").alias("arr_pos"),
        F.lit(WHY_FILLED).alias("explanation"),
    )
    order = W.partitionBy("pref_id").orderBy(F.col("rank").asc_nulls_last(), "arr_pos")
    return (
        picked.unionByName(filled)
        .withColumn("rank", F.row_number().over(order))
        .join(limits, "pref_id")
        .where(F.col("rank") <= F.col("top_k"))
        .select("pref_id", "rank", "cand_pos", "explanation")
    )


def fall_back(candidates: DataFrame, limits: DataFrame, key: str = "pref_id", shown: Sequence[str] = ()) -> DataFrame:
    """The first candidates as they are ranked, with their columns ``shown``; ids may repeat.

    Candidates may be those of requests: ``limits`` then has the profiles' ``key`` beside ``pref_id`` and ``top_k``.
    """
    return (
        candidates.join(limits, key)
        .where(F.col("cand_pos") <= F.col("top_k"))
        .select(
            "pref_id", F.col("cand_pos").alias("rank"), "cand_pos", F.lit(WHY_FALLBACK).alias("explanation"), *shown
        )
    )


def grounding_violations(items: DataFrame, candidates: DataFrame) -> DataFrame:
    """Recommended items whose id is not among their profile's candidates."""
    return items.join(candidates.select("pref_id", "id").distinct(), ["pref_id", "id"], "left_anti")
