"""Counts and catalogues over a canonical corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import CorpusTooSmallError
from ..functions import text
from ..schemas import RAW, SCHEMA_VERSION
from ..sources.listings import conform, has_required_fields, missing_columns


def corpus_metrics() -> list[Column]:
    """Seen and usable rows, for ``agg`` or ``observe``."""
    return [
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(has_required_fields()).alias("rows_passing_validation"),
    ]


def corpus_stats(listings: DataFrame) -> DataFrame:
    return listings.agg(*corpus_metrics()).withColumn("schema_version", F.lit(SCHEMA_VERSION))


def validate_corpus(listings: DataFrame, min_valid: int = 0) -> dict:
    """One pass; raises if fewer than ``min_valid`` listings are usable."""
    stats = corpus_stats(listings).head().asDict()
    if min_valid > 0 and stats["rows_passing_validation"] < min_valid:
        raise CorpusTooSmallError(f"{stats['rows_passing_validation']} usable listings, {min_valid} wanted: {stats}")
    return stats


def localities(listings: DataFrame) -> DataFrame:
    """Distinct non-blank neighborhoods of all rows, sorted without regard to case."""
    return (
        listings.select(text.strip(F.col("neighborhood")).alias("locality"))
        .where(F.col("locality") != "")
        .distinct()
        .orderBy(F.lower("locality"), "locality")
    )


def column_report(raw: DataFrame) -> DataFrame:
    """Per contract column: is it there, and how many rows hold a value. One pass over the table."""
    missing = set(missing_columns(raw))
    counts = conform(raw).agg(*[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(RAW.names)])
    rows = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.lit(c not in missing).alias("present"),
            F.col(f"n{i}").alias("n_values"),
        )
        for i, c in enumerate(RAW.names)
    ]
    return counts.select(F.inline(F.array(*rows)))
