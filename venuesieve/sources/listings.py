"""Raw listing tables in, canonical listings out."""

from __future__ import annotations

import logging
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import IngestConfig
from ..errors import ListingSchemaError
from ..functions import parse, text
from ..schemas import CITY, COST, PASSTHROUGH, RAW

log = logging.getLogger(__name__)

_ROW_BITS = 40


def read_raw(spark: SparkSession, path: str, fmt: str = "parquet", **options: str) -> DataFrame:
    """Scan raw listings by column name: Parquet columns, CSV headers, JSON keys; CSV and JSON values as strings.

    Parquet without an order column ``pos`` gets one from (file path, row in file), the same on every read. The other
    formats are split by size, so their rows have no stable number: they must bring ``pos``. CSV files whose headers
    differ are refused.
    """
    by_name = {"csv": {"header": "true", "enforceSchema": "false"}, "json": {"primitivesAsString": "true"}}
    df = spark.read.format(fmt).options(**by_name.get(fmt, {}) | options).load(path)
    if "pos" in df.columns:
        return df if fmt == "parquet" else df.withColumn("pos", F.col("pos").cast("bigint"))
    if fmt != "parquet":
        raise ListingSchemaError(f"{fmt} listings need an order column pos")
    return _with_file_order(df)


def _with_file_order(df: DataFrame) -> DataFrame:
    # inputFiles() is planning metadata; no row is read for it. Both sides may spell the scheme's slashes differently.
    paths = sorted({re.sub("^([^:/]+):/+", r"\1:/", p) for p in df.inputFiles()})
    if len(paths) == 1:
        return df.withColumn("pos", F.col("_metadata.row_index"))
    order = df.sparkSession.createDataFrame(list(enumerate(paths)), "_ord bigint, _file string")
    marked = df.withColumns(
        {
            "_file": F.regexp_replace("_metadata.file_path", "^([^:/]+):/+", "$1:/"),
            "_row": F.col("_metadata.row_index"),
        }
    )
    place = F.coalesce("_ord", F.raise_error(F.concat(F.lit("file not listed: "), "_file")).cast("bigint"))
    return (
        marked.join(order, "_file", "left")
        .withColumn("pos", F.shiftleft(place, _ROW_BITS) + F.col("_row"))
        .drop("_file", "_row", "_ord")
    )


def missing_columns(df: DataFrame) -> list[str]:
    return sorted(set(RAW.names) - set(df.columns))


def conform(df: DataFrame, strict: bool = False) -> DataFrame:
    """Check the column contract. Strict raises; lax warns and adds the absent columns as NULL."""
    missing = missing_columns(df)
    if missing and strict:
        raise ListingSchemaError(f"raw listings lack columns {missing}")
    if missing:
        log.warning("raw listings lack columns %s; they read as NULL", missing)
    return df.withColumns({c: F.lit(None).cast("string") for c in missing}) if missing else df


def _raw(name: str) -> Column:
    return F.col(f"`{name}`")


def canonicalize(raw: DataFrame, config: IngestConfig = IngestConfig()) -> DataFrame:
    """The full raw -> canonical projection: one narrow select, no shuffle. Needs the order column ``pos``."""
    raw = conform(raw, config.strict_columns)
    votes_numeric = not isinstance(raw.schema["votes"].dataType, T.StringType)

    words = {"name": "name", "city": CITY, "neighborhood": "location"}
    as_read = [F.coalesce(_raw(c).cast("string"), F.lit("")) for c in words.values()]
    listed = _raw("cuisines").cast("string")

    # Each step names what the next one uses more than once, so that nothing is computed twice.
    folded = raw.select(
        "pos",
        *[text.squeeze(c).alias(name) for c, name in zip(as_read, words)],
        listed.alias("cuisines"),
        text.nfkc_row(as_read, listed).alias("folded"),
        parse.number_text(_raw("rate")).alias("rate"),
        parse.parse_cost_inr(_raw(COST)).alias("cost_for_two"),
        parse.parse_votes(_raw("votes"), votes_numeric).alias("votes"),
        F.struct(*[_raw(c).cast("string").alias(c) for c in PASSTHROUGH]).alias("raw_fields"),
    )
    spelled = {c: F.coalesce(F.col("folded")[i], F.col(c)) for i, c in enumerate(words)}
    parts = F.coalesce(F.slice("folded", len(words) + 1, F.size("folded")), F.split("cuisines", ","))
    spelt = folded.withColumns(spelled | {"cuisines": text.split_tokens(F.col("cuisines"), parts)})
    cleaned = spelt.select(
        "pos",
        text.title_case(F.col("name")).alias("name"),
        text.city_of(F.col("city")).alias("city"),
        "neighborhood",
        "cuisines",
        parse.rating_of(F.col("rate")).alias("rating"),
        "cost_for_two",
        "votes",
        "raw_fields",
    )
    return cleaned.select(
        "pos",
        parse.stable_id(F.col("name"), F.col("city"), F.col("neighborhood"), F.col("cuisines")).alias("id"),
        "name",
        "city",
        "neighborhood",
        "cuisines",
        "rating",
        "cost_for_two",
        parse.classify_cost_tier(
            F.col("cost_for_two"), config.cost_low_max_inr, config.cost_medium_max_inr
        ).alias("cost_tier"),
        "votes",
        "raw_fields",
    )


def has_required_fields() -> Column:
    return (F.col("name") != "") & (F.col("city") != "")


def first_rows(df: DataFrame, n: int) -> DataFrame:
    """The first n rows by ``pos``, which must be set and unique; a null or a repeated ``pos`` in reach raises.

    The n-th ``pos`` is located by counting rows per slice of an ever narrower range, and the rows stay where they are,
    whatever n is.
    """
    positions = df.select("pos")
    low, high, known, rows = positions.agg(F.min("pos"), F.max("pos"), F.count("pos"), F.count("*")).head()
    if known < rows:
        raise ValueError(f"{rows - known} rows have no pos")
    if rows <= n or n <= 0:
        return df if n > 0 else df.limit(0)
    wanted, slices = n, 4096
    while True:
        width = (high - low) // slices + 1
        counts = (
            positions.where(F.col("pos").between(low, high))
            .groupBy(F.expr(f"(pos - {low}) div {width}").alias("slice"))
            .count()
        )
        # At most 4096 rows, whatever the size of the table.
        for slice_, count in sorted(counts.collect()):
            if wanted <= count:
                low, high = low + slice_ * width, min(high, low + (slice_ + 1) * width - 1)
                break
            wanted -= count
        if low == high:
            if count > 1:
                raise ValueError(f"pos {low} occurs {count} times")
            return df.where(F.col("pos") <= high)


def load_listings(
    raw: DataFrame, config: IngestConfig = IngestConfig(), cache_path: str | None = None, prefer_cache: bool = False
) -> DataFrame:
    """Cached canonical table if it is valid and wanted, else the projection (written to the cache if one is named).

    ``max_rows`` keeps the first raw rows in ``pos`` order, before any validation.
    """
    from .cache import read_canonical, write_canonical

    spark = raw.sparkSession
    if cache_path and prefer_cache:
        cached = read_canonical(spark, cache_path, config)
        if cached is not None:
            return cached
    if config.max_rows is not None:
        raw = first_rows(raw, config.max_rows)
    listings = canonicalize(raw, config)
    if cache_path:
        write_canonical(listings, cache_path, config)
        return read_canonical(spark, cache_path, config)
    return listings
