"""Raw CSV and JSON listings with broken rows set aside instead of lost or half read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ListingSchemaError
from ..schemas import RAW

BROKEN = "_broken"


def split_raw(spark: SparkSession, path: str, fmt: str, **options: str) -> tuple[DataFrame, DataFrame]:
    """(listings as ``sources.read_raw`` gives them, rejected rows as ``file, block_start, reason, record``).

    Rejected are rows that the format cannot read (``unreadable``: a CSV row with too few or too many fields or an open
    quote, JSON that does not parse or is no object), ``no_pos`` and ``pos_not_whole_number`` for the order column, and
    ``pos_repeated`` for all rows of a ``pos`` that occurs more than once among the readable ones. ``record`` is the row
    as it stands in the file; ``file`` and ``block_start`` name the file and the byte at which the part of it begins that
    the row was read from. Every row is in one of the two tables. Values are strings, and columns beyond the contract
    are left out. Files are read in splits; only ``pos`` is shuffled, to find repeated ones.
    """
    if fmt not in ("csv", "json"):
        raise ListingSchemaError(f"{fmt} listings have no rows that could be broken one by one")
    strings = _columns(spark, path, fmt, options)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*strings, BROKEN]])
    reader = spark.read.format(fmt).schema(schema).option("mode", "PERMISSIVE")
    reader = reader.option("columnNameOfCorruptRecord", BROKEN)
    if fmt == "csv":
        reader = reader.options(header="true", enforceSchema="false", columnPruning="false")
    read = reader.options(**options).load(path)
    known = [c for c in read.columns if c in RAW.names or c == "pos"]
    record = F.to_json(F.struct(*[F.col(f"`{c}`") for c in strings]))
    rows = read.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.col(BROKEN),
        F.coalesce(BROKEN, record).alias("record"),
        F.struct(*[F.col(f"`{c}`") for c in known if c != "pos"]).alias("fields"),
        F.trim(F.col("pos") if "pos" in known else F.lit(None).cast("string")).alias("given"),
    ).withColumn("pos", F.when(F.col("given").rlike("^[+-]?[0-9]+$"), F.col("given").try_cast("bigint")))
    reason = (
        F.when(F.col(BROKEN).isNotNull(), "unreadable")
        .when(F.coalesce("given", F.lit("")) == "", "no_pos")
        .when(F.col("pos").isNull(), "pos_not_whole_number")
    )
    judged = rows.withColumn("first_reason", reason)
    readable = judged.where(F.col("first_reason").isNull())
    twice = readable.groupBy("pos").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("pos")
    good = readable.join(twice, "pos", "left_anti").select("pos", "fields.*")
    apart = ["file", "block_start"]
    repeated = readable.join(twice, "pos", "left_semi").select(*apart, F.lit("pos_repeated").alias("reason"), "record")
    broken = judged.where(F.col("first_reason").isNotNull()).select(*apart, F.col("first_reason").alias("reason"), "record")
    return good, broken.unionByName(repeated)


def _columns(spark: SparkSession, path: str, fmt: str, options: dict[str, str]) -> list[str]:
    """CSV: the names in the header. JSON: the names of the contract, as a key may be absent from any row."""
    if fmt == "json":
        return ["pos", *RAW.names]
    return spark.read.format("csv").options(header="true", enforceSchema="false").options(**options).load(path).columns


def rejected_counts(rejected: DataFrame) -> DataFrame:
    """``reason, n``."""
    n: Column = F.count(F.lit(1)).alias("n")
    return rejected.groupBy("reason").agg(n)
