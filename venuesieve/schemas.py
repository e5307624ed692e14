"""Table contracts: raw listings, canonical listings, preference profiles, results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

SCHEMA_VERSION = "1.0.0"

CITY = "listed_in(city)"
KIND = "listed_in(type)"
COST = "approx_cost(for two people)"

# The 17 raw columns and what each one feeds.
RAW_USES = {
    "url": "raw_fields",
    "address": "raw_fields; searched by location",
    "name": "name",
    "online_order": "raw_fields",
    "book_table": "raw_fields",
    "rate": "rating",
    "votes": "votes",
    "phone": "raw_fields",
    "location": "neighborhood",
    "rest_type": "raw_fields",
    "dish_liked": "raw_fields",
    "cuisines": "cuisines",
    COST: "cost_for_two and cost_tier",
    "reviews_list": "raw_fields",
    "menu_item": "raw_fields",
    KIND: "raw_fields",
    CITY: "city",
}

# Columns carried along untouched.
PASSTHROUGH = (
    "url",
    "address",
    "online_order",
    "book_table",
    "phone",
    "rest_type",
    "dish_liked",
    "reviews_list",
    "menu_item",
    KIND,
)

RAW = T.StructType([T.StructField(c, T.StringType(), True, {"feeds": use}) for c, use in RAW_USES.items()])

RAW_FIELDS = T.StructType([T.StructField(c, T.StringType()) for c in PASSTHROUGH])

CANONICAL = T.StructType(
    [
        T.StructField("pos", T.LongType(), False, {"comment": "corpus order; breaks ties"}),
        T.StructField("id", T.StringType(), False, {"comment": "16 hex digits over name, place and cuisines"}),
        T.StructField("name", T.StringType(), False),
        T.StructField("city", T.StringType(), False),
        T.StructField("neighborhood", T.StringType(), False),
        T.StructField("cuisines", T.ArrayType(T.StringType(), False), False),
        T.StructField("rating", T.DoubleType()),
        T.StructField("cost_for_two", T.LongType()),
        T.StructField("cost_tier", T.StringType(), False, {"values": "low,medium,high"}),
        T.StructField("votes", T.LongType()),
        T.StructField("raw_fields", RAW_FIELDS),
    ]
)

PREFS = T.StructType(
    [
        T.StructField("pref_id", T.LongType(), False),
        T.StructField("location", T.StringType()),
        T.StructField("budget_for_two_inr", T.StringType()),
        T.StructField("budget_max_inr", T.StringType()),
        T.StructField("cuisines", T.ArrayType(T.StringType())),
        T.StructField("min_rating", T.DoubleType()),
        T.StructField("extras", T.StringType()),
        T.StructField("top_k", T.IntegerType()),
    ]
)

RESPONSES = T.StructType([T.StructField("pref_id", T.LongType(), False), T.StructField("raw", T.StringType())])


def column_mapping(spark: SparkSession) -> DataFrame:
    """The documented raw-column catalogue, one row per raw column, with the schema version."""
    rows = [(f.name, f.metadata["feeds"], SCHEMA_VERSION) for f in sorted(RAW.fields, key=lambda f: f.name)]
    return spark.createDataFrame(rows, "raw_column string, canonical_use string, schema_version string")
