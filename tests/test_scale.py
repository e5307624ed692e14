"""Work that has to grow with the tables: what is spread, and what is done once."""

from pyspark.sql import functions as F

from venuesieve.operators import search
from venuesieve.operators.search import relax_ladder
from venuesieve.sources import canonicalize
from venuesieve.sources.listings import has_required_fields
from workload.queries import QUERIES, _raw_files
from workload.tables import listing_raw, prefs_raw

DATA = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_profiles_of_one_small_file_are_spread(spark):
    assert prefs_raw(spark, DATA).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_ladder_rows_carry_no_list_of_labels(spark):
    """Up to 632 rows a profile: a list of all labels beside each of them makes the work quadratic."""
    prefs = QUERIES["prefs_validated"](spark, DATA).withColumn("cuisines", F.split("cuisines", "\\|"))
    generated = [line for line in _plan(relax_ladder(prefs)).splitlines() if "Generate explode" in line]
    assert generated and all("labels" not in line for line in generated)


def test_stream_files_grow_in_number(spark):
    """Four files whatever the table, each read by one task, made a task's share of the stream a quarter of it."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "10")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        _, raw, files = _raw_files(spark, DATA, 4)
        assert files > 1 and len(raw.inputFiles()) == 4 * files
        assert raw.count() == listing_raw(spark, DATA).count()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_listings_pass_the_projection_once(spark, monkeypatch):
    """A filter on names moved below their projection, which all rows then passed twice, Python included."""
    plans = []

    def stage(df, label):
        plans.append(_plan(df))
        return df

    monkeypatch.setattr(search, "stage", stage)
    listings = canonicalize(listing_raw(spark, DATA))
    lean = search.Corpus(listings).lean
    assert plans[0].count("ArrowEvalPython") == 1 and plans[0].count("initcap") == 2
    assert lean.count() == listings.where(has_required_fields()).count() < listings.count()
