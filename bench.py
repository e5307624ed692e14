"""Time the headline queries on local cores; prints one JSON line.

Tables that a user keeps on disk are written before the clock starts: the raw listing and profile tables, and for the
search queries the canonical listings. Every query then runs whole, once to warm up on the smallest data and once on
the clock.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

from venuesieve import SearchConfig  # noqa: E402
from venuesieve.operators.prefs import split_preferences  # noqa: E402
from venuesieve.operators.search import ProfileSearch  # noqa: E402
from venuesieve.plans.recommend import Recommender  # noqa: E402
from venuesieve.sources import canonicalize, stage  # noqa: E402
from workload.tables import listing_raw, prefs_raw  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "12g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def run_all(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def headline(spark: SparkSession, sf_dir: str) -> tuple[dict, dict]:
    raw = stage(listing_raw(spark, sf_dir), "bench-raw")
    asked = stage(prefs_raw(spark, sf_dir), "bench-prefs")
    listings = stage(canonicalize(raw), "bench-canonical")
    cfg = SearchConfig()

    def usable():
        return split_preferences(asked)[0]

    queries = {
        "canonical_listings": lambda: run_all(canonicalize(raw)),
        "prefs_validated": lambda: run_all(usable()),
        "filter_funnel": lambda: run_all(ProfileSearch(usable(), listings, cfg).strict_funnel()),
        "filter_report": lambda: run_all(ProfileSearch(usable(), listings, cfg).report()),
        "recommend_batch": lambda: run_all(Recommender(usable(), listings, None, cfg).items()),
    }
    return queries, {"listings": listings.count(), "profiles": asked.count()}


def main() -> None:
    spark = session()
    warm, _ = headline(spark, os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001"))
    for query in warm.values():
        query()
    queries, sizes = headline(spark, SF_DIR)
    seconds = {}
    for name, query in queries.items():
        start = time.perf_counter()
        query()
        seconds[name] = round(time.perf_counter() - start, 2)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 2),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(SF_DIR).name.removeprefix("sf"),
                "cpus": int(CPUS),
                **sizes,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
