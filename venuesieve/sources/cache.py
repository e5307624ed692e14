"""Canonical Parquet as published snapshots: a reader keeps the one it opened while the next one is written.

A cache is a folder with ``data/<snapshot>``, which is written once and never changed, and ``log``, a few JSON rows that
say what each snapshot is. A row is added after its data is complete, so a failed or running rebuild leaves the earlier
snapshots in force. Beyond name, version and revision the log records every knob that changes the rows; a cache built
with other knobs is a miss.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

from ..config import IngestConfig
from ..schemas import CANONICAL, SCHEMA_VERSION

_LOG = (
    "version bigint, snapshot string, schema_version string, dataset_name string, revision string, row_count bigint, "
    "split string, max_rows bigint, cost_low_max_inr bigint, cost_medium_max_inr bigint"
)


def _data(path: str, snapshot: str) -> str:
    return f"{path.rstrip('/')}/data/{snapshot}"


def _log(path: str) -> str:
    return f"{path.rstrip('/')}/log"


def snapshots(spark: SparkSession, path: str) -> list[Row]:
    """The log, newest snapshot first. It has a row per publication, however large the data."""
    try:
        rows = spark.read.schema(_LOG).json(_log(path)).where(F.col("snapshot").isNotNull()).collect()
    except AnalysisException:
        return []
    return sorted(rows, key=lambda r: (r.version, r.snapshot), reverse=True)


def publish(listings: DataFrame, path: str, config: IngestConfig = IngestConfig()) -> Row:
    """Write a new snapshot, then make it the newest. Rows are counted while they are written. Returns its log row."""
    spark = listings.sparkSession
    snapshot, seen = uuid4().hex, Observation()
    counted = listings.observe(seen, F.count(F.lit(1)).alias("n"))
    counted.write.mode("errorifexists").parquet(_data(path, snapshot))
    before = snapshots(spark, path)
    row = Row(
        version=before[0].version + 1 if before else 1,
        snapshot=snapshot,
        schema_version=SCHEMA_VERSION,
        dataset_name=config.dataset_name,
        revision=config.revision,
        row_count=int(seen.get["n"]),
        split=config.split,
        max_rows=config.max_rows,
        cost_low_max_inr=config.cost_low_max_inr,
        cost_medium_max_inr=config.cost_medium_max_inr,
    )
    spark.createDataFrame([tuple(row)], _LOG).coalesce(1).write.mode("append").json(_log(path))
    return row


def write_canonical(listings: DataFrame, path: str, config: IngestConfig = IngestConfig()) -> int:
    """``publish``; returns the row count."""
    return publish(listings, path, config).row_count


def newest(
    spark: SparkSession, path: str, config: IngestConfig = IngestConfig(), snapshot: str | None = None
) -> str | None:
    """Name of the newest snapshot built for ``config``, or of ``snapshot`` if that one was; None if there is none."""
    for row in snapshots(spark, path):
        if snapshot in (None, row.snapshot) and _fits(row.asDict(), config):
            return row.snapshot
    return None


def read_canonical(
    spark: SparkSession, path: str, config: IngestConfig = IngestConfig(), snapshot: str | None = None
) -> DataFrame | None:
    """The newest (or named) cached table, or None when it is absent, unreadable, or was built for something else."""
    found = newest(spark, path, config, snapshot)
    try:
        return spark.read.schema(CANONICAL).parquet(_data(path, found)) if found else None
    except AnalysisException:
        return None


def prune(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Delete the data of all published snapshots but the newest ``keep``; returns their names.

    Readers of a deleted snapshot fail, so keep as many as a reader may be behind. What a failed ``publish`` has left is
    not in the log and stays.
    """
    if keep < 1:
        raise ValueError("the newest snapshot has to stay")
    context, gone = spark.sparkContext, []
    for row in snapshots(spark, path)[keep:]:
        folder = context._jvm.org.apache.hadoop.fs.Path(_data(path, row.snapshot))
        if folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True):
            gone.append(row.snapshot)
    return gone


def _fits(row: dict, config: IngestConfig) -> bool:
    wanted = {
        "schema_version": SCHEMA_VERSION,
        "dataset_name": config.dataset_name,
        "split": config.split,
        "max_rows": config.max_rows,
        "cost_low_max_inr": config.cost_low_max_inr,
        "cost_medium_max_inr": config.cost_medium_max_inr,
    }
    if config.revision is not None:
        wanted["revision"] = config.revision
    return all(row[k] == v for k, v in wanted.items())
