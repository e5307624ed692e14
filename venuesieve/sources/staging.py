"""Intermediate tables on shared storage.

A staged table is written once as Parquet and read back. That cuts the lineage, survives lost executors, lets every
reader prune columns, and gives the planner the true size of the table: a later join broadcasts it only when that
size is below ``spark.sql.autoBroadcastJoinThreshold`` and shuffles otherwise.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from uuid import uuid4

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

_CONF = "spark.checkpoint.dir"
_SCRATCH = "venuesieve.scratch"
_local_roots: dict[str, str] = {}


def staging_root(spark: SparkSession) -> str:
    """Folder for this application's staged tables, below the folder the cluster names."""
    app = spark.sparkContext.applicationId
    shared = spark.conf.get(_CONF, None)
    if shared:
        return f"{shared.rstrip('/')}/venuesieve-{app}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {_CONF} to a folder all executors can reach")
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="venuesieve-")
    return _local_roots[app]


def staging_path(spark: SparkSession, name: str) -> str:
    """Where a table ``name`` belongs, inside ``scratch`` if that is open."""
    scratch = spark.sparkContext.getLocalProperty(_SCRATCH)
    return f"{staging_root(spark)}/{scratch + '/' if scratch else ''}{name}"


def stage(df: DataFrame, label: str) -> DataFrame:
    spark = df.sparkSession
    path = staging_path(spark, f"{label}-{uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, folder: str) -> None:
    """Delete a folder that will not be read again."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """Tables staged inside, also by ``together``, lie in a folder of their own that is deleted at the end.

    For work that repeats, as in a stream: nothing drawn from those tables may be read afterwards.
    """
    context, name = spark.sparkContext, f"scratch-{uuid4().hex}"
    before = context.getLocalProperty(_SCRATCH)
    context.setLocalProperty(_SCRATCH, name)
    folder = f"{staging_root(spark)}/{name}"
    try:
        yield folder
    finally:
        context.setLocalProperty(_SCRATCH, before)
        discard(spark, folder)


def together(spark: SparkSession, *steps: Callable) -> list:
    """Run independent steps at the same time; the cluster fills up while one of them plans or ends."""
    with ThreadPoolExecutor(len(steps)) as pool:
        running = [pool.submit(inheritable_thread_target(spark)(step)) for step in steps]
        return [r.result() for r in running]
