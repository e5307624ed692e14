"""Shared by the operators: staged tables, blocks of rows inside tasks, packed integers, global ranks, components."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from uuid import uuid4

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from venuesieve.sources.staging import stage, staging_path

__all__ = ["components", "cut", "global_rank", "hash_sample", "pack", "ragged", "slices", "stage", "stage_bucketed", "table", "unpack", "unused", "whole"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(df: DataFrame) -> Column:
    """All columns of ``df`` as one column ``_row``, so that helper columns beside it cannot clash with their names."""
    return F.struct("*").alias("_row")


def unused(df: DataFrame, name: str) -> str:
    """``name``, after as many underscores as it takes to differ from every column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def stage_bucketed(df: DataFrame, key: str, label: str) -> DataFrame:
    """Like ``stage``, but bucketed: later joins on ``key`` read the table without shuffling it.

    Spark writes buckets through the catalogue only. The entry is dropped at once; the files stay.
    """
    spark = df.sparkSession
    name = f"{label}_{uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = df.write.bucketBy(buckets, key).option("path", staging_path(spark, name))
    writer.option("compression", "zstd").saveAsTable(name)
    written = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return written


def slices(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of ``rows`` at most: what a task makes of a batch is held for these rows only."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def cut(batches: Iterable[pa.RecordBatch], text: str, limit: int) -> Iterator[tuple[int, dict[str, list]]]:
    """Blocks of rows of about ``limit`` characters, each with a number that no other block of the job has.

    A text is never divided: one that is longer than ``limit`` makes a block with what came before it. The numbers
    depend on how the rows lie in partitions, so a table that holds them has to be staged before it is read twice.
    """
    number = TaskContext.get().partitionId() << 32
    held: dict[str, list] = {}
    size = 0
    for batch in slices(batches):
        columns = {name: batch.column(name).to_pylist() for name in batch.schema.names}
        start = 0
        for i, value in enumerate(columns[text]):
            size += len(value) if value else 0
            if size >= limit:
                for name, values in columns.items():
                    held.setdefault(name, []).extend(values[start : i + 1])
                yield number, held
                number, held, size, start = number + 1, {}, 0, i + 1
        for name, values in columns.items():
            held.setdefault(name, []).extend(values[start:])
    if held and held[text]:
        yield number, held


def pack(values: np.ndarray) -> bytes:
    """Unsigned 32-bit integers as compressed byte planes."""
    planes = np.ascontiguousarray(values, "<u4").view("u1").reshape(-1, 4).T
    return zstandard.compress(planes.tobytes(), 1)


def unpack(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(packed), "u1").reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices starts[i] ... starts[i] + lengths[i] - 1 for every i, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def global_rank(df: DataFrame, order: Sequence[Column], name: str, label: str) -> tuple[DataFrame, int]:
    """``df`` with its 0-based rank in ``order`` as column ``name``, and the number of rows.

    Ranges are sorted apart; what crosses the driver or one task is a count per range. Rows that tie in ``order`` get
    any of their ranks, fixed once by the staged table, so name all columns that tell rows apart. A column of ``df``
    called ``name`` is replaced.
    """
    df = df.drop(name)
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    held = stage(ranged.select(whole(ranged), F.monotonically_increasing_id().alias("_at")), f"{label}-ranges")
    part = F.shiftright("_at", 33)
    counts = held.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = stage(counts.withColumn("_before", F.coalesce(before, F.lit(0))), f"{label}-offsets")
    total = offsets.agg(F.sum("_n")).first()[0] or 0
    ranked = held.withColumn("_part", part).join(offsets, "_part")
    within = F.col("_at") - F.shiftleft(F.col("_part"), 33)
    return ranked.select("_row.*", (F.col("_before") + within).alias(name)), int(total)


def components(edges: DataFrame, label: str) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the smallest node reachable.

    Alternates two contractions until the edges rest: every neighbour above a node is hung on the node's smallest
    neighbour, then every neighbour below it. Minima are pre-aggregated, so a hub costs no task more than its rows in
    a join that may be split; nothing but a count and a checksum reaches the driver.
    """
    edge = F.struct(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    now = edges.select(edge.alias("e")).select("e.*").where("u <> v").distinct()
    now, seen = stage(now, f"{label}-edges"), None
    while True:
        state = _fingerprint(now)
        if state == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        seen = state
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stage(large.where("u <> v").distinct(), f"{label}-large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        now = stage(small, f"{label}-small")


def _fingerprint(edges: DataFrame) -> tuple:
    mark = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    return tuple(edges.agg(F.count("*"), mark).first())


def hash_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """At most ``n`` rows of ``df``, the same ones on every run: those whose keys hash lowest.

    Only about 1.2 * n rows are sorted, as a threshold on the hash comes first. For fitting a model on a bounded
    sample; nothing else may use it.
    """
    total = df.count()
    mark = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 40))
    if total > n:
        share = min(1.0, 1.2 * n / total + 100 / total)
        df = df.where(mark < int(share * (1 << 40)))
    return df.withColumn("_mark", mark).orderBy("_mark", key).limit(n).drop("_mark")
