"""Raw listing files arriving over time -> canonical Parquet. Stateless, so the batch projection is reused as is."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..config import IngestConfig
from ..operators.quality import corpus_metrics
from ..sources.cache import read_canonical
from ..sources.listings import canonicalize, load_listings, read_raw

_COUNTS = ["total_rows", "rows_passing_validation"]
METRICS = ", ".join(f"{c} bigint" for c in _COUNTS)


def stream_listings(
    spark: SparkSession,
    path: str,
    schema: StructType,
    config: IngestConfig = IngestConfig(),
    fmt: str = "parquet",
    max_files: int | None = None,
) -> DataFrame:
    """Streaming canonical listings. Seen and usable rows are reported per batch as the metric ``ingest``.

    ``schema`` describes the raw files and must hold the order column ``pos``. A stream has no first rows by ``pos``, so
    a config with ``max_rows`` is refused.
    """
    if config.max_rows is not None:
        raise ValueError("max_rows needs a batch read: a stream does not know its first rows")
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return canonicalize(reader.load(path), config).observe("ingest", *corpus_metrics())


def write_stream(listings: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to Parquet everything that is there now, then stop. A restart goes on where the last run ended."""
    return (
        listings.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )


def ingested(spark: SparkSession, path: str) -> tuple[int, int]:
    """(seen, usable) rows written to ``path`` so far, counted in the data: exact after any number of batches."""
    return tuple(spark.read.parquet(path).agg(*corpus_metrics()).first())


def open_listings(
    spark: SparkSession,
    path: str,
    config: IngestConfig = IngestConfig(),
    cache_path: str | None = None,
    prefer_cache: bool = False,
    streaming: bool = False,
    fmt: str = "parquet",
    max_files: int | None = None,
) -> DataFrame:
    """Canonical listings of the raw files at ``path``, from wherever they are to be had first.

    A matching cache, if wanted, comes before everything; then, with ``streaming``, the files as a stream, which writes
    no cache; else a batch read, written to the cache if one is named. A stream takes its columns from the files there
    now and needs the order column ``pos`` among them.
    """
    if cache_path and prefer_cache:
        cached = read_canonical(spark, cache_path, config)
        if cached is not None:
            return cached
    if streaming:
        return stream_listings(spark, path, read_raw(spark, path, fmt).schema, config, fmt, max_files)
    return load_listings(read_raw(spark, path, fmt), config, cache_path)


def add_batch(listings: DataFrame, batch_id: int, path: str) -> None:
    """Write a batch to ``path/batch=<id>``, then its counts to ``<path>-metrics/batch=<id>``.

    Rows are counted while they are written. A repeated batch overwrites both, so nothing is kept or counted twice.
    """
    seen = Observation()
    listings.observe(seen, *corpus_metrics()).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    row = [tuple(seen.get[c] for c in _COUNTS)]
    counts = listings.sparkSession.createDataFrame(row, METRICS).coalesce(1)
    counts.write.mode("overwrite").json(f"{path}-metrics/batch={batch_id}")


def write_counted_stream(listings: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Like ``write_stream``, but by batch and with a log of each batch's counts, so that ``counted`` reads no data."""
    return (
        listings.writeStream.foreachBatch(lambda batch, batch_id: add_batch(batch, batch_id, path))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def batch_metrics(spark: SparkSession, path: str) -> DataFrame:
    """``batch, total_rows, rows_passing_validation`` of every batch of a counted stream, from its log alone."""
    try:
        return spark.read.schema(f"{METRICS}, batch bigint").json(f"{path}-metrics").select("batch", *_COUNTS)
    except AnalysisException:
        return spark.createDataFrame([], f"batch bigint, {METRICS}")


def counted(spark: SparkSession, path: str) -> tuple[int, int]:
    """(seen, usable) rows of a counted stream so far; exact after any number of batches, repeated ones included."""
    return tuple(batch_metrics(spark, path).agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in _COUNTS]).first())
