"""Completions that survive: asked once per prompt, a few at a time, again after a failure, and logged as they come."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.staging import stage
from .responses import Asking

LOG = "digest string, raw string, error string, calls int, model string, asked_at timestamp"
_ASKED = ["system", "user", "model", "temperature", "max_tokens"]


def prompt_digest() -> Column:
    """Equal for prompts that ask the same of the same model."""
    return F.sha2(F.to_json(F.struct(*_ASKED), {"ignoreNullFields": "false"}), 256)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """All entries of the log; none if there is no log yet."""
    try:
        return spark.read.schema(LOG).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], LOG)


def latest(log: DataFrame) -> DataFrame:
    """One entry per digest: an answer if there is one, else the last failure. ``calls`` counts all calls."""
    entry = F.struct("raw", "error", "model")
    best = F.max_by(entry, F.struct(F.col("raw").isNotNull(), "asked_at")).alias("entry")
    found = log.groupBy("digest").agg(best, F.sum("calls").alias("calls"))
    return found.select("digest", "entry.*", "calls")


def complete_logged(
    prompts: DataFrame,
    answer: Callable[..., str],
    path: str,
    waves: int = 4,
    tasks: int | None = None,
    asking: Asking = Asking(attempts=3, at_once=8),
) -> DataFrame:
    """``pref_id, raw, error, model, calls`` for every prompt, through a log of answers at ``path``.

    Prompts that the log holds an answer for are not asked; equal prompts are asked once. The others are asked in
    ``waves``, each a job that adds its answers to the log when it ends, so that a run that breaks off, or a lost executor,
    costs the calls of the running wave's tasks and no more, and the next run asks what is unanswered or failed. Each
    of ``tasks`` (default: the cluster's cores) has ``asking.at_once`` calls open, so ``tasks * at_once`` bounds the load
    on the model. A prompt whose last attempt fails has ``raw`` NULL and the reason in ``error``. Two runs on one log at
    a time may ask the same prompt twice; the log stays valid.
    """
    spark = prompts.sparkSession
    tasks = tasks or spark.sparkContext.defaultParallelism
    asked = stage(prompts.select("pref_id", *_ASKED, prompt_digest().alias("digest")), "prompts")
    answered = read_log(spark, path).where(F.col("raw").isNotNull()).select("digest")
    fresh = asked.dropDuplicates(["digest"]).join(answered, "digest", "left_anti")
    todo = stage(fresh.withColumn("wave", F.pmod(F.xxhash64("digest"), F.lit(waves))), "unanswered")
    for (wave,) in sorted(todo.select("wave").distinct().collect()):
        mine = todo.where(F.col("wave") == wave).drop("pref_id").repartition(tasks, "digest")
        told = mine.mapInPandas(asking.batches(answer, "digest"), "digest string, raw string, error string, calls int, model string")
        told.withColumn("asked_at", F.current_timestamp()).write.mode("append").parquet(path)
    return asked.select("pref_id", "digest").join(latest(read_log(spark, path)), "digest", "left").drop("digest")
