"""Preference profiles arriving over time, answered per micro-batch against the corpus in force."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import AnswerConfig, IngestConfig, SearchConfig
from ..operators.prefs import split_preferences
from ..operators.search import Corpus
from ..plans.recommend import Recommender
from ..sources.cache import newest, read_canonical
from ..sources.staging import scratch, stage, together


@dataclass
class LiveCorpus:
    """The newest snapshot of a canonical cache, staged anew only when another one has been published."""

    spark: SparkSession
    cache_path: str
    config: IngestConfig = IngestConfig()
    snapshot: str | None = field(default=None, init=False)
    corpus: Corpus | None = field(default=None, init=False)

    def now(self) -> tuple[str, Corpus]:
        found = newest(self.spark, self.cache_path, self.config)
        if found is None:
            raise ValueError(f"{self.cache_path} has no snapshot for this configuration")
        if found != self.snapshot:
            self.corpus = Corpus(read_canonical(self.spark, self.cache_path, self.config, found))
            self.snapshot = found
        return self.snapshot, self.corpus


def recommend_stream(
    raw_prefs: DataFrame,
    listings: DataFrame | LiveCorpus,
    path: str,
    checkpoint: str,
    search_config: SearchConfig = SearchConfig(),
    answer_config: AnswerConfig = AnswerConfig(),
) -> StreamingQuery:
    """Write each batch's recommendations to ``path/batch=<id>``, the profiles that break a rule to
    ``<path>-rejected/batch=<id>`` and the report of all others, those without candidates included, to
    ``<path>-report/batch=<id>``. A repeated batch overwrites its own folders; what a batch stages is deleted when the
    batch is written.

    A table of listings is staged once, at the start. With a ``LiveCorpus`` every batch is answered from the snapshot
    that is the newest when it begins, and a column ``snapshot`` of items and report names it.
    """
    fixed = None if isinstance(listings, LiveCorpus) else Corpus(listings)

    def answer(batch: DataFrame, batch_id: int) -> None:
        name, corpus = (None, fixed) if fixed else listings.now()
        spark = batch.sparkSession

        def write(table: DataFrame, where: str) -> None:
            if name and where != "-rejected":
                table = table.withColumn("snapshot", F.lit(name))
            table.write.mode("overwrite").parquet(f"{path}{where}/batch={batch_id}")

        with scratch(spark):
            # A batch of few files would be few tasks, each time it is read.
            spread = stage(batch.repartition(spark.sparkContext.defaultParallelism), "batch")
            usable, rejected = split_preferences(spread)
            result = Recommender(usable, corpus, None, search_config, answer_config)
            together(spark, lambda: write(rejected, "-rejected"), lambda: result.search.stops())
            together(spark, lambda: write(result.items(), ""), lambda: write(result.report(), "-report"))

    return (
        raw_prefs.writeStream.foreachBatch(answer)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
