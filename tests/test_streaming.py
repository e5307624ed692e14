import shutil
from pathlib import Path

import pytest

from venuesieve import CANONICAL
from venuesieve.config import IngestConfig
from venuesieve.sources import canonicalize, publish, read_canonical
from venuesieve.sources.staging import scratch, stage, together
from venuesieve.streaming import recommend
from venuesieve.streaming.ingest import (
    add_batch,
    batch_metrics,
    counted,
    ingested,
    open_listings,
    stream_listings,
    write_counted_stream,
    write_stream,
)
from venuesieve.streaming.recommend import LiveCorpus

from .test_profiles_and_sources import COLUMNS, ROWS
from .test_search import listing


def test_stream_equals_batch_and_goes_on_after_a_restart(spark, tmp_path):
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    raw = spark.createDataFrame(ROWS, COLUMNS)
    raw.where("pos <= 3").write.parquet(source)

    def run():
        write_stream(stream_listings(spark, source, raw.schema, max_files=1), target, state).awaitTermination()
        return ingested(spark, target)

    assert run() == (3, 2)
    raw.where("pos > 3").write.mode("append").parquet(source)
    assert run() == (4, 2)
    assert sorted(spark.read.parquet(target).collect()) == sorted(canonicalize(raw).collect())


def test_counts_do_not_depend_on_kept_progress(spark, tmp_path):
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    raw = spark.createDataFrame(ROWS * 3, COLUMNS).repartition(6)
    raw.write.parquet(source)
    kept = "spark.sql.streaming.numRecentProgressUpdates"
    spark.conf.set(kept, 2)
    try:
        write_stream(stream_listings(spark, source, raw.schema, max_files=1), target, state).awaitTermination()
    finally:
        spark.conf.unset(kept)
    assert ingested(spark, target)[0] == 3 * len(ROWS)


def test_stream_refuses_a_row_cap(spark):
    with pytest.raises(ValueError, match="max_rows"):
        stream_listings(spark, "/nowhere", spark.range(1).schema, IngestConfig(max_rows=5))


def test_scratch_tables_go(spark):
    with scratch(spark) as folder:
        together(spark, lambda: stage(spark.range(3), "a"), lambda: stage(spark.range(2), "b"))
        assert len(list(Path(folder).iterdir())) == 2
    kept = stage(spark.range(4), "c")
    assert not Path(folder).exists() and kept.count() == 4


def test_profile_stream_stages_the_corpus_once(spark, tmp_path, monkeypatch):
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = (
        "pref_id bigint, location string, budget_for_two_inr string, budget_max_inr string, cuisines array<string>, "
        "min_rating double, extras string, top_k int"
    )
    asked = [(1, None, "900", None, ["thai"], 0.0, "", 2), (2, None, None, None, [], 0.0, "", None)]
    asked += [(3, None, "900", None, ["sushi"], 0.0, "", None)]
    raw = spark.createDataFrame(asked, schema).repartition(3, "pref_id")
    raw.write.parquet(source)
    listings = spark.createDataFrame(
        [listing(i, f"Place {i}", cuisines=["thai"], rating=4.0, cost=100 * i) for i in range(1, 9)], CANONICAL
    )
    built = []

    class Watched(recommend.Corpus):
        def __init__(self, rows):
            built.append(rows)
            super().__init__(rows)

    monkeypatch.setattr(recommend, "Corpus", Watched)
    live = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 1).parquet(source)
    recommend.recommend_stream(live, listings, target, state).awaitTermination()
    assert len(built) == 1
    assert [(r.pref_id, r["rank"]) for r in spark.read.parquet(target).orderBy("rank").collect()] == [(1, 1), (1, 2)]
    assert [r.pref_id for r in spark.read.parquet(f"{target}-rejected").collect()] == [2]
    report = {r.pref_id: r.model_id for r in spark.read.parquet(f"{target}-report").collect()}
    assert report == {1: "deterministic_fallback", 3: "none"}


def test_profiles_of_one_file_are_many_tasks(spark, tmp_path, monkeypatch):
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "pref_id bigint, budget_for_two_inr string, cuisines array<string>, min_rating double"
    spark.createDataFrame([(i, "900", [], 0.0) for i in range(400)], schema).coalesce(1).write.parquet(source)
    split, parts = recommend.split_preferences, []

    def watched(batch):
        parts.append(batch.rdd.getNumPartitions())
        return split(batch)

    monkeypatch.setattr(recommend, "split_preferences", watched)
    listings = spark.createDataFrame([listing(1, "Place 1", rating=4.0, cost=100)], CANONICAL)
    live = spark.readStream.schema(schema).parquet(source)
    recommend.recommend_stream(live, listings, target, state).awaitTermination()
    assert parts == [spark.sparkContext.defaultParallelism]
    assert spark.read.parquet(target).count() == 400


def test_cache_comes_before_stream_and_stream_before_batch(spark, tmp_path):
    source, cache, target, state = (str(tmp_path / n) for n in ("in", "cache", "out", "state"))
    raw = spark.createDataFrame(ROWS, COLUMNS)
    raw.write.parquet(source)
    live = open_listings(spark, source, cache_path=cache, prefer_cache=True, streaming=True)
    assert live.isStreaming and read_canonical(spark, cache) is None
    write_stream(live, target, state).awaitTermination()
    batch = open_listings(spark, source, cache_path=cache, prefer_cache=True)
    assert sorted(batch.collect()) == sorted(spark.read.parquet(target).collect()) == sorted(canonicalize(raw).collect())
    cached = open_listings(spark, source, cache_path=cache, prefer_cache=True, streaming=True)
    assert not cached.isStreaming and cached.count() == 4
    other = IngestConfig(cost_low_max_inr=1)
    assert open_listings(spark, source, other, cache, prefer_cache=True, streaming=True).isStreaming


def test_batches_are_counted_once(spark, tmp_path):
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    raw = spark.createDataFrame(ROWS, COLUMNS).repartitionByRange(2, "pos")
    raw.write.parquet(source)
    assert counted(spark, target) == (0, 0)

    def run():
        write_counted_stream(stream_listings(spark, source, raw.schema, max_files=1), target, state).awaitTermination()
        return counted(spark, target)

    assert run() == run() == (4, 2)
    assert batch_metrics(spark, target).count() == 2
    first = stage(spark.read.parquet(f"{target}/batch=0"), "again")
    add_batch(first, 0, target)
    assert counted(spark, target) == (4, 2)
    assert sorted(spark.read.parquet(target).drop("batch").collect()) == sorted(canonicalize(raw).collect())
    add_batch(first.limit(0), 7, target)
    assert counted(spark, target) == (4, 2) and batch_metrics(spark, target).count() == 3


def test_counts_come_from_the_log_alone(spark, tmp_path):
    target = str(tmp_path / "out")
    add_batch(canonicalize(spark.createDataFrame(ROWS, COLUMNS)), 0, target)
    shutil.rmtree(target)
    assert counted(spark, target) == (4, 2)


def test_profile_stream_takes_the_newest_snapshot(spark, tmp_path):
    source, target, state, cache = (str(tmp_path / n) for n in ("in", "out", "state", "cache"))
    schema = "pref_id bigint, budget_for_two_inr string, cuisines array<string>, min_rating double"
    listings = [listing(i, f"Place {i}", cuisines=["thai"], rating=4.0, cost=100) for i in range(1, 9)]
    corpus, used = LiveCorpus(spark, cache), []
    with pytest.raises(ValueError, match="no snapshot"):
        corpus.now()
    for n, size in enumerate((2, 8)):
        used.append(publish(spark.createDataFrame(listings[:size], CANONICAL), cache).snapshot)
        spark.createDataFrame([(n, "900", ["thai"], 0.0)], schema).coalesce(1).write.mode("append").parquet(source)
        live = spark.readStream.schema(schema).parquet(source)
        recommend.recommend_stream(live, corpus, target, state).awaitTermination()
        staged = corpus.corpus
        assert corpus.now() == (used[n], staged)
    got = spark.read.parquet(target).groupBy("pref_id", "snapshot").count().collect()
    assert {(r.pref_id, r.snapshot, r["count"]) for r in got} == {(0, used[0], 2), (1, used[1], 8)}
    assert {r.snapshot for r in spark.read.parquet(f"{target}-report").collect()} == set(used)
