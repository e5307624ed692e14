"""Expectations as rows, and results kept between runs."""

import random

import pytest
from pyspark.sql import functions as F

from venuesieve import CANONICAL, SearchConfig
from venuesieve.operators import expectations
from venuesieve.operators.expectations import SCHEMA, facts, violations
from venuesieve.operators.search import ProfileSearch
from venuesieve.plans import reuse
from venuesieve.plans.recommend import ITEM_COLUMNS, Recommender
from venuesieve.plans.reuse import ResultStore
from venuesieve.sources import publish

from .test_search import PREFS, expected, listing, profile, random_rows


def test_violations(spark):
    told = spark.createDataFrame([(1, "n", 5.0), (2, "n", 7.0), (2, "m", 1.0)], "pref_id bigint, fact string, value double")
    rows = [
        (1, "n", ">=", 5.0, None, True),
        (1, "n", "<=", 4.0, None, False),
        (1, "n", "=", 5.0, None, True),
        (2, "n", ">=", None, 1, True),
        (1, "n", ">=", None, 2, False),
        (1, "n", ">=", -2.0, 2, True),
        (1, "m", "<=", 9.0, None, False),
        (3, "n", "<=", 9.0, None, False),
        (1, "n", ">=", 0.0, 3, False),
        (1, "n", ">=", None, None, False),
        (1, "n", "~", 5.0, None, False),
        (None, "n", ">=", 0.0, None, False),
        (1, "n", "<=", 4.0, None, False),
    ]
    got = violations(spark.createDataFrame([r[:5] for r in rows], SCHEMA), told).collect()
    assert sorted(repr(tuple(r[:5])) for r in got) == sorted(repr(r[:5]) for r in rows if not r[5])
    assert violations(spark.createDataFrame([], SCHEMA), told).collect() == []


def test_facts(spark):
    rng = random.Random(5)
    rows = random_rows(rng, 80)
    profiles = [profile(1, "Goa", 900, ["thai"], 3.0), profile(2, None, 1, ["none such"], 5.0), profile(3)]
    cfg = SearchConfig(max_candidates=4)
    s = ProfileSearch(spark.createDataFrame(profiles, PREFS), spark.createDataFrame(rows, CANONICAL), cfg)
    got = {(r.pref_id, r.fact): r.value for r in facts(s.candidates(), s.report()).collect()}
    for p in profiles:
        labels, counts, best = expected(p, rows, cfg)
        chosen = [r for r in rows if r[0] in best]
        want = dict(zip(("after_location", "after_cuisine", "after_budget", "after_rating"), counts, strict=True))
        want |= {"n_relaxations": len(labels), "n_candidates": len(best)}
        if chosen:
            want |= {"max_cost": max(r[7] for r in chosen), "min_rating": min(r[6] for r in chosen)}
        assert {f: got.get((p[0], f)) for f in expectations.FACTS if (p[0], f) in got} == want


def prefs_of(spark, rows):
    return spark.createDataFrame(rows, PREFS)


def test_store_searches_new_profiles_only(spark, tmp_path, monkeypatch):
    cache, folder = str(tmp_path / "cache"), str(tmp_path / "store")
    listings = spark.createDataFrame(random_rows(random.Random(3), 100), CANONICAL)
    publish(listings, cache)
    profiles = [profile(1, "Goa", 900, ["thai"], 3.0), profile(2), profile(3), profile(4, None, 1, ["none such"], 5.0)]
    more = [*profiles, profile(5, "Goa", 901, ["thai"], 3.0), profile(6, "Goa", 900, ["thai"], 3.0)]
    store = ResultStore(folder, SearchConfig(budget_relax_ceiling_inr=10))

    def run(rows, own=store):
        got = own.recommend(spark, prefs_of(spark, rows), cache)
        assert got.items.columns == list(ITEM_COLUMNS)
        return sorted(r.pref_id for r in got.searched.collect()), sorted(map(repr, got.items.collect()))

    assert run(profiles)[0] in ([1, 2, 4], [1, 3, 4])
    searched, items = run(more)
    plain = Recommender(prefs_of(spark, more), listings, None, store.search_config).items().select(*ITEM_COLUMNS)
    assert searched == [5] and items == sorted(map(repr, plain.collect()))

    def never(*_):
        raise AssertionError("searched again")

    with monkeypatch.context() as patched:
        patched.setattr(reuse, "Recommender", never)
        store.recommend(spark, prefs_of(spark, more), cache)
    assert run([profile(2)], ResultStore(folder, SearchConfig(k_min=1)))[0] == [2]
    publish(spark.createDataFrame([listing(999, "New", cost=5, rating=5.0)], CANONICAL), cache)
    searched, items = run([profile(2)])
    assert searched == [2] and len(items) == 1
    with pytest.raises(ValueError, match="no snapshot"):
        store.recommend(spark, prefs_of(spark, more), str(tmp_path / "nothing"))


def test_store_after_a_broken_run(spark, tmp_path):
    """Items whose digests were never written are searched again, written again and read once."""
    cache = str(tmp_path / "cache")
    listings = spark.createDataFrame(random_rows(random.Random(4), 60), CANONICAL)
    snapshot = publish(listings, cache).snapshot
    store, prefs = ResultStore(str(tmp_path / "store")), prefs_of(spark, [profile(1), profile(2, "Goa")])
    want = sorted(map(repr, store.recommend(spark, prefs, cache).items.collect()))
    known = f"{store._folder(snapshot)}/known"
    spark.read.parquet(known).limit(0).write.mode("overwrite").parquet(known)
    again = store.recommend(spark, prefs, cache)
    assert again.searched.count() == 2 and sorted(map(repr, again.items.collect())) == want
    assert store.recommend(spark, prefs.limit(0), cache).items.where(F.lit(True)).collect() == []
