"""Work that is to be done once: for an answer, for profiles that ask the same, for a listing that no cap can bring up."""

import json
from pathlib import Path

from pyspark.sql import functions as F

from venuesieve import CANONICAL, SearchConfig
from venuesieve.operators import search as search_module
from venuesieve.operators.responses import parse_entries, read_answers
from venuesieve.operators.search import ProfileSearch
from venuesieve.plans import recommend
from venuesieve.plans.reuse import ResultStore
from venuesieve.sources import publish, staging

from workload import queries

from .test_search import PREFS, expected, listing, profile


def test_an_answer_is_parsed_once(spark):
    raws = [json.dumps({"recommendations": [{"rank": n, "restaurant_id": f"v{n}"} for n in range(3)]}), "no JSON", None]
    answers = spark.createDataFrame(list(enumerate(raws)), "pref_id bigint, raw string")
    entries = parse_entries(read_answers(answers))
    plan = entries._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson(") == 1
    assert sorted((r.pref_id, r.rank, r.restaurant_id) for r in entries.collect()) == [(0, n, f"v{n}") for n in range(3)]


def test_kinds_of_answers_and_entries(spark):
    raws = [
        "{}",
        "null",
        '"{}"',
        "true",
        '{"a(b": 1, "recommendations": "[]"}',
        '{"recommendations": [{"rank": 1e400, "restaurant_id": "a"}]}',
        '{"recommendations": [{"rank": "Infinity", "restaurant_id": "true"}, [1], null, 7, {"rank": 2.5, "restaurant_id": true}]}',
        '{"summary": false, "recommendations": [{"restaurant_id": {"b(": [1]}}]}',
    ]
    got = read_answers(spark.createDataFrame(list(enumerate(raws)), "pref_id bigint, raw string"))
    said = {r.pref_id: (r.ok, r.summary) for r in got.select("pref_id", "ok", "summary").collect()}
    assert [said[i][0] for i in (0, 1, 2, 3, 4, 6, 7)] == [True, False, False, False, False, True, True]
    assert said[7][1] == "False"
    entries = sorted((r.pref_id, r.arr_pos, r.rank, r.restaurant_id) for r in parse_entries(got).collect() if r.pref_id != 5)
    assert entries == [(6, 0, 1, "true"), (6, 4, 2, "True"), (7, 0, 1, '{"b(":[1]}')]


def test_candidates_are_kept_by_request(spark, monkeypatch):
    labels = []

    def noted(df, label):
        labels.append(label)
        return staging.stage(df, label)

    monkeypatch.setattr(recommend, "stage", noted)
    monkeypatch.setattr(search_module, "stage", noted)
    listings = spark.createDataFrame([listing(i, f'N "{i}"', rating=4.0, cost=100 + i) for i in range(8)], CANONICAL)
    prefs = spark.createDataFrame([profile(i, None, 200, ["indian"] if i % 2 else []) for i in range(20)], PREFS)
    plain = recommend.Recommender(prefs, listings)
    assert plain.items().groupBy("pref_id").count().where("count = 8").count() == 20
    told = {r.pref_id: json.loads(r.user) for r in plain.prompts().collect()}
    assert "candidates" not in labels and plain.search.found.count() == 2 * 8
    assert [c["name"] for c in told[7]["candidates"]] == [f'N "{i}"' for i in range(8)]
    assert list(told[0]) == ["user_preferences", "relaxed", "candidates", "instructions"]
    assert told[7]["user_preferences"]["cuisine_preferences"] == "indian" and told[7]["relaxed"] == []


def test_listings_that_answer_no_question_are_dropped_early(spark, monkeypatch):
    rows = [listing(i, rating=5.0 - i % 40 / 10, cost=100 + i, votes=i % 7) for i in range(600)]
    rows += [listing(1000 + i, hood="", rating=None if i % 5 == 0 else 4.0, cost=50 + 9 * i) for i in range(60)]
    listings = spark.createDataFrame(rows, CANONICAL)
    asked = [profile(i, ("indiranagar", None)[i % 2], 60 + 31 * i, (), i % 11 / 2) for i in range(24)]
    cfg, reached = SearchConfig(max_candidates=5), []
    top = search_module.top_within_cap

    def counted(rows, *rest):
        reached.append(rows.count())
        return top(rows, *rest)

    monkeypatch.setattr(search_module, "top_within_cap", counted)
    search = ProfileSearch(spark.createDataFrame(asked, PREFS), listings, cfg)
    got = {}
    for r in search.candidates().orderBy("pref_id", "cand_pos").collect():
        got.setdefault(r.pref_id, []).append(r.pos)
    for p in asked:
        assert got.get(p[0], []) == expected(p, rows, cfg)[-1], p
    # Twice the 600 of the place, as the scope of all listings holds them too, and twice the 60 without a neighborhood.
    assert reached[0] < (2 * 600 + 2 * 48) / 3


def test_a_corpus_is_counted_once_and_places_drop_listings_early(spark, monkeypatch):
    rows = [listing(i, hood="Goa" if i % 3 else "Goa Road", rating=5.0 - i % 40 / 10, cost=100 + i) for i in range(600)]
    asked = [profile(i, "goa", 60 + 31 * i, (), i % 11 / 2) for i in range(24)]
    labels, trimmed = [], []
    first = search_module.keep_first

    def noted(df, label):
        labels.append(label)
        return staging.stage(df, label)

    def counted(rows, partition, *rest):
        if "place_city" in partition:
            trimmed.append(rows.count())
        return first(rows, partition, *rest)

    monkeypatch.setattr(search_module, "stage", noted)
    monkeypatch.setattr(search_module, "keep_first", counted)
    corpus = search_module.Corpus(spark.createDataFrame(rows, CANONICAL))
    for batch in (asked[:12], asked[12:]):
        search = ProfileSearch(spark.createDataFrame(batch, PREFS), corpus, SearchConfig(max_candidates=5))
        got = {}
        for r in search.candidates().orderBy("pref_id", "cand_pos").collect():
            got.setdefault(r.pref_id, []).append(r.pos)
        for p in batch:
            assert got.get(p[0], []) == expected(p, rows, search.cfg)[-1], p
    assert labels.count("counts") == 1 and labels.count("scoped") == 2
    assert len(trimmed) == 2 and max(trimmed) < 600 / 2


def test_raw_text_is_packed_and_deleted_when_read(spark, monkeypatch):
    seen = []

    def noted(session, path, fmt, **options):
        files = session.read.format("binaryFile").load(path).select("path").collect()
        seen.append([f.path for f in files])
        return split(session, path, fmt, **options)

    split = queries.split_raw
    monkeypatch.setattr(queries, "split_raw", noted)
    monkeypatch.setattr(queries, "_RAW_ROWS", 500)
    assert queries.quarantine(spark, "/root/testdata/sf0.001").count() == 10
    root = Path(staging.staging_root(spark))
    for files, ending in zip(seen, (".csv.gz", ".txt.gz"), strict=True):
        assert len(files) >= 5 and all(f.endswith(ending) for f in files)
        assert not Path(files[0].removeprefix("file:")).exists()
    assert not list(root.rglob("raw-broken-*"))


def test_a_result_store_stages_a_snapshot_once(spark, tmp_path, monkeypatch):
    labels = []

    def noted(df, label):
        labels.append(label)
        return staging.stage(df, label)

    monkeypatch.setattr(search_module, "stage", noted)
    cache, store = str(tmp_path / "cache"), ResultStore(str(tmp_path / "results"))
    rows = [listing(i, f"Place {i}", rating=4.0, cost=100 + i) for i in range(8)]

    def found(*profiles):
        got = store.recommend(spark, spark.createDataFrame(profiles, PREFS), cache)
        return got.searched.count(), sorted({r.pos for r in got.items.select(F.substring("name", 7, 2).cast("int").alias("pos")).collect()})

    publish(spark.createDataFrame(rows[:6], CANONICAL), cache)
    with staging.scratch(spark):
        assert found(profile(1, cap=200)) == (1, [0, 1, 2, 3, 4, 5])
    assert found(profile(1, cap=200), profile(2, cap=300)) == (1, [0, 1, 2, 3, 4, 5])
    assert labels.count("lean") == 2
    assert found(profile(3, cap=400)) == (1, [0, 1, 2, 3, 4, 5]) and labels.count("lean") == 2
    publish(spark.createDataFrame(rows, CANONICAL), cache)
    assert found(profile(3, cap=400)) == (1, [0, 1, 2, 3, 4, 5, 6, 7]) and labels.count("lean") == 3
