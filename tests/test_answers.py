import json

import pytest

from venuesieve import CANONICAL, AnswerConfig, SearchConfig
from venuesieve.operators.prompts import answer_limits
from venuesieve.operators.reconcile import (
    WHY_FALLBACK,
    WHY_FILLED,
    WHY_PICKED,
    grounding_violations,
    reconcile,
    resolve,
)
from venuesieve.operators.responses import complete, parse_entries, read_answers
from venuesieve.plans.recommend import Recommender

from .test_search import PREFS, listing, profile


def answers(spark, raws):
    return read_answers(spark.createDataFrame(list(enumerate(raws)), "pref_id bigint, raw string"))


def recs(*entries, **rest):
    return json.dumps({"recommendations": list(entries), **rest})


def test_usable_or_not(spark):
    raws = [
        '{"summary": "Good.", "recommendations": []}',
        '```json\n{"summary": null}\n```',
        "```JSON {} ```  ",
        "[1]",
        "not json",
        "",
        None,
        '{"recommendations": {}}',
        '{"recommendations": null, "summary": 7}',
    ]
    got = {r.pref_id: (r.ok, r.summary) for r in answers(spark, raws).collect()}
    assert [got[i][0] for i in range(9)] == [True, True, True, False, False, False, False, False, True]
    assert got[0][1] == "Good." and got[1][1] is None and got[8][1] == "7"


def test_entries(spark):
    raw = recs(
        {"rank": 1.5, "restaurant_id": " a ", "explanation": " x "},
        {"rank": "2", "restaurant_id": "b", "explanation": None},
        {"rank": "1.5", "restaurant_id": "c"},
        {"restaurant_id": 7},
        "junk",
        {"rank": 1, "restaurant_id": None},
        {"rank": True, "restaurant_id": "t"},
        {"rank": [], "restaurant_id": "l"},
        {"rank": -3, "restaurant_id": "n"},
        {"restaurant_id": True, "explanation": 0},
        {"restaurant_id": "e", "explanation": True},
        {"restaurant_id": "f", "explanation": []},
    )
    rows = parse_entries(answers(spark, [raw])).orderBy("rank", "arr_pos").collect()
    assert [(r.restaurant_id, r.rank, r.explanation) for r in rows] == [
        ("n", -3, ""),
        ("a", 1, "x"),
        ("t", 1, ""),
        ("b", 2, ""),
        ("c", 3, ""),
        ("7", 4, ""),
        ("l", 8, ""),
        ("True", 10, ""),
        ("e", 11, "True"),
        ("f", 12, ""),
    ]


def test_endless_rank_spoils_the_answer(spark):
    raws = ['{"recommendations": [{"rank": 1e400, "restaurant_id": %s}]}' % ref for ref in ('"a"', "null")]
    assert {r.pref_id: r.ok for r in answers(spark, raws).collect()} == {0: False, 1: True}


def test_strangers_are_seen(spark, candidates):
    raw = recs({"restaurant_id": "i5"}, {"restaurant_id": "nobody"}, {"restaurant_id": "VENICE"})
    rows = resolve(parse_entries(answers(spark, [raw])), candidates).orderBy("arr_pos").collect()
    assert [(r.restaurant_id, r.id, r.cand_pos) for r in rows] == [("i5", "i5", 5), ("nobody", None, None), ("VENICE", "i5", 5)]


@pytest.fixture(scope="module")
def candidates(spark):
    rows = [(1, "i1", "Roma"), (2, "i2", "roma "), (3, "i1", "Other"), (4, "i4", ""), (5, "i5", "Venice")]
    return spark.createDataFrame([(0, *r) for r in rows], "pref_id bigint, cand_pos int, id string, name string")


@pytest.mark.parametrize(
    "entries, k, picked",
    [
        ([("i5", "why"), ("i2", "")], 2, [(5, "why"), (2, WHY_PICKED)]),
        # By id the last of two, by name the first; each id once; then filled up with the first of each id.
        ([("i1", "a"), ("ROMA", "b"), ("nobody", "c")], 3, [(3, "a"), (2, WHY_FILLED), (4, WHY_FILLED)]),
        ([(" venice", "v"), ("i5", "again")], 12, [(5, "v"), (1, WHY_FILLED), (2, WHY_FILLED), (4, WHY_FILLED)]),
        ([], 2, [(1, WHY_FILLED), (2, WHY_FILLED)]),
    ],
)
def test_reconcile(spark, candidates, entries, k, picked):
    raw = recs(*[{"restaurant_id": ref, "explanation": why} for ref, why in entries])
    limits = spark.createDataFrame([(0, k)], "pref_id bigint, top_k int")
    rows = reconcile(parse_entries(answers(spark, [raw])), candidates, limits).orderBy("rank").collect()
    assert [r.rank for r in rows] == list(range(1, len(rows) + 1))
    assert [(r.cand_pos, r.explanation) for r in rows] == picked


def test_grounding_check_sees_strangers(spark, candidates):
    items = spark.createDataFrame([(0, "i1"), (0, "zz"), (1, "i1")], "pref_id bigint, id string")
    assert sorted(grounding_violations(items, candidates).collect()) == [(0, "zz"), (1, "i1")]


def test_limits(spark):
    rows = spark.createDataFrame([(1, None), (2, 12), (3, 3)], "pref_id bigint, top_k int")
    got = {r.pref_id: (r.top_k, r.max_tokens) for r in answer_limits(rows).collect()}
    assert got == {1: (10, 1200), 2: (12, 1370), 3: (3, 1200)}
    assert answer_limits(rows, AnswerConfig(top_k=40, max_tokens=9000)).head().max_tokens == 9000


def test_whole_way(spark):
    listings = spark.createDataFrame(
        [listing(i, f"Place {i}", cuisines=["thai"], rating=3.0 + i / 10, cost=100 * i) for i in range(1, 9)], CANONICAL
    )
    prefs = spark.createDataFrame(
        [profile(1, "Indiranagar", 900, ["thai"]), profile(2, None, 900, ["thai"]), profile(3, None, 900, ["sushi"])],
        PREFS,
    )
    plain = Recommender(prefs, listings, None, SearchConfig(budget_relax_ceiling_inr=2000))
    prompt = {r.pref_id: r for r in plain.prompts().collect()}
    assert set(prompt) == {1, 2}
    body = json.loads(prompt[2].user)
    assert body["user_preferences"] == {
        "locality_or_area": "any locality",
        "max_budget_inr_for_two": 900,
        "cuisine_preferences": "thai",
        "min_rating": 0.0,
        "extras": None,
    }
    assert [c["name"] for c in body["candidates"]] == [f"Place {i}" for i in range(8, 0, -1)]
    assert "at most 10" in body["instructions"]

    def answer(messages, *, model, temperature, max_tokens):
        import json

        offered = json.loads(messages[1]["content"])
        if offered["user_preferences"]["locality_or_area"] == "any locality":
            raise RuntimeError("model is down")
        ids = [c["id"] for c in offered["candidates"]]
        return json.dumps({"summary": "Two.", "recommendations": [{"restaurant_id": ids[3]}, {"restaurant_id": ids[0]}]})

    assert (json.loads(prompt[1].user)["relaxed"], body["relaxed"]) == ([], [])
    said = complete(plain.prompts(), answer)
    assert {r.pref_id: (r.error, r.model) for r in said.collect()} == {
        1: (None, AnswerConfig().model),
        2: ("RuntimeError: model is down", AnswerConfig().model),
    }
    full = plain.with_answers(said)
    assert full.search is plain.search and full.candidates is plain.candidates
    items = {}
    for r in full.items().orderBy("pref_id", "rank").collect():
        items.setdefault(r.pref_id, []).append((r.rank, r.name, r.explanation))
    assert [n for _, n, _ in items[1]] == ["Place 5", "Place 8", "Place 7", "Place 6"] + [f"Place {i}" for i in (4, 3, 2, 1)]
    assert {e for _, _, e in items[2]} == {WHY_FALLBACK} and 3 not in items
    report = {r.pref_id: r for r in full.report().collect()}
    assert (report[1].summary, report[1].fallback_used, report[1].model_id) == ("Two.", False, AnswerConfig().model)
    assert (report[2].model_id, report[2].fallback_used) == ("deterministic_fallback", True)
    assert (report[3].model_id, report[3].total_after_rating) == ("none", 0)
    assert full.violations().count() == 0
    assert [r.id is None for r in full.named().collect()] == [False, False]
