"""Profiles given as values: the same results as the plain loop, from two scans."""

import random

import pytest

from venuesieve import CANONICAL, SearchConfig
from venuesieve.plans.few import MOST, FewProfiles, Ladder, Profile
from venuesieve.plans.recommend import ITEM_COLUMNS, Recommender

from .test_search import FOODS, PREFS, expected, ladder_of, random_rows


def random_profiles(rng, n):
    return [
        Profile(
            i,
            rng.choice([1, 100, 300, 600, 1000, 2600, 1_000_000]),
            rng.choice([0.0, 2.5, 2.6, 3.0, 4.2, 5.0]),
            rng.choice([None, "Bangalore", "Goa", "Mg Road", "Nowhere"]),
            tuple(rng.sample([*FOODS, "none such"], rng.randint(0, 3))),
            rng.choice([None, 1, 3, 12]),
        )
        for i in range(n)
    ]


def as_row(p):
    return (p.pref_id, p.location, p.max_cost_for_two_inr, list(p.cuisines), p.min_rating, "", p.top_k)


CONFIGS = [
    SearchConfig(),
    SearchConfig(k_min=1, max_candidates=3, budget_relax_ceiling_inr=2500),
    SearchConfig(k_min=30, rating_relax_step=0.3, budget_relax_step_inr=170, budget_relax_ceiling_inr=1200),
    SearchConfig(k_min=0, budget_relax_step_inr=0, max_candidates=0),
]


@pytest.mark.parametrize("seed, cfg", list(enumerate(CONFIGS)))
def test_equals_plain_loop(spark, seed, cfg):
    rng = random.Random(seed)
    rows, profiles = random_rows(rng, 120), random_profiles(rng, 12)
    listings = spark.createDataFrame(rows, CANONICAL).repartition(3)
    few = FewProfiles(listings, profiles, cfg)
    lean = FewProfiles(listings, profiles, cfg)
    report = {r.pref_id: r for r in few.report().collect()}
    assert lean.stops == [report[p.pref_id].stop for p in profiles]
    found = {}
    for r in lean.candidates().orderBy("pref_id", "cand_pos").collect():
        found.setdefault(r.pref_id, []).append((r.cand_pos, r.pos))
    for p in profiles:
        labels, counts, best = expected(as_row(p), rows, cfg)
        r = report[p.pref_id]
        assert r.relaxations == labels and r.stop == len(labels), p
        left = [r.total_after_location, r.total_after_cuisine, r.total_after_budget, r.total_after_rating]
        assert left == counts and r.truncated == (counts[3] > cfg.max_candidates), p
        assert found.get(p.pref_id, []) == list(enumerate(best, 1)), p


def test_ladder_equals_plain_loop():
    rng = random.Random(7)
    for cfg in CONFIGS:
        for p in random_profiles(rng, 40):
            ladder, plain = Ladder(p, cfg), ladder_of(as_row(p), cfg)
            assert ladder.steps == len(plain)
            assert ladder.labels(ladder.steps - 1) == [s[0] for s in plain[1:]]
            for i, (_, place, wanted, cap, floor) in enumerate(plain):
                got = ladder.at(i)
                assert (got.location, list(got.cuisines), got.cap, got.min_rating) == (place, wanted, cap, floor)


def test_equals_batch(spark):
    rng = random.Random(11)
    listings = spark.createDataFrame(random_rows(rng, 150), CANONICAL)
    profiles = random_profiles(rng, 9)
    few = FewProfiles(listings, profiles)
    batch = Recommender(spark.createDataFrame([as_row(p) for p in profiles], PREFS), listings)
    assert few.items().columns == list(ITEM_COLUMNS)
    assert sorted(map(repr, few.items().collect())) == sorted(map(repr, batch.items().select(*ITEM_COLUMNS).collect()))


def test_two_scans_with_pushed_filters(spark, tmp_path, capsys):
    spark.createDataFrame(random_rows(random.Random(1), 50), CANONICAL).write.parquet(str(tmp_path / "c"))
    listings = spark.read.schema(CANONICAL).parquet(str(tmp_path / "c"))
    few = FewProfiles(listings, [Profile(1, 600, 4.0, "Goa", ("thai", "an"), 4)], SearchConfig(k_min=1))
    items = few.items()
    items.explain("formatted")
    plan = capsys.readouterr().out
    assert plan.count("Scan parquet") == 2 and "NestedLoop" not in plan and "Join" not in plan  # tree and details
    pushed = plan[plan.index("PushedFilters") :].split("\n")[0]
    assert "LessThanOrEqual(cost_for_two,600)" in pushed and "GreaterThanOrEqual(rating,4.0)" in pushed


def test_corner_cases(spark):
    empty = spark.createDataFrame([], CANONICAL)
    few = FewProfiles(empty, [Profile(4, 500, 3.0)])
    assert few.items().collect() == []
    (row,) = few.report().collect()
    assert (row.total_after_location, row.total_after_rating, row.truncated) == (0, 0, False)
    assert row.stop == few.ladders[0].steps - 1
    for wrong in ([], [Profile(i, 1, 0.0) for i in range(MOST + 1)], [Profile(1, 1, 0.0)] * 2):
        with pytest.raises(ValueError):
            FewProfiles(empty, wrong)
