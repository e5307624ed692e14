import pytest
from pyspark.sql import functions as F

from venuesieve import PREFS, CorpusTooSmallError, IngestConfig, ListingSchemaError, column_mapping
from venuesieve.operators import match, quality
from venuesieve.operators.prefs import split_preferences, validate_preferences
from venuesieve.schemas import COST, RAW
from venuesieve.operators.search import _lean
from venuesieve.sources import (
    canonicalize,
    load_listings,
    missing_columns,
    prune,
    publish,
    read_canonical,
    read_raw,
    snapshots,
    write_canonical,
)
from venuesieve.sources.listings import first_rows

ROWS = [
    (1, " jalsa ", "bengaluru", "Banashankari", "North Indian, Mughlai", "4.1/5", "800", "775", "942, MG Road"),
    (2, "spice elephant", "bangalore", None, "Chinese", "NEW", None, "x", None),
    (3, "", "Delhi", "Hauz Khas", "", "3.9", "1,500", None, ""),
    (4, "nowhere", "", "hauz khas", "Thai", "-", "90", "2", ""),
]
COLUMNS = f"pos bigint, name string, `listed_in(city)` string, location string, cuisines string, rate string, `{COST}` string, votes string, address string"


@pytest.fixture(scope="module")
def raw(spark):
    return spark.createDataFrame(ROWS, COLUMNS)


def test_projection(raw):
    first, second, third, fourth = canonicalize(raw).orderBy("pos").collect()
    assert (first.name, first.city, first.neighborhood) == ("Jalsa", "Bangalore", "Banashankari")
    assert first.cuisines == ["north indian", "mughlai"]
    assert (first.rating, first.cost_for_two, first.cost_tier, first.votes) == (4.1, 800, "medium", 775)
    assert first.raw_fields.address == "942, MG Road" and first.raw_fields.url is None
    assert (second.rating, second.cost_for_two, second.cost_tier, second.votes) == (None, None, "medium", None)
    assert second.neighborhood == "" and third.name == "" and fourth.city == ""
    assert third.cost_tier == "high" and fourth.cost_tier == "low"


def test_column_contract(spark, raw):
    assert "url" in missing_columns(raw)
    with pytest.raises(ListingSchemaError):
        canonicalize(raw, IngestConfig(strict_columns=True))
    full = spark.createDataFrame([], RAW).withColumn("pos", F.lit(1))
    assert canonicalize(full, IngestConfig(strict_columns=True)).count() == 0
    report = {r.column_name: (r.present, r.n_values) for r in quality.column_report(raw).collect()}
    assert report["location"] == (True, 3) and report["url"] == (False, 0) and len(report) == 17
    assert column_mapping(spark).count() == 17


def test_corpus_checks(raw):
    listings = canonicalize(raw)
    assert quality.validate_corpus(listings, 2)["rows_passing_validation"] == 2
    with pytest.raises(CorpusTooSmallError):
        quality.validate_corpus(listings, 3)
    assert [r.locality for r in quality.localities(listings).collect()] == ["Banashankari", "Hauz Khas", "hauz khas"]


def test_cache(spark, raw, tmp_path):
    path = str(tmp_path / "cache")
    assert read_canonical(spark, path) is None
    listings = canonicalize(raw)
    assert write_canonical(listings, path) == 4
    back = read_canonical(spark, path)
    assert sorted(back.collect()) == sorted(listings.collect())
    assert read_canonical(spark, path, IngestConfig(revision="r2")) is None
    assert read_canonical(spark, path, IngestConfig(dataset_name="other")) is None
    assert read_canonical(spark, path, IngestConfig(max_rows=2)) is None
    assert read_canonical(spark, path, IngestConfig(cost_low_max_inr=1)) is None
    few = load_listings(raw, IngestConfig(max_rows=2), cache_path=path, prefer_cache=True)
    assert sorted(r.pos for r in few.collect()) == [1, 2]


def test_file_order_becomes_pos(spark, tmp_path):
    for name, start in (("b", 100), ("a", 0)):
        spark.range(start, start + 5).select(F.col("id").cast("string").alias("name")).coalesce(1).write.parquet(
            str(tmp_path / "raw" / f"part={name}")
        )
    read = read_raw(spark, str(tmp_path / "raw")).orderBy("pos").collect()
    assert [int(r.name) for r in read] == [0, 1, 2, 3, 4, 100, 101, 102, 103, 104]


def test_single_profile_filters_reach_the_scan(spark, raw, tmp_path, capsys):
    path = str(tmp_path / "canonical")
    write_canonical(canonicalize(raw), path)
    hits = match.filter_listings(read_canonical(spark, path), "Bangalore", ("indian",), 1000, 4.0)
    assert [r.name for r in hits.collect()] == ["Jalsa"]
    hits.select("pos").explain("formatted")
    plan = capsys.readouterr().out
    assert "LessThanOrEqual(cost_for_two,1000)" in plan and "GreaterThanOrEqual(rating,4.0)" in plan


def test_search_reads_no_more_than_it_needs(spark, raw, tmp_path, capsys):
    path = str(tmp_path / "canonical")
    write_canonical(canonicalize(raw), path)
    _lean(read_canonical(spark, path)).explain("formatted")
    plan = capsys.readouterr().out
    assert "raw_fields:struct<address:string>" in plan and "reviews_list" not in plan
    assert "Not(EqualTo(city,))" in plan


@pytest.mark.parametrize("n", [0, 1, 7, 499, 500, 600])
def test_first_rows(spark, n):
    df = spark.range(500).select((F.col("id") * F.col("id") * 12345 - 10**6).alias("pos"))
    want = sorted(i * i * 12345 - 10**6 for i in range(500))[:n]
    assert sorted(r.pos for r in first_rows(df, n).collect()) == want


@pytest.mark.parametrize("positions", [[None, 1, 2, 3], [1, 1, 2, 3]])
def test_first_rows_needs_unique_positions(spark, positions):
    df = spark.createDataFrame([(p,) for p in positions], "pos bigint")
    with pytest.raises(ValueError, match="pos"):
        first_rows(df, 1)


@pytest.mark.parametrize("fmt", ["csv", "json"])
def test_text_sources_are_read_by_name(spark, tmp_path, fmt):
    df = spark.createDataFrame([("Jalsa", "4.1/5", "BTM", 7)], "name string, rate string, location string, pos bigint")
    df.write.option("header", True).format(fmt).save(str(tmp_path / "raw"))
    read = read_raw(spark, str(tmp_path / "raw"), fmt)
    row = canonicalize(read).first()
    assert (row["pos"], row["name"], row["rating"], row["neighborhood"]) == (7, "Jalsa", 4.1, "BTM")
    with pytest.raises(ListingSchemaError):
        canonicalize(read, IngestConfig(strict_columns=True))
    df.drop("pos").write.option("header", True).format(fmt).save(str(tmp_path / "bare"))
    with pytest.raises(ListingSchemaError, match="pos"):
        read_raw(spark, str(tmp_path / "bare"), fmt)


PROFILES = [
    (1, " bangalore ", "1000", None, ["Italian", " "], 4.0, " quiet ", 5, None),
    (2, None, "0", None, [], 3.0, None, None, "budget_not_positive"),
    (3, None, None, None, [], 3.0, None, None, "budget_missing"),
    (4, None, None, "700", None, 3.0, "", None, None),
    (5, None, "12.5", None, [], 3.0, "", None, "budget_not_whole_number"),
    (6, None, "1000001", None, [], 3.0, "", None, "budget_too_large"),
    (7, None, "5", None, ["a", None], 9.0, "", None, "cuisine_not_string"),
    (8, None, "5", None, [], 6.0, "", None, "min_rating_out_of_range"),
    (9, None, "5", None, [], None, "", None, "min_rating_missing"),
    (10, None, "5", None, [], float("nan"), "", None, "min_rating_not_number"),
    (11, " \t", "5", None, ["b", "B"], 5.0, "", 13, "top_k_out_of_range"),
    (12, "new delhi", " 5 ", "x", ["b", "B"], 0.0, "", 12, None),
]


def test_profiles(spark):
    frame = spark.createDataFrame([p[:-1] for p in PROFILES], PREFS)
    checked = {r.pref_id: r for r in validate_preferences(frame).collect()}
    assert {k: r.error for k, r in checked.items()} == {p[0]: p[-1] for p in PROFILES}
    assert (checked[1].location, checked[1].cuisines, checked[1].extras) == ("Bangalore", ["italian"], "quiet")
    assert checked[4].max_cost_for_two_inr == 700 and checked[4].cuisines == []
    assert checked[12].location == "Delhi" and checked[12].cuisines == ["b", "b"] and checked[11].location is None
    usable, rejected = split_preferences(frame)
    assert usable.count() + rejected.count() == len(PROFILES)


def test_profiles_with_other_column_types(spark):
    frame = spark.createDataFrame(
        [(1, 12.7, "Thai", "4.5"), (2, 12.7, None, "4.5x"), (3, 12.7, None, "4.5")],
        "pref_id bigint, budget_for_two_inr double, cuisines string, min_rating string",
    )
    rows = {r.pref_id: r for r in validate_preferences(frame).collect()}
    assert rows[1].error == "cuisines_not_list" and rows[2].error == "min_rating_not_number"
    assert rows[3].error is None and rows[3].max_cost_for_two_inr == 12 and rows[3].min_rating == 4.5


def test_readers_keep_their_snapshot(spark, raw, tmp_path):
    path = str(tmp_path / "cache")
    listings = canonicalize(raw)
    first = publish(listings.where("pos <= 2"), path)
    early = read_canonical(spark, path)
    rows = early.toLocalIterator()
    assert next(rows).pos in (1, 2)
    second = publish(listings, path)
    assert next(rows).pos in (1, 2) and next(rows, None) is None
    assert early.count() == 2 and read_canonical(spark, path).count() == 4
    assert read_canonical(spark, path, snapshot=first.snapshot).count() == 2
    assert read_canonical(spark, path, IngestConfig(max_rows=9), first.snapshot) is None
    assert read_canonical(spark, path, snapshot="none such") is None
    assert [(s.version, s.snapshot, s.row_count) for s in snapshots(spark, path)] == [
        (2, second.snapshot, 4),
        (1, first.snapshot, 2),
    ]


def test_failed_rebuild_leaves_the_old_snapshot(spark, raw, tmp_path):
    path = str(tmp_path / "cache")
    listings = canonicalize(raw)
    publish(listings, path)
    broken = listings.withColumn("votes", F.when(F.col("pos") == 3, F.raise_error(F.lit("broken")).cast("bigint")))
    with pytest.raises(Exception, match="broken"):
        publish(broken, path)
    assert len(snapshots(spark, path)) == 1 and read_canonical(spark, path).count() == 4


def test_prune(spark, raw, tmp_path):
    path = str(tmp_path / "cache")
    listings = canonicalize(raw)
    names = [publish(listings.where(f"pos <= {n}"), path).snapshot for n in (1, 2, 3)]
    assert prune(spark, path) == names[:1]
    assert prune(spark, path) == []
    assert read_canonical(spark, path, snapshot=names[0]) is None
    assert read_canonical(spark, path, snapshot=names[1]).count() == 2 and read_canonical(spark, path).count() == 3
    with pytest.raises(ValueError):
        prune(spark, path, 0)
