"""Broken raw rows are set aside with file, reason and text; every row is in one of the two tables."""

import pytest
from pyspark.sql import functions as F

from venuesieve import ListingSchemaError
from venuesieve.sources import canonicalize
from venuesieve.sources.quarantine import rejected_counts, split_raw
from workload.queries import QUERIES
from workload.tables import listing_raw, table

DATA = "/root/testdata/sf0.001"


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text(
        'pos,name,listed_in(city),extra\n1,One,Goa,x\n2,Two\n3,Three,Goa,x,y\n,Four,Goa,x\n5.5,Five,Goa,x\n6,"Six, six",Goa,\n'
    )
    (tmp_path / "b.csv").write_text("pos,name,listed_in(city),extra\n7,Seven,,\n6,Again,Goa,\n99999999999999999999,Nine,Goa,x\n")
    good, rejected = split_raw(spark, str(tmp_path), "csv")
    assert sorted(map(tuple, good.select("pos", "name", "`listed_in(city)`").collect())) == [(1, "One", "Goa"), (7, "Seven", None)]
    assert "extra" not in good.columns
    got = sorted((r.file.rsplit("/", 1)[1], r.reason) for r in rejected.collect())
    assert got == [
        ("a.csv", "no_pos"),
        ("a.csv", "pos_not_whole_number"),
        ("a.csv", "pos_repeated"),
        ("a.csv", "unreadable"),
        ("a.csv", "unreadable"),
        ("b.csv", "pos_not_whole_number"),
        ("b.csv", "pos_repeated"),
    ]
    assert {r.record for r in rejected.where("reason = 'unreadable'").collect()} == {"2,Two", "3,Three,Goa,x,y"}
    assert all(r.block_start == 0 for r in rejected.collect())
    assert canonicalize(good).count() == 2


def test_json(spark, tmp_path):
    lines = [
        '{"pos": 1, "name": "One", "votes": 12, "other": [1]}',
        '{"pos": "2", "name": {"deep": "Two"}}',
        '{"pos": 3, "name": "cut',
        "[1, 2]",
        "just text",
        '{"name": "no order"}',
        '{"pos": -5, "name": "Minus", "rate": null}',
        "{}",
    ]
    (tmp_path / "a.json").write_text("\n".join(lines) + "\n")
    good, rejected = split_raw(spark, str(tmp_path), "json")
    assert sorted((r.pos, r.name, r.votes) for r in good.collect()) == [(-5, "Minus", None), (1, "One", "12"), (2, '{"deep": "Two"}', None)]
    counts = {r.reason: r.n for r in rejected_counts(rejected).collect()}
    assert good.count() + sum(counts.values()) == len(lines)
    assert counts["no_pos"] == 2 and counts["unreadable"] == 3
    assert lines[2] in {r.record for r in rejected.collect()}


def test_other_formats_and_empty_input(spark, tmp_path):
    with pytest.raises(ListingSchemaError):
        split_raw(spark, str(tmp_path), "parquet")
    (tmp_path / "only.csv").write_text("pos,name\n")
    good, rejected = split_raw(spark, str(tmp_path), "csv")
    assert good.collect() == rejected.collect() == []


def test_query_sums_beyond_64_bits(spark, tmp_path):
    """Order numbers of a large table add up to more than 64 bits; on the given tables the sum is a bigint."""
    far = 4_000_000_000_000
    for name in ("nation", "region", "supplier", "part", "lineitem"):
        rows = table(spark, DATA, name)
        moved = {c: F.col(c) + far for c in ("p_partkey", "l_partkey") if c in rows.columns}
        rows.withColumns(moved).write.parquet(f"{tmp_path}/{name}.parquet")
    kept = [p for (p,) in listing_raw(spark, str(tmp_path)).select("pos").collect() if p % 11 not in (1, 2, 3, 4)]
    assert sum(kept) >= 2**63
    good = {r.fmt: int(r.pos_sum) for r in QUERIES["quarantine"](spark, str(tmp_path)).where("outcome = 'good'").collect()}
    assert good == {"csv": sum(kept), "json": sum(kept)}
    assert dict(QUERIES["quarantine"](spark, DATA).dtypes)["pos_sum"] == "bigint"
