"""A few registered queries against their SQL on the smallest data; the rest are compared by the driver."""

import math

import duckdb
import pytest

from workload.oracles import ORACLES
from workload.queries import QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages conversations labels".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize(
    "name",
    [
        "canonical_listings",
        "cache_snapshots",
        "title_case",
        "prefs_validated",
        "prefs_rejected",
        "relax_ladder",
        "reconcile",
        "completion_log",
        "few_items",
        "few_report",
    ],
)
def test_equal(spark, sql, name):
    cursor = sql.execute(ORACLES[name])
    columns = [c[0] for c in cursor.description]
    want = [tuple(plain(v) for v in row) for row in cursor.fetchall()]
    frame = QUERIES[name](spark, DATA)
    assert sorted(frame.columns) == sorted(columns)
    got = [tuple(plain(v) for v in row) for row in frame.select(columns).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
