import json
import random
import subprocess
import sys
from collections import defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from venuesieve.operators.containment import FILTER_BITS, gram_filter, offers, probes, touching_pairs
from venuesieve.operators.dominance import count_dominated, kth_cost, top_within_cap
from venuesieve.operators.prefix import bucket_of, cut_points

LOW = float("-inf")
ROOT = Path(__file__).resolve().parent.parent


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(3)
    levels = [LOW, 0.0, 1.0, 1.5, 2.0, 3.7, 4.1, 5.0]
    # One group holds nine tenths of the cells.
    cells = [
        ("hot" if rng.random() < 0.9 else "b", rng.randint(0, 60), rng.choice(levels), rng.randint(1, 3))
        for _ in range(200)
    ]
    asked = sorted(
        {
            (rng.choice(["hot", "b", "none"]), rng.randint(0, 70), rng.choice(levels + [0.5, 2.5, 5.5]))
            for _ in range(150)
        }
    )
    return (
        cells,
        asked,
        spark.createDataFrame(cells, "g string, cost bigint, rating double, n bigint"),
        spark.createDataFrame(asked, "g string, cap bigint, t double"),
    )


def test_counts(data):
    cells, asked, c, p = data
    got = {(r.g, r.cap, r.t): r.hits for r in count_dominated(c, p, ["g"]).collect()}
    for g, cap, t in asked:
        assert got.get((g, cap, t), 0) == sum(n for h, cost, rating, n in cells if h == g and cost <= cap and rating >= t)


@pytest.mark.parametrize("cuts", [[], [7], [3, 3, 10, 59], list(range(-5, 80))])
def test_counts_do_not_depend_on_cuts(data, cuts):
    cells, asked, c, p = data
    got = {(r.g, r.cap, r.t): r.hits for r in count_dominated(c, p, ["g"], cuts).collect()}
    for g, cap, t in asked:
        assert got.get((g, cap, t), 0) == sum(n for h, cost, rating, n in cells if h == g and cost <= cap and rating >= t)


def test_cut_points(spark):
    frame = spark.createDataFrame([(i % 100,) for i in range(1000)] + [(7,)] * 500, "v bigint")
    cuts = cut_points(frame, "v", 16)
    assert cuts == sorted(set(cuts)) and 8 <= len(cuts) <= 15 and 7 in cuts
    assert cut_points(frame.limit(0), "v") == []
    rows = spark.range(-3, 105).select("id", bucket_of("id", cuts).alias("b")).collect()
    assert all(r.b == sum(c <= r.id for c in cuts) for r in rows)


@pytest.mark.parametrize("k", [1, 5, 40])
def test_kth_cost(data, k):
    cells, asked, c, p = data
    got = {(r.g, r.t): r.kth_cost for r in kth_cost(c, p, ["g"], k).collect()}
    for g, _, t in asked:
        costs = sorted(cost for h, cost, rating, n in cells if h == g and rating >= t for _ in range(n))
        assert got.get((g, t)) == (costs[k - 1] if len(costs) >= k else None)


def test_top_within_cap(spark, data):
    _, asked, _, p = data
    rng = random.Random(5)
    rows = [(rng.choice(["hot", "hot", "b"]), rng.randint(0, 60), rng.randint(0, 5), i) for i in range(200)]
    frame = spark.createDataFrame(rows, "g string, cost bigint, score int, pos int")
    got = defaultdict(list)
    for r in top_within_cap(frame, frame, p, ["g"], [F.col("score").desc(), F.col("pos")], 7).collect():
        got[r.g, r.cap].append((-r.score, r.pos))
    for g, cap in {(g, cap) for g, cap, _ in asked}:
        assert sorted(got[g, cap]) == sorted((-s, i) for h, cost, s, i in rows if h == g and cost <= cap)[:7]


def test_substrings(spark):
    rng = random.Random(1)

    def word(letters, longest):
        return "".join(rng.choice(letters) for _ in range(rng.randint(1, longest)))

    words = sorted({word("ab é", 40) for _ in range(200)} | {word("ab", 4) for _ in range(60)})
    left, right = words[::2], sorted({*words[1::2], *words[:4]})
    pairs = touching_pairs(
        spark.createDataFrame([(w,) for w in left], "l string"),
        spark.createDataFrame([(w,) for w in right], "r string"),
        "l",
        "r",
    )
    got = sorted((p.l, p.r) for p in pairs.collect())
    assert got == sorted((a, b) for a in left for b in right if a in b or b in a)


def test_offers_are_few(spark):
    """Only substrings that some needle begins with leave a haystack, and a needle is never kept from its haystack."""
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    haystacks = [word(rng.randint(0, 60)) for _ in range(400)]
    needles = sorted({h[i : i + rng.randint(1, 20)] for h in haystacks[:12] for i in [rng.randint(0, 30)]} - {""} | {word(9)})
    wanted = probes(spark.createDataFrame([(w,) for w in needles], "needle string"))
    filters = gram_filter(wanted)
    assert all(len(w) * 64 == FILTER_BITS for w in filters.values())
    offered = offers(spark.createDataFrame([(h,) for h in haystacks], "haystack string"), filters).collect()
    grams = {r.gram for r in wanted.collect()}
    due = {(h, g) for h in haystacks for g in grams if g in h}
    assert due <= {(r.haystack, r.gram) for r in offered}
    assert len(offered) <= 1.1 * len([1 for h in haystacks for g in grams if g in h]) + 5
    assert gram_filter(wanted.limit(0)) == {}
    assert offers(spark.createDataFrame([("abc",)], "haystack string"), {}).collect() == []


def test_no_cross_join(spark, data):
    _, _, c, p = data
    plan = count_dominated(c, p, ["g"])._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


_HOT = """
import sys
sys.path.insert(0, sys.argv[2])
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from venuesieve.operators.dominance import count_dominated

conf = {
    "spark.ui.enabled": "false",
    "spark.eventLog.enabled": "true",
    "spark.eventLog.compress": "false",
    "spark.eventLog.rolling.enabled": "false",
    "spark.eventLog.dir": "file://" + sys.argv[1],
    "spark.checkpoint.dir": "file://" + sys.argv[1] + "/shared",
    "spark.sql.shuffle.partitions": "64",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}
spark = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
i = F.col("id")
group = F.when(i % 10 == 0, F.concat(F.lit("cold"), (i % 70).cast("string"))).otherwise("hot").alias("g")
rating = (F.xxhash64("id") % 5 / 2 + 2).alias("rating")
cells = spark.range(150000).select(group, (i * 7 % 20011).alias("cost"), rating, F.lit(1).cast("bigint").alias("n"))
points = spark.range(30000).select(group, (i * 11 % 21000).alias("cap"), (i % 12 / 4 + 1).alias("t")).distinct()
got = count_dominated(cells, points, ["g"])
want = points.join(cells, (cells.g == points.g) & (cells.cost <= points.cap) & (cells.rating >= points.t), "left")
sample = want.where("cap % 400 = 0").groupBy(points.g, "cap", "t").agg(F.count("n").alias("want"))
told = got.persist()
print("rows", told.count())
spark.sparkContext.setJobGroup("later", "not counted")
print("wrong", sample.join(told, ["g", "cap", "t"], "left").where("coalesce(hits, 0) <> want").count())
spark.stop()
"""


def test_hot_group_is_spread(tmp_path):
    """Nine tenths of the cells and points in one group: no task reads more than a few times the mean of its stage."""
    ran = subprocess.run([sys.executable, "-c", _HOT, str(tmp_path), str(ROOT)], capture_output=True, text=True, timeout=300)
    assert ran.returncode == 0, ran.stderr[-2000:]
    assert "wrong 0\n" in ran.stdout
    read, later = defaultdict(list), set()
    (log,) = [f for f in tmp_path.iterdir() if f.is_file()]
    for line in log.open():
        event = json.loads(line)
        if event["Event"] == "SparkListenerJobStart" and event["Properties"].get("spark.jobGroup.id") == "later":
            later |= set(event["Stage IDs"])
        elif event["Event"] == "SparkListenerTaskEnd" and event["Stage ID"] not in later:
            read[event["Stage ID"]].append(event["Task Metrics"]["Shuffle Read Metrics"]["Total Records Read"])
    large = [sorted(r) for r in read.values() if sum(r) > 100_000]
    assert large
    for rows in large:
        assert rows[-1] <= 4 * sum(rows) / 64, rows[-5:]
