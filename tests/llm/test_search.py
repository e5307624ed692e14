"""Top-k and near duplicates against all pairs."""

import cProfile
import pstats
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from venuesieve.llm import near_dup, topk, vector_dedup
from venuesieve.llm.common import components
from venuesieve.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"


def roots(nodes, links):
    root = {n: n for n in nodes}

    def up(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = up(a), up(b)
        root[max(a, b)] = min(a, b)
    return {n: up(n) for n in nodes}


def test_components(spark):
    rng = np.random.default_rng(4)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(400, 440)]
    got = components(spark.createDataFrame(links, "a long, b long"), "test").collect()
    want = roots({n for link in links for n in link}, links)
    assert all(want[r["node"]] == r["root"] for r in got)
    assert {r["node"] for r in got} == {n for a, b in links for n in (a, b) if a != b}


def best(vectors, queries, k):
    out = []
    for q, own in queries:
        scored = sorted((-sum(a * b for a, b in zip(own, v, strict=False)), i) for i, v in vectors if i != q)
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("spread", [2, 50, 10**9])
def test_top_k_with_ties(spark, spread):
    rng = np.random.default_rng(spread % 97)
    rows = [(i, [int(x) for x in rng.integers(-spread, spread + 1, 6)]) for i in range(300)]
    rows += [(300 + i, rows[0][1]) for i in range(40)]
    df = spark.createDataFrame([*rows, (None, [1]), (999, None)], "vec_id long, v array<long>")
    df = df.union(df.where("vec_id = 3"))
    got = [tuple(r) for r in topk.top_k(df, df.where("vec_id % 50 = 0"), 5).collect()]
    assert sorted(got) == best(rows, [r for r in rows if r[0] % 50 == 0], 5)


def test_top_k_stops_before_the_ends_of_its_lists(spark):
    """On the given vectors every query is settled by bounds before its lists are read out."""
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", topk.scaled("embedding").alias("v"))
    rows = rows.where("v IS NOT NULL").orderBy("vec_id").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["v"] for r in rows])
    asked, read = ids % 50 == 0, []
    found = topk.search(x, ids, x[asked], ids[asked], 5, read)
    assert len(read) == asked.sum() and max(read) < 1
    scores = x[asked] @ x.T
    for q, i in enumerate(np.flatnonzero(asked)):
        order = [j for j in np.lexsort((ids, -scores[q])) if j != i][:5]
        assert [(b, s) for a, b, s in found if a == q] == [(j, scores[q][j]) for j in order]


def test_top_k_few_rows_and_scaling(spark):
    rows = [(0, [0.5, -0.001]), (1, [1.0, float("nan")]), (2, [None, 1.0]), (3, [2.0, 1.0]), (4, None), (5, [])]
    df = spark.createDataFrame(rows, "vec_id long, e array<double>").select("vec_id", topk.scaled("e").alias("v"))
    assert {r["vec_id"]: r["v"] for r in df.collect()} == {0: [128, -1], 1: None, 2: None, 3: [512, 256], 4: None, 5: []}
    got = [tuple(r) for r in topk.top_k(df, df.where("vec_id = 0"), 5).collect()]
    assert sorted(got) == [(0, 1, 3, 512 * 128 - 256), (0, 2, 5, 0)]
    assert topk.top_k(df.limit(0), df, 5).collect() == []


def vectors():
    rng = np.random.default_rng(8)
    base = rng.normal(size=(12, 32))
    rows = [b + rng.normal(size=32) * s for b in base for s in np.linspace(0, 0.5, 14)]
    rows += [rows[0]] * 30 + [rows[5] * 1e-200, rows[5] * 1e200, -rows[5]]
    return [(i, [float(x) for x in r]) for i, r in enumerate(rows)]


def test_vectors(spark):
    rows = vectors()
    n = len(rows)
    bad = [(n, None), (n + 1, [0.0] * 32), (n + 2, [None] * 32), (n + 3, [float("inf")] * 32), (n + 4, []), (n + 5, [1.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows + bad], "vec_id long, embedding array<double>, n_links string")
    x = np.array([r[1] for r in rows])
    x /= np.abs(x).max(axis=1, keepdims=True)
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    links = [(i, j) for i, j in zip(*np.nonzero(x @ x.T >= 0.95), strict=True) if i != j]
    degree, root = Counter(int(i) for i, _ in links), roots(range(n), links)
    got = {r["vec_id"]: tuple(r)[1:] for r in vector_dedup.near_vectors(df).collect()}
    found = sum(v[0] for v in got.values())
    assert found >= 0.999 * len(links) and all(got[i][0] <= degree[i] for i in range(n))
    if found == len(links):
        assert all(got[i] == (degree[i], root[i], root[i] == i) for i in range(n))
    assert all(got[i] == (0, i, True) for i, _ in bad)
    assert vector_dedup.near_vectors(df.limit(0)).collect() == []


def test_vectors_with_null_and_repeated_keys(spark):
    a, b = [1.0, 0.0, 0.0, 0.2], [0.0, 1.0, 0.3, 0.0]
    near_b = [0.0, 1.0, 0.31, 0.0]
    rows = [(1, a), (1, b), (2, near_b), (3, a), (None, a), (None, b), (None, [5.0, -5.0, 5.0, 5.0]), (None, None), (7, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = [tuple(r) for r in vector_dedup.near_vectors(df).collect()]
    want = [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), (None, 2, 1, False), (None, 2, 1, False)]
    want += [(None, 0, None, True), (None, 0, None, True), (7, 0, 7, True)]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


@pytest.mark.parametrize("rows, turns", [(1000, 3), (300_000, 4), (30_000_000, 5)])
def test_recall_of_hashes_that_tables_of_every_size_get(rows, turns):
    how = vector_dedup.Hashing.for_rows(rows, 64)
    assert how.turns == turns
    rng = np.random.default_rng(turns)
    x, y = rng.normal(size=(2, 3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(1, keepdims=True) * x
    y = 0.95 * x + np.sqrt(1 - 0.95**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    a, b = (vector_dedup.buckets(v, how) for v in (x, y))
    met = (a[:, :, :, None] == b[:, :, None, :]).any(axis=(1, 2, 3))
    assert met.mean() >= 0.999


def multiset(text):
    words = (text or "").split()
    k = min(5, len(words))
    return Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if words else Counter()


def classes(rows):
    sets = {}
    for _, t in rows:
        sets[t] = multiset(t)
    texts = [t for t in sets if sets[t]]
    links = []
    for i, a in enumerate(texts):
        for b in texts[:i]:
            both = sum((sets[a] & sets[b]).values())
            if both >= 0.8 * (sum(sets[a].values()) + sum(sets[b].values()) - both):
                links.append((a, b))
    root = roots(texts, links)
    first = {}
    for k, t in sorted(r for r in rows if r[1] in root):
        first.setdefault(root[t], k)
    return {(k, t): first[root[t]] if t in root else k for k, t in rows}


def planted():
    rng = np.random.default_rng(6)
    base = [f"w{x}" for x in rng.integers(0, 500, 300)]
    rows = [(0, " ".join(base))]
    for i in range(1, 160):  # one group whose members differ more and more from the base
        words = list(base)
        for at in rng.integers(0, 300, i // 12):
            words[at] = f"n{i}-{at}"
        rows.append((i, " ".join(words)))
    rows += [(200 + i, " ".join(base)) for i in range(40)]
    rows += [(300, None), (301, ""), (302, " \n\t"), (303, "two words"), (304, "two words"), (305, "two  words")]
    rows += [(310, "rep " * 400), (311, "rep " * 420), (312, "rep " * 900)]
    return rows + [(320 + i, " ".join(f"q{x}" for x in rng.integers(0, 10**6, 60))) for i in range(50)]


def test_near_texts(spark):
    rows = planted()
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, class_id string").repartition(3)
    got = {r["doc_id"]: r for r in near_dup.near_texts(df).collect()}
    want = classes(rows)
    assert {k: got[k]["class_id"] for k, _ in rows} == {k: want[k, t] for k, t in rows}
    assert all(got[k]["kept"] == (got[k]["class_id"] == k) for k, _ in rows)
    kept = near_dup.one_per_class(df.union(df))
    assert kept.columns == df.columns
    texts = Counter(r["doc_id"] for r in kept.collect())
    assert {k for k in texts} == {want[k, t] for k, t in rows}
    assert all(n == (2 if k in (300, 301, 302) else 1) for k, n in texts.items())
    assert near_dup.near_texts(df.limit(0)).collect() == []


def test_near_dup_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    want = {k: c for (k, _), c in classes(rows).items()}
    assert {r["doc_id"]: r["class_id"] for r in QUERIES["op8_near_dup"](spark, DATA).collect()} == want


def test_signatures_estimate_weighted_jaccard():
    how = near_dup.Darts(bands=400, rows=5)
    a, b = "x y z u v w " * 30 + "k l m n o p", "x y z u v w " * 20 + "k l m n o q r s"
    owner, element, weight = near_dup.shingles([a, b, None], 5)
    codes = near_dup.signatures(owner, element, weight, 3, how)
    x, y = multiset(a), multiset(b)
    both = sum((x & y).values())
    true = both / (sum(x.values()) + sum(y.values()) - both)
    assert abs((codes[0] == codes[1]).mean() - true) < 0.05 and not codes[2].any()


def test_few_texts_are_signed_at_a_time():
    """All darts of a block of short texts at once took some 15 KB a text."""
    how = near_dup.Darts()
    texts = [f"a{i} b{i // 2} c{i // 3} d e f" if i % 7 else None for i in range(12_000)]
    sets = near_dup.shingles(texts, how.words)
    tracemalloc.start()
    bands = near_dup._bands(*sets, len(texts), how)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6
    some = near_dup.shingles(texts[5_000:5_010], how.words)
    assert (near_dup._bands(*some, 10, how) == bands[5_000:5_010]).all()


def test_vectors_are_scaled_together():
    """One Python number a component and a few calls a row made the cosines' tasks some forty times as dear."""
    rows = np.random.default_rng(3).normal(size=(2000, 8)) * 10.0 ** np.arange(-4, 4)
    listed = [*rows.tolist(), [3.0, 4.0], [-1e-300]]
    batch = pa.record_batch([pa.array([[9.0], *listed], pa.list_(pa.float64()))], ["v"]).slice(1)
    profile = cProfile.Profile()
    units = profile.runcall(vector_dedup._units, batch)
    assert pstats.Stats(profile).total_calls < len(listed) / 2
    for got, row in zip(units, listed, strict=True):
        row = np.array(row) / np.abs(row).max()
        assert (got == row / np.sqrt((row * row).sum())).all()
