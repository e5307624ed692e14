"""Exact top-k by inner product, aggregating sorted lists without random access."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARD_ROWS = 4096
QUERY_ROWS = 4096
SLICE = 256
STEPS = 16
EXACT = 1 << 53


def scaled(vector: Column | str, factor: int = 256) -> Column:
    """floor(factor * x) of every component as long; null if the vector or a component is null or not finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    whole = F.transform(vector, lambda x: F.floor(F.lit(float(factor)) * x.cast("double")))
    return F.when(F.forall(vector, finite), whole)


class Lists:
    """The candidates of one shard as one list per dimension, sorted by component and read from both ends.

    A query with a positive weight in a dimension reads that list downwards, one with a negative weight upwards. What
    is unread is known only to lie between the last value read and the end of the list.
    """

    def __init__(self, vectors: np.ndarray):
        self.vectors, self.n = vectors, len(vectors)
        order = np.argsort(vectors, axis=0, kind="stable")
        self.values = np.take_along_axis(vectors, order, axis=0)
        self.place = np.empty_like(order)
        np.put_along_axis(self.place, order, np.arange(self.n)[:, None], axis=0)

    def bounds(self, depth: int) -> tuple[np.ndarray, ...]:
        """Per component its least and greatest possible value after ``depth`` reads downwards, then upwards."""
        down, up = self.place >= self.n - depth, self.place < depth
        x, low, high = self.vectors, self.values[0], self.values[-1]
        top, bottom = self.values[self.n - depth], self.values[depth - 1]
        return np.where(down, x, low), np.where(down, x, top), np.where(up, x, bottom), np.where(up, x, high)


def search(vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int, read: list | None = None):
    """(query row, candidate row, score) of the ``k`` best of each query; ties to the smaller id, ``own`` id left out.

    Lists are read in blocks of a sixteenth of their length. After each block every candidate has a lower and an upper
    bound, and a query stops when no more than a few candidates have an upper bound that reaches its k-th best lower
    bound; their scores are then completed. ``read`` gets, per query, the share of the lists that it has read. In double
    arithmetic while every product sum is exact there, in Python integers beyond.
    """
    biggest = int(np.abs(vectors).max(initial=0)) * int(np.abs(queries).max(initial=0)) * max(1, vectors.shape[1])
    kind = np.float64 if biggest < EXACT else object
    vectors, queries = vectors.astype(kind), queries.astype(kind)
    n, lists = len(vectors), Lists(vectors)
    few, out = max(4 * k, 16), []
    for s in range(0, len(queries), SLICE):
        rows, step = np.arange(s, min(s + SLICE, len(queries))), 0
        while len(rows):
            step += 1
            depth = -(-n * step // STEPS)
            plus, minus = np.maximum(queries[rows], 0), np.minimum(queries[rows], 0)
            low_down, high_down, low_up, high_up = lists.bounds(depth)
            worst = plus @ low_down.T + minus @ high_up.T
            best = worst if depth == n else plus @ high_down.T + minus @ low_up.T
            mine = own[rows][:, None] == ids[None, :]
            least = -np.inf if kind is np.float64 else -(1 << 200)
            worst = np.where(mine, least, worst)
            kth = np.partition(worst, n - k, axis=1)[:, n - k] if n > k else np.full(len(rows), least, kind)
            stays = (best >= kth[:, None]) & ~mine
            done = (stays.sum(axis=1) <= few) | (depth == n)
            for r, row in zip(np.flatnonzero(done), rows[done], strict=True):
                found = np.flatnonzero(stays[r])
                score = vectors[found] @ queries[row]
                rank = np.lexsort((ids[found], -score))[:k] if kind is np.float64 else _ranked(ids[found], score, k)
                out += [(int(row), int(found[j]), int(score[j])) for j in rank]
            if read is not None:
                read += [depth / n] * int(done.sum())
            rows = rows[~done]
    return out


def _ranked(ids: np.ndarray, score: np.ndarray, k: int) -> list[int]:
    return sorted(range(len(ids)), key=lambda j: (-score[j], ids[j]))[:k]


def top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query its ``k`` highest inner products among ``vectors``.

    Both tables are (vec_id long, v array<long>). Candidates fall by hash into shards of about 4096, queries into
    blocks of as many; every pair of shard and block is one task's work, gives k rows per query, and the k best of
    those are the result, exactly. Rows without id or vector take no part; equal rows count once; a query's own id is
    never a candidate; a shorter vector counts as filled up with zeros; with fewer candidates than k, all are returned.
    Two different vectors under one id are two candidates, and as queries give k rows each. An empty side gives no rows.
    """
    taking = "vec_id IS NOT NULL AND v IS NOT NULL"
    vectors = vectors.select("vec_id", "v").where(taking).dropDuplicates()
    queries = queries.select("vec_id", "v").where(taking).dropDuplicates()
    shards = max(1, -(-vectors.count() // SHARD_ROWS))
    blocks = max(1, -(-queries.count() // QUERY_ROWS))
    deal = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = vectors.withColumn("shard", deal(shards)).withColumn("block", every(blocks))
    right = queries.withColumn("block", deal(blocks)).withColumn("shard", every(shards))
    keys = ["shard", "block"]
    schema = "query_id long, turn long, vec_id long, score long"
    local = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_meet(k), schema)
    best = Window.partitionBy("query_id", "turn").orderBy(F.desc("score"), "vec_id")
    ranked = local.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _meet(k: int):
    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        v, q = vectors.column("v").to_pylist(), queries.column("v").to_pylist()
        ids, own = (np.array(t.column("vec_id").to_pylist(), np.int64) for t in (vectors, queries))
        found = []
        if v and q:
            width = max(map(len, v + q))
            found = search(_matrix(v, width), ids, _matrix(q, width), own, k)
        turns = [hash(tuple(x)) for x in q]
        return pa.table(
            {
                "query_id": pa.array([own[a] for a, _, _ in found], pa.int64()),
                "turn": pa.array([turns[a] for a, _, _ in found], pa.int64()),
                "vec_id": pa.array([ids[b] for _, b, _ in found], pa.int64()),
                "score": pa.array([s for _, _, s in found], pa.int64()),
            }
        )

    return run


def _matrix(rows: list[list[int]], width: int) -> np.ndarray:
    return np.array([r + [0] * (width - len(r)) for r in rows], np.int64).reshape(len(rows), width)
