"""Reproducible shuffle into shards: a keyed permutation of global row numbers."""

from __future__ import annotations

from collections.abc import Sequence
from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import global_rank, whole

ROUNDS = 5
WALK = 64


def permuted(row: Column, total: int, seed: int) -> Column:
    """Where row number ``row`` of ``total`` goes: a bijection of 0 ... total - 1.

    A Feistel network on pairs (left below a, right below b), with a * b the smallest such product that holds all rows,
    permutes the pairs; whoever lands at ``total`` or beyond walks on along its cycle. Fewer than a pairs lie there,
    out of about a * a, so a walk of more than one step is rare and one of 64 does not happen for any table below 4096
    rows and has probability 64 ** -64 above; it would raise an error, not lose a row.
    """
    a = max(1, isqrt(max(total, 1) - 1) + 1)
    b = max(1, -(-total // a))

    def turn(pair: Column, key: Column) -> Column:
        left = (pair["left"] + F.pmod(F.xxhash64(pair["right"], key), F.lit(a))) % F.lit(a)
        right = (pair["right"] + F.pmod(F.xxhash64(left, key, F.lit(1)), F.lit(b))) % F.lit(b)
        return F.struct(left.alias("left"), right.alias("right"))

    def network(at: Column) -> Column:
        pair = F.struct((at % F.lit(a)).alias("left"), _div(at, a).alias("right"))
        keys = F.array(*[F.lit(seed * ROUNDS + i).cast("long") for i in range(ROUNDS)])
        return F.aggregate(keys, pair, turn, lambda p: p["right"] * F.lit(a) + p["left"])

    def onward(at: Column, _: Column) -> Column:
        return F.when(at < total, at).otherwise(network(at))

    first = network(row)
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), first, onward)
    landed = F.when(walked < total, walked).otherwise(F.raise_error(F.lit("cycle walk did not land")).cast("long"))
    return F.when(first < total, first).otherwise(landed)


def shuffle_into_shards(df: DataFrame, order: Sequence[Column], shards: int, seed: int = 7) -> DataFrame:
    """``df`` with columns ``row``, ``shard`` (0 ... shards - 1) and ``slot``.

    ``row`` is the global rank in ``order``; the permuted row p goes to shard p mod shards, slot p div shards. So shard
    sizes differ by one at most, slots have no gaps, and both are computable from row, row count and seed alone.
    ``order`` must name every column that tells rows apart; rows equal in all of them may swap places. An empty table
    stays empty; nulls sort first. Columns named row, shard or slot in ``df`` are replaced.
    """
    clean = df.drop("row", "shard", "slot")
    ranked, total = global_rank(clean, order, "row", "sharding")
    placed = ranked.select(whole(ranked), permuted(F.col("row"), total, seed).alias("_to"))
    shard, slot = F.col("_to") % F.lit(shards), _div(F.col("_to"), shards)
    return placed.select("_row.*", shard.cast("int").alias("shard"), slot.alias("slot"))


def _div(at: Column, by: int) -> Column:
    """Whole division; exact below 2 ** 53 rows."""
    return ((at - at % F.lit(by)) / F.lit(by)).cast("long")
