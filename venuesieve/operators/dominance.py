"""Two-sided threshold questions over weighted points, without pairing points and questions.

Points carry a cost, a rating and a weight; a question names a cost cap and a minimum rating. Points and questions
live in groups (``keys``). One axis is reduced to the thresholds that the questions of a group use. On that axis a
one-sided range is a union of at most log2(thresholds) blocks of power-of-two size, and a point lies in at most that
many useful blocks. Inside a block the other axis is a prefix sum, cut into buckets of about equal weight. So the work
is (points + questions) x log(thresholds), spread over (group, block, bucket), and a hot group is split accordingly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.staging import stage
from .prefix import bucket_of, cut_points, running_total

BLOCK = ["lvl", "node"]


def _bit_levels(x: Column, bits: Column, wanted: int) -> Column:
    """Levels below ``bits`` at which x has the wanted bit."""
    return F.filter(F.sequence(F.lit(0), bits - 1), lambda lvl: F.getbit(x, lvl) == wanted)


def _shift(x: Column, lvl: Column) -> Column:
    return F.call_function("shiftright", x, lvl)


def _positions(values: DataFrame, marks: DataFrame, keys: Sequence[str], marks_first: bool) -> DataFrame:
    """Per group, place distinct values (column ``v``) among distinct marks (``v``).

    ``idx`` counts the marks at or before a row in order of ``v``; ``bits`` is the bit length of the group's number
    of marks. ``marks_first`` decides whether a mark equal to a value counts for it. The table is staged: it is far
    smaller than the rows it is joined to, and its true size lets the planner see that. A group's distinct values and
    marks meet in one task, so use it on an axis with a bounded number of them: ratings, or costs up to a highest cap.
    """
    both = (
        values.select(*keys, "v")
        .distinct()
        .withColumn("is_mark", F.lit(0))
        .unionByName(marks.select(*keys, "v").distinct().withColumn("is_mark", F.lit(1)))
    )
    tie = F.col("is_mark").desc() if marks_first else F.col("is_mark").asc()
    group = W.partitionBy(*keys)
    running = group.orderBy("v", tie).rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = both.select(
        *keys,
        "v",
        "is_mark",
        F.sum("is_mark").over(running).alias("idx"),
        F.length(F.bin(F.sum("is_mark").over(group))).alias("bits"),
    )
    return stage(placed, "positions")


def _rating_blocks(
    cells: DataFrame, asked: DataFrame, keys: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """Blocks over rating thresholds: (block, cost, n) rows of the cells, questions per block."""
    spots = _positions(
        cells.withColumn("v", F.col("rating")), asked.withColumn("v", F.col("t")), keys, marks_first=True
    )
    of_cell = spots.where((F.col("is_mark") == 0) & (F.col("idx") > 0)).withColumnRenamed("v", "rating")
    of_asked = spots.where(F.col("is_mark") == 1).withColumnRenamed("v", "t")
    # Useful blocks start at an odd index, so a cell is listed only where its index has a set bit.
    cell_blocks = (
        cells.join(of_cell, [*keys, "rating"])
        .withColumn("lvl", F.explode(_bit_levels(F.col("idx"), F.col("bits"), 1)))
        .withColumn("node", _shift(F.col("idx"), F.col("lvl")))
        .select(*keys, *BLOCK, "cost", "n")
    )
    asked_blocks = (
        asked.join(of_asked, [*keys, "t"])
        .withColumn("lvl", F.explode(_bit_levels(F.col("idx") - 1, F.col("bits"), 0)))
        .withColumn("node", _shift(F.col("idx") - 1, F.col("lvl")) + 1)
        .drop("is_mark", "idx", "bits")
    )
    return cell_blocks, asked_blocks


def count_dominated(cells: DataFrame, points: DataFrame, keys: Sequence[str], cuts: Sequence | None = None) -> DataFrame:
    """For each distinct point (keys, cap, t): weight of cells with cost <= cap and rating >= t, as ``hits``.

    Cells: keys, cost, rating, n, without NULLs. ``cuts`` spread the costs and caps of a block (see ``cut_points``, which
    finds them if there are none); they change no count.
    """
    if cuts is None:
        cuts = cut_points(cells.select("cost").union(points.select("cap")), "cost")
    cell_blocks, asked = _rating_blocks(cells, points, keys)
    nothing, no_t = F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("double").alias("t")
    events = cell_blocks.select(
        *keys, *BLOCK, bucket_of("cost", cuts).alias("bucket"), F.col("cost").alias("x"), F.lit(0).alias("asks"), "n", no_t
    ).unionByName(
        asked.select(
            *keys, *BLOCK, bucket_of("cap", cuts).alias("bucket"), F.col("cap").alias("x"), F.lit(1).alias("asks"), nothing, "t"
        )
    )
    return (
        running_total(events, [*keys, *BLOCK], "bucket", ["x", "asks"], "n", "below")
        .where(F.col("asks") == 1)
        .groupBy(*keys, F.col("x").alias("cap"), "t")
        .agg(F.sum("below").alias("hits"))
    )


def kth_cost(cells: DataFrame, wanted: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """For each distinct (keys, t): the k-th smallest cost among cells with rating >= t; no row if fewer than k."""
    cell_blocks, asked = _rating_blocks(cells, wanted.select(*keys, "t").distinct(), keys)
    # Every row weighs one at least, so k of them are enough.
    cheapest = keep_first(cell_blocks, [*keys, *BLOCK], [F.col("cost")], k)
    merged = W.partitionBy(*keys, "t").orderBy("cost").rowsBetween(W.unboundedPreceding, W.currentRow)
    return (
        asked.join(cheapest, [*keys, *BLOCK])
        .groupBy(*keys, "t", "cost")
        .agg(F.sum("n").alias("n"))
        .withColumn("upto", F.sum("n").over(merged))
        .where(F.col("upto") >= k)
        .groupBy(*keys, "t")
        .agg(F.min("cost").alias("kth_cost"))
    )


def keep_first(rows: DataFrame, partition: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """First k rows per partition; Spark trims each task's share before it shuffles."""
    at = F.row_number().over(W.partitionBy(*partition).orderBy(*order))
    return rows.withColumn("_rn", at).where(F.col("_rn") <= k).drop("_rn")


def top_within_cap(
    rows: DataFrame, costs: DataFrame, wanted: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int
) -> DataFrame:
    """For each distinct (keys, cap): the first k rows in ``order`` with cost <= cap. Rows may answer many caps.

    ``costs`` holds at least every (keys, cost) of the rows.
    """
    caps = wanted.select(*keys, "cap").distinct()
    spots = _positions(
        costs.withColumn("v", F.col("cost")), caps.withColumn("v", F.col("cap")), keys, marks_first=False
    )
    of_row = spots.where(F.col("is_mark") == 0).withColumnRenamed("v", "cost").drop("is_mark")
    of_cap = spots.where(F.col("is_mark") == 1).withColumnRenamed("v", "cap").drop("is_mark")
    # All rows between two neighbouring caps answer the same caps, so k of them are enough.
    between = keep_first(rows.join(of_row, [*keys, "cost"]), [*keys, "idx"], order, k)
    row_blocks = (
        between.withColumn("lvl", F.explode(_bit_levels(F.col("idx"), F.col("bits"), 0)))
        .withColumn("node", _shift(F.col("idx"), F.col("lvl")))
        .drop("idx", "bits")
    )
    cap_blocks = (
        of_cap.withColumn("lvl", F.explode(_bit_levels(F.col("idx"), F.col("bits"), 1)))
        .withColumn("node", _shift(F.col("idx"), F.col("lvl")) - 1)
        .drop("idx", "bits")
    )
    best = keep_first(row_blocks, [*keys, *BLOCK], order, k)
    return keep_first(cap_blocks.join(best, [*keys, *BLOCK]), [*keys, "cap"], order, k).drop(*BLOCK)
