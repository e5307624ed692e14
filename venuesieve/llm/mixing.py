"""Mixing sources to target weights: repetition rates per source, whole copies plus one random copy per document."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import global_rank, stage

WORD = "[^\\x20\\x09-\\x0D]+"
CELL_ROWS = 4096


def words(text: Column | str) -> Column:
    """Runs of other characters than ASCII white space; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sized: DataFrame, weights: Sequence[int], cap: int) -> DataFrame:
    """(source, source_size, n, target, rate) per source of ``sized`` (source, size).

    Sources in code point order, null last, take the weights in turn. Each gets its share of all sizes, but ``cap``
    times its size at most; the excess goes to the others by weight until none is above. The level (share per unit of
    weight) only rises, so it alone is carried from round to round.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    ranked, _ = global_rank(sums, [F.col("source").asc_nulls_last()], "_rank", "mix")
    turn = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    held = stage(ranked.withColumn("weight", turn).drop("_rank"), "mix-sources")
    most = F.col("source_size") * cap
    total = held.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while total:
        full = most < F.col("weight") * F.lit(level)
        at, taken, open_weight = held.agg(
            F.count_if(full),
            F.coalesce(F.sum(F.when(full, most)), F.lit(0)),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)),
        ).first()
        if at == capped:
            break
        capped, level = at, (total - taken) / open_weight if open_weight else level
    target = F.least(most.cast("double"), F.col("weight") * F.lit(level))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return stage(held.withColumn("target", target).withColumn("rate", rate).drop("weight"), "mix-targets")


def mix(
    df: DataFrame, size: Column, key: Column, weights: Sequence[int] = (1, 2, 3), cap: int = 3, seed: int = 11
) -> DataFrame:
    """``df`` (with a column ``source``) plus mix_size, mix_source_size, mix_target and mix_copies.

    A document is taken floor(rate) times and once more with probability equal to the fraction. That draw is seeded
    by a hash of ``key``: the rows of a source fall by hash into cells of about 4096, and inside a cell, ordered by
    size and hash, row i gets its copy when i * fraction + u passes an integer, u being the cell's hash in [0, 1). So
    each document's chance is the fraction, and a source's total stays near its target even when a few long documents
    hold most of its words. A cell bounds what one task sorts, also for a source with a third of all rows.

    Reruns agree. Null sources are a source of their own; a source without words has target 0 and no copies; null and
    empty texts have size 0; repeated rows are drawn one by one. No rate is above ``cap``. Columns of ``df`` called like
    the added ones are replaced.
    """
    added = ["mix_size", "mix_source_size", "mix_target", "mix_copies"]
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in added])
    return _drawn(df, row, size, key, weights, cap, seed).select("_row.*", *added)


def _drawn(
    df: DataFrame, row: Column, size: Column, key: Column, weights: Sequence[int] = (1, 2, 3), cap: int = 3, seed: int = 11
) -> DataFrame:
    """``row`` of every row of ``df`` as ``_row``, and the columns that ``mix`` adds."""
    hashed = F.xxhash64(key, F.lit(seed)).alias("_h")
    sized = df.select(row.alias("_row"), F.col("source").alias("_own"), size.alias("mix_size"), hashed)
    plan = targets(sized.select(F.col("_own").alias("source"), F.col("mix_size").alias("size")), weights, cap)
    plan = plan.withColumnsRenamed({"source": "_source", "source_size": "mix_source_size", "target": "mix_target"})
    joined = sized.join(plan, F.col("_own").eqNullSafe(F.col("_source")))
    cell = F.pmod(F.col("_h"), F.ceil(F.col("n") / CELL_ROWS))
    start = F.pmod(F.xxhash64("_source", "_cell", F.lit(seed + 1)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    place = F.row_number().over(Window.partitionBy("_source", "_cell").orderBy("mix_size", "_h"))
    whole, fraction = F.floor("rate"), F.col("rate") - F.floor("rate")
    passed = F.floor(F.col("_i") * fraction + F.col("_u")) - F.floor((F.col("_i") - 1) * fraction + F.col("_u"))
    drawn = joined.withColumn("_cell", cell).withColumn("_i", place).withColumn("_u", start)
    return drawn.withColumn("mix_copies", (whole + passed).cast("long"))


def emit(df: DataFrame, **how) -> DataFrame:
    """The mixed corpus itself: every row of ``df`` as many times as the mix takes it, in its own columns."""
    taken = _drawn(df, F.struct("*"), **how).where("mix_copies > 0")
    copies = F.explode(F.sequence(F.lit(1), F.col("mix_copies").cast("int")))
    return taken.select("_row", copies).select("_row.*")
