"""Running totals per key as a prefix scan in two levels, so that no task holds a key.

The values of a key are cut into buckets. A bucket's total is summed where its rows lie; the totals of a key, one row a
bucket, are summed up in order; inside a bucket the rows are summed up in order and the total before the bucket is added.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BUCKETS = 64


def cut_points(values: DataFrame, column: str, buckets: int = BUCKETS) -> list:
    """Fewer than ``buckets`` values, ascending, that cut ``column`` into parts of about equal weight.

    One aggregate; what reaches the driver is the cuts. Where one value has the weight of several parts, there are
    fewer parts. The cuts decide how work is spread, never what comes out.
    """
    shares = [i / buckets for i in range(1, buckets)]
    found = values.agg(F.percentile_approx(column, shares, 20 * buckets)).first()[0]
    return sorted(set(found or []))


def bucket_of(column: str, cuts: Sequence) -> Column:
    """How many of the ascending ``cuts`` lie at or below ``column``, as a tree of comparisons that compiles to code."""

    def tree(low: int, high: int) -> str:
        if low == high:
            return str(low)
        middle = (low + high) // 2
        return f"IF(`{column}` < {cuts[middle]!r}, {tree(low, middle)}, {tree(middle + 1, high)})"

    return F.expr(tree(0, len(cuts)))


def running_total(
    events: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[str], weight: str, name: str
) -> DataFrame:
    """``events`` with ``name``: the sum of ``weight`` over the rows of a key up to this one in ``order``.

    ``bucket`` numbers the parts of a key and rises with ``order`` (``bucket_of`` its first column); rows that tie in
    ``order`` may come either way round. The widest task holds a bucket of a key, and one row for each bucket of a key
    where totals are summed up. ``events`` is read twice, the first time for totals that are summed before they are
    shuffled. Needs keys without NULLs.
    """
    totals = events.groupBy(*keys, bucket).agg(F.sum(weight).alias("_total"))
    earlier = W.partitionBy(*keys).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_before")
    inside = W.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    summed = events.withColumn(name, F.sum(weight).over(inside))
    joined = summed.join(totals.select(*keys, bucket, before), [*keys, bucket])
    return joined.withColumn(name, F.col(name) + F.col("_before")).drop("_before")
