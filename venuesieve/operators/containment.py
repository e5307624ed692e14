"""Substring join: every (needle, haystack) pair with the needle inside the haystack, as an equi-join.

A needle is looked up by a prefix whose length is a power of two, at most 16. A haystack offers its substrings of those
lengths, as far as a Bloom filter of the needles' prefixes lets them pass; only what is offered becomes a row and is
shuffled. So a needle is one row, a haystack about as many as there are needles that begin alike inside it, and only
pairs that share at least half of a short needle (or 16 characters of a long one) are compared in full.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LENGTHS = (16, 8, 4, 2, 1)
#: Bits of the filter per prefix length, whatever the number of needles: 32 KB each, 160 KB in all.
FILTER_BITS = 1 << 18
_WORD = 64

_PROBE = """
substring(needle, 1, CASE WHEN length(needle) >= 16 THEN 16 WHEN length(needle) >= 8 THEN 8
                          WHEN length(needle) >= 4 THEN 4 WHEN length(needle) >= 2 THEN 2 ELSE 1 END)
"""


def _places(gram: Column) -> list[Column]:
    """The two bits of a gram."""
    mark = F.xxhash64(gram)
    low = F.lit(FILTER_BITS - 1).cast("bigint")
    return [mark.bitwiseAND(low), F.shiftrightunsigned(mark, 32).bitwiseAND(low)]


def gram_filter(probes: DataFrame) -> dict[int, list[int]]:
    """Per prefix length that occurs, the filter's words of 64 bits. ``probes`` has the column ``gram``.

    One aggregate; the driver gets at most 4096 words per length and hands them back as literals of the plan. Beyond
    some 50,000 prefixes of a length most bits are set and the filter lets most substrings pass, as if there were none.
    """
    at = F.explode(F.array(*_places(F.col("gram")))).alias("at")
    bits = probes.select(F.length("gram").alias("n"), at)
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("at") % _WORD).cast("int"))
    words = bits.groupBy("n", (F.col("at") / _WORD).cast("int").alias("word")).agg(F.bit_or(one).alias("bits"))
    filters: dict[int, list[int]] = {}
    for n, word, set_bits in words.collect():
        filters.setdefault(n, [0] * (FILTER_BITS // _WORD))[word] = set_bits
    return filters


def _offered_of(haystack: Column, n: int, bits: list[int]) -> Column:
    """Substrings of ``haystack`` of length ``n`` that pass; a haystack that is shorter offers none."""
    words = F.from_json(F.lit(str(bits)), "array<bigint>")

    def is_set(place: Column) -> Column:
        return F.getbit(F.get(words, (place / _WORD).cast("int")), (place % _WORD).cast("int")) == 1

    def passes(gram: Column) -> Column:
        first, second = _places(gram)
        return is_set(first) & is_set(second)

    starts = F.sequence(F.lit(1), F.length(haystack) - n + 1)
    grams = F.transform(starts, lambda i: F.substring(haystack, i, F.lit(n)))
    return F.when(F.length(haystack) >= n, F.filter(grams, passes)).otherwise(F.array().cast("array<string>"))


def _offered(haystack: Column, filters: dict[int, list[int]]) -> Column:
    """Distinct substrings of ``haystack`` that pass the filter of their length."""
    passed = [_offered_of(haystack, n, filters[n]) for n in LENGTHS if n in filters]
    return F.array_distinct(F.concat(*passed)) if passed else F.array().cast("array<string>")


def offers(haystacks: DataFrame, filters: dict[int, list[int]]) -> DataFrame:
    """``haystacks`` once for each of its substrings ``gram`` that pass."""
    return haystacks.where("haystack <> ''").withColumn("gram", F.explode(_offered(F.col("haystack"), filters)))


def probes(needles: DataFrame) -> DataFrame:
    """``needles`` with the prefix ``gram`` they are looked up by."""
    return needles.where("needle <> ''").withColumn("gram", F.expr(_PROBE))


def containment_pairs(needles: DataFrame, haystacks: DataFrame) -> DataFrame:
    """Pairs of a row with a string ``needle`` and a row with a string ``haystack`` around it; all columns stay.

    ``needles`` is read twice, first for the filter. Empty needles are left out: they lie in everything, so callers count
    them without making pairs.
    """
    wanted = probes(needles)
    found = offers(haystacks, gram_filter(wanted))
    return found.join(wanted, "gram").where(F.contains("haystack", "needle")).drop("gram")


def touching_pairs(left: DataFrame, right: DataFrame, left_col: str, right_col: str) -> DataFrame:
    """Distinct pairs of rows in which either string lies inside the other; all columns stay."""
    forward = containment_pairs(
        left.withColumnRenamed(left_col, "needle"), right.withColumnRenamed(right_col, "haystack")
    ).withColumnsRenamed({"needle": left_col, "haystack": right_col})
    backward = containment_pairs(
        right.withColumnRenamed(right_col, "needle"), left.withColumnRenamed(left_col, "haystack")
    ).withColumnsRenamed({"haystack": left_col, "needle": right_col})
    return forward.unionByName(backward).distinct()
