"""Merkle manifest of a table: blocks of leaves hash their own subtrees, then swap roots in a butterfly of rounds."""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, StructType

from .common import global_rank, stage, whole

BLOCK_LEVELS = 10
STEP = ArrayType(StructType().add("before", "string").add("after", "string"))


def leaf(fields: Sequence[Column]) -> Column:
    """Lowercase hex sha256 of the fields one after the other: "-" if null, else UTF-8 byte count, ":" and value."""

    def told(field: Column) -> Column:
        raw = field.cast("string").cast("binary")
        size = F.concat(F.octet_length(raw).cast("string"), F.lit(":")).cast("binary")
        return F.coalesce(F.concat(size, raw), F.lit(b"-"))

    return F.sha2(F.concat(*[told(f) for f in fields]), 256)


def fold(node: Column | str, proof: Column | str) -> Column:
    """The root that a leaf and the siblings of its ``proof`` lead to."""
    return F.aggregate(
        proof,
        F.col(node) if isinstance(node, str) else node,
        lambda own, step: F.sha2(F.concat(step["before"], own, step["after"]).cast("binary"), 256),
    )


def siblings(proof: Column | str) -> Column:
    """All siblings of a proof as one text, level by level and left to right."""
    return F.array_join(F.transform(proof, lambda step: F.concat(step["before"], step["after"])), "")


def manifest(
    df: DataFrame, key: str, group: str, digest: str, fanout: int = 2, block_levels: int = BLOCK_LEVELS
) -> DataFrame:
    """``df`` with columns ``subroot``, ``root`` and ``proof``; ``digest`` (hex text) is the leaf of a row.

    The leaves of a ``group`` ascend by ``key`` (null first; equal keys by leaf, so that the order of repeated rows does
    not matter), and ``fanout`` neighbours at a time become the sha256 of their digests, the last ones also if fewer,
    until one is left: the subroot (a lone leaf itself). Subroots in order of group (null first, bytewise) give the
    root in the same way. ``proof`` holds per level the siblings before and after the node on the leaf's path, so
    ``fold(leaf, proof)`` is the root of an untouched row.

    1. Leaves are ranked over ranges; ``fanout ** block_levels`` of one group in a row are a block, whose subtree one
       task hashes. A hot group is many blocks; copies of one row are dealt like other rows.
    2. Round by round, every block asks one block under each sibling of its node, the one at its own place there (or
       at its place modulo their number where the tree is ragged), for the digest it holds. All blocks below a node
       hash that node, so at the end each has the root and its own upper proof, and nothing is handed down. A round
       moves ``fanout`` narrow rows a block and is written to shared storage.

    The driver sees the number of rows and groups and the size of the largest group. Columns named subroot, root or
    proof in ``df`` are replaced. An empty table stays empty. A null digest raises an error.
    """
    if fanout < 2 or block_levels < 0:
        raise ValueError("fanout is 2 or more, block_levels 0 or more")
    clean = df.drop("subroot", "root", "proof")
    known = F.coalesce(F.col(digest), F.raise_error(F.lit("a leaf has no digest")).cast("string"))
    rows = clean.select(whole(clean), F.col(group).alias("g"), F.col(key).alias("k"), known.alias("leaf"))
    rows = stage(rows.withColumn("tie", F.monotonically_increasing_id()), "merkle-leaves")
    ranked, _ = global_rank(rows, [F.col(c) for c in ("g", "k", "leaf", "tie")], "at", "merkle")
    ranked = ranked.drop("k", "tie")
    sizes = ranked.groupBy("g").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    groups, n_groups = global_rank(sizes, [F.col("g")], "group_at", "merkle-groups")
    groups = stage(groups, "merkle-sizes")
    block_rows = fanout**block_levels
    at = F.col("at") - F.col("first")
    own = groups.withColumnRenamed("g", "_g")
    placed = ranked.join(own, F.col("g").eqNullSafe(F.col("_g"))).select(
        "_row", "leaf", "group_at", _div(at, block_rows).alias("block"), at.alias("at"), "n"
    )
    shape = placed.select("_row", "group_at", "block", "n").schema.add("inner", STEP).add("top", "string")
    hashed = placed.groupBy("group_at", "block").applyInArrow(_subtree(fanout, block_levels, to_arrow_schema(shape)), shape)
    held = stage(hashed, "merkle-blocks")
    nodes = _butterfly(held, groups, n_groups, fanout, block_rows)
    joined = held.select("_row", "group_at", "block", "inner").join(nodes, ["group_at", "block"])
    return joined.select("_row.*", "subroot", F.col("digest").alias("root"), F.concat("inner", "upper").alias("proof"))


def _butterfly(held: DataFrame, groups: DataFrame, n_groups: int, fanout: int, block_rows: int) -> DataFrame:
    """(group_at, block, subroot, digest, upper) per block, ``digest`` being the root."""
    blocks = lambda n: _div(F.col(n) + (block_rows - 1), block_rows)
    tops = held.groupBy("group_at", "block").agg(F.first("top").alias("digest"), F.first("n").alias("n"))
    nodes = tops.select("group_at", "block", blocks("n").alias("blocks"), "digest", F.array().cast(STEP).alias("upper"))
    nodes = stage(nodes, "merkle-tops")
    most = nodes.agg(F.max("blocks")).first()[0] or 0
    span = 1
    while span < most:
        here = F.lit(span)
        count = _div(F.col("blocks") + (span - 1), span)
        asks = _asks(nodes, F.col("block"), count, span, fanout)
        under = F.least(here, F.col("blocks") - F.col("sibling") * here)
        to = F.col("sibling") * here + F.col("block") % here % under
        nodes = _swapped(asks.select("*", F.col("group_at").alias("to_group"), to.alias("to_block")), nodes)
        span *= fanout
    nodes = nodes.withColumn("subroot", F.col("digest"))
    wide = groups.select(F.col("group_at").alias("to_group"), blocks("n").alias("to_blocks"))
    span = 1
    while span < n_groups:
        here = F.lit(span)
        asks = _asks(nodes, F.col("group_at"), F.lit(-(-n_groups // span)), span, fanout)
        under = F.least(here, F.lit(n_groups) - F.col("sibling") * here)
        to = F.col("sibling") * here + F.col("group_at") % here % under
        asks = asks.withColumn("to_group", to).join(wide, "to_group").withColumn("to_block", F.col("block") % F.col("to_blocks")).drop("to_blocks")
        nodes = _swapped(asks, nodes)
        span *= fanout
    return nodes.drop("blocks")


def _asks(nodes: DataFrame, at: Column, count: Column, span: int, fanout: int) -> DataFrame:
    """``nodes`` once per child of their parent; ``own`` is the number of the child that they hold themselves.

    Nodes of a level with one node only (``count`` 1) rest and ask for themselves alone.
    """
    own = _div(at, span)
    low = own - own % fanout
    rests = count <= 1
    high = F.when(rests, own).otherwise(F.least(low + (fanout - 1), count - 1))
    every = F.sequence(F.when(rests, own).otherwise(low), high)
    return nodes.select("*", own.alias("own"), rests.alias("rests"), F.explode(every).alias("sibling"))


def _swapped(asks: DataFrame, nodes: DataFrame) -> DataFrame:
    """``nodes`` a level higher: what each block has asked for joined, hashed and added to its proof."""
    theirs = nodes.select(F.col("group_at").alias("to_group"), F.col("block").alias("to_block"), F.col("digest").alias("theirs"))
    told = asks.join(theirs, ["to_group", "to_block"])
    kept = [c for c in nodes.columns if c not in ("group_at", "block")]
    met = told.groupBy("group_at", "block").agg(
        F.first(F.struct(*kept, "own", "rests")).alias("mine"),
        F.sort_array(F.collect_list(F.struct("sibling", "theirs"))).alias("run"),
    )

    def side(wanted) -> Column:
        chosen = F.filter("run", lambda x: wanted(x["sibling"], F.col("mine.own")))
        return F.array_join(F.transform(chosen, lambda x: x["theirs"]), "")

    step = F.struct(side(lambda s, own: s < own).alias("before"), side(lambda s, own: s > own).alias("after"))
    met = met.select("group_at", "block", "mine", step.alias("step"))
    above = F.sha2(F.concat("step.before", "mine.digest", "step.after").cast("binary"), 256)
    out = {
        "digest": F.when(F.col("mine.rests"), F.col("mine.digest")).otherwise(above),
        "upper": F.when(F.col("mine.rests"), F.col("mine.upper")).otherwise(F.concat("mine.upper", F.array("step"))),
    }
    columns = [out.get(c, F.col(f"mine.{c}")).alias(c) for c in kept]
    return stage(met.select("group_at", "block", *columns), "merkle-round")


def _div(at: Column, by: int) -> Column:
    return F.floor((at - at % F.lit(by)) / F.lit(by)).cast("long")


def _subtree(fanout: int, block_levels: int, schema: pa.Schema):
    def digest(run: list[str]) -> str:
        return sha256("".join(run).encode()).hexdigest()

    def levels(size: int) -> int:
        """Levels above ``size`` leaves, those of the block at most."""
        found = 0
        while found < block_levels and fanout**found < size:
            found += 1
        return found

    def run(block: pa.Table) -> pa.Table:
        block = block.sort_by("at")
        level: list[str] = block.column("leaf").to_pylist()
        place = np.arange(len(level))
        before, after, steps, offset = [], [], [], 0
        for _ in range(levels(block.column("n")[0].as_py())):
            runs = [level[i : i + fanout] for i in range(0, len(level), fanout)]
            before += ["".join(r[:i]) for r in runs for i in range(len(r))]
            after += ["".join(r[i + 1 :]) for r in runs for i in range(len(r))]
            steps.append(place + offset)
            offset, place = offset + len(level), place // fanout
            level = [digest(r) for r in runs]
        n = block.num_rows
        which = pa.array(np.stack(steps, axis=1).ravel() if steps else np.empty(0, np.int64), pa.int64())
        sides = [pa.array(x, pa.string()).take(which) for x in (before, after)]
        inner = pa.ListArray.from_arrays(
            pa.array(np.arange(n + 1) * len(steps), pa.int32()), pa.StructArray.from_arrays(sides, ["before", "after"])
        )
        kept = block.select(["_row", "group_at", "block", "n"])
        columns = [*kept.columns, inner, pa.array([level[0]] * n, pa.string())]
        return pa.table(columns, names=[*kept.column_names, "inner", "top"]).cast(schema)

    return run
