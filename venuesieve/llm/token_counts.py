"""Tokens per document in flat token files: separators are searched by block and stitched by a prefix scan."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .bpe import Vocabulary
from .common import stage

BLOCK_TOKENS = 1 << 20


def write_files(
    df: DataFrame, vocabulary: Vocabulary, separator: int, key: str = "doc_id", text: str = "text", width: int = 2
) -> DataFrame:
    """Encode all documents into flat token files and return them as ``separator_scan`` reads them.

    One file per input partition: the tokens of its documents, each document ended by ``separator``, in blocks of 2**20
    tokens cut without regard to documents. (file long, block long, tokens binary, keys array): ``keys`` holds the keys
    of the documents that end in a block, which the scan does not read. Null and empty texts are a separator alone.
    """
    kind = df.schema[key].dataType
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    shape = f"file long, block long, tokens binary, keys array<{kind.simpleString()}>"
    flat = rows.mapInArrow(_flatten(vocabulary, separator, width, to_arrow_type(kind)), shape)
    return stage(flat, "token-files")


def read_files(spark: SparkSession, path: str, width: int = 2) -> DataFrame:
    """(file string, block long, tokens binary) from flat files of little-endian ids of ``width`` bytes.

    Spark's binaryFile source hands a file over as one row, so files should stay below some 100 MB, as token writers
    cut them. A length that is no multiple of ``width`` raises an error.
    """
    whole = spark.read.format("binaryFile").load(path).select("path", "content")
    return whole.mapInArrow(_slices(width), "file string, block long, tokens binary")


def separator_scan(files: DataFrame, separator: int, width: int = 2) -> DataFrame:
    """(file, doc_index, start, n_tokens, closed): the documents of every token file, in order.

    Each block is searched for ``separator`` at once and on its own. What a block needs from those before it (tokens,
    separators and the place of the last separator) is a prefix scan over one narrow row per block; documents that
    cross blocks are stitched with it. ``n_tokens`` leaves the separator out. Two separators in a row are an empty
    document; tokens after the last separator of a file are a document with closed = false; a file without tokens has
    none. Blocks may come in any order and of any length; other columns are left out.
    """
    found = files.select("file", "block", "tokens").mapInArrow(
        _find(separator, width, to_arrow_type(files.schema["file"].dataType)),
        f"file {files.schema['file'].dataType.simpleString()}, block long, n long, ends array<int>",
    )
    marks = stage(found, "token-marks")
    carry = stage(prefix(marks, F.size("ends"), F.col("n"), F.try_element_at("ends", F.lit(-1))), "token-carry")
    here = marks.drop("n").join(carry, ["file", "block"]).select("*", F.posexplode("ends").alias("i", "end"))
    previous = F.when(F.col("i") > 0, F.col("tokens_before") + F.get("ends", F.col("i") - 1))
    closed = here.select(
        "file",
        (F.col("docs_before") + F.col("i")).alias("doc_index"),
        (F.coalesce(previous, F.col("last_before"), F.lit(-1)) + 1).alias("start"),
        (F.col("tokens_before") + F.col("end")).alias("stop"),
        F.lit(True).alias("closed"),
    )
    ends = carry.groupBy("file").agg(
        F.max(F.col("docs_before") + F.col("docs")).alias("doc_index"),
        (F.coalesce(F.max("last"), F.lit(-1)) + 1).alias("start"),
        F.max(F.col("tokens_before") + F.col("n")).alias("stop"),
        F.lit(False).alias("closed"),
    )
    every = closed.union(ends.where("stop > start"))
    return every.select("file", "doc_index", "start", (F.col("stop") - F.col("start")).alias("n_tokens"), "closed")


def prefix(blocks: DataFrame, docs: Column, n: Column, last: Column) -> DataFrame:
    """One narrow row per (file, block) with the tokens, documents and last separator before it."""
    rows = blocks.select("file", "block", docs.alias("docs"), n.alias("n"), last.alias("at"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    summed = rows.withColumn("tokens_before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    summed = summed.withColumn("docs_before", F.coalesce(F.sum("docs").over(before), F.lit(0)))
    placed = summed.withColumn("last", F.col("tokens_before") + F.col("at"))
    return placed.withColumn("last_before", F.max("last").over(before)).drop("at")


def keyed(files: DataFrame, counts: DataFrame, key: str = "doc_id") -> DataFrame:
    """``counts`` of files made by ``write_files`` with the key of every document."""
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = files.select("file", "block", F.size("keys").alias("docs"))
    carry = sizes.withColumn("docs_before", F.coalesce(F.sum("docs").over(before), F.lit(0))).drop("docs")
    keys = files.select("file", "block", F.posexplode("keys").alias("i", key)).join(carry, ["file", "block"])
    keys = keys.select("file", (F.col("docs_before") + F.col("i")).alias("doc_index"), key)
    return counts.join(keys, ["file", "doc_index"])


def _flatten(vocabulary: Vocabulary, separator: int, width: int, kind: pa.DataType):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, block = TaskContext.get().partitionId(), 0
        held = np.empty(0, f"<u{width}")
        waiting: list[tuple[int, object]] = []  # where each document ends that is not written yet, and its key
        for batch in batches:
            parts, at = [held], len(held)
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = [*vocabulary.encode(text or ""), separator]
                parts.append(np.array(ids, f"<u{width}"))
                waiting.append((at + len(ids) - 1, key))
                at += len(ids)
            held = np.concatenate(parts)
            while len(held) >= BLOCK_TOKENS:
                yield row(file, block, held[:BLOCK_TOKENS], [k for p, k in waiting if p < BLOCK_TOKENS])
                waiting = [(p - BLOCK_TOKENS, k) for p, k in waiting if p >= BLOCK_TOKENS]
                held, block = held[BLOCK_TOKENS:], block + 1
        if len(held):
            yield row(file, block, held, [k for _, k in waiting])

    def row(file: int, block: int, tokens: np.ndarray, keys: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [
                pa.array([file], pa.int64()),
                pa.array([block], pa.int64()),
                pa.array([tokens.tobytes()], pa.binary()),
                pa.array([keys], pa.list_(kind)),
            ],
            ["file", "block", "tokens", "keys"],
        )

    return run


def _slices(width: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = BLOCK_TOKENS * width
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                if len(content) % width:
                    raise ValueError(f"{path}: {len(content)} bytes are no whole tokens")
                for block, at in enumerate(range(0, len(content), size)):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([path], pa.string()),
                            pa.array([block], pa.int64()),
                            pa.array([content[at : at + size]], pa.binary()),
                        ],
                        ["file", "block", "tokens"],
                    )

    return run


def _find(separator: int, width: int, kind: pa.DataType):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, ends = [], []
            for raw in batch.column("tokens").to_pylist():
                tokens = np.frombuffer(raw or b"", f"<u{width}")
                counts.append(len(tokens))
                ends.append(np.flatnonzero(tokens == separator).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("file").cast(kind),
                    batch.column("block"),
                    pa.array(counts, pa.int64()),
                    pa.array(ends, pa.list_(pa.int32())),
                ],
                ["file", "block", "n", "ends"],
            )

    return run
