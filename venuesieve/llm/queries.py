"""The registered queries of this subpackage: each operator over its whole table, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    bpe,
    fill_middle,
    language,
    merkle,
    mixing,
    near_dup,
    packing,
    quality,
    sharding,
    token_counts,
    topk,
    toxicity,
    vector_dedup,
)
from .common import table
from .oracles import ORACLES

__all__ = ["ORACLES", "QUERIES", "remainder", "vocabulary"]

Query = Callable[[SparkSession, str], DataFrame]
VOCABULARY = "byte_bpe_50k.tiktoken"
WORD_TOKENIZER = "word_bpe_49k.json"
SEPARATOR = 50256


def vocabulary(spark: SparkSession) -> bpe.Vocabulary:
    return bpe.Vocabulary(spark, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def remainder(key: str, by: int) -> Column:
    return F.crc32(F.col(key).cast("string").cast("binary")) % by


def op1_bpe(spark: SparkSession, d: str) -> DataFrame:
    own = vocabulary(spark)
    decoded = bpe.decode(bpe.encode(table(spark, d, "documents"), own), own)
    return decoded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op2_topk(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings").select("vec_id", topk.scaled("embedding").alias("v"))
    return topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), 5)


def op3_mixing(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select(
        "doc_id", "source", mixing.words("text").alias("size"), F.xxhash64("text").alias("content")
    )
    mixed = mixing.mix(rows, F.col("size"), F.xxhash64("doc_id", "content"))
    return mixed.select(
        "doc_id",
        "size",
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        (F.col("size") * F.col("mix_copies")).alias("taken"),
    )


def op4_token_counts(spark: SparkSession, d: str) -> DataFrame:
    files = token_counts.write_files(table(spark, d, "documents"), vocabulary(spark), SEPARATOR)
    return token_counts.keyed(files, token_counts.separator_scan(files, SEPARATOR))


def op5_language(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    net = language.fit(docs, remainder("doc_id", 3) != 1)
    held_out = F.coalesce(remainder("doc_id", 3) == 1, F.lit(False))
    return language.predict(docs.select("doc_id", held_out.alias("held_out"), "text"), net)


def op6_quality(spark: SparkSession, d: str) -> DataFrame:
    trusted = table(spark, d, "labels").where("quality = 1").select("doc_id")
    return quality.classify(table(spark, d, "documents"), trusted, block_chars=2 * quality.BLOCK_CHARS)


def op7_sharding(spark: SparkSession, d: str) -> DataFrame:
    raw = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    rows = table(spark, d, "documents").select(
        "doc_id", (F.octet_length(raw) + 16).cast("long").alias("size"), F.crc32(raw).alias("text_crc32")
    )
    placed = sharding.shuffle_into_shards(rows, [F.col("doc_id"), F.col("text_crc32"), F.col("size")], 40)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op8_near_dup(spark: SparkSession, d: str) -> DataFrame:
    return near_dup.near_texts(table(spark, d, "documents")).select("doc_id", "class_id", "kept")


def op9_toxicity(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    model = toxicity.fit(docs, table(spark, d, "labels").where(remainder("doc_id", 4) != 2))
    held_out = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False))
    return toxicity.predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model)


def op10_vector_dedup(spark: SparkSession, d: str) -> DataFrame:
    return vector_dedup.near_vectors(table(spark, d, "embeddings"))


def op11_fill_middle(spark: SparkSession, d: str) -> DataFrame:
    formed = fill_middle.fill_in_middle(fill_middle.store(table(spark, d, "documents")))
    return fill_middle.digests(formed).withColumnRenamed("key", "doc_id")


def op12_packing(spark: SparkSession, d: str) -> DataFrame:
    tokenizer = packing.TokenizerFile(spark, public_tokenizers.path(WORD_TOKENIZER))
    cut = packing.pieces(table(spark, d, "documents"), tokenizer)
    return packing.pack(cut.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


def op13_merkle(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    own = {c: F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")}
    hit = F.coalesce(remainder("doc_id", 7) == 0, F.lit(False))
    claimed = own | {"n_chars": F.col("n_chars") + hit.cast("int")}
    leaves = docs.select(
        "doc_id", "lang", merkle.leaf([*own.values()]).alias("leaf"), merkle.leaf([*claimed.values()]).alias("claimed")
    )
    proved = merkle.manifest(leaves, "doc_id", "lang", "leaf")
    folded = proved.withColumn("folded_root", merkle.fold("claimed", "proof"))
    return folded.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        F.sha2(merkle.siblings("proof").cast("binary"), 256).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_bpe,
        op2_topk,
        op3_mixing,
        op4_token_counts,
        op5_language,
        op6_quality,
        op7_sharding,
        op8_near_dup,
        op9_toxicity,
        op10_vector_dedup,
        op11_fill_middle,
        op12_packing,
        op13_merkle,
    )
}
