"""From raw documents to token ids: judged, recognised, without near duplicates, mixed and encoded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from venuesieve.llm import bpe, language, mixing, near_dup, quality
from venuesieve.llm.common import stage, table
from venuesieve.llm.queries import remainder, vocabulary


def accept(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity under the trusted ones (quality 1) stays below their language's threshold."""
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return quality.accepted_rows(docs, trusted)


def recognise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the network knows."""
    return language.recognised_rows(docs, language.fit(docs, remainder("doc_id", 3) != 1))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return near_dup.one_per_class(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix of sources takes them."""
    key = F.xxhash64("doc_id", "text")
    return mixing.emit(docs, size=mixing.words("text"), key=key)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, text): the ids of every document and the text they decode to."""
    own = vocabulary(spark)
    decoded = bpe.decode(bpe.encode(docs, own), own)
    return decoded.select("doc_id", "n_tokens", "ids", F.col("decoded").cast("string").alias("text"))


STAGES = [
    ("quality classifier", accept),
    ("language ID", recognise),
    ("MinHash near-dedup", deduplicate),
    ("mixing sources to target weights", mix),
    ("byte-level BPE encoding and decoding", tokenize),
]

#: Perplexities, the network and the signatures have no SQL counterpart; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name.split()[0].lower()}")
    return docs
