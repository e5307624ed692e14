"""Toxicity: character n-grams scaled by naive Bayes log-count ratios under a linear classifier."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_sample, stage, unused

NGRAMS = (3, 4, 5, 6)
BITS = 20
SAMPLE_DOCS = 6000
BASE = 0x100000001B3
THRESHOLD = 0.3
STEPS = 300


@dataclass
class Model:
    weights: np.ndarray  # per hashed n-gram; zero where it tells nothing
    bias: float

    def score(self, text: str | None) -> float:
        hit = self.weights_at(text)
        return float(1 / (1 + np.exp(-(self.bias + hit.sum()))))

    def weights_at(self, text: str | None) -> np.ndarray:
        found = grams(text)
        return self.weights[np.unique(found[self.weights[found] != 0])]


def grams(text: str | None) -> np.ndarray:
    """Hashed numbers of all n-grams of characters (code points) of the lower-case text, one space before and behind, with
    repeats."""
    padded = f" {(text or '').lower()} ".encode("utf-32-le", "surrogatepass")
    points = np.frombuffer(padded, np.uint32).astype(np.uint64)
    out, code = [], points
    for n in range(2, max(NGRAMS) + 1):
        code = code[:-1] * np.uint64(BASE) + points[n - 1 :] if len(points) >= n else code[:0]
        if n in NGRAMS:
            mixed = (code + np.uint64(n << 56)) * np.uint64(0x9E3779B97F4A7C15)
            mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            out.append((mixed >> np.uint64(64 - BITS)).astype(np.int64))
    return np.concatenate(out)


def log_ratios(counts: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of n-grams that take part, their log-count ratios) from (label, n-gram) documents and documents per label.

    An n-gram takes part if it is in 4 documents and its share of toxic ones lies off the mean by more than five
    standard deviations; the ratio compares smoothed shares of toxic and other documents.
    """
    both = counts.sum(axis=0)
    share = n[1] / n.sum()
    spread = np.sqrt(both * share * (1 - share))
    tells = np.flatnonzero((both >= 4) & (np.abs(counts[1] - both * share) > 5 * spread))
    return tells, np.log(((counts[1][tells] + 1) / (n[1] + 2)) / ((counts[0][tells] + 1) / (n[0] + 2)))


def regress(hits: list[np.ndarray], toxic: np.ndarray, tells: np.ndarray, ratio: np.ndarray) -> Model:
    """Presence of each n-gram in ``tells``, times its log-count ratio, into a logistic regression with L2.

    ``hits`` are the places in ``tells`` of the n-grams of each document.
    """
    n = np.bincount(toxic, minlength=2).astype(float)
    row = np.repeat(np.arange(len(hits)), [len(h) for h in hits])
    column = np.concatenate(hits)
    value = ratio[column]
    weight, bias, y = np.zeros(len(tells)), float(np.log(n[1] / n[0])), toxic.astype(float)
    first, second, first_b, second_b = np.zeros_like(weight), np.zeros_like(weight), 0.0, 0.0
    for step in range(1, STEPS + 1):
        margin = bias + np.bincount(row, weight[column] * value, len(hits))
        error = (1 / (1 + np.exp(-margin)) - y) / len(hits)
        grad = np.bincount(column, error[row] * value, len(weight)) + 1e-3 * weight
        grad_b = error.sum()
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        first_b, second_b = 0.9 * first_b + 0.1 * grad_b, 0.999 * second_b + 0.001 * grad_b**2
        a, b = 1 - 0.9**step, 1 - 0.999**step
        weight -= 0.02 * first / a / (np.sqrt(second / b) + 1e-9)
        bias -= 0.02 * first_b / a / (np.sqrt(second_b / b) + 1e-9)
    whole = np.zeros(1 << BITS, np.float32)
    whole[tells] = weight * ratio
    return Model(whole, float(bias))


def _constant(n: np.ndarray) -> Model:
    return Model(np.zeros(1 << BITS, np.float32), 10.0 if n[1] else -10.0)


def train(texts: list[str | None], toxic: np.ndarray) -> Model:
    """``fit`` for texts at hand."""
    n = np.bincount(toxic, minlength=2).astype(float)
    if not n.all():
        return _constant(n)
    counts, own = np.zeros((2, 1 << BITS)), [np.unique(grams(t)) for t in texts]
    for found, y in zip(own, toxic, strict=True):
        counts[y, found] += 1
    tells, ratio = log_ratios(counts, n)
    return regress([_places(found, tells) for found in own], toxic, tells, ratio)


def _places(found: np.ndarray, tells: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.isin(tells, found, assume_unique=True))


def fit(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """A model from ``labels`` (key, label 0/1; nulls left out) and the texts of ``df``.

    Fitted on a bounded sample: at most 6,000 labelled keys (SAMPLE_DOCS), picked by a hash of the key, and at most
    12,000 of their rows, by a hash of key and text where keys repeat; texts are whole, however long. Tasks turn texts into
    n-gram numbers. The driver gets documents per label and n-gram (2**20 numbers), and then of each text only the
    n-grams that tell something. A key with both labels counts as toxic. With one label only, or none, every text gets
    the score of that label, or 0.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull())
    known = known.groupBy(F.col(key).alias("key")).agg(F.max(label).cast("int").alias("y"))
    chosen = hash_sample(known, "key", SAMPLE_DOCS, 9)
    rows = df.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))
    wanted = rows.join(F.broadcast(chosen), "key")  # SAMPLE_DOCS rows at most
    order = [F.xxhash64("key", "text"), "key", "text"]
    wanted = stage(wanted.orderBy(*order).limit(2 * SAMPLE_DOCS).select("y", "text"), "toxicity-sample")
    sizes = {r["y"]: r["n"] for r in wanted.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n = np.array([sizes.get(0, 0), sizes.get(1, 0)], float)
    if not n.all():
        return _constant(n)
    counts = np.zeros((2, 1 << BITS))
    local = wanted.mapInArrow(_counted, "y int, gram int, n long").groupBy("y", "gram").agg(F.sum("n").alias("n"))
    for batch in local.toArrow().to_batches():
        at = (batch.column("y").to_numpy(), batch.column("gram").to_numpy())
        counts[at] = batch.column("n").to_numpy()
    tells, ratio = log_ratios(counts, n)
    found = wanted.mapInArrow(_hits(tells), "y int, hits array<int>").collect()
    found.sort(key=lambda r: (r["y"], r["hits"]))
    return regress([np.array(r["hits"], np.int64) for r in found], np.array([r["y"] for r in found]), tells, ratio)


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, 1 << BITS), np.int64)
    for batch in batches:
        for y, text in zip(batch.column("y").to_pylist(), batch.column("text").to_pylist(), strict=True):
            counts[y, np.unique(grams(text))] += 1
    y, gram = np.nonzero(counts)
    columns = [pa.array(y, pa.int32()), pa.array(gram, pa.int32()), pa.array(counts[y, gram])]
    yield pa.RecordBatch.from_arrays(columns, ["y", "gram", "n"])


def _hits(tells: np.ndarray):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = [_places(np.unique(grams(t)), tells) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(hits, pa.list_(pa.int32()))], ["y", "hits"])

    return run


def predict(df: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``df`` without ``text``, plus ``score`` double (0 to 1) and ``predicted`` int, from the whole text alone.

    Null and empty texts get the score of a text without any telling n-gram. Columns score and predicted of ``df`` are
    replaced; all others and repeated rows are kept.
    """
    own = unused(df, "_text")
    kept = [c for c in df.columns if c != text and c.lower() not in ("score", "predicted")]
    rows = df.select(F.col(text).alias(own), *kept)
    schema = rows.drop(own).schema.add("score", "double")
    scored = rows.mapInArrow(_score(model, own), schema)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def _score(model: Model, own: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score(t) for t in batch.column(own).to_pylist()]
            kept = [n for n in batch.schema.names if n != own]
            columns = [batch.column(n) for n in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(scores, pa.float64())], [*kept, "score"])

    return run
