"""Language ID: a byte convolutional network over fixed-length windows, trained in numpy."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, stage, unused

WINDOW = 128
WIDTHS = (2, 3, 4, 5)
FILTERS = 10
EMBEDDING = 8
SAMPLE_DOCS = 3000
LEAST_DOCS = 24
SAMPLE_WINDOWS = 4
EPOCHS = 5
BATCH = 64
UNKNOWN = "und"
LEAST_SCORE = 0.4

_LETTER = np.array([chr(b).isalpha() if b < 128 else True for b in range(256)], np.float32)


@dataclass
class Network:
    """Bytes -> embedding -> filters of several widths -> maximum over the window -> softmax over ``labels``."""

    labels: list[str]
    embed: np.ndarray  # (256, EMBEDDING)
    kernel: np.ndarray  # (widest * EMBEDDING, filters); a narrow filter has zeros below its width
    bias: np.ndarray
    dense: np.ndarray  # (filters, labels)
    offset: np.ndarray

    def tables(self) -> list[np.ndarray]:
        """Per place in the kernel, what each byte adds to every filter: the convolution as table look-ups."""
        kernel = self.kernel.reshape(-1, EMBEDDING, self.kernel.shape[1])
        return [np.ascontiguousarray(self.embed @ k, np.float32) for k in kernel]

    def probabilities(self, windows: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
        span = WINDOW - len(tables) + 1
        out = np.empty((len(windows), len(self.labels)), np.float32)
        for s in range(0, len(windows), BATCH):
            w = windows[s : s + BATCH]
            z = tables[0][w[:, :span]]
            for place, table in enumerate(tables[1:], 1):
                z += table[w[:, place : place + span]]
            out[s : s + BATCH] = _softmax(np.maximum(z.max(axis=1) + self.bias, 0) @ self.dense + self.offset)
        return out


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def windows_of(raw: bytes) -> np.ndarray:
    """The whole text as (n, WINDOW) bytes, the last window filled up with zeros."""
    n = -(-len(raw) // WINDOW)
    return np.frombuffer(raw.ljust(n * WINDOW, b"\0"), np.uint8).reshape(n, WINDOW)


def train(windows: np.ndarray, classes: np.ndarray, labels: list[str], seed: int = 1) -> Network:
    """Adam on the cross entropy, the same result for the same rows in the same order."""
    rng = np.random.default_rng(seed)
    widest, filters = max(WIDTHS), FILTERS * len(WIDTHS)
    span = WINDOW - widest + 1
    mask = np.zeros((widest, EMBEDDING, len(WIDTHS), FILTERS), np.float32)
    for i, width in enumerate(WIDTHS):
        mask[:width, :, i] = 1
    mask = mask.reshape(widest * EMBEDDING, filters)
    net = Network(
        labels,
        rng.normal(0, 0.5, (256, EMBEDDING)).astype(np.float32),
        rng.normal(0, 0.3, mask.shape).astype(np.float32) * mask,
        np.zeros(filters, np.float32),
        rng.normal(0, 0.3, (filters, len(labels))).astype(np.float32),
        np.zeros(len(labels), np.float32),
    )
    names = ["embed", "kernel", "bias", "dense", "offset"]
    first = {n: np.zeros_like(getattr(net, n)) for n in names}
    second = {n: np.zeros_like(getattr(net, n)) for n in names}
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(windows))
        for s in range(0, len(order), BATCH):
            w, y = windows[order[s : s + BATCH]], classes[order[s : s + BATCH]]
            n = len(w)
            x = net.embed[w]
            x = np.concatenate([x[:, o : o + span] for o in range(widest)], axis=2)
            z = x @ net.kernel
            at = z.argmax(axis=1)  # (n, filters)
            pooled = np.take_along_axis(z, at[:, None, :], axis=1)[:, 0] + net.bias
            hidden = np.maximum(pooled, 0)
            error = _softmax(hidden @ net.dense + net.offset)
            error[np.arange(n), y] -= 1
            error /= n
            back = (error @ net.dense.T) * (pooled > 0)
            seen = x[np.arange(n)[:, None], at]  # (n, filters, widest * EMBEDDING)
            grad = {
                "offset": error.sum(axis=0),
                "dense": hidden.T @ error,
                "bias": back.sum(axis=0),
                "kernel": np.einsum("nf,nfk->kf", back, seen) * mask,
                "embed": np.zeros_like(net.embed),
            }
            shape = (n, filters, widest, EMBEDDING)
            through = (back[:, :, None] * net.kernel.T[None]).reshape(shape)
            places = at[:, :, None] + np.arange(widest)
            np.add.at(grad["embed"], w[np.arange(n)[:, None, None], places], through)
            step += 1
            for name in names:
                first[name] = 0.9 * first[name] + 0.1 * grad[name]
                second[name] = 0.999 * second[name] + 0.001 * grad[name] ** 2
                move = first[name] / (1 - 0.9**step) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)
                setattr(net, name, (getattr(net, name) - 0.01 * move).astype(np.float32))
    return net


def fit(df: DataFrame, allowed: Column, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Network | None:
    """A network from rows of ``df`` that are ``allowed`` and have a text and a language; None if there are none.

    Fitted on a bounded sample: 4 windows, at places that a hash of the key picks, of at most 3,000 documents in equal
    parts by language (SAMPLE_WINDOWS, SAMPLE_DOCS), or of 24 documents of each (LEAST_DOCS) where there are more than 125
    languages; a language with fewer documents brings them all. Those with the lowest hashes of key and text are taken.
    Only the windows reach the driver, 1.5 MB in all, or 12 KB a language.
    """
    rows = df.where(allowed & F.col(lang).isNotNull() & (F.length(text) > 0) & F.col(key).isNotNull())
    rows = rows.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    counts = stage(rows.groupBy("lang").agg(F.count("*").alias("n")), "language-counts")
    each = max(LEAST_DOCS, SAMPLE_DOCS // max(1, counts.count()))
    marked = rows.withColumn("mark", F.pmod(F.xxhash64("key", "text", F.lit(5)), F.lit(1 << 40)))
    # Twice what is wanted, and some more for small languages, before anything is sorted.
    share = F.least(F.lit(1.0), F.lit(2.0 * each + 200) / F.col("n"))
    low = marked.join(counts, "lang").where(F.col("mark") < share * (1 << 40)).dropDuplicates(["lang", "mark"])
    at = F.row_number().over(Window.partitionBy("lang").orderBy("mark"))
    wanted = low.withColumn("at", at).where(F.col("at") <= each).select("key", "text", "lang")
    some = wanted.mapInArrow(_pick, "key string, lang string, windows binary")
    found = some.orderBy("lang", "key", "windows").collect()
    if not found:
        return None
    labels = sorted({r["lang"] for r in found})
    windows = [np.frombuffer(r["windows"], np.uint8).reshape(-1, WINDOW) for r in found]
    classes = np.repeat([labels.index(r["lang"]) for r in found], [len(w) for w in windows])
    return train(np.concatenate(windows), classes, labels)


def _pick(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
            windows = windows_of(text.encode("utf-8", "surrogatepass"))
            rng = np.random.default_rng(np.frombuffer(key.encode(), np.uint8))
            at = rng.permutation(len(windows))[:SAMPLE_WINDOWS]
            out.append(windows[np.sort(at)].tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column("key"), batch.column("lang"), pa.array(out, pa.binary())], ["key", "lang", "windows"]
        )


def predict(df: DataFrame, net: Network | None, text: str = "text", keep_text: bool = False) -> DataFrame:
    """``df`` without ``text`` unless ``keep_text``, plus ``lang_pred`` string and ``score`` double, from the whole text and nothing else.

    All windows of a text go through the network; their probabilities are averaged, each weighted by how many of its
    bytes belong to letters. The best language wins, ties to the first in code point order; ``score`` is its average.
    A null text, or one without a letter, is ``und`` with score 0, and so is every text if there was nothing to learn
    from. Columns lang_pred and score of ``df`` are replaced.
    """
    left_out = {"lang_pred", "score"} | (set() if keep_text else {text})
    own = unused(df, "_text")
    rows = df.select(F.col(text).alias(own), *[c for c in df.columns if c.lower() not in left_out and c != text])
    schema = rows.drop(own).schema.add("lang_pred", "string").add("score", "double")
    if keep_text:
        schema = schema.add(own, "string")
    found = rows.mapInArrow(_predict(net, own, keep_text), schema)
    return found.withColumnRenamed(own, text) if keep_text else found


def recognised_rows(df: DataFrame, net: Network | None, text: str = "text", least: float = LEAST_SCORE) -> DataFrame:
    """The rows of ``df`` whose text has a language with a score of ``least`` or more, in their own columns."""
    own = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    named = predict(own, net, f"c{df.columns.index(text)}", keep_text=True)
    kept = named.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least))
    return kept.select(*own.columns).toDF(*df.columns)


def _predict(net: Network | None, own: str, keep_text: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = net.tables() if net else []
        for batch in slices(batches):
            names, scores = [], []
            for text in batch.column(own).to_pylist():
                name, score = UNKNOWN, 0.0
                if net and text and any(map(str.isalpha, text)):
                    windows = windows_of(text.encode("utf-8", "surrogatepass"))
                    weight = _LETTER[windows].sum(axis=1)
                    mean = weight @ net.probabilities(windows, tables) / weight.sum()
                    name, score = net.labels[int(mean.argmax())], min(1.0, float(mean.max()))
                names.append(name)
                scores.append(score)
            rest = [c for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != own]
            kept = [n for n in batch.schema.names if n != own]
            columns = [*rest, pa.array(names, pa.string()), pa.array(scores, pa.float64())]
            kept += ["lang_pred", "score"]
            if keep_text:
                columns, kept = [*columns, batch.column(own)], [*kept, own]
            yield pa.RecordBatch.from_arrays(columns, kept)

    return run
