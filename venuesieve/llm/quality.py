"""Quality by perplexity: an interpolated modified Kneser-Ney model over byte n-grams of trusted text.

N-grams travel packed. A block of texts sends, per shard, its distinct n-grams and how often trusted texts hold them. A
shard is a set of byte pairs: the two bytes before the last of an n-gram decide it, so that an n-gram, its context and
the suffixes down to three bytes lie in one shard, and counts of every order from three on and all back-off are settled
inside it. Below that there are 65,536 byte pairs at most, which are counted once and handed to all.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from hashlib import md5

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from .common import cut, stage, stage_bucketed, whole

ORDER = 6
BLOCK_CHARS = 8 << 20
QUANTILE = 0.995
HELD_OUT = 5
START = b"\n"
PRIOR_BYTES = 100
MOST_SHARDS = 1024
SALT_BLOCKS = 512
_FRACTION = 31
_PAIRS = 1 << 16


def _grams(raw: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram that ends at each byte as a number, first position of each text); texts start after line ends."""
    lengths = np.array([len(r) for r in raw], np.int64)
    padded = np.frombuffer(b"".join(START * (order - 1) + r for r in raw), np.uint8)
    codes = np.zeros(max(0, len(padded) - order + 1), np.uint64)
    for k in range(order):
        codes = (codes << np.uint64(8)) | padded[k : k + len(codes)]
    starts = np.cumsum(lengths + order - 1) - lengths - (order - 1)
    inside = np.zeros(len(codes) + 1, np.int32)
    np.add.at(inside, np.minimum(starts, len(codes)), 1)
    np.add.at(inside, np.minimum(starts + lengths, len(codes)), -1)
    return codes[np.cumsum(inside)[:-1] > 0], np.cumsum(lengths) - lengths


def _pack(values: np.ndarray, width: int) -> bytes:
    """Unsigned integers below 256 ** width as compressed byte planes."""
    planes = np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(-1, 8)[:, :width].T
    return zstandard.compress(planes.tobytes(), 3)


def _unpack(packed: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(packed), np.uint8).reshape(width, -1)
    wide = np.zeros((planes.shape[1], 8), np.uint8)
    wide[:, :width] = planes.T
    return wide.view("<u8").ravel()


def _pack_sorted(values: np.ndarray) -> bytes:
    return _pack(np.diff(values, prepend=np.uint64(0)), 8)


def _unpack_sorted(packed: bytes) -> np.ndarray:
    return np.cumsum(_unpack(packed, 8), dtype=np.uint64)


def _pack_logs(logs: np.ndarray) -> bytes:
    """Log probabilities above -512 as fixed-point numbers; the error is below 2 ** -32."""
    return _pack(np.rint(-logs * (1 << _FRACTION)).astype(np.uint64), 5)


def _unpack_logs(packed: bytes) -> np.ndarray:
    return _unpack(packed, 5).astype(np.float64) / -(1 << _FRACTION)


def _shard_of(gram: np.ndarray, shards: int) -> np.ndarray:
    """By the two bytes before the last one."""
    pair = (gram >> np.uint64(8)) & np.uint64(0xFFFF)
    return ((pair * np.uint64(40503) & np.uint64(0xFFFF)) * np.uint64(shards) >> np.uint64(16)).astype(np.int64)


def _by_shard(gram: np.ndarray, shards: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """(order that sorts ascending n-grams by shard, [(shard, start, stop) in that order])."""
    shard = _shard_of(gram, shards)
    order = np.argsort(shard, kind="stable")
    starts = np.flatnonzero(np.diff(shard[order], prepend=-1))
    stops = np.append(starts, len(order))[1:]
    return order, [(int(shard[order[a]]), int(a), int(b)) for a, b in zip(starts, stops, strict=True)]


def _distinct(raw: list[bytes], order: int) -> np.ndarray:
    return np.unique(np.concatenate([np.unique(_grams(part, order)[0]) for part in _parts(raw)]))


def _counted(raw: list[bytes], order: int, among: np.ndarray) -> np.ndarray:
    """How often each of ``among`` (ascending, with every n-gram of ``raw``) occurs."""
    n = np.zeros(len(among), np.uint64)
    for part in _parts(raw):
        gram, count = np.unique(_grams(part, order)[0], return_counts=True)
        n[np.searchsorted(among, gram)] += count.astype(np.uint64)
    return n


class Corpus:
    """The texts of ``df`` in compressed blocks on shared storage, bucketed by block.

    (block, keys, langs, lengths, texts), and per block which of its texts are trusted and which of those held out.
    """

    def __init__(self, df: DataFrame, trusted: DataFrame, order: int, key: str, text: str, lang: str, block_chars: int):
        self.order, self.kind = order, df.schema[key].dataType
        rows = df.select(F.col(key).alias("key"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
        shape = f"block long, keys array<{self.kind.simpleString()}>, langs array<string>, lengths array<int>, texts binary"
        self.blocks = stage_bucketed(rows.mapInArrow(_collect(self.kind, block_chars), shape), "block", "quality")
        held = (F.pmod(F.xxhash64("key", F.lit(11)), F.lit(HELD_OUT)) == 0).alias("held")
        at = self.blocks.select("block", F.posexplode("keys").alias("i", "key"))
        chosen = at.join(trusted.select("key", held), "key").groupBy("block")
        chosen = chosen.agg(F.collect_list("i").alias("chosen"), F.collect_list(F.when(F.col("held"), F.col("i"))).alias("held"))
        self.marked = self.blocks.join(stage(chosen, "quality-chosen"), "block", "left")
        blocks = self.blocks.count()
        self.shards = min(max(blocks, 16), MOST_SHARDS)
        self.salts = max(1, -(-blocks // SALT_BLOCKS))

    def salt(self, column: str = "block"):
        return F.pmod(F.xxhash64(column), F.lit(self.salts))

    def learned(self) -> DataFrame:
        """(shard, block, grams, n, own): the distinct n-grams of a block's trusted texts in a shard, packed, with their
        counts in those and in the held-out ones among them."""
        rows = self.marked.where("chosen IS NOT NULL").select("block", "lengths", "texts", "chosen", "held")
        return rows.mapInArrow(_learned(self.order, self.shards), "shard int, block long, grams binary, n binary, own binary")

    def asked(self) -> DataFrame:
        """(shard, block, grams, held): all distinct n-grams of a block in a shard, packed, and which of them are in
        held-out texts, a bit each (no bits if none)."""
        rows = self.marked.select("block", "lengths", "texts", "held")
        return rows.mapInArrow(_asked(self.order, self.shards), "shard int, block long, grams binary, held binary")

    def score(self, answers: DataFrame) -> DataFrame:
        """(key, lang, text_md5, n_bytes, perplexity, held_nll) per document; the last one of held-out texts only."""
        told = answers.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("shard", "logs", "held_logs"))).alias("told"))
        shape = f"key {self.kind.simpleString()}, lang string, text_md5 string, n_bytes long, perplexity double, held_nll double"
        rows = self.marked.join(told, "block", "left").drop("chosen")
        return rows.mapInArrow(_scored(self.order, self.shards, self.kind), shape)


def _collect(kind: DataType, block_chars: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows in cut(batches, "text", block_chars):
            raw = [(t or "").encode("utf-8", "surrogatepass") for t in rows["text"]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([block], pa.int64()),
                    pa.array([rows["key"]], pa.list_(to_arrow_type(kind))),
                    pa.array([rows["lang"]], pa.list_(pa.string())),
                    pa.array([[len(r) for r in raw]], pa.list_(pa.int32())),
                    pa.array([zstandard.compress(b"".join(raw), 3)], pa.binary()),
                ],
                ["block", "keys", "langs", "lengths", "texts"],
            )

    return run


def _parts(raw: list[bytes], limit: int = 1 << 20) -> Iterator[list[bytes]]:
    held, size = [], 0
    for r in raw:
        held.append(r)
        size += len(r)
        if size >= limit:
            yield held
            held, size = [], 0
    yield held


def _texts(lengths: list[int], packed: bytes) -> list[bytes]:
    whole = zstandard.decompress(packed)
    ends = np.cumsum([0, *lengths])
    return [whole[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(name)[i].as_py() for name in batch.schema.names}


def _learned(order: int, shards: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            raw = _texts(row["lengths"], row["texts"])
            chosen = [raw[i] for i in row["chosen"]]
            gram = _distinct(chosen, order)
            n = _counted(chosen, order, gram)
            own = _counted([raw[i] for i in row["held"]], order, gram)
            by, spans = _by_shard(gram, shards)
            for shard, a, b in spans:
                at = by[a:b]
                values = [[shard], [row["block"]], [_pack_sorted(gram[at])], [_pack(n[at], 4)], [_pack(own[at], 4)]]
                kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, k) for v, k in zip(values, kinds, strict=True)], ["shard", "block", "grams", "n", "own"]
                )

    return run


def _asked(order: int, shards: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            raw = _texts(row["lengths"], row["texts"])
            gram = _distinct(raw, order)
            held = np.zeros(len(gram), bool)
            if row["held"]:
                held[np.searchsorted(gram, _distinct([raw[i] for i in row["held"]], order))] = True
            by, spans = _by_shard(gram, shards)
            for shard, a, b in spans:
                at = by[a:b]
                bits = np.packbits(held[at]).tobytes() if held[at].any() else b""
                values = [[shard], [row["block"]], [_pack_sorted(gram[at])], [bits]]
                kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, k) for v, k in zip(values, kinds, strict=True)], ["shard", "block", "grams", "held"]
                )

    return run


def _added(grams: list[np.ndarray], *counts: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Distinct n-grams of several lists and the sums of their counts."""
    gram, at = np.unique(np.concatenate(grams), return_inverse=True)
    return gram, *[np.bincount(at, np.concatenate(c).astype(np.float64), len(gram)).astype(np.int64) for c in counts]


def _merged(part: pa.Table) -> pa.Table:
    rows = part.to_pylist()
    lists = [_unpack_sorted(r["grams"]) for r in rows], *[[_unpack(r[c], 4) for r in rows] for c in ("n", "own")]
    gram, n, own = _added(*lists)
    return pa.table({"gram": gram.astype(np.int64), "n": n, "own": own})


def learned(corpus: Corpus) -> DataFrame:
    """(gram, n, own): counts over all trusted texts, and over the held-out ones.

    Packed counts of up to some 512 blocks are added per shard first; what is left is added n-gram by n-gram.
    """
    some = corpus.learned().withColumn("salt", corpus.salt())
    local = some.groupBy("shard", "salt").applyInArrow(_merged, "gram long, n long, own long")
    return stage(local.groupBy("gram").agg(F.sum("n").alias("n"), F.sum("own").alias("own")), "quality-counts")


def _lower(gram: np.ndarray, n: np.ndarray, order: int, least: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """N-grams and counts by order: the highest has its own counts, a lower one the bytes seen before it."""
    tables = {order: (gram, n)}
    for k in range(order - 1, least - 1, -1):
        tables[k] = np.unique(tables[k + 1][0] & np.uint64((1 << 8 * k) - 1), return_counts=True)
    return tables


def _models(gram: np.ndarray, n: np.ndarray, own: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(n-grams, counts) of all trusted texts and of those that are not held out."""
    rest = n - own
    return [(gram, n), (gram[rest > 0], rest[rest > 0])]


def _statistics(order: int):
    """Per shard and model: how many n-grams of each order from three on occur once to four times (value 1 to 4), and in
    how many n-grams of three bytes each byte pair ends (order 2, value: the pair)."""

    def run(shard: pa.Table) -> pa.Table:
        gram, n, own = (shard.column(c).to_numpy() for c in ("gram", "n", "own"))
        by = np.argsort(gram)
        out = []
        for model, (g, c) in enumerate(_models(gram[by].astype(np.uint64), n[by], own[by])):
            tables = _lower(g, c, order, 3)
            for k, (_, counts) in tables.items():
                out += [(model, k, v, int((counts == v).sum())) for v in (1, 2, 3, 4)]
            pair, ends = np.unique(tables[3][0] & np.uint64(0xFFFF), return_counts=True)
            out += [(model, 2, int(p), int(e)) for p, e in zip(pair, ends, strict=True)]
        return pa.table([pa.array(list(x), pa.int64()) for x in zip(*out, strict=True)], names=["model", "k", "value", "n"])

    return run


@dataclass(frozen=True)
class Floor:
    """What all shards share of a model: discounts by order, and the probability of each byte pair's second byte."""

    discounts: dict[int, tuple[float, float, float]]
    pairs: np.ndarray


def _floor(order: int, seen: dict[tuple[int, int], int]) -> Floor:
    """From (order, value) -> number, as ``_statistics`` gives them."""
    discounts = {k: _discounts([seen.get((k, v), 0) for v in (1, 2, 3, 4)]) for k in range(3, order + 1)}
    pairs = np.zeros(_PAIRS, np.int64)
    for (k, value), n in seen.items():
        if k == 2:
            pairs[value] = n
    gram = np.flatnonzero(pairs).astype(np.uint64)
    tables = _lower(gram, pairs[gram.astype(np.int64)], 2, 1)
    for k in (1, 2):
        discounts[k] = _discounts([int((tables[k][1] == v).sum()) for v in (1, 2, 3, 4)])
    every = np.arange(_PAIRS, dtype=np.uint64)
    below = np.full(_PAIRS, 1 / 256)
    for k in (1, 2):
        below = _interpolated(every & np.uint64((1 << 8 * k) - 1), tables[k], discounts[k], below)
    return Floor(discounts, below)


def _interpolated(
    wanted: np.ndarray, table: tuple[np.ndarray, np.ndarray], discounts: tuple[float, float, float], below: np.ndarray
) -> np.ndarray:
    """Probability of the last byte of each ``wanted`` n-gram, given that of a lower order."""
    gram, n = table
    if not len(gram):
        return below
    off = np.array(discounts)[np.minimum(n, 3) - 1]
    context = gram >> np.uint64(8)
    first = np.flatnonzero(np.append(True, context[1:] != context[:-1]))
    total, left = np.add.reduceat(n, first).astype(np.float64), np.add.reduceat(off, first)
    at = np.minimum(np.searchsorted(gram, wanted), len(gram) - 1)
    own = np.where(gram[at] == wanted, np.maximum(n[at] - off[at], 0.0), 0.0)
    here = np.minimum(np.searchsorted(context[first], wanted >> np.uint64(8)), len(first) - 1)
    known = context[first][here] == wanted >> np.uint64(8)
    return np.where(known, (own + left[here] * below) / total[here], below)


def _logs(wanted: np.ndarray, model: tuple[np.ndarray, np.ndarray], order: int, floor: Floor) -> np.ndarray:
    tables = _lower(*model, order, 3)
    p = floor.pairs[(wanted & np.uint64(0xFFFF)).astype(np.int64)]
    for k in range(3, order + 1):
        p = _interpolated(wanted & np.uint64((1 << 8 * k) - 1), tables[k], floor.discounts[k], p)
    return np.log(p)


def _answered(order: int, floors: list[Floor]):
    def run(asked: pa.Table, counts: pa.Table) -> pa.Table:
        gram, n, own = (counts.column(c).to_numpy() for c in ("gram", "n", "own"))
        by = np.argsort(gram)
        full, rest = _models(gram[by].astype(np.uint64), n[by], own[by])
        rows = asked.to_pylist()
        wanted = [_unpack_sorted(r["grams"]) for r in rows]
        marks = [np.unpackbits(np.frombuffer(r["held"], np.uint8), count=len(w)) if r["held"] else None for w, r in zip(wanted, rows, strict=True)]
        held = [w[:0] if m is None else w[m > 0] for w, m in zip(wanted, marks, strict=True)]
        told = []
        for lists, model, floor in ((wanted, full, floors[0]), (held, rest, floors[1])):
            distinct = np.unique(np.concatenate(lists)) if lists else np.empty(0, np.uint64)
            logs = _logs(distinct, model, order, floor)
            told.append([_pack_logs(logs[np.searchsorted(distinct, x)]) for x in lists])
        return pa.table(
            {
                "shard": pa.array([r["shard"] for r in rows], pa.int32()),
                "block": pa.array([r["block"] for r in rows], pa.int64()),
                "logs": pa.array(told[0], pa.binary()),
                "held_logs": pa.array(told[1], pa.binary()),
            }
        )

    return run


def answers(corpus: Corpus, counts: DataFrame) -> DataFrame:
    """(shard, block, logs, held_logs): log probability of the last byte of each n-gram asked after the bytes before it, in
    the order asked; ``held_logs`` of those in held-out texts, under a model of the other trusted texts.

    Interpolated modified Kneser-Ney with three discounts per order. The highest order has the counts themselves, each
    lower one the number of different bytes seen before the n-gram; below single bytes lies the uniform distribution.
    With no trusted text at all every byte has probability 1/256. A shard's counts meet the n-grams of some 512 blocks at
    a time. The driver gets four counts of counts per order and shard, summed, and the byte pairs.
    """
    pair = F.shiftright("gram", 8).bitwiseAND(F.lit(0xFFFF))
    of = F.shiftright((pair * 40503).bitwiseAND(F.lit(0xFFFF)) * corpus.shards, 16).cast("int")
    placed = counts.withColumn("shard", of)
    shape = "model long, k long, value long, n long"
    seen = placed.groupBy("shard").applyInArrow(_statistics(corpus.order), shape)
    seen = seen.groupBy("model", "k", "value").agg(F.sum("n").alias("n")).collect()
    floors = [_floor(corpus.order, {(r["k"], r["value"]): r["n"] for r in seen if r["model"] == m}) for m in (0, 1)]
    every = placed.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(corpus.salts - 1).cast("long"))))
    asked = corpus.asked().withColumn("salt", corpus.salt())
    met = asked.groupBy("shard", "salt").cogroup(every.groupBy("shard", "salt"))
    return met.applyInArrow(_answered(corpus.order, floors), "shard int, block long, logs binary, held_logs binary")


def _scored(order: int, shards: int, kind: DataType):
    def in_order(gram: np.ndarray, told: list[dict], name: str) -> np.ndarray:
        """Log probabilities of ascending n-grams from what each shard has told."""
        by, spans = _by_shard(gram, shards)
        logs, known = np.empty(len(gram)), {t["shard"]: t[name] for t in told}
        for shard, a, b in spans:
            logs[by[a:b]] = _unpack_logs(known[shard])
        return logs

    def sums(raw: list[bytes], gram: np.ndarray, logs: np.ndarray) -> list[float]:
        out = []
        for part in _parts(raw):
            codes, starts = _grams(part, order)
            distinct, at = np.unique(codes, return_inverse=True)
            so_far = np.concatenate([[0.0], np.cumsum(logs[np.searchsorted(gram, distinct)][at])])
            ends = np.append(starts[1:], len(codes)) if len(starts) else starts
            out += (so_far[ends] - so_far[starts]).tolist()
        return out

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            raw, told = _texts(row["lengths"], row["texts"]), row["told"] or []
            gram = _distinct(raw, order)
            score = np.array(sums(raw, gram, in_order(gram, told, "logs")))
            held_nll = np.full(len(raw), np.nan)
            if held := sorted(row["held"] or []):
                some = [raw[i] for i in held]
                gram = _distinct(some, order)
                held_nll[held] = -np.array(sums(some, gram, in_order(gram, told, "held_logs")))
            size = np.array(row["lengths"])
            with np.errstate(divide="ignore", invalid="ignore"):
                perplexity, held_nll = np.exp(-score / size), held_nll / size
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(row["keys"], to_arrow_type(kind)),
                    pa.array(row["langs"], pa.string()),
                    pa.array([md5(r).hexdigest() for r in raw], pa.string()),
                    pa.array(size, pa.int64()),
                    pa.array(perplexity, pa.float64(), mask=size == 0),
                    pa.array(held_nll, pa.float64(), mask=~np.isfinite(held_nll)),
                ],
                ["key", "lang", "text_md5", "n_bytes", "perplexity", "held_nll"],
            )

    return run


def _discounts(seen: list[int]) -> tuple[float, float, float]:
    """The three discounts from how many n-grams occur once to four times; fixed ones where those counts give none."""
    n1, n2, n3, n4 = seen
    if not (n1 and n2 and n3 and n4):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    found = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3
    return tuple(min(max(f, 0.05), i + 0.95) for i, f in enumerate(found))


def classify(
    df: DataFrame,
    trusted: DataFrame,
    quantile: float = QUANTILE,
    order: int = ORDER,
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """(key, lang, text_md5, n_bytes, perplexity, adjusted, threshold, accepted) for every row of ``df``.

    The model has n-grams of ``order`` (3 to 7) bytes. It is trained on all rows of ``df`` whose key is in ``trusted``
    (column ``key``), and every n-gram of every row is scored; keys are of any type that can be compared. ``adjusted`` is the perplexity after adding 100 bytes (PRIOR_BYTES) of the language's trusted mean,
    so that a text of a few bytes is not judged by chance. The threshold of a language is the
    ``quantile`` of ``adjusted`` among its trusted documents (relative error of the rank 1/10,000). Mean and threshold
    come from the fifth of the trusted documents whose keys hash to it (HELD_OUT), scored by a second model of the
    other four fifths: a text that a model has learned is no measure for one that it has not. A language with too few of
    them to have such a quantile (under 200 for 0.995) takes its mean times the quantile of ``adjusted`` over the mean
    among all languages; one without any takes mean and threshold of all. If either part is empty, all trusted
    documents are judged by the model itself; without trusted documents at all nothing is rejected. Null and empty
    texts have no perplexity and are not accepted. A null language is one of its own. Repeated rows are scored alike; a
    null key is never trusted. Texts are worked on in blocks of some ``block_chars`` characters: larger ones send fewer
    n-grams, smaller ones take less memory.
    """
    if not 3 <= order <= 7:
        raise ValueError("order is 3 to 7 bytes")
    kind = df.schema[key].dataType.simpleString()
    trusted = trusted.select(F.col(key).cast(kind).alias("key")).where("key IS NOT NULL").distinct()
    corpus = Corpus(df, trusted, order, key, text, lang, block_chars)
    counts = learned(corpus)
    scored = stage(corpus.score(answers(corpus, counts)), "quality-scores")
    rest = counts.agg(F.sum(F.col("n") - F.col("own"))).first()[0]
    good = stage(scored.where("held_nll IS NOT NULL").select("lang", "n_bytes", F.col("held_nll").alias("nll")), "quality-trusted")
    if not rest or good.isEmpty():
        known = scored.join(trusted, "key", "left_semi").where("perplexity IS NOT NULL")
        good = stage(known.select("lang", "n_bytes", F.log("perplexity").alias("nll")), "quality-trusted")
    mean = (F.sum(F.col("nll") * F.col("n_bytes")) / F.sum("n_bytes")).alias("mean")
    adjusted = (F.col("nll") * F.col("n_bytes") + F.col("mean") * PRIOR_BYTES) / (F.col("n_bytes") + PRIOR_BYTES)
    upper = lambda x: F.percentile_approx(x, quantile, 10_000)
    all_mean = good.agg(mean).first()[0]
    all_limit = good.withColumn("mean", F.lit(all_mean).cast("double")).agg(upper(F.exp(adjusted))).first()[0]
    means = stage(good.groupBy("lang").agg(mean).withColumnRenamed("lang", "_lang"), "quality-means")
    same = F.col("lang").eqNullSafe(F.col("_lang"))
    placed = good.join(means, same)
    above = F.lit(placed.agg(upper(F.exp(adjusted - F.col("mean")))).first()[0]).cast("double")
    enough = F.count("*") * (1 - quantile) >= 1 - 1e-9
    limit = F.when(enough, upper(F.exp(adjusted))).otherwise(F.exp(F.any_value("mean")) * above).alias("limit")
    limits = placed.groupBy("_lang").agg(F.any_value("mean").alias("mean"), limit)
    joined = scored.join(stage(limits, "quality-limits"), same, "left").withColumn("nll", F.log("perplexity"))
    joined = joined.withColumn("mean", F.coalesce("mean", F.lit(all_mean).cast("double")))
    joined = joined.withColumn("adjusted", F.exp(adjusted))
    threshold = F.coalesce("limit", F.lit(all_limit).cast("double"))
    accepted = F.coalesce(F.col("adjusted") <= threshold, F.col("perplexity").isNotNull())
    return joined.select(
        F.col("key").alias(key),
        F.col("lang").alias(lang),
        "text_md5",
        "n_bytes",
        "perplexity",
        "adjusted",
        threshold.alias("threshold"),
        accepted.alias("accepted"),
    )


def accepted_rows(
    df: DataFrame, trusted: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", **how
) -> DataFrame:
    """The rows of ``df`` that ``classify`` accepts, in their own columns."""
    judged = classify(df, trusted, key=key, text=text, lang=lang, **how)
    out = judged.where(~F.col("accepted")).select(
        F.col(key).alias("out_key"), F.col(lang).alias("out_lang"), F.col("text_md5").alias("out_md5")
    )
    digest = F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("_md5")
    own = df.select(whole(df), F.col(key).alias("_key"), F.col(lang).cast("string").alias("_lang"), digest)
    same = F.col("_key").eqNullSafe(F.col("out_key")) & F.col("_lang").eqNullSafe(F.col("out_lang"))
    return own.join(out.distinct(), same & (F.col("_md5") == F.col("out_md5")), "left_anti").select("_row.*")
