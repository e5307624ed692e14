"""Documents into sequences of a fixed number of tokens by the sum-of-squares rule for choosing an open sequence."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from tokenizers import Tokenizer

from .common import ragged, slices, stage, whole

CAPACITY = 2048
GROUP_ROWS = 8192
MOST_TOKENIZER = 64 << 20
KNOWN_CHUNKS = 1_000_000
CHUNK_BYTES = 64
_WHITE = (" ", "\t", "\n", "\r", "\v", "\f")


class TokenizerFile:
    """A tokenizer of the tokenizers library for use in tasks.

    The file is read once on the driver and broadcast; it holds a fixed vocabulary, and more than 64 MB are refused.
    """

    def __init__(self, spark: SparkSession, path: str):
        with open(path, "rb") as file:
            raw = file.read(MOST_TOKENIZER + 1)
        if len(raw) > MOST_TOKENIZER:
            raise ValueError(f"{path} has more than {MOST_TOKENIZER} bytes")
        self.raw: Broadcast = spark.sparkContext.broadcast(raw)

    def encoder(self) -> Encoder:
        return _encoder(self.raw.value)


class _Numbers(dict):
    """Chunks by number in order of arrival. Long ones are not kept: they are listed, as -1, -2, ..."""

    long: list[bytes]

    def __missing__(self, chunk: bytes) -> int:
        if len(chunk) > CHUNK_BYTES:
            self.long.append(chunk)
            return -len(self.long)
        self[chunk] = len(self)
        return self[chunk]


class _Ids:
    """Ids of numbered chunks in arrays that double, so that a batch costs its own chunks and not all that are known."""

    def __init__(self) -> None:
        self.flat, self.starts = np.empty(0, np.uint32), np.zeros(1, np.int64)

    def put(self, at: int, ids: np.ndarray, sizes: np.ndarray) -> None:
        """The ids of chunks ``at``, ``at`` + 1, ... in place of whatever stood there and after."""
        end = at + len(sizes)
        self.starts = _room(self.starts, end + 1)
        self.starts[at + 1 : end + 1] = self.starts[at] + np.cumsum(sizes)
        self.flat = _room(self.flat, int(self.starts[end]))
        self.flat[self.starts[at] : self.starts[end]] = ids

    def of(self, chunks: np.ndarray) -> np.ndarray:
        starts = self.starts[chunks]
        return self.flat[ragged(starts, self.starts[chunks + 1] - starts)]


def _room(values: np.ndarray, size: int) -> np.ndarray:
    """``values`` if it has ``size`` places, else a copy with as many and at least twice those of before."""
    if size <= len(values):
        return values
    grown = np.empty(max(size, 2 * len(values)), values.dtype)
    grown[: len(values)] = values
    return grown


class Encoder:
    """Ids of texts without the special tokens that a template adds.

    Where no token can hold white space or look across it (``divisible``), a text is cut at ASCII white space and each
    distinct chunk is encoded once and remembered, up to a million of them; then the half that came first, and so is the
    more frequent, stays. Otherwise texts are encoded whole. Both give the library's ids.
    """

    def __init__(self, raw: bytes):
        self.tokenizer = Tokenizer.from_buffer(raw)
        parts = json.loads(raw)
        self.by_chunk, self.lowers = divisible(parts), lowers(parts)
        self.added = [t["content"].lower().encode() for t in parts.get("added_tokens", [])]
        self.number = _Numbers()
        self.ids = _Ids()

    def _forget(self) -> None:
        self.number = _Numbers(islice(self.number.items(), len(self.number) // 2))

    def _chunks(self, text: bytes) -> list[bytes]:
        """Lower-cased first where the tokenizer would do it anyway and no added token could come of it."""
        lower = text.lower() if self.lowers else text
        return (text if lower != text and any(t in lower for t in self.added) else lower).split()

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        if not self.by_chunk:
            ids, sizes = self._library(texts)
            return np.split(ids, np.cumsum(sizes)[:-1]) if texts else []
        if len(self.number) > KNOWN_CHUNKS:
            self._forget()
        number, self.number.long = self.number, []
        known = len(number)
        parts = [self._chunks(t) for t in texts]
        lines = [np.fromiter(map(number.__getitem__, p), np.int64, len(p)) for p in parts]
        self.ids.put(known, *self._library([*islice(number, known, None)]))
        self.ids.put(len(number), *self._library(number.long))
        return [self.ids.of(np.where(line < 0, len(number) - 1 - line, line)) for line in lines]

    def _library(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many each has."""
        coded = self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)
        ids = [c.ids for c in coded]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum())), sizes


@lru_cache(2)
def _encoder(raw: bytes) -> Encoder:
    return Encoder(raw)


def lowers(tokenizer: dict) -> bool:
    """Whether ASCII capitals may be lower-cased before the tokenizer sees them: a normalizer does it by character."""
    parts = tokenizer.get("normalizer") or {}
    return {"type": "Lowercase"} in parts.get("normalizers", [parts])


def divisible(tokenizer: dict) -> bool:
    """Whether a text may be cut at ASCII white space: told from the parts of the tokenizer, no if in doubt.

    Normalizers have to leave it alone or squeeze it, the split has to drop it (its matches are the tokens, and none
    spans or looks at white space), and no added token may hold it or strip it.
    """
    parts = tokenizer.get("normalizer") or {"type": "Sequence", "normalizers": []}
    for part in parts.get("normalizers", [parts]):
        squeeze = part["type"] == "Replace" and part["pattern"] == {"Regex": "\\s+"} and part["content"] == " "
        if not squeeze and part["type"] not in ("NFC", "Lowercase"):
            return False
    parts = tokenizer.get("pre_tokenizer") or {}
    first, *rest = parts.get("pretokenizers", [parts])
    if first.get("type") != "Split" or first.get("behavior") != "Removed" or not first.get("invert"):
        return False
    if any(p["type"] != "ByteLevel" or p["add_prefix_space"] or p["use_regex"] for p in rest):
        return False
    added = tokenizer.get("added_tokens", [])
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] or any(w in t["content"] for w in _WHITE) for t in added):
        return False
    pattern = first["pattern"].get("Regex")
    if not pattern or "(?" in pattern or regex.search(r"\\[bBAzZGK]|[\^$](?![^\[]*\])", pattern):
        return False
    tries = [f"{a}{w}{b}" for w in _WHITE for a in ("a", "1", "'", "!", "é", "") for b in ("a", "1", "'s", "!", "é", "")]
    return not any(w in m.group() for t in tries for m in regex.finditer(pattern, t) for w in _WHITE)


def pieces(
    df: DataFrame,
    tokenizer: TokenizerFile,
    end: int = 0,
    capacity: int = CAPACITY,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """(key, piece int, start long, length long, ids binary): the tokens of every row of ``df`` in pieces.

    A document is its ids and the id ``end``; only one of more than ``capacity`` ids is cut, into pieces of ``capacity``
    of which the last may be shorter. ``start`` counts the document's ids before the piece; ``ids`` are little-endian
    unsigned 32-bit integers. A null or empty text is ``end`` alone. Repeated rows and null keys are kept as they are;
    other columns are left out.
    """
    kind = df.schema[key].dataType
    rows = df.select(F.col(key).alias("_key"), F.col(text).cast("binary").alias("_text"))
    shape = f"`{key}` {kind.simpleString()}, piece int, start long, length long, ids binary"
    return rows.mapInArrow(_cut(tokenizer, end, capacity, key, to_arrow_type(kind)), shape)


def pack(df: DataFrame, size: str = "length", capacity: int = CAPACITY, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``df`` with columns ``sequence_id`` and ``offset``: rows of a sequence lie one after the other from 0.

    ``df`` is written once. Its rows are dealt at random into groups of about ``group_rows``, and in every group, the
    largest first, a row goes to the open sequence for which the sum over gaps of (open sequences with that gap) ** 2
    becomes smallest, ties to the smallest gap; a sequence is opened if none has room. A row of ``capacity`` is a
    sequence of its own. Then what sequences hold is packed in the same way, as one item each, over groups of groups,
    until one group is left or a round saves less than a sequence a group. A sequence's id is the number of its first
    row, numbers being unique but else without meaning.

    A size that is null, negative or above ``capacity`` raises an error; rows of size 0 share the sequence they fall
    into. Columns called sequence_id or offset are replaced. An empty table stays empty.
    """
    clean = df.drop("sequence_id", "offset")
    fits = F.col(size).between(0, capacity)
    checked = F.when(fits, F.col(size).cast("long")).otherwise(F.raise_error(F.lit(f"a size is not in 0 ... {capacity}")).cast("long"))
    rows = stage(clean.select(whole(clean), F.monotonically_increasing_id().alias("at"), checked.alias("size")), "pack-rows")
    rows = rows.select("_row", "at", "size")
    alone = F.col("size") == capacity
    items = rows.where(~alone).select("at", "size")
    n, turn, moves, before = items.count(), 0, [], 0
    while n:
        groups = -(-n // group_rows)
        dealt = items.withColumn("group", F.pmod(F.xxhash64("at", F.lit(turn)), F.lit(groups)))
        placed = dealt.groupBy("group").applyInArrow(_packed(capacity), "at long, into long, shift long, held long")
        moves.append(stage(placed, f"pack-round-{turn}"))
        last = moves[-1]
        opened, n = last.agg(F.expr("count_if(at = into)"), F.expr(f"count_if(at = into AND held < {capacity})")).first()
        if groups == 1 or turn and before - opened < groups:
            break
        before = n
        items = last.where(f"at = into AND held < {capacity}").select("at", F.col("held").alias("size"))
        turn += 1
    place = rows.select("_row", "size", F.col("at").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    for i, move in enumerate(moves):
        wanted = move if i == 0 else move.where("at <> into")
        wanted = wanted.select(F.col("at").alias("sequence_id"), "into", "shift")
        place = place.join(wanted, "sequence_id", "left").select(
            "_row",
            F.coalesce("into", "sequence_id").alias("sequence_id"),
            (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"),
        )
    return place.select("_row.*", "sequence_id", "offset")


def sequences(packed: DataFrame, ids: str = "ids") -> DataFrame:
    """(sequence_id, n_tokens, ids): the ids of every sequence of ``pack``, its pieces in order of offset."""
    met = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", F.col(ids).alias("ids")))).alias("run"))
    joined = F.aggregate("run", F.lit(b""), lambda so_far, piece: F.concat(so_far, piece["ids"]))
    return met.select("sequence_id", joined.alias("ids")).select("sequence_id", _tokens("ids").alias("n_tokens"), "ids")


def _tokens(ids: str):
    return (F.octet_length(ids) / 4).cast("long")


def _cut(tokenizer: TokenizerFile, end: int, capacity: int, key: str, kind: pa.DataType):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokenizer.encoder()
        for batch in slices(batches, 256):
            keys, piece, start, length, ids = [], [], [], [], []
            texts = [t or b"" for t in batch.column("_text").to_pylist()]
            for i, coded in enumerate(encoder.encode(texts)):
                full = np.append(coded, np.uint32(end)).astype("<u4")
                for number, at in enumerate(range(0, len(full), capacity)):
                    part = full[at : at + capacity]
                    keys.append(i)
                    piece.append(number)
                    start.append(at)
                    length.append(len(part))
                    ids.append(part.tobytes())
            columns = [
                batch.column("_key").cast(kind).take(pa.array(keys, pa.int64())),
                pa.array(piece, pa.int32()),
                pa.array(start, pa.int64()),
                pa.array(length, pa.int64()),
                pa.array(ids, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, [key, "piece", "start", "length", "ids"])

    return run


def place(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin (0, 1, ...) of every size, in the order given: the sum-of-squares rule over open bins."""
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # by gap
    count = np.zeros(capacity + 1, np.int64)
    bins, out = 0, np.empty(len(sizes), np.int64)
    for i, size in enumerate(sizes.tolist()):
        gaps = np.flatnonzero(count[size:]) + size
        if len(gaps):
            rest = gaps - size
            change = count[rest] - count[gaps] + 1  # half of what the sum gains
            gap = int(gaps[np.where(rest == 0, -count[gaps] + 0.5, change).argmin()]) if size else int(gaps[0])
            own = open_bins[gap].pop()
            count[gap] -= 1
        else:
            gap, own, bins = capacity, bins, bins + 1
        out[i] = own
        if gap > size:
            open_bins[gap - size].append(own)
            count[gap - size] += 1
    return out


def _packed(capacity: int):
    def run(group: pa.Table) -> pa.Table:
        at, size = group.column("at").to_numpy(), group.column("size").to_numpy()
        order = np.lexsort((at, -size))
        at, size = at[order], size[order]
        own = place(size, capacity)
        by = np.argsort(own, kind="stable")
        own, at, size = own[by], at[by], size[by]
        first = np.flatnonzero(np.diff(own, prepend=-1))
        before = np.cumsum(size) - size
        length = np.diff(np.append(first, len(own)))
        held = np.add.reduceat(size, first)
        return pa.table(
            {
                "at": at,
                "into": np.repeat(at[first], length),
                "shift": before - np.repeat(before[first], length),
                "held": np.repeat(held, length),
            }
        )

    return run
