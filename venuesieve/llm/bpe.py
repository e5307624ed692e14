"""Byte-level BPE: distinct pre-tokens are encoded once for the whole corpus and joined back by block and position."""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import pack, ragged, slices, stage_bucketed, unpack

BLOCK_CHARS = 16 << 20
SLICE_TOKENS = 1 << 19
MOST_VOCABULARY = 64 << 20
LONG_TEXT = 1 << 16

# The code points that \s of the split pattern matches.
_SPACE = (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
SPACE = "".join(map(chr, _SPACE))


class Vocabulary:
    """The ranks of a byte-level BPE and its split pattern, for use in tasks.

    ``path`` names a file of lines "base64-token rank". It is read once on the driver and broadcast; it holds a fixed
    vocabulary, whatever the corpus, and more than 64 MB are refused. A pattern that lets a pre-token go on from other
    characters into white space is refused too, as texts are cut there.
    """

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        with open(path, "rb") as file:
            raw = file.read(MOST_VOCABULARY + 1)
        if len(raw) > MOST_VOCABULARY:
            raise ValueError(f"{path} has more than {MOST_VOCABULARY} bytes")
        if crosses(pattern):
            raise ValueError("the pattern has pre-tokens that go on from other characters into white space")
        self.pattern = pattern
        self.raw: Broadcast = spark.sparkContext.broadcast(raw)

    def encoding(self) -> tiktoken.Encoding:
        return _encoding(self.raw.value, self.pattern)

    def encode(self, text: str) -> list[int]:
        """The ids of a text. The library's own search recurses on long white space, so long texts are split here."""
        encoding = self.encoding()
        if len(text) <= LONG_TEXT:
            return encoding.encode_ordinary(text)
        return [i for word in _compiled(self.pattern).findall(text) for i in encoding._encode_single_piece(word)]

    def tokens(self) -> list[bytes]:
        """The bytes of every id."""
        ranks = _ranks(self.raw.value)
        out = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            out[rank] = token
        return out


@lru_cache(4)
def _compiled(pattern: str) -> regex.Pattern:
    return regex.compile(pattern)


def crosses(pattern: str) -> bool:
    """Whether a match has white space behind another character, tried on short texts of every kind of character."""
    others = ["a", "É", "中", "7", "'", "'s", "!", "_", "-", "\x1c", "\u0301", "🙂"]
    tries = [f"{a}{w}{b}" for a in others for w in [*SPACE, "\r\n", "  ", "\n\n"] for b in ("", "a", "1", "!", "\n")]
    inside = regex.compile(f"[^{SPACE}][{SPACE}]")
    return any(inside.search(m) for t in tries for m in _compiled(pattern).findall(t))


@lru_cache(2)
def _ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, raw.splitlines())}


@lru_cache(2)
def _encoding(raw: bytes, pattern: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=_ranks(raw), special_tokens={})


def encode(df: DataFrame, vocabulary: Vocabulary, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens long, ids binary) for every row: the ids as little-endian unsigned 32-bit integers.

    1. Blocks of documents are split into pre-tokens; a block keeps its distinct pre-tokens by position in the block
       and its texts as sequences of those positions.
    2. (block, position, pre-token) rows are exploded and dealt by pre-token, so that equal ones lie side by side and
       each is encoded once. A pre-token occurs once per block at most, so none makes a partition hot.
    3. The codes are joined back by block and put in place of the positions.

    A null text is empty and has no tokens; a text longer than a block makes a block of its own; repeated rows and null
    keys are kept as they are; other columns of ``df`` are left out. An empty table gives no rows.
    """
    kind = df.schema[key].dataType
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    shape = f"block long, keys array<{kind.simpleString()}>, lengths binary, sequence binary, words array<string>, "
    shape += "counts binary"
    blocks = stage_bucketed(rows.mapInArrow(_split(vocabulary.pattern, to_arrow_type(kind)), shape), "block", "bpe")
    words = blocks.select("block", F.posexplode("words").alias("position", "word"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = words.repartition(parts, "word").sortWithinPartitions("word")
    codes = dealt.mapInArrow(_encode_words(vocabulary), "block long, positions binary, sizes binary, ids binary")
    table = codes.groupBy("block").agg(F.collect_list(F.struct("positions", "sizes", "ids")).alias("codes"))
    whole = blocks.drop("words")
    joined = whole.join(table, "block", "left")
    out = f"`{key}` {kind.simpleString()}, n_tokens long, ids binary"
    return joined.mapInArrow(_reassemble(key, to_arrow_type(kind)), out)


def decode(df: DataFrame, vocabulary: Vocabulary, ids: str = "ids") -> DataFrame:
    """``df`` plus ``decoded`` binary: the bytes of the tokens. The token-byte table is the broadcast side of the join.

    Null ids give null; no ids give no bytes; an id that the vocabulary lacks raises an error.
    """
    schema = df.drop("decoded").schema.add("decoded", "binary")
    return df.drop("decoded").mapInArrow(_join_bytes(vocabulary, ids), schema)


class _Block:
    """Texts as sequences of chunks: white space with what follows it up to the next. No pre-token crosses their ends."""

    def __init__(self):
        self.keys: list = []
        self.texts: list[np.ndarray] = []
        self.chunks: dict[str, int] = {}
        self.size = 0

    def add(self, key, found: list[str], size: int) -> None:
        number = self.chunks
        self.keys.append(key)
        self.texts.append(np.array([number.setdefault(c, len(number)) for c in found], np.int32))
        self.size += size

    def row(self, block: int, fine: regex.Pattern, kind: pa.DataType) -> pa.RecordBatch:
        """Distinct pre-tokens in code point order; the sequence names them by how often they occur, ties as listed."""
        words: dict[str, int] = {}
        flat, sizes = array("i"), array("i")
        for chunk in self.chunks:
            found = fine.findall(chunk)
            sizes.append(len(found))
            flat.extend([words.setdefault(w, len(words)) for w in found])
        self.chunks = {}
        listed = sorted(words)
        place = np.empty(len(words), np.int32)
        place[[words[w] for w in listed]] = np.arange(len(words))
        flat, sizes = place[np.frombuffer(flat, np.int32)], np.frombuffer(sizes, np.int32)
        starts = np.cumsum(sizes) - sizes
        lengths = np.array([sizes[t].sum() for t in self.texts], np.int64)
        line = np.concatenate(self.texts)
        self.texts = []
        sequence = flat[ragged(starts[line], sizes[line])]
        counts = np.bincount(sequence, minlength=len(listed))
        rank = np.empty(len(listed), np.int32)
        rank[_by_count(counts)] = np.arange(len(listed))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([block], pa.int64()),
                pa.array([self.keys], pa.list_(kind)),
                pa.array([pack(lengths)], pa.binary()),
                pa.array([pack(rank[sequence])], pa.binary()),
                pa.array([listed], pa.list_(pa.string())),
                pa.array([pack(counts)], pa.binary()),
            ],
            ["block", "keys", "lengths", "sequence", "words", "counts"],
        )


def _by_count(counts: np.ndarray) -> np.ndarray:
    return np.argsort(-counts.astype(np.int64), kind="stable")


def _split(pattern: str, kind: pa.DataType):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fine = regex.compile(pattern)
        chunk = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
        number, held = TaskContext.get().partitionId() << 32, _Block()
        for batch in batches:
            keys, texts = batch.column("key"), batch.column("text")
            for i in range(batch.num_rows):
                text = texts[i].as_py() or ""
                held.add(keys[i].as_py(), chunk.findall(text), len(text))
                if held.size >= BLOCK_CHARS:
                    yield held.row(number, fine, kind)
                    number, held = number + 1, _Block()
        if held.keys:
            yield held.row(number, fine, kind)

    return run


def _encode_words(vocabulary: Vocabulary):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = vocabulary.encoding()
        last, code = None, []
        for batch in batches:
            codes = []
            for word in batch.column("word").to_pylist():
                if word != last:
                    last, code = word, encoding._encode_single_piece(word)
                codes.append(code)
            block = batch.column("block").to_numpy()
            position = batch.column("position").to_numpy()
            out = []
            order = np.argsort(block, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(block[order])) + 1):
                if len(own):
                    mine = [codes[i] for i in own]
                    sizes = np.array([len(c) for c in mine])
                    ids = np.array([i for c in mine for i in c])
                    out.append((int(block[own[0]]), pack(np.diff(position[own], prepend=0)), pack(sizes), pack(ids)))
            kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary()]
            columns = list(zip(*out, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["block", "positions", "sizes", "ids"]
            )

    return run


def _reassemble(key: str, kind: pa.DataType):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                yield from documents(row)

    def documents(row: dict) -> Iterator[pa.RecordBatch]:
        parts = row["codes"] or []
        empty = np.empty(0, np.uint32)
        position = np.concatenate([empty, *[np.cumsum(unpack(p["positions"])) for p in parts]]).astype(np.int64)
        size = np.concatenate([empty, *[unpack(p["sizes"]) for p in parts]]).astype(np.int64)
        ids = np.concatenate([empty, *[unpack(p["ids"]) for p in parts]])
        counts = unpack(row["counts"])
        if len(position) != len(counts):
            raise ValueError(f"block {row['block']} has {len(counts)} words, but {len(position)} codes")
        sizes, starts = np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64)
        sizes[position], starts[position] = size, np.cumsum(size) - size
        often = _by_count(counts)
        sizes, starts = sizes[often], starts[often]
        words = unpack(row["sequence"])
        ends = np.cumsum(unpack(row["lengths"]), dtype=np.int64)
        tokens = np.zeros(len(ends) + 1, np.int64)
        if len(words):
            so_far = np.cumsum(sizes.astype(np.int32)[words], dtype=np.int64)
            tokens[1:] = np.where(ends > 0, so_far[np.maximum(ends, 1) - 1], 0)
            del so_far
        first = 0
        while first < len(ends):
            last = max(first + 1, int(np.searchsorted(tokens, tokens[first] + SLICE_TOKENS, "right")) - 1)
            last = min(last, len(ends))
            own = words[ends[first - 1] if first else 0 : ends[last - 1]]
            raw = ids[ragged(starts[own], sizes[own])].astype("<u4").tobytes()
            at = (tokens[first : last + 1] - tokens[first]) * 4
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(row["keys"][first:last], kind),
                    pa.array(np.diff(tokens[first : last + 1]), pa.int64()),
                    pa.array([raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary()),
                ],
                [key, "n_tokens", "ids"],
            )
            first = last

    return run


def _join_bytes(vocabulary: Vocabulary, ids: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = vocabulary.tokens()
        for batch in slices(batches):
            decoded = [
                None if raw is None else b"".join([tokens[i] for i in np.frombuffer(raw, "<u4").tolist()])
                for raw in batch.column(ids).to_pylist()
            ]
            columns = [*batch.columns, pa.array(decoded, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "decoded"])

    return run
