"""Fill-in-middle over texts stored as independent zstandard frames: only the frames that a cut falls into are opened."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator, Sequence
from hashlib import sha256

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import slices, stage

FRAME_BYTES = 1 << 16
LEVEL = 1
MARKS = ("<P>", "<S>", "<M>")
UNITS = ("line", "char")


def store(df: DataFrame, key: str = "doc_id", text: str = "text", unit: str = "line", frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """(key, frames, sizes, units, chars) for every row of ``df``, written once and read back.

    ``frames`` are the text's bytes as independent zstandard frames of ``frame_bytes`` at most, cut between characters;
    one after the other they are a valid zstandard stream. ``sizes``, ``units`` and ``chars`` hold bytes, units and code
    points up to the end of each frame. A unit is a line with its line end (what follows the last one is a unit too) or,
    with ``unit="char"``, a code point. A null text is empty; an empty text has no frames. Repeated rows, null keys
    and texts of any length are kept; other columns are left out.
    """
    if unit not in UNITS:
        raise ValueError(f"unit is one of {UNITS}, not {unit!r}")
    if frame_bytes < 4:
        raise ValueError("a frame holds a character, so four bytes at least")
    kind = df.schema[key].dataType
    rows = df.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text"))
    shape = f"key {kind.simpleString()}, frames array<binary>, sizes array<long>, units array<long>, chars array<long>"
    return stage(rows.mapInArrow(_framed(unit, frame_bytes, to_arrow_type(kind)), shape), "fim-frames")


def numbers(key: Column | str, seed: int) -> Column:
    """The first four 8-digit groups of the hex sha256 of "seed:key" as an array of longs; a null key is empty."""
    told = F.coalesce((F.col(key) if isinstance(key, str) else key).cast("string"), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), told).cast("binary"), 256)
    return F.array(*[F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)])


def fill_in_middle(
    stored: DataFrame,
    unit: str = "line",
    seed: int = 7,
    share: int = 100,
    spm_share: int = 50,
    marks: Sequence[str] = MARKS,
) -> DataFrame:
    """(key, n, form, prefix_chars, middle_chars, frames) for every row of ``store`` (same ``unit``).

    Two units, drawn by ``numbers(key, seed)``, end the prefix and the middle; the third number leaves a text plain
    unless its remainder by 100 is below ``share``, the fourth chooses spm below ``spm_share``, else psm. Empty texts and
    texts with a mark in them are plain. psm is P prefix S suffix M middle, spm is S suffix P prefix M middle. ``frames``
    is the output as ordered frames: whole frames of the store are taken as they are, and only the two that hold the
    cuts are opened and closed again. ``n`` counts units; prefix_chars and middle_chars are null if plain. Equal keys get
    equal draws. Marks that could be mistaken for one another across a border are refused.
    """
    raw = [m.encode() for m in marks]
    for a in raw:
        if len(raw) != 3 or not a or any(b.startswith(a[i:]) for b in raw for i in range(1, len(a))) or sum(a in b for b in raw) > 1:
            raise ValueError(f"{marks}: three marks, none of which may end as one begins or lie inside another")
    kind = stored.schema["key"].dataType
    shape = f"key {kind.simpleString()}, n long, form string, prefix_chars long, middle_chars long, frames array<binary>"
    drawn = stored.select("*", numbers("key", seed).alias("drawn"))
    return drawn.mapInArrow(_transformed(unit, share, spm_share, raw, to_arrow_type(kind)), shape)


def digests(formed: DataFrame, marks: Sequence[str] = MARKS) -> DataFrame:
    """``formed`` without its frames, plus output_sha256 and restored_sha256.

    Both stream the ordered frames, one open at a time: the first digests the output, the second what ``restore`` makes
    of the output and its form alone.
    """
    schema = formed.drop("frames").schema.add("output_sha256", "string").add("restored_sha256", "string")
    return formed.mapInArrow(_digested([m.encode() for m in marks]), schema)


def text_of(frames: Iterable[bytes]) -> bytes:
    """The bytes of ordered frames."""
    return b"".join(_opened(frames))


def restore(frames: list[bytes], form: str, marks: Sequence[bytes]) -> Iterator[bytes]:
    """The original text, part by part, of an output: its marks are found and its three parts put in order."""
    if form == "plain":
        yield from _opened(frames)
        return
    order = [marks[i] for i in ((0, 1, 2) if form == "psm" else (1, 0, 2))]
    first, second, third, end = _places(frames, order)
    spans = [(first + len(order[0]), second), (second + len(order[1]), third), (third + len(order[2]), end)]
    prefix, suffix = spans[:2] if form == "psm" else (spans[1], spans[0])
    for a, b in (prefix, spans[2], suffix):
        at = 0
        for frame in frames:
            size = zstandard.frame_content_size(frame)
            if at < b and a < at + size:
                yield _open(frame)[max(0, a - at) : b - at]
            at += size


def _open(frame: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(frame)


def _opened(frames: Iterable[bytes]) -> Iterator[bytes]:
    return map(zstandard.ZstdDecompressor().decompress, frames)


def _places(frames: list[bytes], order: Sequence[bytes]) -> list[int]:
    """Where each mark of ``order`` first occurs after the one before it, and where the output ends."""
    places, held, at, left = [], b"", 0, list(order)
    for raw in _opened(frames):
        held += raw
        while left and (found := held.find(left[0])) >= 0:
            places.append(at + found)
            at, held = at + found + len(left[0]), held[found + len(left[0]) :]
            del left[0]
        keep = min(len(held), len(left[0]) - 1) if left else 0
        at, held = at + len(held) - keep, held[len(held) - keep :]
    if left:
        raise ValueError(f"the output lacks {left[0]!r}")
    return [*places, at + len(held)]


def _ends(raw: bytes, unit: str) -> np.ndarray:
    """Offsets just after each unit that ends in ``raw``, which begins and ends between characters."""
    data = np.frombuffer(raw, np.uint8)
    if unit == "line":
        return np.flatnonzero(data == 10) + 1
    return np.append(np.flatnonzero(_heads(data))[1:], len(data))


def _heads(data: np.ndarray) -> np.ndarray:
    return (data & 0xC0) != 0x80


def _between(raw: bytes, at: int) -> int:
    """The last place up to ``at`` where a character begins; ``at`` itself in bytes that are no UTF-8."""
    for back in range(at, max(at - 4, 0), -1):
        if back == len(raw) or raw[back] & 0xC0 != 0x80:
            return back
    return at


class _Store:
    """One row of the store."""

    def __init__(self, row: dict, unit: str):
        self.frames, self.unit = row["frames"], unit
        self.sizes, self.units, self.chars = ([0, *row[c]] for c in ("sizes", "units", "chars"))

    def has_any(self, marks: Sequence[bytes]) -> bool:
        found, held, reach = re.compile(b"|".join(map(re.escape, marks))), b"", max(map(len, marks)) - 1
        for raw in _opened(self.frames):
            held += raw
            if found.search(held):
                return True
            held = held[len(held) - reach :] if len(held) > reach else held
        return False

    def place(self, k: int) -> tuple[int, int]:
        """(bytes, code points) before the end of unit ``k``; one frame is opened."""
        if k == 0:
            return 0, 0
        if k >= self.units[-1]:
            return self.sizes[-1], self.chars[-1]
        f = bisect_left(self.units, k) - 1
        raw = _open(self.frames[f])
        at = int(_ends(raw, self.unit)[k - self.units[f] - 1])
        return self.sizes[f] + at, self.chars[f] + int(np.count_nonzero(_heads(np.frombuffer(raw[:at], np.uint8))))

    def span(self, a: int, b: int, close: zstandard.ZstdCompressor) -> Iterator[bytes]:
        """Frames of the bytes a ... b - 1."""
        f = max(0, bisect_right(self.sizes, a) - 1)
        while f < len(self.frames) and self.sizes[f] < b:
            low, high = max(a, self.sizes[f]), min(b, self.sizes[f + 1])
            if (low, high) == (self.sizes[f], self.sizes[f + 1]):
                yield self.frames[f]
            elif low < high:
                yield close.compress(_open(self.frames[f])[low - self.sizes[f] : high - self.sizes[f]])
            f += 1


def _framed(unit: str, limit: int, kind: pa.DataType):
    def cut(raw: bytes) -> Iterator[bytes]:
        at = 0
        while at < len(raw):
            stop = _between(raw, min(len(raw), at + limit))
            yield raw[at:stop]
            at = stop

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        close = zstandard.ZstdCompressor(level=LEVEL)
        for batch in slices(batches):
            out: dict[str, list] = {"frames": [], "sizes": [], "units": [], "chars": []}
            for text in batch.column("text"):
                raw = text.as_py() or b""
                frames, size, units, chars = [], [], [], []
                for part in cut(raw):
                    frames.append(close.compress(part))
                    size.append(len(part))
                    units.append(len(_ends(part, unit)))
                    chars.append(int(np.count_nonzero(_heads(np.frombuffer(part, np.uint8)))))
                if raw and unit == "line" and not raw.endswith(b"\n"):
                    units[-1] += 1
                for name, values in zip(out, (frames, size, units, chars), strict=True):
                    out[name].append(values if name == "frames" else np.cumsum(values, dtype=np.int64))
            kinds = [pa.list_(pa.binary()), *[pa.list_(pa.int64())] * 3]
            columns = [pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("key").cast(kind), *columns], ["key", *out])

    return run


def _transformed(unit: str, share: int, spm_share: int, marks: list[bytes], kind: pa.DataType):
    def formed(row: dict, close: zstandard.ZstdCompressor, p: bytes, s: bytes, m: bytes) -> tuple:
        text, (h1, h2, h3, h4) = _Store(row, unit), row["drawn"]
        n = text.units[-1]
        if not n or h3 % 100 >= share or text.has_any(marks):
            return n, "plain", None, None, text.frames
        (a, a_chars), (b, b_chars) = (text.place(k) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
        prefix = [p, *text.span(0, a, close)]
        suffix = [s, *text.span(b, text.sizes[-1], close)]
        middle = [m, *text.span(a, b, close)]
        spm = h4 % 100 < spm_share
        order = [*suffix, *prefix, *middle] if spm else [*prefix, *suffix, *middle]
        return n, "spm" if spm else "psm", a_chars, b_chars - a_chars, order

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        close = zstandard.ZstdCompressor(level=LEVEL)
        closed = [close.compress(m) for m in marks]
        names = ["n", "form", "prefix_chars", "middle_chars", "frames"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.binary())]
        for batch in slices(batches):
            rows = batch.drop_columns(["key"]).to_pylist()
            columns = zip(*[formed(row, close, *closed) for row in rows], strict=True)
            made = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("key").cast(kind), *made], ["key", *names])

    return run


def _digested(marks: list[bytes]):
    def digest(parts: Iterable[bytes]) -> str:
        whole = sha256()
        for part in parts:
            whole.update(part)
        return whole.hexdigest()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = batch.select(["form", "frames"]).to_pylist()
            output = pa.array([digest(_opened(r["frames"])) for r in rows], pa.string())
            restored = pa.array([digest(restore(r["frames"], r["form"], marks)) for r in rows], pa.string())
            rest = batch.drop_columns(["frames"])
            yield pa.RecordBatch.from_arrays(
                [*rest.columns, output, restored], [*rest.schema.names, "output_sha256", "restored_sha256"]
            )

    return run
