"""Near-duplicate texts: weighted MinHash signatures from hashed darts, banded joining, exact verification."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, cut, ragged, stage, whole

BATCH_CHARS = 1 << 20
SIGN_TEXTS = 1024
FEW = 64
BLOCK_TEXTS = 1024
WORD = r"(?U)\S"


@dataclass(frozen=True)
class Darts:
    """Signatures of ``bands`` * ``rows`` coordinates; two texts meet if they agree on all rows of a band.

    At similarity 0.8 a band of 5 agrees with probability 0.33, so 24 bands miss 1 pair in 14,000; at 0.9 fewer than
    1 in 10**9.
    """

    words: int = 5
    bands: int = 24
    rows: int = 5
    seed: int = 3


def _mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: a bijection whose bits look random."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _uniform(x: np.ndarray) -> np.ndarray:
    """(0, 1] from hashes."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53


def shingles(texts: list[str | None], words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, weight) of every distinct run of ``words`` words of each text, weighted by how often it occurs.

    Words are split at white space, as they are. A text of fewer words has one shingle of all it has; a null text or
    one without words has none.
    """
    numbers: dict[str, int] = {}
    split = [[numbers.setdefault(w, len(numbers)) for w in (t or "").split()] for t in texts]
    hashes = _hashed(list(numbers))
    owner, found = [], []
    for i, s in enumerate(split):
        if not s:
            continue
        h = hashes[np.array(s)]
        width = min(words, len(h))
        total = np.zeros(len(h) - width + 1, np.uint64)
        for k in range(width):
            total = _mix(total + h[k : k + len(total)] + np.uint64(k + 1))
        found.append(total)
        owner.append(np.full(len(total), i))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    owner, found = np.concatenate(owner), np.concatenate(found)
    order = np.lexsort((found, owner))
    owner, found = owner[order], found[order]
    first = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (found[1:] != found[:-1])]))
    weight = np.diff(np.concatenate([first, [len(found)]]))
    return owner[first], found[first], weight


def _hashed(words: list[str]) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words], np.uint64)


def signatures(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, how: Darts) -> np.ndarray:
    """(n, bands * rows) dart numbers; two sets agree on a coordinate with probability of their weighted Jaccard.

    The plane weight x rank of every element carries random darts of density 1, the same for all sets. A set sees those
    below its element's weight; per coordinate (a hash of the dart) it keeps the one of the lowest rank. Darts are
    thrown by region, weights [0, 1), [1, 2), [2, 4), ..., in the order of their ranks, up to the rank where a set of
    this total weight has about k (ln k + 3) of them for k coordinates. A set with an empty coordinate throws again up
    to twice the rank. So the work is the number of elements plus k log k per set, whatever the weights.
    """
    k = how.bands * how.rows
    out = np.zeros((n, k), np.uint64)
    total = np.bincount(owner, weight, n)
    wanted = np.full(n, k * (np.log(k) + 3.0))
    open_ = total > 0
    while open_.any():
        mine = open_[owner]
        cut_at = np.divide(wanted, total, out=np.zeros(n), where=open_)
        text, rank, dart = _thrown(owner[mine], element[mine], weight[mine], cut_at, how.seed)
        slot = text * k + (dart % np.uint64(k)).astype(np.int64)
        order = np.lexsort((rank, slot))
        slot, dart = slot[order], dart[order]
        first = np.concatenate([[True], slot[1:] != slot[:-1]]) if len(slot) else np.empty(0, bool)
        slot, dart = slot[first], dart[first]
        out.ravel()[slot] = dart
        filled = np.bincount(slot // k, minlength=n)
        open_ &= filled < k
        wanted[open_] *= 2
    return out


def _thrown(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, cut_at: np.ndarray, seed: int):
    text, ranks, darts = [], [], []
    level, low, high = 0, 0.0, 1.0
    while len(owner):
        state = _mix(element ^ np.uint64((seed * 1_000_003 + level + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        own, heavy, rank = owner, weight, np.zeros(len(owner))
        while len(own):
            state = state + np.uint64(0x9E3779B97F4A7C15)
            dart = _mix(state)
            rank = rank - np.log(_uniform(dart)) / (high - low)
            going = rank < cut_at[own]
            own, heavy, rank, state, dart = own[going], heavy[going], rank[going], state[going], dart[going]
            dart = _mix(dart ^ np.uint64(0xD6E8FEB86659FD93))
            seen = low + (high - low) * (1.0 - _uniform(dart)) < heavy
            dart = _mix(dart ^ np.uint64(0xA0761D6478BD642F))
            text.append(own[seen])
            ranks.append(rank[seen])
            darts.append(dart[seen])
        left = weight > high
        owner, element, weight = owner[left], element[left], weight[left]
        level, low, high = level + 1, high, high * 2
    return np.concatenate(text), np.concatenate(ranks), np.concatenate(darts)


def _bands(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, how: Darts) -> np.ndarray:
    """(n, bands) hashes of the signatures' bands.

    A set throws some k log k darts however short its text, so few texts are signed at a time: the darts of a block of
    short texts would fill a task's memory. ``owner`` ascends.
    """
    out = np.empty((n, how.bands), np.uint64)
    for first in range(0, n, SIGN_TEXTS):
        last = min(n, first + SIGN_TEXTS)
        a, b = np.searchsorted(owner, [first, last])
        codes = signatures(owner[a:b] - first, element[a:b], weight[a:b], last - first, how)
        codes = codes.reshape(last - first, how.bands, how.rows)
        bands = np.arange(how.bands, dtype=np.uint64) + np.uint64(1)
        for r in range(how.rows):
            bands = _mix(bands * np.uint64(0x9E3779B97F4A7C15) + codes[:, :, r])
        out[first:last] = bands
    return out


def near_texts(
    df: DataFrame, threshold: float = 0.8, how: Darts = Darts(), key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(key, class_id, text_md5, kept) for every row of ``df``.

    Rows whose texts are equal, or linked by weighted Jaccard similarity of word shingles >= ``threshold``, directly or
    by a chain, are one class; ``class_id`` is its smallest key; ``kept`` marks the row of that key (of equal rows all,
    of rows that share a key but not the text the one with the smallest digest).

    1. Equal texts are merged by MD5, so a group of copies is one text from here on.
    2. Signatures, cut into bands; (band, text) rows of bands that occur once are dropped.
    3. In each band every text is compared with one leader, at first one picked by a hash of text and band, so that
       leaders differ between bands; similar pairs make components. Then again, with texts of other components than the
       leader's and the text with most links as leader, until a round finds no link. A hot band costs as many pairs a
       round as it has texts outside the leader's component.
    4. What is left: a band whose texts are still in several components. There the texts outside the leader's component
       are compared with all texts of other components, except for pairs already compared; in bands of more than 64
       texts by blocks inside tasks, which return only likely pairs. So every two texts that share a band are compared
       or in one component already, and the pairs of a group of copies are never emitted.
    5. Pairs are verified on the exact shingle multisets; components of the links give the classes.

    Null texts and texts without words belong to no group and are kept. Repeated rows are rows of one class. Rows with
    a null key get a null class only if no key of the class is set. Other columns of ``df`` are left out.
    """
    digest = F.md5(F.col(text).cast("binary"))
    rows = df.select(F.col(key).alias("k"), F.when(F.col(text).rlike(WORD), digest).alias("t"))
    texts = df.select(digest.alias("t"), F.col(text).alias("text")).where("t IS NOT NULL")
    rows = stage(rows, "near-rows")
    coded = texts.mapInArrow(_sign(how), "t string, bands array<long>").dropDuplicates(["t"])
    coded = stage(coded, "near-signatures")
    banded = coded.select("t", F.explode("bands").alias("band"))
    sizes = banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    shared = stage(banded.join(sizes, "band"), "near-bands")
    needed = shared.select("t").distinct()
    sets = texts.join(needed, "t", "left_semi").dropDuplicates(["t"])
    sets = stage(sets.mapInArrow(_multisets(how), "t string, s array<long>"), "near-sets")
    state = stage(shared.withColumn("own", F.col("t")).withColumn("degree", F.lit(0).cast("long")), "near-state")
    tested = links = label = None
    while True:
        leader = F.max_by(F.struct("t", "own"), F.struct("degree", F.xxhash64("t", "band"))).alias("leader")
        led = state.join(state.groupBy("band").agg(leader), "band").where(F.col("own") != F.col("leader.own"))
        pairs = _ordered(led.select(F.col("t").alias("x"), F.col("leader.t").alias("y")))
        pairs = stage(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "near-pairs")
        tested = pairs if tested is None else tested.union(pairs)
        new = _similar(pairs, sets, threshold)
        found = new.count()
        if found or label is None:
            links = new if links is None else links.union(new)
            label = components(links, "near")
            state = stage(_state(shared, label, links), "near-state")
        if not found:
            break
    main = F.max_by("own", F.struct("degree", F.xxhash64("t", "band"))).alias("main")
    outside = state.join(state.groupBy("band").agg(main), "band").where("own <> main")
    counts = outside.groupBy("band").agg(F.count("*").alias("n_out"))
    counts = state.groupBy("band").agg(F.count("*").alias("n")).join(counts, "band")
    counts = stage(counts, "near-open")
    outside = stage(outside.select("band", F.col("t").alias("x"), F.col("own").alias("x_own")), "near-outside")
    few = counts.where(F.col("n") <= FEW).select("band")
    small = outside.join(few, "band").join(state.select("band", F.col("t").alias("y"), "own"), "band")
    met = small.where("own <> x_own").select("x", "y").union(_in_blocks(outside, state, counts, sets, threshold))
    rest = stage(_ordered(met).join(tested, ["a", "b"], "left_anti"), "near-rest")
    label = components(links.union(_similar(rest, sets, threshold)), "near-all")
    named = rows.join(label.withColumnRenamed("node", "t"), "t", "left")
    named = stage(named.withColumn("root", F.coalesce("root", "t")), "near-named")
    winner = F.min(F.struct(F.col("k").isNull().alias("none"), "k", "t")).alias("w")
    classes = named.where("root IS NOT NULL").groupBy("root").agg(winner)
    joined = named.join(classes, "root", "left")
    mine = F.col("k").eqNullSafe(F.col("w.k")) & F.col("t").eqNullSafe(F.col("w.t"))
    return joined.select(
        F.col("k").alias(key),
        F.when(F.col("root").isNull(), F.col("k")).otherwise(F.col("w.k")).alias("class_id"),
        F.col("t").alias("text_md5"),
        (F.col("root").isNull() | mine).alias("kept"),
    )


def one_per_class(df: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """One row of every class of ``near_texts``, that of the smallest key, in the columns of ``df``.

    Of rows that share key and text any one stays. Rows without words stay, each of them.
    """
    out = near_texts(df, key=key, text=text, **how).where("NOT kept").select(F.col(key).alias("out_key"), "text_md5")
    digest = F.when(F.col(text).rlike(WORD), F.md5(F.col(text).cast("binary")))
    own = df.select(whole(df), F.col(key).alias("_key"), digest.alias("_md5"))
    same = F.col("_key").eqNullSafe(F.col("out_key")) & (F.col("_md5") == F.col("text_md5"))
    left = own.join(out.distinct(), same, "left_anti")
    single = left.where("_md5 IS NOT NULL").dropDuplicates(["_key", "_md5"])
    return single.union(left.where("_md5 IS NULL")).select("_row.*")


def _in_blocks(outside: DataFrame, state: DataFrame, counts: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs (x, y) of different components in bands of more than ``FEW`` texts that may be similar enough.

    Blocks of texts outside the leader's component meet blocks of all texts of the band inside tasks, as sets of 32-bit
    hashes. A collision can only raise a similarity, so no pair is lost, and only likely ones come out.
    """
    large = counts.where(F.col("n") > FEW)
    brief = sets.select("t", F.transform("s", lambda h: h.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")).alias("s"))
    blocks = {name: F.ceil(F.col(n) / BLOCK_TEXTS) for name, n in (("i", "n_out"), ("j", "n"))}
    deal = lambda name: F.pmod(F.xxhash64("t", "band"), blocks[name])
    every = lambda name: F.explode(F.sequence(F.lit(0).cast("long"), blocks[name] - 1))
    left = outside.select("band", F.col("x").alias("t"), F.col("x_own").alias("own")).join(large, "band")
    left = left.withColumn("i", deal("i")).withColumn("j", every("j")).join(brief, "t")
    right = state.select("band", "t", "own").join(large, "band")
    right = right.withColumn("j", deal("j")).withColumn("i", every("i")).join(brief, "t")
    columns, keys = ["band", "i", "j", "t", "own", "s"], ["band", "i", "j"]
    left, right = (df.select([F.col(c).alias(c) for c in columns]) for df in (left, right))
    grouped = left.groupBy(*keys).cogroup(right.groupBy(*keys))
    return grouped.applyInArrow(_likely(threshold), "x string, y string")


def _likely(threshold: float):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        x, y = left.column("t").to_pylist(), right.column("t").to_pylist()
        found_x, found_y = [], []
        if x and y:
            own_x, own_y = np.array(left.column("own").to_pylist()), np.array(right.column("own").to_pylist())
            lists = right.column("s").combine_chunks()
            size_y = lists.value_lengths().to_numpy()
            values, holder = lists.flatten().to_numpy(), np.repeat(np.arange(len(y)), size_y)
            order = np.argsort(values, kind="stable")
            values, holder = values[order], holder[order]
            for a, own in enumerate(left.column("s").combine_chunks()):
                mine = own.values.to_numpy()
                first = np.searchsorted(values, mine, "left")
                hits = holder[ragged(first, np.searchsorted(values, mine, "right") - first)]
                both = np.bincount(hits, minlength=len(y))
                near = both >= threshold * (len(mine) + size_y - both) - 1e-9
                for b in np.flatnonzero(near & (own_y != own_x[a])):
                    found_x.append(x[a])
                    found_y.append(y[b])
        return pa.table({"x": pa.array(found_x, pa.string()), "y": pa.array(found_y, pa.string())})

    return run


def _ordered(pairs: DataFrame) -> DataFrame:
    """Distinct (a, b), a < b, of pairs (x, y)."""
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _state(shared: DataFrame, label: DataFrame, links: DataFrame) -> DataFrame:
    """(t, band, own, degree): the component of each text so far, and how many links it has."""
    degree = links.select(F.col("a").alias("t")).union(links.select("b")).groupBy("t").agg(F.count("*").alias("degree"))
    known = label.withColumnsRenamed({"node": "t", "root": "own"}).join(degree, "t")
    found = shared.join(known, "t", "left")
    return found.select("t", "band", F.coalesce("own", "t").alias("own"), F.coalesce("degree", F.lit(0)).alias("degree"))


def _similar(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Those of the pairs (a, b) of digests whose weighted Jaccard similarity is >= ``threshold``.

    A multiset is an array of hashes of (shingle, how many times before), so weighted Jaccard is that of sets. Pairs
    whose sizes alone rule it out are dropped before sets are joined to them.
    """
    a, b = (sets.select(F.col("t").alias(x), F.size("s").alias(f"n_{x}")) for x in "ab")
    sized = pairs.join(a, "a").join(b, "b")
    able = F.least("n_a", "n_b") >= F.lit(threshold) * F.greatest("n_a", "n_b")
    a, b = (sets.select(F.col("t").alias(x), F.col("s").alias(f"s_{x}")) for x in "ab")
    both: Column = F.size(F.array_intersect("s_a", "s_b"))
    jaccard = both / (F.col("n_a") + F.col("n_b") - both)
    met = sized.where(able).join(a, "a").join(b, "b")
    return stage(met.where(jaccard >= threshold).select("a", "b"), "near-links")


def _sign(how: Darts):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in cut(batches, "text", BATCH_CHARS):
            sets = shingles(rows["text"], how.words)
            bands = _bands(*sets, len(rows["t"]), how)
            some = np.unique(sets[0])
            kept = bands[some].view(np.int64)
            offsets = pa.array(np.arange(len(some) + 1, dtype=np.int32) * how.bands)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([rows["t"][i] for i in some], pa.string()),
                    pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(kept).ravel())),
                ],
                ["t", "bands"],
            )

    return run


def _multisets(how: Darts):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in cut(batches, "text", BATCH_CHARS):
            owner, element, weight = shingles(rows["text"], how.words)
            ends = np.cumsum(weight)
            nth = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - weight, weight)
            hashed = _mix(np.repeat(element, weight) + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            sizes = np.bincount(owner, weight, len(rows["t"])).astype(np.int32)
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(rows["t"], pa.string()),
                    pa.ListArray.from_arrays(offsets, pa.array(hashed.view(np.int64))),
                ],
                ["t", "s"],
            )

    return run
