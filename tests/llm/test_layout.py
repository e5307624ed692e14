"""Fill-in-middle, packing and the Merkle manifest against plain versions."""

import hashlib
import random
import re
import tracemalloc
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from venuesieve.llm import fill_middle, merkle, packing
from venuesieve.llm.queries import ORACLES, QUERIES, WORD_TOKENIZER

DATA = "/root/testdata/sf0.001"
TEXTS = [
    None,
    "",
    "\n",
    "\n\n\n",
    "one line",
    "a\nb\nc",
    "a\nb\nc\n",
    "é\nü 中文\n🙂🙂\nß",
    "has <P> in it\nand more",
    "almost <\n<S\nP>\nM>",
    "ends in <",
    "x" * 70_000,
    "\n" * 70_000,
    "line of words\n" * 9_000,
    "中" * 50_000,
]


def sha(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()


def middle_filled(key, text, unit, share, spm_share):
    text = text or ""
    units = list(text) if unit == "char" else re.findall("[^\n]*\n|[^\n]+", text)
    n = len(units)
    digest = hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    if not text or any(m in text for m in fill_middle.MARKS) or h[2] % 100 >= share:
        return key, n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < spm_share:
        return key, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return key, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.mark.parametrize("unit, frame, share", [("line", 1 << 16, 100), ("line", 5, 100), ("char", 7, 60)])
def test_fill_in_middle(spark, unit, frame, share):
    texts = TEXTS if frame > 99 else [t for t in TEXTS if not t or len(t) < 99]
    rows = [(k, t, "clash", i) for k in (None, 1, 2, 2, 35) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, frames string, n int").repartition(3)
    stored = fill_middle.store(df, unit=unit, frame_bytes=frame)
    formed = fill_middle.fill_in_middle(stored, unit=unit, share=share)
    got = fill_middle.digests(formed.withColumn("output", F.col("frames"))).collect()
    want = [middle_filled(k, t, unit, share, 50) for k, t, _, _ in rows]
    told = [(*r[:5], fill_middle.text_of(r["output"]).decode()) for r in got]
    assert sorted(map(repr, told)) == sorted(map(repr, want))
    assert sorted(r["output_sha256"] for r in got) == sorted(sha(w[5].encode()) for w in want)
    assert sorted(r["restored_sha256"] for r in got) == sorted(sha((t or "").encode()) for _, t, _, _ in rows)


def test_fill_in_middle_opens_cut_frames_only(spark):
    df = spark.createDataFrame([(i, "some words\n" * 500) for i in range(8)], "doc_id long, text string")
    stored = fill_middle.store(df, frame_bytes=100)
    kept = {r["key"]: {bytes(f) for f in r["frames"]} for r in stored.collect()}
    for r in fill_middle.fill_in_middle(stored).collect():
        assert len([f for f in r["frames"] if bytes(f) not in kept[r["key"]]]) <= 3 + 4


def test_fill_in_middle_refuses(spark):
    df = spark.createDataFrame([], "doc_id string, text string")
    stored = fill_middle.store(df)
    assert fill_middle.digests(fill_middle.fill_in_middle(stored)).collect() == []
    for marks in (("<P>", "<S>", "<P>"), ("ab", "bc", "x"), ("a", "", "b"), ("abab", "x", "y"), ("abc", "b", "x")):
        with pytest.raises(ValueError, match="marks"):
            fill_middle.fill_in_middle(stored, marks=marks)
    with pytest.raises(ValueError, match="unit"):
        fill_middle.store(df, unit="page")


WORDS = [
    *TEXTS,
    "Hello  WORLD, it's 42's\n\n\n fine\tday \x85 x   y",
    "a\x1cb\x1d c -᠎- ​ don't 'twas''s <|endoftext|> x<|startoftext|>y <| endoftext |>",
    "é ́x ΑΣ ΑΣΑ İstanbul ﬁ ＦＵＬＬ",
    "word " * 9_000,
    "\x00 \v\f\r\r\n tail ",
]


@pytest.fixture(scope="module")
def tokenizer(spark):
    return packing.TokenizerFile(spark, public_tokenizers.path(WORD_TOKENIZER))


def test_pieces_equal_library(spark, tokenizer, monkeypatch):
    library = Tokenizer.from_file(public_tokenizers.path(WORD_TOKENIZER))
    rows = [(k, t, "clash", 1) for k, t in enumerate(WORDS)] + [(None, "again", "clash", 1), (3, WORDS[3], "clash", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, piece string, ids int").repartition(3)
    want = []
    for key, text, _, _ in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        for i, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want.append((key, i, at, len(part), np.array(part, "<u4").tobytes()))
    got = [(*r[:4], bytes(r["ids"])) for r in packing.pieces(df, tokenizer).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert packing.pieces(df.limit(0), tokenizer).collect() == []


def test_chunks_are_forgotten_and_long_ones_not_kept(monkeypatch):
    monkeypatch.setattr(packing, "KNOWN_CHUNKS", 3)
    with open(public_tokenizers.path(WORD_TOKENIZER), "rb") as file:
        encoder = packing.Encoder(file.read())
    assert encoder.by_chunk
    for text in ("a b c d e", "b " + "z" * 70 + " a " + "y" * 90, "f a A", "", "  ", "X <|EndOfText|> x<|endoftext|>", "c B a"):
        want = encoder.tokenizer.encode(text, add_special_tokens=False).ids
        assert [x.tolist() for x in encoder.encode([text.encode()] * 2)] == [want, want]
    assert "z" * 70 not in encoder.number


def test_known_chunks_cost_a_batch_nothing():
    """Every batch copied the ids of all chunks known so far, twice."""
    with open(public_tokenizers.path(WORD_TOKENIZER), "rb") as file:
        encoder = packing.Encoder(file.read())
    encoder.encode([" ".join(f"{n:x}" for n in range(50_000)).encode()])
    tracemalloc.start()
    encoder.encode([b"a b c"])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100_000


def test_only_known_tokenizers_are_divided():
    ok = {
        "normalizer": {"type": "Lowercase"},
        "pre_tokenizer": {"type": "Split", "pattern": {"Regex": "[a-z]+|\\S"}, "behavior": "Removed", "invert": True},
        "added_tokens": [],
    }
    assert packing.divisible(ok)
    split = ok["pre_tokenizer"]
    for change in (
        {"normalizer": {"type": "NFKC"}},
        {"pre_tokenizer": None},
        {"pre_tokenizer": split | {"invert": False}},
        {"pre_tokenizer": split | {"pattern": {"Regex": " ?[a-z]+"}}},
        {"pre_tokenizer": split | {"pattern": {"Regex": "[^0-9]+"}}},
        {"pre_tokenizer": split | {"pattern": {"Regex": "[a-z]+(?= )"}}},
        {"added_tokens": [{"lstrip": False, "rstrip": False, "single_word": False, "content": "a b"}]},
    ):
        assert not packing.divisible(ok | change)


def squares(sizes, capacity):
    """The rule word for word: every open bin is tried and the whole sum computed."""
    gaps, used = [], 0
    for size in sizes:
        tries = []
        for gap in sorted({g for g in gaps if g >= size}):
            after = list(gaps)
            after.remove(gap)
            after += [gap - size] if gap > size else []
            count = defaultdict(int)
            for g in after:
                count[g] += 1
            tries.append((sum(c * c for c in count.values()), gap))
        if tries:
            gaps.remove(min(tries)[1])
            gaps += [min(tries)[1] - size] if min(tries)[1] > size else []
        else:
            used += 1
            gaps += [capacity - size] if capacity > size else []
    return used, sorted(gaps)


def test_rule_of_squares():
    rng = random.Random(4)
    for capacity in (5, 12, 30):
        sizes = [rng.randint(1, capacity) for _ in range(120)]
        own = packing.place(np.array(sizes), capacity)
        held = np.bincount(own, sizes)
        assert (len(held), sorted(capacity - held[held < capacity])) == squares(sizes, capacity)


def best_fit(sizes, capacity):
    gaps = []
    for size in sorted(sizes, reverse=True):
        own = min((g for g in gaps if g >= size), default=None)
        if own is not None:
            gaps.remove(own)
        gaps.append((capacity if own is None else own) - size)
    return len(gaps)


@pytest.mark.parametrize("group_rows", [50, 10**6])
def test_pack(spark, group_rows):
    rng = random.Random(8)
    rows = [(i % 9, rng.choice([0, 1, 2, 7, 40, 55, 63, 99, 100]), "x", i) for i in range(700)] + [(None, 100, "x", 0)] * 3
    df = spark.createDataFrame(rows, "doc_id long, length long, `offset` string, at int").repartition(3)
    got = packing.pack(df, capacity=100, group_rows=group_rows).collect()
    assert sorted((r["doc_id"] or -1, r["length"], r["at"]) for r in got) == sorted((k or -1, n, i) for k, n, _, i in rows)
    held = defaultdict(list)
    for r in got:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 100
    assert len(held) <= 1.02 * best_fit([n for _, n, _, _ in rows], 100) + 1


def test_pack_corner_cases(spark):
    df = spark.createDataFrame([(1, 2)], "doc_id long, length long")
    assert packing.pack(df.limit(0)).collect() == []
    for bad in (None, -1, 101):
        with pytest.raises(Exception, match="a size is not in"):
            packing.pack(df.withColumn("length", F.lit(bad).cast("long")), capacity=100).collect()


def test_sequences(spark, tokenizer):
    df = spark.createDataFrame([(i, "some words of a text " * (i * 37 % 90)) for i in range(60)], "doc_id long, text string")
    packed = packing.pack(packing.pieces(df, tokenizer, capacity=64), capacity=64)
    rows = packed.collect()
    whole = {r["sequence_id"]: (r["n_tokens"], bytes(r["ids"])) for r in packing.sequences(packed).collect()}
    assert len(whole) == len({r["sequence_id"] for r in rows})
    for r in rows:
        n, ids = whole[r["sequence_id"]]
        assert len(ids) == 4 * n and ids[4 * r["offset"] : 4 * (r["offset"] + r["length"])] == bytes(r["ids"])


def tree(leaves, fanout):
    levels = [leaves]
    while len(levels[-1]) > 1:
        level = levels[-1]
        levels.append([sha("".join(level[i : i + fanout]).encode()) for i in range(0, len(level), fanout)])
    return levels


def path(levels, i, fanout):
    out = []
    for level in levels[:-1]:
        low = i // fanout * fanout
        out.append(("".join(level[low:i]), "".join(level[i + 1 : low + fanout])))
        i //= fanout
    return out


def plain_manifest(rows, fanout):
    groups = defaultdict(list)
    for key, group, digest in rows:
        groups[group].append((key, digest))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    trees = {g: tree([d for _, d in groups[g]], fanout) for g in order}
    top = tree([trees[g][-1][0] for g in order], fanout)
    return [
        (key, g, digest, trees[g][-1][0], top[-1][0], path(trees[g], i, fanout) + path(top, order.index(g), fanout))
        for g in order
        for i, (key, digest) in enumerate(groups[g])
    ]


@pytest.mark.parametrize("fanout, block_levels", [(2, 10), (2, 0), (2, 2), (3, 1), (5, 1)])
def test_manifest(spark, fanout, block_levels):
    rng = random.Random(fanout)
    rows = []
    for group, n in ((None, 3), ("", 1), ("b", 41), ("a", 16), ("é", 9), ("z", 2)):
        rows += [(rng.choice([None, *range(30)]), group, sha(bytes([rng.randint(0, 9)]))) for _ in range(n)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "k long, g string, leaf string, root int, n int").repartition(3)
    proved = merkle.manifest(df, "k", "g", "leaf", fanout, block_levels)
    found = proved.withColumn("again", merkle.fold("leaf", "proof")).collect()
    told = [(r["k"], r["g"], r["leaf"], r["subroot"], r["root"], [tuple(s) for s in r["proof"]]) for r in found]
    assert sorted(map(repr, told)) == sorted(map(repr, plain_manifest(rows, fanout)))
    assert all(r["again"] == r["root"] for r in found)


def test_manifest_corner_cases(spark):
    df = spark.createDataFrame([("x", "g", sha(b"1"))], "k string, g string, leaf string")
    assert merkle.manifest(df.limit(0), "k", "g", "leaf").collect() == []
    (only,) = merkle.manifest(df, "k", "g", "leaf").collect()
    assert (only["root"], only["subroot"], only["proof"]) == (sha(b"1"), sha(b"1"), [])
    with pytest.raises(Exception, match="a leaf has no digest"):
        merkle.manifest(df.withColumn("leaf", F.lit(None).cast("string")), "k", "g", "leaf").collect()


def test_leaf(spark):
    df = spark.createDataFrame([(5, None, "é:"), (None, "", None)], "a long, b string, c string")
    got = {r[0] for r in df.select(merkle.leaf([F.col(c) for c in "abc"])).collect()}
    assert got == {sha(b"1:5-" + "3:é:".encode()), sha(b"-0:-")}


@pytest.mark.parametrize("name", ["op11_fill_middle", "op13_merkle"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{DATA}/documents.parquet')")
    frame = QUERIES[name](spark, DATA)
    want = con.execute(f"SELECT {', '.join(frame.columns)} FROM ({ORACLES[name]})").fetchall()
    assert sorted(map(tuple, frame.collect()), key=repr) == sorted(want, key=repr)


def test_packing_query(spark):
    library = Tokenizer.from_file(public_tokenizers.path(WORD_TOKENIZER))
    tokens = {}
    for r in spark.read.parquet(f"{DATA}/documents.parquet").collect():
        tokens[r["doc_id"]] = [*library.encode(r["text"] or "", add_special_tokens=False).ids, 0]
    held, total = defaultdict(int), 0
    for r in QUERIES["op12_packing"](spark, DATA).collect():
        part = tokens[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["start"] == 2048 * r["piece"] and len(part) == r["length"]
        assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
        held[r["sequence_id"]] += r["length"]
        total += r["length"]
    assert total == sum(map(len, tokens.values())) and max(held.values()) <= 2048
    assert len(held) <= -(-total // 2048) + 1
