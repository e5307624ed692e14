"""BPE, token counts, mixing and sharding against plain versions."""

import hashlib
import math
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from venuesieve.llm import bpe, mixing, sharding, token_counts
from venuesieve.llm.common import stage_bucketed
from venuesieve.llm.queries import QUERIES, SEPARATOR, vocabulary

DATA = "/root/testdata/sf0.001"
ODD = [
    (1, "Hello  world, it's 42's\n\n\n fine day \x85 x"),
    (2, ""),
    (3, None),
    (4, "   \t\n"),
    (5, "a\x1cb -᠎- ​ don't 'twas''s"),
    (None, "é ü ß 中文 🙂🙂 " * 3),
    (7, "x" * 70_000),
    (7, "x" * 70_000),
    (8, "word " * 30_000),
]
LONG = [(1, " " * 3_000_000), (2, "\n" * 3_000_000 + "x"), (3, "y" * 300_000), (4, " \t" * 100_000 + "tail  "), (5, "a")]


@pytest.fixture(scope="module")
def words(spark):
    return vocabulary(spark)


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(k, t, "clash", i, None) for i, (k, t) in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int, decoded int").repartition(3)


def test_bpe_equals_library(words, odd):
    coded = bpe.encode(odd, words)
    assert coded.columns == ["doc_id", "n_tokens", "ids"]
    library = words.encoding()
    want = [(k, np.array(library.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for k, t in ODD]
    rows = bpe.decode(coded, words).collect()
    assert sorted(repr((r["doc_id"], bytes(r["ids"]), bytes(r["decoded"]))) for r in rows) == sorted(map(repr, want))
    assert all(r["n_tokens"] * 4 == len(r["ids"]) for r in rows)


def test_very_long_runs(spark, words):
    """The library fails on a million spaces; what it would give is a run of its longest tokens, as on shorter runs."""
    df = spark.createDataFrame(LONG, "doc_id long, text string").repartition(2)
    texts = dict(LONG)
    for r in bpe.decode(bpe.encode(df, words), words).collect():
        assert bytes(r["decoded"]).decode() == texts[r["doc_id"]]
        assert np.frombuffer(r["ids"], "<u4").tolist() == words.encode(texts[r["doc_id"]])
    files = token_counts.write_files(df, words, SEPARATOR)
    counts = token_counts.keyed(files, token_counts.separator_scan(files, SEPARATOR)).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in counts} == {k: len(words.encode(t)) for k, t in LONG}
    library = words.encoding()
    for text in (" " * 200_000, "\n" * 200_000 + "x", "ab " * 70_000, " \t" * 50_000 + "tail  "):
        assert words.encode(text) == library.encode_ordinary(text)


def test_patterns_that_cross_are_refused(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    for pattern in (r"\p{L}+|[^\s\p{L}]+[\r\n]*|\s+", r"\S+\s*|\s+", r"[^a]+|a"):
        with pytest.raises(ValueError, match="white space"):
            bpe.Vocabulary(spark, path, pattern)


def test_bucketed_tables_leave_no_catalogue_entry(spark, odd):
    held = stage_bucketed(odd.select("n_tokens", "text"), "n_tokens", "left")
    assert held.count() == held.join(held.select("n_tokens").distinct(), "n_tokens").count() == odd.count()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("left_")]


def test_bpe_empty_table(words, odd):
    assert bpe.decode(bpe.encode(odd.limit(0), words), words).collect() == []


def test_vocabulary_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(bpe, "MOST_VOCABULARY", 1000)
    with pytest.raises(ValueError, match="more than 1000 bytes"):
        bpe.Vocabulary(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def test_bpe_query(spark, words):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    for r in QUERIES["op1_bpe"](spark, DATA).collect():
        ids = np.array(words.encoding().encode_ordinary(texts[r["doc_id"]]), "<u4").tobytes()
        assert r["ids_sha256"] == hashlib.sha256(ids).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_separators_across_blocks(spark):
    rng = np.random.default_rng(0)
    files = {7: rng.integers(0, 4, 500), 3: np.array([1, 1, 1]), 5: np.array([0, 0]), 9: np.array([], int)}
    rows, want = [], []
    for file, tokens in files.items():
        cuts = np.sort(rng.integers(0, len(tokens) + 1, 20))
        parts = np.split(tokens, cuts)
        rows += [(file, b, bytearray(p.astype("<u2").tobytes()), "x") for b, p in enumerate(parts)]
        start = index = 0
        for i, t in enumerate(tokens):
            if t == 0:
                want.append((file, index, start, i - start, True))
                start, index = i + 1, index + 1
        if start < len(tokens):
            want.append((file, index, start, len(tokens) - start, False))
    df = spark.createDataFrame(rows, "file long, block long, tokens binary, ends string").repartition(5)
    got = [tuple(r) for r in token_counts.separator_scan(df, 0).collect()]
    assert sorted(got) == sorted(want)
    assert token_counts.separator_scan(df.limit(0), 0).collect() == []


def test_flat_files(spark, tmp_path):
    tokens = np.array([5, 6, 0, 7, 0, 0, 9], "<u4")
    (tmp_path / "a.bin").write_bytes(tokens.tobytes())
    files = token_counts.read_files(spark, str(tmp_path), width=4)
    got = sorted((r["doc_index"], r["n_tokens"], r["closed"]) for r in token_counts.separator_scan(files, 0, 4).collect())
    assert got == [(0, 2, True), (1, 1, True), (2, 0, True), (3, 1, False)]


def test_token_counts_of_documents(spark, words, odd):
    files = token_counts.write_files(odd, words, SEPARATOR)
    got = token_counts.keyed(files, token_counts.separator_scan(files, SEPARATOR)).collect()
    want = [(k, len(words.encoding().encode_ordinary(t or ""))) for k, t in ODD]
    assert sorted(repr((r["doc_id"], r["n_tokens"])) for r in got) == sorted(map(repr, want))


def fill(sizes: dict, weights, cap):
    """Targets by sharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, rest, open_ = dict.fromkeys(names, 0.0), float(sum(sizes.values())), set(names)
    while rest > 1e-9 and open_:
        unit = rest / sum(weight[s] for s in open_)
        rest = 0.0
        for s in list(open_):
            target[s] += unit * weight[s]
            if target[s] >= cap * sizes[s]:
                rest += target[s] - cap * sizes[s]
                target[s] = float(cap * sizes[s])
                open_.discard(s)
    return target


def test_mix(spark):
    rng = np.random.default_rng(2)
    sources = ["b", "a", None, "Z", "é", "empty", "tiny"]
    rows = []
    for i in range(6000):
        s = sources[0] if i % 3 == 0 else sources[i % 7]
        rows.append((i, s, 0 if s == "empty" else 1 if s == "tiny" else int(rng.lognormal(4, 1))))
    df = spark.createDataFrame(rows, "doc_id long, source string, size long")
    how = dict(size=F.col("size"), key=F.col("doc_id"))
    got = mixing.mix(df, **how).collect()
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["size"] * r["mix_copies"]
        target[r["source"]] = r["mix_target"]
        assert r["mix_copies"] <= 3
    want = fill(sizes, (1, 2, 3), 3)
    for s in want:
        assert math.isclose(target[s], want[s], rel_tol=1e-9)
        assert abs(taken[s] - want[s]) <= 0.03 * want[s] + 50
    again = mixing.mix(df.repartition(7), **how).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    assert mixing.emit(df, **how).count() == sum(r["mix_copies"] for r in got)
    assert mixing.emit(df, **how).columns == df.columns
    assert mixing.mix(df.limit(0), **how).collect() == []


def test_words(spark):
    rows = [(" a\tb\x0bc d \n", 3), ("", 0), (None, 0), ("\t\n", 0), ("x", 1)]
    df = spark.createDataFrame(rows, "t string, n long").withColumn("got", mixing.words("t"))
    assert all(r["got"] == r["n"] for r in df.collect())


@pytest.mark.parametrize("total", [1, 2, 3, 17, 100, 1000, 4097])
def test_permutation_is_a_bijection(spark, total):
    rows = spark.range(total).select("id", sharding.permuted(F.col("id"), total, 7).alias("to")).collect()
    assert sorted(r["to"] for r in rows) == list(range(total))
    if total > 500:
        assert abs(np.corrcoef([r["id"] for r in rows], [r["to"] for r in rows])[0, 1]) < 0.1


def test_shards(spark):
    rows = [(i // 2, "t") for i in range(101)] + [(None, "n")] * 3
    df = spark.createDataFrame(rows, "doc_id long, shard string")
    place = lambda d: sharding.shuffle_into_shards(d, [F.col("doc_id")], 8)
    got = place(df).collect()
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1 and len(slots) == 8
    assert sorted(map(repr, got)) == sorted(map(repr, place(df.repartition(5)).collect()))
    assert place(df.limit(0)).collect() == []


def test_sharding_plan_has_no_python(spark, capsys):
    QUERIES["op7_sharding"](spark, DATA).explain()
    assert "Python" not in capsys.readouterr().out
