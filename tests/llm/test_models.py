"""Language, quality and toxicity: held-out accuracy, defined corner cases, and the model against a plain version."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from venuesieve.llm import language, quality, sharding, toxicity
from venuesieve.llm.queries import QUERIES

from .test_search import classes

DATA = "/root/testdata/sf0.01"
ODD = [(1, None, "en"), (2, "", None), (3, "123 !!", "fr"), (4, "ß" * 50_000, None), (4, "ß" * 50_000, None), (None, "word", "en")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(*r, 0.5, "x") for r in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, perplexity string")


def test_language_held_out(spark, docs):
    got = QUERIES["op5_language"](spark, DATA).where("held_out").join(docs, "doc_id")
    right, n = got.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*")).first()
    assert right >= 0.95 * n > 0


def test_language_corner_cases(docs, odd):
    net = language.fit(docs, F.lit(True))
    got = language.predict(odd, net).collect()
    assert len(got) == len(ODD) and got[0].asDict().keys() == {"doc_id", "lang", "score", "perplexity", "lang_pred"}
    assert all((r["lang_pred"], r["score"]) == ("und", 0.0) for r in got if r["doc_id"] in (1, 2, 3))
    assert all(r["lang_pred"] != "und" and 0 < r["score"] <= 1 for r in got if r["doc_id"] == 4)
    assert {r["lang_pred"] for r in language.predict(odd, language.fit(odd.limit(0), F.lit(True))).collect()} == {"und"}
    kept = language.recognised_rows(odd, net)
    assert kept.columns == odd.columns and {r["score"] for r in kept.collect()} <= {0.5}


def test_a_rare_language_is_learned(spark, docs):
    """A hundred rows of a fifth language among thousands, one of them as often as all others together."""
    rare = [(200_000 + i, "кошка сидит на окне " * (i % 5 + 1), "xx", "s", 1) for i in range(100)]
    copies = [(900_000, "gleich bleibt gleich", "de", "s", 1)] * 1000
    rows = docs.union(spark.createDataFrame(rare + copies, docs.schema))
    net = language.fit(rows, F.lit(True))
    assert net.labels == sorted({"xx", *[r["lang"] for r in docs.select("lang").distinct().collect() if r["lang"]]})
    asked = spark.createDataFrame([(1, "кошка и окно сидит"), (2, "на окне кошка")], "doc_id long, text string")
    assert {r["lang_pred"] for r in language.predict(asked, net).collect()} == {"xx"}


def kneser_ney(texts, order):
    """Interpolated modified Kneser-Ney by dictionaries."""
    padded = [b"\n" * (order - 1) + t.encode() for t in texts]
    counts = {order: Counter(p[i : i + order] for p in padded for i in range(len(p) - order + 1))}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    discounts = {k: quality._discounts([sum(v == n for v in c.values()) for n in (1, 2, 3, 4)]) for k, c in counts.items()}

    def p(gram):
        k = len(gram)
        if k == 0:
            return 1 / 256
        seen = {g: n for g, n in counts[k].items() if g[:-1] == gram[:-1]}
        below = p(gram[1:])
        if not seen:
            return below
        off = {g: discounts[k][min(n, 3) - 1] for g, n in seen.items()}
        own = max(seen.get(gram, 0) - off.get(gram, 0.0), 0.0)
        return (own + sum(off.values()) * below) / sum(seen.values())

    return p


def test_perplexity_equals_plain_model(spark):
    rows = [(1, "the cat sat on the mat", "en"), (2, "the dog sat", "en"), (3, "Die Katze", "de"), (4, "zzz é the", None)]
    rows += [(5, "", "en"), (6, None, "en"), (4, "zzz é the", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(2)
    trusted = spark.createDataFrame([(1,), (2,), (3,), (3,), (None,)], "doc_id long")
    got = quality.classify(df, trusted, order=3).collect()
    p = kneser_ney([t for k, t, _ in rows if k in (1, 2, 3)], 3)
    assert len(got) == len(rows)
    for r in got:
        text = next(t for k, t, _ in rows if k == r["doc_id"])
        if not text:
            assert r["perplexity"] is None and not r["accepted"]
            continue
        raw = b"\n\n" + text.encode()
        nll = -sum(math.log(p(raw[i : i + 3])) for i in range(len(raw) - 2)) / len(text.encode())
        assert math.isclose(r["perplexity"], math.exp(nll), rel_tol=1e-9)


def test_probabilities_add_up():
    p = kneser_ney(["abracadabra", "banana band"], 3)
    for context in (b"ab", b"an", b"zz", b"\n\n"):
        assert math.isclose(sum(p(context + bytes([b])) for b in range(256)), 1, rel_tol=1e-9)


def test_quality_separates(spark, docs):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    got = QUERIES["op6_quality"](spark, DATA).join(labels, "doc_id")
    share = {r["quality"]: r["s"] for r in got.groupBy("quality").agg(F.avg(F.col("accepted").cast("int")).alias("s")).collect()}
    assert share[1] >= 0.97 and share[0] <= 0.2


def test_quality_model_grows_with_the_text(spark):
    """Five times the trusted text has at least half as many n-grams again; a table that is full does not."""
    sizes = []
    for folder in ("sf0.001", "sf0.01"):
        rows = spark.read.parquet(f"/root/testdata/{folder}/documents.parquet")
        labels = spark.read.parquet(f"/root/testdata/{folder}/labels.parquet").where("quality = 1")
        texts = [r["text"].encode() for r in rows.join(labels, "doc_id").where("text IS NOT NULL").collect()]
        sizes.append(len(np.unique(quality._grams(texts, quality.ORDER)[0])))
    assert sizes[1] >= 1.5 * sizes[0]


def test_quality_threshold_comes_from_outside_training(spark):
    """Most bad texts, repeated words too, lie above it, and good texts that the model has not seen seldom do."""
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    unseen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    got = quality.classify(spark.read.parquet(f"{folder}/documents.parquet"), labels.where((F.col("quality") == 1) & ~unseen))
    rows = got.join(labels, "doc_id").select("quality", unseen.alias("unseen"), "accepted").collect()

    def rejected(good, *hidden):
        some = [not r["accepted"] for r in rows if r["quality"] == good and r["unseen"] in hidden]
        return sum(some) / len(some)

    assert rejected(0, True, False) >= 0.92 and rejected(1, False) <= 0.005 and rejected(1, True) <= 0.015


def test_quality_without_trusted(spark, odd):
    none = spark.createDataFrame([], "doc_id long")
    got = quality.classify(odd, none).collect()
    assert [r["accepted"] for r in sorted(got, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))] == [
        False, False, True, True, True, True,
    ]
    kept = quality.accepted_rows(odd, none)
    assert kept.columns == odd.columns and kept.count() == 4
    assert quality.classify(odd.limit(0), none).collect() == []


def test_toxicity_held_out(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = QUERIES["op9_toxicity"](spark, "/root/testdata/sf0.1").where("held_out").join(labels, "doc_id")
    share = {r["toxic"]: r["s"] for r in got.groupBy("toxic").agg(F.avg("predicted").alias("s")).collect()}
    assert share[1] >= 0.85 and share[0] <= 0.02


def test_toxicity_corner_cases(spark, docs, odd):
    labels = spark.createDataFrame([(0, 1), (0, 0), (1, None), (None, 1), (99, 7)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert model.score(None) > 0.99  # one document, toxic
    got = toxicity.predict(odd, toxicity.fit(docs, labels.limit(0))).collect()
    assert len(got) == len(ODD) and all(r["predicted"] == 0 and 0 <= r["score"] <= 1 for r in got)
    texts = ["you clown" if i % 3 == 0 else "a fine day" for i in range(60)]
    model = toxicity.train(texts, np.array([int(i % 3 == 0) for i in range(60)]))
    assert model.score("what a CLOWN") > 0.5 > 0.3 > model.score("a day")
    assert model.score("") == model.score(None)


def test_toxic_words_of_any_script(spark):
    """N-grams are of characters: words of two or three letters tell, whatever bytes they take."""
    assert len(toxicity.grams("中文字")) == 3 + 2 + 1 and len(toxicity.grams("")) == 0
    assert len(np.intersect1d(toxicity.grams("中文字"), toxicity.grams("甲中文字乙"))) == 1
    rng = np.random.default_rng(1)
    rows, labels = [], []
    for i in range(400):
        filler = "".join(rng.choice(list("абвгдежзик лмно"), 60)) + "".join(rng.choice(list("天地人山水火木"), 20))
        bad = i % 4 == 0
        rows.append((i, filler + (["дрянь", "坏蛋笨"][i // 4 % 2] if bad else "") + filler[::-1] * (400 if i == 8 else 1)))
        labels.append((i, int(bad)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(df, spark.createDataFrame(labels, "doc_id long, toxic int").where("doc_id % 3 <> 1"))
    got = {r["doc_id"]: r["predicted"] for r in toxicity.predict(df, model).collect()}
    wrong = [i for i, y in labels if i % 3 == 1 and got[i] != y]
    assert len(wrong) <= 4, wrong


def test_quality_against_brute_force(spark):
    """Model, threshold and decision of every document, with text keys, as dictionaries and sorting give them."""
    rng = np.random.default_rng(3)
    words = ["the", "cat", "sat", "mat", "dog", "and", "ran", "far"]
    rows = [(f"k{i}", " ".join(rng.choice(words, 12)), "en" if i % 2 else "de") for i in range(60)]
    rows += [(f"b{i}", "".join(rng.choice(list("qxzvjk!"), 40)), "en") for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id string, text string, lang string").repartition(3)
    good = [k for k, _, _ in rows if k[0] == "k" and int(k[1:]) % 3]
    trusted = spark.createDataFrame([(k,) for k in good], "doc_id string")
    marks = trusted.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(quality.HELD_OUT)).alias("m")).collect()
    held = {r["doc_id"] for r in marks if r["m"] == 0}
    text, lang = {k: t for k, t, _ in rows}, {k: g for k, _, g in rows}

    def nll(p, t):
        raw = b"\n" * 3 + t.encode()
        return -sum(math.log(p(raw[i : i + 4])) for i in range(len(raw) - 3)) / len(t.encode())

    full = kneser_ney([text[k] for k in good], 4)
    rest = kneser_ney([text[k] for k in good if k not in held], 4)
    outside = {k: nll(rest, text[k]) for k in held}
    size = {k: len(t) for k, t in text.items()}
    mean_of = lambda ks: sum(outside[k] * size[k] for k in ks) / sum(size[k] for k in ks)
    adjusted = lambda x, n, mean: (x * n + mean * quality.PRIOR_BYTES) / (n + quality.PRIOR_BYTES)
    upper = lambda xs, q: sorted(xs)[math.ceil(q * len(xs)) - 1]
    groups = {g: [k for k in held if lang[k] == g] for g in ("en", "de")}
    assert all(groups.values())
    means = {g: mean_of(ks) for g, ks in groups.items()}
    above = upper([math.exp(adjusted(outside[k], size[k], means[lang[k]]) - means[lang[k]]) for k in held], 0.75)
    for r in quality.classify(df, trusted, quantile=0.75, order=4).collect():
        k = r["doc_id"]
        own, mean = groups[lang[k]], means[lang[k]]
        limit = upper([math.exp(adjusted(outside[x], size[x], mean)) for x in own], 0.75) if len(own) * 0.25 >= 1 - 1e-9 else math.exp(mean) * above
        want = nll(full, text[k])
        assert math.isclose(r["perplexity"], math.exp(want), rel_tol=1e-9)
        assert math.isclose(r["adjusted"], math.exp(adjusted(want, size[k], mean)), rel_tol=1e-9)
        assert math.isclose(r["threshold"], limit, rel_tol=1e-9), (k, limit)
        assert r["accepted"] == (r["adjusted"] <= r["threshold"])


def test_packed_numbers():
    rng = np.random.default_rng(0)
    grams = np.unique(rng.integers(0, 1 << 48, 5000).astype(np.uint64))
    assert (quality._unpack_sorted(quality._pack_sorted(grams)) == grams).all()
    logs = np.log(rng.random(5000) * 10.0 ** rng.integers(-30, 1, 5000))
    assert np.abs(quality._unpack_logs(quality._pack_logs(logs)) - logs).max() <= 2.0**-32 + 1e-12
    assert len(quality._unpack_sorted(quality._pack_sorted(grams[:0]))) == 0


def test_pipeline_run(spark):
    """All stages in a row, written and read again, give what the stages give one by one."""
    small = "/root/testdata/sf0.001"
    before = spark.read.parquet(f"{small}/documents.parquet")
    kept = []
    for _, step in corpus_pipeline.STAGES:
        before = corpus_pipeline.stage(step(spark, before, small), "one-by-one")
        kept.append(before.count())
    got = corpus_pipeline.run(spark, small)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, before.collect()))
    labels = spark.read.parquet(f"{small}/labels.parquet")
    docs = spark.read.parquet(f"{small}/documents.parquet")
    first = corpus_pipeline.accept(spark, docs, small)
    judged = quality.classify(docs, labels.where("quality = 1").select("doc_id"))
    assert {r["doc_id"] for r in first.collect()} == {r["doc_id"] for r in judged.where("accepted").collect()}
    net = language.fit(first, corpus_pipeline.remainder("doc_id", 3) != 1)
    known = language.predict(first, net).where(f"lang_pred <> 'und' AND score >= {language.LEAST_SCORE}")
    assert kept[0] == first.count() and kept[1] == known.count()


def test_pipeline(spark):
    small = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, before = docs.columns, docs
    for i, (_, step) in enumerate(corpus_pipeline.STAGES):
        after = step(spark, before, small).cache()
        if i < 4:
            assert after.columns == columns
        if i == 2:
            rows = [(r["doc_id"], r["text"]) for r in before.collect()]
            assert {r["doc_id"] for r in after.collect()} == set(classes(rows).values())
        if i == 4:
            want = Counter((r["doc_id"], r["text"]) for r in before.collect())
            assert Counter((r["doc_id"], r["text"]) for r in after.collect()) == want
        before = after
    assert 0.5 * docs.count() < before.count() < 2 * docs.count()


CLASHING = (
    "_row _key _lang _md5 out_key out_lang out_md5 text_md5 accepted _text lang_pred score _own _source source_size "
    "target rate n weight mix_size mix_copies _copy _cell _i _u _h _rank _at _part k t class_id kept key c0 ids decoded block"
).split()


def test_pipeline_stages_with_clashing_columns(spark):
    """Extra columns, whatever their names, come out as they went in; odd rows and empty tables have results."""
    small = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(90_001, None, "en", None, 0), (None, "", None, "a", 0), (90_003, "123 !!", "fr", None, None)]
    odd = spark.createDataFrame(rows, docs.schema)
    extra = [F.concat(F.lit(f"{c} "), F.coalesce("doc_id", F.lit(0)).cast("string")).alias(c) for c in CLASHING]
    before = docs.union(odd).union(docs.where("doc_id < 5")).select("*", *extra)
    for i, (name, step) in enumerate(corpus_pipeline.STAGES):
        after = step(spark, before, small).cache()
        assert after.count() > 50, name
        if i < 4:
            assert after.columns == before.columns, name
            right = [F.col(c) == F.concat(F.lit(f"{c} "), F.coalesce("doc_id", F.lit(0)).cast("string")) for c in CLASHING]
            assert after.where(~F.forall(F.array(*right), lambda x: x)).count() == 0, name
        assert step(spark, before.limit(0), small).collect() == [], name
        before = after


def test_operators_with_clashing_columns(spark):
    named = spark.range(20).select(F.col("id").alias("doc_id"), F.lit("a fine day").alias("text"), F.lit("x").alias("_text"))
    assert toxicity.predict(named, toxicity.train([], np.array([], np.int64))).where("_text = 'x'").count() == 20
    assert language.predict(named, None).columns == ["doc_id", "_text", "lang_pred", "score"]
    placed = sharding.shuffle_into_shards(named.selectExpr("doc_id", "'x' AS _to", "'y' AS _at"), [F.col("doc_id")], 3)
    assert placed.where("_to = 'x' AND _at = 'y'").count() == 20
