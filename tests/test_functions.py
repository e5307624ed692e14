import unicodedata

import pytest
from pyspark.sql import functions as F

from venuesieve import functions as fn
from venuesieve.sources import canonicalize


def apply(spark, column, values, kind="string"):
    """Values of ``column(F.col('x'))`` for each input, in order."""
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in rows.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


TEXTS = [
    "domino's pizza",
    "7th street",
    "cafe-coffee day",
    "ÉCOLE d'été",
    "ßtraße o'neil",
    "ǆungla ﬁ",
    "x²y ªb ʰa",
    "οδυσσευς ΣΑΣ",
    "i̇stanbul İzmir",
    "Ａｂｃ　ｄ\x1ce\x85f g",
    "ñandũ ña",
    "한국어 한",
    " \t a  b\r\n",
    "",
]


def test_whitespace_and_title_equal_python(spark):
    words = [" ".join(unicodedata.normalize("NFKC", t).split()) for t in TEXTS]
    assert apply(spark, fn.normalize_whitespace, TEXTS) == words
    assert apply(spark, lambda x: fn.title_case(fn.normalize_whitespace(x)), TEXTS) == [w.title() for w in words]


def test_every_low_character_folds_like_python(spark):
    texts = [f"a{chr(c)}b" for c in range(1, 0x700)]
    assert apply(spark, fn.normalize_whitespace, texts) == [
        " ".join(unicodedata.normalize("NFKC", t).split()) for t in texts
    ]


def test_city(spark):
    names = ["bengaluru", "New  Delhi", " ", "banashankari", "NCR", "bombay ", "gurugram"]
    assert apply(spark, fn.normalize_city, names) == [
        "Bangalore",
        "Delhi",
        "",
        "Banashankari",
        "Delhi",
        "Mumbai",
        "Gurgaon",
    ]


def test_cuisines(spark):
    raw = ["North Indian, Mughlai, Chinese", "a , A,,b", None, "  ", "ａ，b,ﬁsh", "x"]
    assert apply(spark, fn.split_cuisines, raw) == [
        ["north indian", "mughlai", "chinese"],
        ["a", "b"],
        [],
        [],
        ["a,b", "fish"],
        ["x"],
    ]


def test_plain_and_odd_lists_split_alike(spark):
    raw = ["A , b,  c d ,A", " , ,a b,,", "a  b , B\t,é", "x,y ", ",", " ", "q\x1c,ﬁ , fi", 'say "x",\\ ,', "\x7f, a"]
    said = [[" ".join(unicodedata.normalize("NFKC", p).split()).lower() for p in t.split(",")] for t in raw]
    assert apply(spark, fn.split_cuisines, raw) == [list(dict.fromkeys(p for p in parts if p)) for parts in said]


def test_listings_fold_row_by_row(spark):
    """Rows that NFKC changes, in one field or in several, beside rows that it leaves alone."""
    names = ["domino's  pizza", "ﬁsh\u3000bar", "x²y", " \t", "7th street", "a\x1cb"]
    rows = [(i, n, "ncr", m, f"{n} , {m},,{n}") for i, (n, m) in enumerate((n, m) for n in names for m in names)]
    raw = spark.createDataFrame(rows, "pos bigint, name string, `listed_in(city)` string, location string, cuisines string")
    spelt = lambda t: " ".join(unicodedata.normalize("NFKC", t).split())
    for got, row in zip(canonicalize(raw).orderBy("pos").collect(), rows):
        assert (got.name, got.city, got.neighborhood) == (spelt(row[1]).title(), "Delhi", spelt(row[3]))
        assert got.cuisines == [t for t in dict.fromkeys(spelt(p).lower() for p in row[4].split(",")) if t]


def test_wanted_tokens_keep_order_and_repeats(spark):
    raw = [[" Thai ", "", "thai", "ＰＩＺＺＡ"], [], None]
    assert apply(spark, fn.lower_tokens, raw, "array<string>") == [["thai", "thai", "pizza"], [], None]


def test_free_text_list(spark):
    assert apply(spark, fn.split_free_text, ["a, b\n c ,,", None, " "]) == [["a", "b", "c"], [], []]


RATINGS = {
    "4.1/5": 4.1,
    "4.1 /5": 4.1,
    "NEW": None,
    "-": None,
    "nan": None,
    "none": None,
    " ": None,
    "9.9/5": 9.9,
    "4.1/50": 4.1,
    "4.1": 4.1,
    " 4. ": 4.0,
    ".5": 0.5,
    "1e0": 1.0,
    "4.1d": None,
    "4.1f": None,
    "0x1p3": None,
    "-4/5": None,
    "45": 45.0,
    "inf": float("inf"),
    "+nan": None,
    "٤/5": 4.0,
}


def test_rating(spark):
    assert apply(spark, fn.parse_rating, list(RATINGS) + [None]) == list(RATINGS.values()) + [None]


COSTS = {
    "800": 800,
    "1,200": 1200,
    "800.0": 8000,
    "300-500": 300500,
    "-": None,
    "nan": None,
    "": None,
    "₹८००": 800,
    "1,200.50": 120050,
}


def test_cost_and_tier(spark):
    assert apply(spark, fn.parse_cost_inr, list(COSTS) + [None]) == list(COSTS.values()) + [None]
    tiers = apply(spark, lambda c: fn.classify_cost_tier(c, 400, 1000), [None, 400, 401, 1000, 1001], "bigint")
    assert tiers == ["medium", "low", "medium", "medium", "high"]


def test_votes(spark):
    raw = ["775", " 775 ", "4.5", None, "+5", "1_0", "x", ""]
    assert apply(spark, fn.parse_votes, raw) == [775, 775, None, None, 5, 10, None, None]
    assert apply(spark, lambda v: fn.parse_votes(v, numeric=True), [4.7, float("nan"), None], "double") == [
        4,
        None,
        None,
    ]


def test_id(spark):
    row = spark.range(1).select(
        fn.stable_id(F.lit("Jalsa"), F.lit("Bangalore"), F.lit("Banashankari"), F.array(F.lit("north indian")))
    )
    assert row.head()[0] == "8ed15c8abab38daa"


@pytest.mark.parametrize(
    "cost, shown", [(None, "—"), (90, "₹90 for two"), (1200, "₹1,200 for two"), (1234567, "₹12,34,567 for two")]
)
def test_display_cost(spark, cost, shown):
    assert apply(spark, fn.display_cost, [cost], "bigint") == [shown]


def test_display_rest(spark):
    assert apply(spark, fn.display_rating, [4.0, None], "double") == ["4.0", "—"]
    assert apply(spark, lambda h: fn.display_area(h, F.lit("Delhi")), ["", "Hauz Khas"]) == ["Delhi", "Hauz Khas, Delhi"]
