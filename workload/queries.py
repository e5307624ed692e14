"""Registered queries: each runs over whole tables and has a SQL counterpart unless noted."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from uuid import uuid4

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from venuesieve.config import IngestConfig, SearchConfig
from venuesieve.functions import display, parse, text
from venuesieve.operators import expectations, match, prompts, quality, search, signals
from venuesieve.operators import prefs as profiles
from venuesieve.operators.completions import complete_logged
from venuesieve.operators.responses import Asking, complete, parse_entries, read_answers
from venuesieve.plans.few import FewProfiles, Profile
from venuesieve.plans.recommend import NO_MODEL, Recommender
from venuesieve.plans.reuse import ResultStore
from venuesieve.schemas import CITY, COST
from venuesieve.sources import canonicalize, load_listings, publish, read_canonical, write_canonical
from venuesieve.sources.listings import has_required_fields
from venuesieve.sources.quarantine import rejected_counts, split_raw
from venuesieve.sources.staging import discard, scratch, stage, staging_root
from venuesieve.streaming.ingest import (
    add_batch,
    counted,
    ingested,
    stream_listings,
    write_counted_stream,
    write_stream,
)
from venuesieve.streaming.recommend import LiveCorpus
from venuesieve.streaming.recommend import recommend_stream as start_recommend_stream

from .tables import listing_raw, prefs_raw, responses, table

Query = Callable[[SparkSession, str], DataFrame]
CFG = SearchConfig()
_RAW_ROWS = 250_000  # a file of raw text
_WIDE = "decimal(38,0)"  # a sum of millions of order numbers has more than 64 bits


def _canonical(spark: SparkSession, d: str) -> DataFrame:
    return canonicalize(listing_raw(spark, d))


def _prefs(spark: SparkSession, d: str) -> DataFrame:
    return profiles.split_preferences(prefs_raw(spark, d))[0]


def _flat(df: DataFrame) -> DataFrame:
    """Arrays as '|'-joined text, for comparison outside Spark."""
    arrays = {f.name for f in df.schema.fields if f.dataType.typeName() == "array"}
    return df.select(*[F.array_join(c, "|").alias(c) if c in arrays else F.col(c) for c in df.columns])


def _listing_columns(df: DataFrame) -> DataFrame:
    return _flat(
        df.select(
            "pos",
            "id",
            "name",
            "city",
            "neighborhood",
            "cuisines",
            "rating",
            "cost_for_two",
            "cost_tier",
            "votes",
            F.col("raw_fields.address").alias("address"),
        )
    )


def _narrow(sums: DataFrame, *names: str) -> DataFrame:
    """Exact sums as bigint, as in the SQL, if all of a column fit; a column with one beyond 64 bits stays decimal."""
    most = sums.agg(*[F.max(F.abs(c)).alias(c) for c in names]).first()
    return sums.withColumns({c: F.col(c).cast("bigint") for c in names if (most[c] or 0) < 2**63})


def _folder(spark: SparkSession, label: str) -> str:
    return f"{staging_root(spark)}/{label}-{uuid4().hex}"


def _raw_files(spark: SparkSession, d: str, batches: int, by_range: bool = False) -> tuple[str, DataFrame, int]:
    """Raw listings as files for a stream: (folder, table, files a batch, so that there are that many ``batches``).

    There are as many files as the listings come in parts of, a multiple of four, so no file grows with the table.
    """
    raw = stage(listing_raw(spark, d), "raw-whole")
    files = 4 * -(-len(raw.inputFiles()) // 4)
    parts = raw.repartitionByRange(files, "pos") if by_range else raw.repartition(files)
    raw = stage(parts, "raw-stream")
    return raw.inputFiles()[0].rsplit("/", 1)[0], raw, -(-len(raw.inputFiles()) // batches)


# --- ingest ---------------------------------------------------------------------------------------------------------


def ingest_batch(spark: SparkSession, d: str) -> DataFrame:
    return _listing_columns(load_listings(listing_raw(spark, d)))


def ingest_limit(spark: SparkSession, d: str) -> DataFrame:
    return _listing_columns(load_listings(listing_raw(spark, d), IngestConfig(max_rows=1000)))


def schema_check(spark: SparkSession, d: str) -> DataFrame:
    return quality.column_report(listing_raw(spark, d))


def canonical_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    return _listing_columns(load_listings(listing_raw(spark, d), cache_path=_folder(spark, "canonical")))


def cache_hit(spark: SparkSession, d: str) -> DataFrame:
    """Rows served by a matching cache; a config it was not built for must miss."""
    path = _folder(spark, "canonical")
    write_canonical(_canonical(spark, d), path)
    if read_canonical(spark, path, IngestConfig(cost_low_max_inr=500)) is not None:
        raise AssertionError("cache served a configuration it was not built for")
    return _listing_columns(load_listings(listing_raw(spark, d), cache_path=path, prefer_cache=True))


def cache_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """Two snapshots of one cache: the first, opened by name after the second was published, and the newest."""
    path, listings = _folder(spark, "canonical"), _canonical(spark, d)
    first = publish(listings.where(F.col("pos") % 3 != 0), path).snapshot
    publish(listings, path)
    earlier, now = read_canonical(spark, path, snapshot=first), read_canonical(spark, path)
    return earlier.select("pos", "id", F.lit("first").alias("snapshot")).unionByName(
        now.select("pos", "id", F.lit("newest").alias("snapshot"))
    )


def canonical_listings(spark: SparkSession, d: str) -> DataFrame:
    return _listing_columns(_canonical(spark, d))


def valid_listings(spark: SparkSession, d: str) -> DataFrame:
    return _canonical(spark, d).where(has_required_fields()).select("pos", "id", "name", "city")


def validate_corpus(spark: SparkSession, d: str) -> DataFrame:
    return quality.corpus_stats(_canonical(spark, d))


def localities(spark: SparkSession, d: str) -> DataFrame:
    return quality.localities(_canonical(spark, d))


def ingest_metrics(spark: SparkSession, d: str) -> DataFrame:
    seen = Observation()
    _canonical(spark, d).observe(seen, *quality.corpus_metrics()).write.format("noop").mode("overwrite").save()
    got = seen.get
    return spark.createDataFrame(
        [(got["total_rows"], got["rows_passing_validation"])], "total_rows bigint, rows_passing_validation bigint"
    )


def ingest_stream(spark: SparkSession, d: str) -> DataFrame:
    source, raw, files = _raw_files(spark, d, 2)
    target, state = _folder(spark, "live"), _folder(spark, "live-state")
    write_stream(stream_listings(spark, source, raw.schema, max_files=files), target, state).awaitTermination()
    return _listing_columns(spark.read.parquet(target))


def ingest_stream_metrics(spark: SparkSession, d: str) -> DataFrame:
    source, raw, files = _raw_files(spark, d, 4)
    target, state = _folder(spark, "live"), _folder(spark, "live-state")
    write_stream(stream_listings(spark, source, raw.schema, max_files=files), target, state).awaitTermination()
    return spark.createDataFrame([ingested(spark, target)], "total_rows bigint, rows_passing_validation bigint")


def ingest_batch_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Counts of every batch from the stream's log, a quarter of the raw files a batch; a batch that comes again counts
    once."""
    source, raw, files = _raw_files(spark, d, 4, by_range=True)
    target, state = _folder(spark, "live"), _folder(spark, "live-state")
    write_counted_stream(stream_listings(spark, source, raw.schema, max_files=files), target, state).awaitTermination()
    again = spark.read.parquet(f"{target}/batch=0")
    add_batch(stage(again, "again"), 0, target)
    total, usable = counted(spark, target)
    written = spark.read.parquet(target)
    return written.agg(F.count(F.lit(1)).alias("rows_written")).select(
        F.lit(total).alias("total_rows"), F.lit(usable).alias("rows_passing_validation"), "rows_written"
    )


def quarantine(spark: SparkSession, d: str) -> DataFrame:
    """Listings written as CSV and as JSON with rows broken in four ways, and read back: what came through, what not."""
    kind = F.col("pos") % 11
    raw = listing_raw(spark, d).withColumn("kind", kind)
    pos = F.col("pos").cast("string")
    copies = F.array_repeat(F.lit(1), F.when(kind == 3, 2).otherwise(1))
    rows = raw.select("*", F.explode(copies).alias("copy")).drop("copy")
    rows = rows.withColumn("pos", F.when(kind == 1, " ").when(kind == 2, F.concat(pos, F.lit(".5"))).otherwise(pos))
    cut_off, names = F.col("kind") == 4, [c for c in rows.columns if c != "kind"]
    csv, json = _folder(spark, "raw-csv"), _folder(spark, "raw-json")
    plain = {"sep": ";", "quote": "", "header": "true"}
    # Text is some twenty times as large as the tables it is made of, so it is packed, in files of a bounded number of rows
    # (a packed file is read as a whole), and what has been read is deleted.
    packed = {"compression": "gzip", "maxRecordsPerFile": _RAW_ROWS}
    with scratch(spark):
        rows = stage(rows, "raw-broken")
        longer = F.when(cut_off, F.concat("address", F.lit(";more;fields"))).otherwise(F.col("address"))
        rows.withColumn("address", longer).select(*names).write.options(emptyValue="", **plain, **packed).csv(csv)
        line = F.to_json(F.struct(*names))
        shorter = F.when(cut_off, F.substring(line, F.lit(1), F.length(line) - 5)).otherwise(line)
        rows.select(shorter.alias("value")).write.options(**packed).text(json)
    none, out = F.lit(None).cast(_WIDE), []
    for fmt, path, options in (("csv", csv, plain), ("json", json, {})):
        good, rejected = split_raw(spark, path, fmt, **options)
        wide = [F.sum(F.col(c).cast(_WIDE)).cast(_WIDE).alias(s) for c, s in (("pos", "pos_sum"), ("cost_for_two", "cost_sum"))]
        sums = [F.count(F.lit(1)).alias("n"), *wide]
        apart = rejected_counts(rejected).withColumnsRenamed({"reason": "outcome"})
        through = canonicalize(good).agg(*sums).withColumns({"outcome": F.lit("good"), "fmt": F.lit(fmt)})
        aside = apart.withColumns({"pos_sum": none, "cost_sum": none, "fmt": F.lit(fmt)})
        out.append(stage(through.unionByName(aside), "outcomes"))
        discard(spark, path)
    return _narrow(reduce(DataFrame.unionByName, out), "pos_sum", "cost_sum")


# --- scalar functions -----------------------------------------------------------------------------------------------


def norm_whitespace(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.normalize_whitespace(F.col("text")).alias("norm"))


def title_case(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(
        "doc_id", text.title_case(text.normalize_whitespace(F.col("text"))).alias("title")
    )


def norm_city(spark: SparkSession, d: str) -> DataFrame:
    return listing_raw(spark, d).select("pos", text.normalize_city(F.col(f"`{CITY}`")).alias("city"))


def split_tokens(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return _flat(docs.select("doc_id", text.split_cuisines(F.col("text")).alias("tokens")))


def parse_rating(spark: SparkSession, d: str) -> DataFrame:
    return listing_raw(spark, d).select("pos", parse.parse_rating(F.col("rate")).alias("rating"))


def parse_cost(spark: SparkSession, d: str) -> DataFrame:
    return listing_raw(spark, d).select("pos", parse.parse_cost_inr(F.col(f"`{COST}`")).alias("cost_for_two"))


def cost_tier(spark: SparkSession, d: str) -> DataFrame:
    cost = parse.parse_cost_inr(F.col(f"`{COST}`"))
    return listing_raw(spark, d).select("pos", parse.classify_cost_tier(cost, 400, 1000).alias("cost_tier"))


def parse_votes(spark: SparkSession, d: str) -> DataFrame:
    return listing_raw(spark, d).select("pos", parse.parse_votes(F.col("votes")).alias("votes"))


def stable_id(spark: SparkSession, d: str) -> DataFrame:
    return _canonical(spark, d).select("pos", "id")


def split_free_text(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return _flat(docs.select("doc_id", text.split_free_text(F.col("text")).alias("parts")))


def display_columns(spark: SparkSession, d: str) -> DataFrame:
    return _canonical(spark, d).select(
        "pos",
        display.display_area(F.col("neighborhood"), F.col("city")).alias("area"),
        display.display_cost(F.col("cost_for_two")).alias("cost"),
        display.display_rating(F.col("rating")).alias("rating"),
    )


# --- profiles -------------------------------------------------------------------------------------------------------


def prefs_validated(spark: SparkSession, d: str) -> DataFrame:
    return _flat(_prefs(spark, d))


def prefs_rejected(spark: SparkSession, d: str) -> DataFrame:
    return profiles.split_preferences(prefs_raw(spark, d))[1]


def token_budget(spark: SparkSession, d: str) -> DataFrame:
    return prompts.answer_limits(_prefs(spark, d))


def relax_ladder(spark: SparkSession, d: str) -> DataFrame:
    return _flat(search.relax_ladder(_prefs(spark, d), CFG))


# --- search ---------------------------------------------------------------------------------------------------------


def _search(spark: SparkSession, d: str) -> search.ProfileSearch:
    return search.ProfileSearch(_prefs(spark, d), _canonical(spark, d), CFG)


def filter_location(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d).strict_funnel().select("pref_id", "total_after_location")


def filter_cuisine(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d).strict_funnel().select("pref_id", "total_after_cuisine")


def filter_budget(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d).strict_funnel().select("pref_id", "total_after_budget")


def filter_rating(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d).strict_funnel().select("pref_id", "total_after_rating")


def filter_funnel(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d).strict_funnel()


def relaxations_applied(spark: SparkSession, d: str) -> DataFrame:
    return _flat(_search(spark, d).relaxations())


def filter_report(spark: SparkSession, d: str) -> DataFrame:
    return _flat(_search(spark, d).report())


def relaxed_search(spark: SparkSession, d: str) -> DataFrame:
    s = _search(spark, d)
    counts = s.candidates().groupBy("pref_id").agg(F.count(F.lit(1)).alias("n_candidates"), F.sum("pos").alias("pos_sum"))
    return s.relaxations().select("pref_id", "stop").join(counts, "pref_id", "left")


def topk_candidates(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d).candidates().select("pref_id", "cand_pos", "pos", "id")


def packed_candidates(spark: SparkSession, d: str) -> DataFrame:
    packed = prompts.pack_candidates(_search(spark, d).candidates())
    return _flat(packed.select("pref_id", F.posexplode("candidates").alias("place", "c")).select("pref_id", "place", "c.*"))


def rank_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Strict search for one profile given as values, in rank order."""
    hits = match.filter_listings(_canonical(spark, d), "Bangalore", ("economy", "ring"), 1200, 3.0)
    return match.top_listings(hits, CFG.max_candidates).select("pos", "id", "name", "rating", "votes")


# --- recommendation -------------------------------------------------------------------------------------------------


def _answered(spark: SparkSession, d: str) -> Recommender:
    plain = Recommender(_prefs(spark, d), _canonical(spark, d), None, CFG)
    return plain.with_answers(responses(plain.candidates))


def fallback_recommendations(spark: SparkSession, d: str) -> DataFrame:
    return Recommender(_prefs(spark, d), _canonical(spark, d), None, CFG).items().select(
        "pref_id", "rank", "id", "explanation"
    )


def recommend_batch(spark: SparkSession, d: str) -> DataFrame:
    return _flat(Recommender(_prefs(spark, d), _canonical(spark, d), None, CFG).items())


def rec_report(spark: SparkSession, d: str) -> DataFrame:
    return _flat(_answered(spark, d).report())


def reconcile(spark: SparkSession, d: str) -> DataFrame:
    return _flat(_answered(spark, d).items())


def parse_responses(spark: SparkSession, d: str) -> DataFrame:
    plain = Recommender(_prefs(spark, d), _canonical(spark, d), None, CFG)
    return parse_entries(read_answers(responses(plain.candidates)))


def grounding_violations(spark: SparkSession, d: str) -> DataFrame:
    """Per profile with items: how many there are, what its answer names, and how much of that is no candidate."""
    r = _answered(spark, d)
    counts = r.items().groupBy("pref_id").agg(F.count(F.lit(1)).alias("n_items"))
    said = r.named().groupBy("pref_id")
    said = said.agg(F.count(F.lit(1)).alias("n_entries"), F.count_if(F.col("id").isNull()).alias("n_violations"))
    none = F.lit(0).cast("bigint")
    return counts.join(said, "pref_id", "left").select(
        "pref_id",
        "n_items",
        F.coalesce("n_entries", none).alias("n_entries"),
        F.coalesce("n_violations", none).alias("n_violations"),
    )


def prompt_payload(spark: SparkSession, d: str) -> DataFrame:
    """The prompt text, read back field by field."""
    user = F.col("user")

    def field(path: str):
        return F.get_json_object(user, path)

    asked = Recommender(_prefs(spark, d), _canonical(spark, d), None, CFG).prompts()
    ids = F.from_json(field("$.candidates"), "array<struct<id:string>>")
    return asked.select(
        "pref_id",
        field("$.user_preferences.locality_or_area").alias("locality_or_area"),
        field("$.user_preferences.max_budget_inr_for_two").cast("bigint").alias("max_budget_inr_for_two"),
        field("$.user_preferences.cuisine_preferences").alias("cuisine_preferences"),
        field("$.user_preferences.min_rating").cast("double").alias("min_rating"),
        field("$.user_preferences.extras").alias("extras"),
        F.array_join(F.from_json(field("$.relaxed"), "array<string>"), "|").alias("relaxed"),
        F.array_join(F.transform(ids, lambda c: c["id"]), "|").alias("candidate_ids"),
        "max_tokens",
    )


def completion_hook(spark: SparkSession, d: str) -> DataFrame:
    """Prompts answered by a caller's function in the tasks (here one that reverses the list), then read back."""

    def last_first(messages, *, model, temperature, max_tokens):
        import json

        offered = json.loads(messages[1]["content"])["candidates"]
        picks = [{"rank": n, "restaurant_id": c["id"]} for n, c in enumerate(reversed(offered), 1)]
        return json.dumps({"summary": None, "recommendations": picks})

    asked = Recommender(_prefs(spark, d), _canonical(spark, d), None, CFG).prompts()
    return parse_entries(read_answers(complete(asked, last_first))).select("pref_id", "rank", "restaurant_id")


def completion_log(spark: SparkSession, d: str) -> DataFrame:
    """Prompts asked through a log by a function whose first call fails where the number of candidates is odd. A second
    run, with a function that always fails, finds all answers in the log."""

    def last_first_again(messages, *, model, temperature, max_tokens, failed=set()):  # noqa: B006
        import json

        offered = json.loads(messages[1]["content"])["candidates"]
        if len(offered) % 2 and messages[1]["content"] not in failed:
            failed.add(messages[1]["content"])
            raise TimeoutError("no answer")
        picks = [{"rank": n, "restaurant_id": c["id"]} for n, c in enumerate(reversed(offered), 1)]
        return json.dumps({"summary": None, "recommendations": picks})

    def never(messages, **_):
        raise AssertionError("asked again")

    asked = Recommender(_prefs(spark, d), _canonical(spark, d), None, CFG).prompts()
    asked, log = stage(asked, "prompts"), _folder(spark, "answers")
    complete_logged(asked, last_first_again, log, asking=Asking(attempts=3, at_once=4, first_wait=0.0))
    again = complete_logged(asked, never, log)
    entries = parse_entries(read_answers(again)).select("pref_id", "rank", "restaurant_id")
    return entries.join(again.select("pref_id", "calls", "error"), "pref_id")


# --- a handful of profiles ------------------------------------------------------------------------------------------


FEW = (
    Profile(1, 1200, 3.0, "Bangalore", ("economy", "ring"), 5),
    Profile(2, 700, 4.5),
    Profile(3, 150, 5.0, "Asia Brand#1", ("promo", "gear", "plate"), 12),
    Profile(4, 2000, 2.5, None, ("unlisted kitchen",)),
    Profile(5, 1, 2.0, "Nowhere At All", ("standard",)),
    Profile(6, 300, 4.0, "Nation_3", ("unlisted kitchen", "widget"), 1),
)


def _few(spark: SparkSession, d: str) -> FewProfiles:
    """Six profiles given as values over the listings of a cache."""
    return FewProfiles(load_listings(listing_raw(spark, d), cache_path=_folder(spark, "canonical")), FEW, CFG)


def few_items(spark: SparkSession, d: str) -> DataFrame:
    return _flat(_few(spark, d).items())


def few_report(spark: SparkSession, d: str) -> DataFrame:
    return _flat(_few(spark, d).report())


def _streamed(spark: SparkSession, d: str) -> str:
    """Profiles as a file stream in two batches against the static corpus; the folder of the results."""
    raw = stage(prefs_raw(spark, d).repartition(2), "prefs-stream")
    source, target, state = raw.inputFiles()[0].rsplit("/", 1)[0], _folder(spark, "recs"), _folder(spark, "recs-state")
    live = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 1).parquet(source)
    start_recommend_stream(live, _canonical(spark, d), target, state, CFG).awaitTermination()
    return target


def recommend_stream(spark: SparkSession, d: str) -> DataFrame:
    return _flat(spark.read.parquet(_streamed(spark, d)).drop("batch"))


def recommend_stream_rejected(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{_streamed(spark, d)}-rejected").drop("batch")


def recommend_stream_report(spark: SparkSession, d: str) -> DataFrame:
    return _flat(spark.read.parquet(f"{_streamed(spark, d)}-report").drop("batch"))


def recommend_stream_live(spark: SparkSession, d: str) -> DataFrame:
    """A profile stream over a cache: one snapshot answers the first batch, a larger one published later the second."""
    # Two snapshots are published from one projection.
    cache, listings = _folder(spark, "canonical"), stage(_canonical(spark, d), "listings")
    source, target, state = (_folder(spark, f"live-{n}") for n in ("profiles", "recs", "state"))
    names, corpus, raw = {}, LiveCorpus(spark, cache), prefs_raw(spark, d)
    for name, kept, who in (("first", F.col("pos") % 3 != 0, 0), ("second", F.lit(True), 1)):
        names[name] = publish(listings.where(kept), cache).snapshot
        raw.where(F.col("pref_id") % 2 == who).write.mode("append").parquet(source)
        live = spark.readStream.schema(raw.schema).parquet(source)
        start_recommend_stream(live, corpus, target, state, CFG).awaitTermination()
    told = F.when(F.col("snapshot") == names["first"], "first").when(F.col("snapshot") == names["second"], "second")
    return spark.read.parquet(target).select("pref_id", "rank", "id", told.alias("snapshot"))


def reuse_half(spark: SparkSession, d: str) -> DataFrame:
    """Recommendations from a store that holds every second profile's; ``n_searched`` counts what was searched anew."""
    cache, store = _folder(spark, "canonical"), ResultStore(_folder(spark, "results"), CFG)
    publish(_canonical(spark, d), cache)
    prefs = stage(_prefs(spark, d), "prefs")
    store.recommend(spark, prefs.where("pref_id % 2 = 0"), cache)
    second = store.recommend(spark, prefs, cache)
    return second.items.select("pref_id", "rank", "id", "explanation", F.lit(second.searched.count()).alias("n_searched"))


# --- evaluation -----------------------------------------------------------------------------------------------------


def expectations_missed(spark: SparkSession, d: str) -> DataFrame:
    """Profiles whose results are dearer, rated lower or fewer than they wish, as a table of expectations finds them."""
    prefs = stage(_prefs(spark, d), "prefs")
    s = search.ProfileSearch(prefs, _canonical(spark, d), CFG)
    wishes = {"max_cost": ("<=", "max_cost_for_two_inr"), "min_rating": (">=", "min_rating"), "n_candidates": (">=", None)}
    none = F.lit(None).cast("bigint").alias("other_id")
    expected = [
        prefs.select(
            "pref_id",
            F.lit(fact).alias("fact"),
            F.lit(side).alias("side"),
            (F.col(bound) if bound else F.lit(CFG.k_min)).cast("double").alias("bound"),
            none,
        )
        for fact, (side, bound) in wishes.items()
    ]
    told = expectations.facts(s.candidates(), s.report())
    return expectations.violations(reduce(DataFrame.unionByName, expected), told).drop("other_id")


def twins_compared(spark: SparkSession, d: str) -> DataFrame:
    """Every profile and a twin with a higher cap: the twin never finds fewer (none missed). Every ninth profile is also
    expected, wrongly, to find no fewer within its budget than its twin."""
    own = stage(_prefs(spark, d), "prefs")
    twin = F.col("pref_id") + 10_000_000
    both = own.unionByName(own.withColumns({"pref_id": twin, "max_cost_for_two_inr": F.col("max_cost_for_two_inr") + 500}))
    strict = search.ProfileSearch(both, _canonical(spark, d), CFG).strict_funnel()
    none = spark.createDataFrame([], "pref_id bigint, cost_for_two bigint, rating double")
    told = expectations.facts(none, strict.withColumn("relaxations", F.array().cast("array<string>")))
    no_bound, at_least = F.lit(None).cast("double").alias("bound"), F.lit(">=").alias("side")
    right = own.select(twin.alias("pref_id"), F.lit("after_rating").alias("fact"), at_least, no_bound, F.col("pref_id").alias("other_id"))
    wrong = own.where("pref_id % 9 = 0").select("pref_id", F.lit("after_budget").alias("fact"), at_least, no_bound, twin.alias("other_id"))
    return expectations.violations(right.unionByName(wrong), told).drop("bound")


# --- signals --------------------------------------------------------------------------------------------------------


def run_signals(spark: SparkSession, d: str) -> DataFrame:
    return signals.outcomes(_answered(spark, d).report(), NO_MODEL)


def places_asked(spark: SparkSession, d: str) -> DataFrame:
    return signals.places_asked(_prefs(spark, d))


def unique_venues(spark: SparkSession, d: str) -> DataFrame:
    return signals.unique_venues(_canonical(spark, d)).select("pos", "id", "name", "city")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        ingest_batch,
        ingest_limit,
        schema_check,
        canonical_roundtrip,
        cache_hit,
        cache_snapshots,
        canonical_listings,
        valid_listings,
        validate_corpus,
        localities,
        ingest_metrics,
        ingest_stream,
        ingest_stream_metrics,
        ingest_batch_metrics,
        quarantine,
        norm_whitespace,
        title_case,
        norm_city,
        split_tokens,
        parse_rating,
        parse_cost,
        cost_tier,
        parse_votes,
        stable_id,
        split_free_text,
        display_columns,
        prefs_validated,
        prefs_rejected,
        token_budget,
        relax_ladder,
        filter_location,
        filter_cuisine,
        filter_budget,
        filter_rating,
        filter_funnel,
        relaxations_applied,
        filter_report,
        relaxed_search,
        topk_candidates,
        packed_candidates,
        rank_candidates,
        fallback_recommendations,
        recommend_batch,
        rec_report,
        reconcile,
        parse_responses,
        grounding_violations,
        prompt_payload,
        completion_hook,
        completion_log,
        few_items,
        few_report,
        recommend_stream,
        recommend_stream_rejected,
        recommend_stream_report,
        recommend_stream_live,
        reuse_half,
        expectations_missed,
        twins_compared,
        run_signals,
        places_asked,
        unique_venues,
    )
}
