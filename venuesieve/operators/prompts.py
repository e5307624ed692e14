"""One prompt row per profile, and the result size and token budget that go with it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import MAX_TOP_K, AnswerConfig

# Version tag and the shape of the payload.
PROMPT_VERSION = "v2"
ANY_PLACE = "any locality"
ANY_CUISINE = "any cuisine (user did not specify)"
CANDIDATE_FIELDS = (
    "id",
    "name",
    "city",
    "neighborhood",
    "cuisines",
    "rating",
    "cost_for_two",
    "cost_tier",
    "votes",
)

SYSTEM = (
    "You choose venues for one person. The message is a JSON object: user_preferences holds the wishes, relaxed lists "
    "in order how wishes were loosened because too few venues met them, candidates holds every venue on offer. Choose "
    "among candidates only and name each choice by its id, copied letter for letter. If a loosened wish shows in a "
    "choice, say that in its explanation. If no venue suits, choose the nearest and say that in the summary."
)

_TASK = (
    'Answer with one JSON object: {{"summary": one sentence, "recommendations": [{{"rank": 1, "restaurant_id": an id '
    'from candidates, "explanation": why it fits, one to three sentences}}]}}. Give at most {k} recommendations, best '
    "first, ranks counting from 1. No other text."
)


def resolve_top_k(asked: Column, cfg: AnswerConfig = AnswerConfig()) -> Column:
    return F.least(F.coalesce(asked, F.lit(cfg.top_k)), F.lit(MAX_TOP_K)).cast("int")


def token_budget(top_k: Column, cfg: AnswerConfig = AnswerConfig()) -> Column:
    """Long answers get room: 350 tokens plus 85 per pick, up to 4096, but never less than configured."""
    needed = F.lit(350) + top_k * 85
    return (
        F.when(F.lit(cfg.max_tokens) < needed, F.least(F.lit(4096), needed))
        .otherwise(F.lit(cfg.max_tokens))
        .cast("int")
    )


def answer_limits(prefs: DataFrame, cfg: AnswerConfig = AnswerConfig()) -> DataFrame:
    k = resolve_top_k(F.col("top_k"), cfg)
    return prefs.select("pref_id", k.alias("top_k"), token_budget(k, cfg).alias("max_tokens"))


def pack_candidates(candidates: DataFrame, key: str = "pref_id") -> DataFrame:
    """Per profile (or ``key``), its candidates as one array in rank order. The search has capped them."""
    item = F.struct("cand_pos", *CANDIDATE_FIELDS)
    packed = candidates.groupBy(key).agg(F.sort_array(F.collect_list(item)).alias("packed"))
    bare = F.transform("packed", lambda c: F.struct(*[c[f].alias(f) for f in CANDIDATE_FIELDS]))
    return packed.select(key, bare.alias("candidates"))


def _json(c: Column) -> Column:
    return F.coalesce(F.to_json(c, {"ignoreNullFields": "false"}), F.lit("null"))


def shortlists(found: DataFrame, relaxations: DataFrame) -> DataFrame:
    """``req, relaxed, offered``: what all profiles of a request are told, as JSON that is written once for all of them.

    ``found`` are the candidates of each request (``ProfileSearch.found``); ``relaxations`` (``req, relaxations``) tells
    which wishes they need not meet.
    """
    packed = pack_candidates(found, "req").join(relaxations.select("req", "relaxations"), "req")
    return packed.select("req", _json(F.col("relaxations")).alias("relaxed"), _json(F.col("candidates")).alias("offered"))


def build_prompts(prefs: DataFrame, profiles: DataFrame, offers: DataFrame, cfg: AnswerConfig) -> DataFrame:
    """``pref_id, system, user, model, temperature, max_tokens`` for every profile that has candidates.

    ``profiles`` (``pref_id, req``) names each profile's request, ``offers`` are the ``shortlists`` of the requests.
    """
    k = resolve_top_k(F.col("top_k"), cfg)
    before, after = _TASK.format(k="\0").split("\0")
    wishes = F.struct(
        F.coalesce("location", F.lit(ANY_PLACE)).alias("locality_or_area"),
        F.col("max_cost_for_two_inr").alias("max_budget_inr_for_two"),
        F.when(F.size("cuisines") == 0, ANY_CUISINE)
        .otherwise(F.array_join("cuisines", ", "))
        .alias("cuisine_preferences"),
        "min_rating",
        F.nullif("extras", F.lit("")).alias("extras"),
    )
    instructions = F.concat(F.lit(before), k.cast("string"), F.lit(after)).alias("instructions")
    asked = prefs.select(
        "pref_id",
        F.struct(wishes.alias("user_preferences")).alias("head"),
        F.struct(instructions).alias("tail"),
        token_budget(k, cfg).alias("max_tokens"),
    )
    # One object: the head without its closing brace, the tail without its opening one.
    head, tail = _json(F.col("head")), F.substr(_json(F.col("tail")), F.lit(2))
    body = F.concat(
        F.substr(head, F.lit(1), F.length(head) - 1),
        F.lit(',"relaxed":'),
        "relaxed",
        F.lit(',"candidates":'),
        "offered",
        F.lit(","),
        tail,
    )
    return asked.join(profiles, "pref_id").join(offers, "req").select(
        "pref_id",
        F.lit(SYSTEM).alias("system"),
        body.alias("user"),
        F.lit(cfg.model).alias("model"),
        F.lit(cfg.temperature).alias("temperature"),
        "max_tokens",
    )
