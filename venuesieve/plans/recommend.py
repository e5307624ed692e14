"""Search, answer, ground: the whole way from profiles and listings to recommendations."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import AnswerConfig, SearchConfig
from ..operators.prompts import PROMPT_VERSION, answer_limits, build_prompts, shortlists
from ..operators.reconcile import fall_back, grounding_violations, reconcile, resolve
from ..operators.responses import parse_entries, read_answers
from ..operators.search import Corpus, ProfileSearch
from ..sources.staging import stage

# Model ids and summaries of results that no model wrote.
FALLBACK_MODEL = "deterministic_fallback"
FALLBACK_SUMMARY = "Here are top picks from your filtered list."
NO_MODEL = "none"
NO_SUMMARY = "No restaurants matched your filters."

ITEM_COLUMNS = (
    "pref_id",
    "rank",
    "id",
    "name",
    "city",
    "neighborhood",
    "cuisines",
    "rating",
    "cost_for_two",
    "cost_tier",
    "explanation",
)


@dataclass
class Recommender:
    """Recommendations for a table of validated profiles over a canonical corpus.

    ``responses`` holds model answers (``pref_id, raw``, and ``model`` if known), from ``prompts`` and
    ``operators.responses.complete`` or from anywhere else. Profiles without a usable answer get the deterministic
    ranking. Answers to ``prompts`` go into ``with_answers``, so that model and reconciliation see one candidate list.
    """

    prefs: DataFrame
    listings: DataFrame | Corpus
    responses: DataFrame | None = None
    search_config: SearchConfig = SearchConfig()
    answer_config: AnswerConfig = AnswerConfig()

    @cached_property
    def search(self) -> ProfileSearch:
        return ProfileSearch(self.prefs, self.listings, self.search_config)

    def with_answers(self, responses: DataFrame) -> Recommender:
        """The same search and candidates, with model answers to read."""
        answered = replace(self, responses=responses)
        answered.search, answered.candidates = self.search, self.candidates
        return answered

    @cached_property
    def candidates(self) -> DataFrame:
        return stage(self.search.candidates(), "candidates")

    @cached_property
    def limits(self) -> DataFrame:
        return answer_limits(self.prefs, self.answer_config).select("pref_id", "top_k")

    def prompts(self) -> DataFrame:
        offers = shortlists(self.search.found, self.search.stops())
        return build_prompts(self.prefs, self.search.profiles, offers, self.answer_config)

    @cached_property
    def _answers(self) -> DataFrame | None:
        return None if self.responses is None else stage(read_answers(self.responses), "answers")

    def items(self) -> DataFrame:
        """One row per recommendation, ranks counting from 1."""
        if self._answers is None:
            # Straight from what the requests found: no table of candidates by profile, and none to look them up in.
            limits = self.search.profiles.join(self.limits, "pref_id")
            shown = [c for c in ITEM_COLUMNS if c not in ("pref_id", "rank", "explanation")]
            return fall_back(self.search.found, limits, "req", shown).select(*ITEM_COLUMNS)
        usable = self._answers.where("ok").select("pref_id")
        answered = self.limits.join(usable, "pref_id", "left_semi")
        unanswered = self.limits.join(usable, "pref_id", "left_anti")
        grounded = reconcile(parse_entries(self._answers), self.candidates, answered)
        picks = grounded.unionByName(fall_back(self.candidates, unanswered))
        return picks.join(self.candidates, ["pref_id", "cand_pos"]).select(*ITEM_COLUMNS)

    def violations(self) -> DataFrame:
        """Recommended items that are no candidates; there can be none, as items are drawn from the candidates."""
        return grounding_violations(self.items(), self.candidates)

    def named(self) -> DataFrame:
        """What the usable answers name, entry by entry; ``id`` is NULL where it is no candidate of the profile."""
        if self._answers is None:
            raise ValueError("there are no answers to check")
        return resolve(parse_entries(self._answers), self.candidates)

    def report(self) -> DataFrame:
        """One row per profile: who answered, what was relaxed, the funnel."""
        found = self.search.report()
        if self._answers is None:
            nothing = F.lit(None).cast("string")
            answered = found.select("*", F.lit(False).alias("ok"), nothing.alias("said"), nothing.alias("model"))
        else:
            said = self._answers.select("pref_id", "ok", F.col("summary").alias("said"), "model")
            answered = found.join(said, "pref_id", "left").withColumn("ok", F.coalesce("ok", F.lit(False)))
        empty = F.col("total_after_rating") == 0
        return answered.select(
            "pref_id",
            F.when(empty, NO_SUMMARY).when(F.col("ok"), F.col("said")).otherwise(FALLBACK_SUMMARY).alias("summary"),
            F.when(empty, NO_MODEL)
            .when(F.col("ok"), F.coalesce("model", F.lit(self.answer_config.model)))
            .otherwise(FALLBACK_MODEL)
            .alias("model_id"),
            F.lit(PROMPT_VERSION).alias("prompt_version"),
            (empty | ~F.col("ok")).alias("fallback_used"),
            F.col("relaxations").alias("relaxations_applied"),
            "truncated",
            "total_after_location",
            "total_after_cuisine",
            "total_after_budget",
            "total_after_rating",
        )
