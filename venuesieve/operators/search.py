"""Constrained search with relaxation for all profiles at once.

A profile asks for listings that match its location, any of its cuisines, its budget cap and its minimum rating. Too
few hits relax it along a ladder that depends on the profile alone: drop the location, keep the first cuisine only,
lower the rating step by step, raise the cap step by step.

Profiles are never paired with listings. The text conditions are resolved between *distinct* strings (places,
addresses, cuisine lists, wanted lists) by substring equi-joins. Listings shrink to weighted (cost, rating) cells per
search group, and every ladder step is a threshold question on such a group (see ``dominance``).

Search groups are (scope, q, want):

====== ============ =====================================================================================
scope  q            listings
====== ============ =====================================================================================
any    ``''``       all usable listings (profiles without location, or after it was dropped)
place  a location   usable listings with a neighborhood that match the location
blank  ``''``       usable listings without neighborhood; they match every location, so they are counted
                    once and added to each place instead of being paired with it
====== ============ =====================================================================================
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import MAX_BUDGET_INR, SearchConfig
from ..sources.listings import has_required_fields
from ..sources.staging import stage, together
from .containment import containment_pairs, touching_pairs
from .dominance import count_dominated, keep_first, kth_cost, top_within_cap
from .prefix import bucket_of, cut_points

# Labels of the ladder steps.
DROP_LOCATION = "removed_location_filter"
FIRST_CUISINE = "kept_primary_cuisine_only"
LOWER_RATING = "lowered_min_rating"
RAISE_BUDGET = "increased_budget_cap_inr"

RATING_SLACK = 1e-9
_LOWEST = float("-inf")
_NO_WANT = "[]"
_GROUP = ["scope", "q", "want"]
_PLACE = ["place_city", "hood"]
_CELL = ["tags", "cost", "rating"]
_ID = ["gid"]  # a group's number, which travels in place of its three strings

_PAYLOAD = ["id", "name", "city", "neighborhood", "cuisines", "rating", "cost_for_two", "cost_tier", "votes"]


# --- ladder ---------------------------------------------------------------------------------------------------------


def rating_ladder(min_rating: Column, cfg: SearchConfig) -> Column:
    """All minimum ratings a profile passes through, by repeated subtraction so that the doubles come out equal."""
    most = max(0, int((5.0 - cfg.min_rating_floor) / cfg.rating_relax_step) + 2)
    if most == 0:
        return F.array(min_rating)
    last = lambda acc: F.element_at(acc, -1)
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(most)),
        F.array(min_rating),
        lambda acc, _: F.when(
            last(acc) > F.lit(cfg.min_rating_floor + RATING_SLACK),
            F.concat(
                acc, F.array(F.greatest(F.lit(float(cfg.min_rating_floor)), last(acc) - F.lit(cfg.rating_relax_step)))
            ),
        ).otherwise(acc),
    )


def budget_steps(cap: Column, cfg: SearchConfig) -> Column:
    """How often the cap can still be raised."""
    step, ceiling = cfg.budget_relax_step_inr, cfg.budget_relax_ceiling_inr
    if step <= 0:
        return F.lit(0).cast("bigint")
    return F.greatest(F.lit(0), F.ceil((F.lit(ceiling) - cap) / F.lit(step))).cast("bigint")


def with_ladder(prefs: DataFrame, cfg: SearchConfig) -> DataFrame:
    """Add the ladder's shape: one flag or count per kind of step."""
    return prefs.withColumns(
        {
            "loc_steps": F.col("location").isNotNull().cast("int"),
            "cuisine_steps": (F.size("cuisines") > 1).cast("int"),
            "ratings": rating_ladder(F.col("min_rating"), cfg),
            "raises": budget_steps(F.col("max_cost_for_two_inr"), cfg),
        }
    )


def _step_label(step: Column) -> Column:
    """Label of a ladder step, counted from 1."""
    before_cuisine = F.col("loc_steps")
    before_rating = before_cuisine + F.col("cuisine_steps")
    before_budget = before_rating + F.size("ratings") - 1
    return (
        F.when(step <= before_cuisine, DROP_LOCATION)
        .when(step <= before_rating, FIRST_CUISINE)
        .when(step <= before_budget, LOWER_RATING)
        .otherwise(RAISE_BUDGET)
    )


def step_labels(stop: Column) -> Column:
    """Labels of ladder steps 1..stop."""
    steps = F.sequence(F.lit(1).cast("bigint"), stop.cast("bigint"))
    return F.when(stop > 0, F.transform(steps, _step_label)).otherwise(F.array().cast("array<string>"))


def relax_ladder(prefs: DataFrame, cfg: SearchConfig = SearchConfig()) -> DataFrame:
    """One row per profile and ladder step, strict step 0 first, with the parameters in force at that step."""
    shaped = with_ladder(prefs, cfg).withColumn("rating_steps", F.size("ratings") - 1)
    free = F.col("loc_steps") + F.col("cuisine_steps")
    last = free + F.col("rating_steps") + F.col("raises")
    steps = shaped.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), last.cast("bigint"))).alias("step"))
    step = F.col("step")
    lowered = F.greatest(F.lit(0), F.least(F.col("rating_steps"), step - free)).cast("int")
    raised = F.greatest(F.lit(0).cast("bigint"), step - free - F.col("rating_steps"))
    cap = F.col("max_cost_for_two_inr")
    return steps.select(
        "pref_id",
        "step",
        F.when(step > 0, _step_label(step)).alias("label"),
        F.when(step < F.col("loc_steps") + F.lit(0), F.col("location"))
        .when(F.col("loc_steps") == 0, F.col("location"))
        .alias("location"),
        F.when((F.col("cuisine_steps") == 1) & (step >= free), F.slice("cuisines", 1, 1))
        .otherwise(F.col("cuisines"))
        .alias("cuisines"),
        F.get("ratings", lowered).alias("min_rating"),
        F.when(raised > 0, F.least(F.lit(cfg.budget_relax_ceiling_inr), cap + raised * cfg.budget_relax_step_inr))
        .otherwise(cap)
        .alias("max_cost_for_two_inr"),
    )


# --- text conditions between distinct strings -----------------------------------------------------------------------


def _want_key(tokens: Column) -> Column:
    """A wanted list as a set; JSON keeps any token apart from its neighbours."""
    return F.to_json(F.sort_array(F.array_distinct(tokens)))


def _tokens(frame: DataFrame, key: str, token: str) -> DataFrame:
    """(key, token) of distinct JSON token lists."""
    return frame.select(key, F.explode(F.from_json(F.col(key), "array<string>")).alias(token))


def _searched(listings: DataFrame) -> DataFrame:
    """The searched columns, lower-cased, what a result shows of a listing, and whether the listing is usable."""
    return listings.select(
        "pos",
        has_required_fields().alias("usable"),
        F.lower("city").alias("place_city"),
        F.lower("neighborhood").alias("hood"),
        F.lower(F.coalesce(F.col("raw_fields.address"), F.lit(""))).alias("address"),
        F.to_json(F.sort_array("cuisines")).alias("tags"),
        F.col("cost_for_two").alias("cost"),
        F.coalesce("votes", F.lit(0).cast("bigint")).alias("rank_votes"),
        F.lower("name").alias("lname"),
        *_PAYLOAD,
    )


def _lean(listings: DataFrame) -> DataFrame:
    """Usable listings, as searched and shown."""
    return _usable(_searched(listings))


def _usable(searched: DataFrame) -> DataFrame:
    return searched.where("usable").drop("usable")


def _requests(prefs: DataFrame, cfg: SearchConfig) -> tuple[DataFrame, DataFrame]:
    """(distinct requests, profile -> request), both staged. Profiles that ask the same are searched once."""
    asked = prefs.select(
        "pref_id",
        F.coalesce(F.lower("location"), F.lit("")).alias("q"),
        "cuisines",
        F.col("max_cost_for_two_inr").alias("cap"),
        "min_rating",
    ).withColumn("req", F.sha2(F.to_json(F.struct("q", "cuisines", "cap", "min_rating")), 256))
    asked = stage(asked, "asked")
    primary = F.when(F.size("cuisines") > 1, F.slice("cuisines", 1, 1)).otherwise(F.col("cuisines"))
    requests = (
        asked.drop("pref_id")
        .distinct()
        .select(
            "req",
            "q",
            _want_key(F.col("cuisines")).alias("want"),
            _want_key(primary).alias("prime"),
            "cap",
            (F.col("q") != "").cast("int").alias("loc_steps"),
            (F.size("cuisines") > 1).cast("int").alias("cuisine_steps"),
            rating_ladder(F.col("min_rating"), cfg).alias("ratings"),
            budget_steps(F.col("cap"), cfg).alias("raises"),
        )
    )
    return stage(requests, "requests"), asked.select("pref_id", "req")


@dataclass(frozen=True)
class _Places:
    """Which distinct places and addresses match which distinct locations."""

    by_place: DataFrame  # place_city, hood, q
    by_address: DataFrame  # address, q


def _match_places(corpus: Corpus, requests: DataFrame) -> _Places:
    spark, places = requests.sparkSession, corpus.places
    names = places.select(F.explode(F.array("place_city", "hood")).alias("place_name")).distinct()
    locations, names = together(
        spark,
        lambda: stage(requests.where(F.col("q") != "").select("q").distinct(), "locations"),
        lambda: stage(names, "place-names"),
    )

    def by_place() -> DataFrame:
        touching = stage(touching_pairs(locations, names, "q", "place_name"), "touching")
        pairs = places.withColumn("place_name", F.explode(F.array_distinct(F.array("place_city", "hood"))))
        return stage(pairs.join(touching, "place_name").select("place_city", "hood", "q").distinct(), "by-place")

    def by_address() -> DataFrame:
        addresses = corpus.addresses.withColumnRenamed("address", "haystack")
        pairs = containment_pairs(locations.withColumnRenamed("q", "needle"), addresses)
        return stage(pairs.select(F.col("haystack").alias("address"), F.col("needle").alias("q")), "by-address")

    return _Places(*together(spark, by_place, by_address))


def _match_tokens(tag_lists: DataFrame, requests: DataFrame) -> DataFrame:
    """(want, c): listed cuisine tokens that satisfy a wanted list."""
    wants = requests.select("want").union(requests.select("prime")).distinct()
    wanted = _tokens(wants, "want", "w")
    listed = _tokens(tag_lists, "tags", "c").select("c").distinct()
    pairs = touching_pairs(wanted.select("w").distinct(), listed, "w", "c")
    return stage(wanted.join(pairs, "w").select("want", "c").distinct(), "want-tokens")


# --- search groups --------------------------------------------------------------------------------------------------


def _asked_places(places: _Places, scopes: DataFrame) -> _Places:
    """The matches of those locations that are among the wanted scopes."""
    asked = scopes.where(F.col("scope") == "place").select("q")
    return _Places(places.by_place.join(asked, "q", "left_semi"), places.by_address.join(asked, "q", "left_semi"))


def _at_asked(located: DataFrame, by_place: DataFrame) -> DataFrame:
    """Rows of the places that some location matches."""
    return located.join(by_place.select(_PLACE).distinct(), _PLACE, "left_semi")


def _at_address(lean: DataFrame, places: _Places) -> DataFrame:
    """Listings for the locations that match their address, but not their place."""
    located = lean.where(F.col("hood") != "")
    found = located.join(places.by_address, "address").join(places.by_place, [*_PLACE, "q"], "left_anti")
    return found.withColumn("scope", F.lit("place"))


def _everywhere(rows: DataFrame, scopes: DataFrame) -> DataFrame:
    """Rows of the scopes that are no place: a usable listing belongs to "any", and to "blank" as well if it has no
    neighborhood."""
    own = F.when(F.col("hood") == "", F.array(F.lit("any"), F.lit("blank"))).otherwise(F.array(F.lit("any")))
    return rows.withColumns({"scope": F.explode(own), "q": F.lit("")}).join(scopes, ["scope", "q"], "left_semi")


def _handed_out(rows: DataFrame, by_place: DataFrame) -> DataFrame:
    """Rows of a place, once for each location that matches it."""
    return rows.join(by_place, _PLACE).drop(*_PLACE).withColumn("scope", F.lit("place"))


def _group_matches(scoped: DataFrame, groups: DataFrame, want_tokens: DataFrame) -> DataFrame:
    """(gid, scope, q, tags): the distinct cuisine lists that belong to each group.

    Joined on (scope, q, token), so only lists that share a matching token with a wanted list ever meet it. A scope
    has at most one group that wants nothing in particular; that one takes every list of its scope.
    """
    offered = scoped.select("scope", "q", "tags").distinct()
    free = groups.where(F.col("want") == _NO_WANT).join(offered, ["scope", "q"])
    asked = groups.where(F.col("want") != _NO_WANT).join(want_tokens, "want")
    by_token = offered.withColumn("c", F.explode(F.from_json("tags", "array<string>")))
    shared = asked.join(by_token, ["scope", "q", "c"]).select(*_ID, "scope", "q", "tags").distinct()
    return shared.unionByName(free.select(*_ID, "scope", "q", "tags"))


def _group_of(q: Column, strict: Column) -> Column:
    """Groups a question goes to: a strict question with a location asks its place and the blank listings."""
    group = lambda scope, q_: F.struct(F.lit(scope).alias("scope"), q_.alias("q"))
    return F.when(strict & (q != ""), F.array(group("place", q), group("blank", F.lit("")))).otherwise(
        F.array(group("any", F.lit("")))
    )


def _ask(questions: DataFrame, strict: Column) -> DataFrame:
    return questions.withColumn("g", F.explode(_group_of(F.col("q"), strict))).withColumns(
        {"scope": F.col("g.scope"), "q": F.col("g.q")}
    ).drop("g")


# --- the search -----------------------------------------------------------------------------------------------------


class Corpus:
    """Usable listings in the form a search reads, their numbers by place, cuisine list, cost and rating, and their distinct
    places, addresses and cuisine lists, staged once for any number of searches."""

    def __init__(self, listings: DataFrame):
        # The filter runs on the staged flag: ahead of the stage Spark would move it below the projection of names and
        # cities, which every row would then pass twice, in one method too long for the JVM to compile.
        self.lean = _usable(stage(_searched(listings), "lean"))
        spark, located = listings.sparkSession, self.lean.where(F.col("hood") != "")
        counts = self.lean.groupBy(*_PLACE, *_CELL).agg(F.count(F.lit(1)).alias("n"))
        self.counts, self.addresses = together(
            spark,
            lambda: stage(counts, "counts"),
            lambda: stage(located.select("address").distinct(), "addresses"),
        )
        placed = self.counts.where(F.col("hood") != "").select(*_PLACE, "tags")
        self.place_tags, self.tag_lists = together(
            spark,
            lambda: stage(placed.distinct(), "place-tags"),
            lambda: stage(self.counts.select("tags").distinct(), "tag-lists"),
        )
        self.places = stage(self.place_tags.select(_PLACE).distinct(), "places")


class ProfileSearch:
    """One corpus against one table of validated profiles.

    The corpus and the requests are staged when the object is built. Asking for candidates, a funnel or a report stages
    the counts it rests on; what is returned is lazy from there.
    """

    def __init__(self, prefs: DataFrame, listings: DataFrame | Corpus, cfg: SearchConfig = SearchConfig()):
        self.cfg = cfg
        spark = prefs.sparkSession
        (self.requests, self.profiles), corpus = together(
            spark,
            lambda: _requests(prefs, cfg),
            lambda: listings if isinstance(listings, Corpus) else Corpus(listings),
        )
        self.corpus, self.lean = corpus, corpus.lean
        self.places, self.want_tokens, self.groups = together(
            spark,
            lambda: _match_places(corpus, self.requests),
            lambda: _match_tokens(corpus.tag_lists, self.requests),
            self._groups,
        )
        self.cells, self.totals = self._cells()
        self._stops: DataFrame | None = None

    # Groups any ladder step of any request can ask.
    def _groups(self) -> DataFrame:
        strict = _ask(self.requests.select("q", "want"), F.lit(True))
        relaxed = self.requests.select(F.lit("any").alias("scope"), F.lit("").alias("q"), "want")
        prime = self.requests.select(F.lit("any").alias("scope"), F.lit("").alias("q"), F.col("prime").alias("want"))
        groups = strict.select(_GROUP).unionByName(relaxed).unionByName(prime).distinct()
        return stage(groups.withColumn("gid", F.monotonically_increasing_id()), "groups")

    def _asked(self, questions: DataFrame, strict: Column) -> DataFrame:
        """``questions`` for each group they go to, with its number."""
        return _ask(questions, strict).join(self.groups, _GROUP)

    def _cells(self) -> tuple[DataFrame, DataFrame]:
        """(cost-rating cells per group, listings per scope)."""

        def weigh(rows: DataFrame) -> DataFrame:
            return rows.groupBy("scope", "q", *_CELL).agg(F.sum("n").alias("n"))

        scopes = self.groups.select("scope", "q").distinct()
        places, counts = _asked_places(self.places, scopes), self.corpus.counts
        located = counts.where(F.col("hood") != "")
        everywhere = weigh(_everywhere(counts, scopes))
        at_place = _handed_out(_at_asked(located, places.by_place), places.by_place)
        at_address = weigh(_at_address(self.lean, places).withColumn("n", F.lit(1).cast("bigint")))
        self.scoped = scoped = stage(everywhere.unionByName(at_place).unionByName(at_address), "scoped")
        self.matches = stage(_group_matches(scoped, self.groups, self.want_tokens), "matches")
        cells = (
            scoped.join(self.matches, ["scope", "q", "tags"])
            .groupBy(*_ID, "cost", "rating")
            .agg(F.sum("n").alias("n"))
        )
        totals = scoped.groupBy("scope", "q").agg(F.sum("n").alias("n"))
        return stage(cells, "cells"), totals

    @property
    def _reach(self) -> int:
        """No cap can be higher than this."""
        return max(MAX_BUDGET_INR, self.cfg.budget_relax_ceiling_inr)

    @cached_property
    def _cuts(self) -> list:
        """Costs and caps that spread the work of a hot group."""
        costs = self._priced.select("cost").union(self.requests.select("cap"))
        return cut_points(costs, "cost")

    @property
    def _priced(self) -> DataFrame:
        """Cells a cap can reach; an unknown rating sits below every minimum."""
        return self.cells.where(F.col("cost") <= self._reach).withColumn(
            "rating", F.coalesce("rating", F.lit(_LOWEST))
        )

    def stops(self) -> DataFrame:
        """Per request: the ladder step the search ends at and the parameters in force there."""
        if self._stops is None:
            self._stops = stage(self._find_stops(), "stops")
        return self._stops

    def _find_stops(self) -> DataFrame:
        cfg = self.cfg
        free = F.col("loc_steps") + F.col("cuisine_steps")
        last_free = free + F.size("ratings") - 1
        steps = self.requests.select(
            "*", last_free.alias("last_free"), F.explode(F.sequence(F.lit(0), last_free)).alias("step")
        )
        step = F.col("step")
        steps = steps.withColumns(
            {
                "want": F.when((F.col("cuisine_steps") == 1) & (step >= free), F.col("prime")).otherwise(
                    F.col("want")
                ),
                "t": F.get("ratings", F.greatest(F.lit(0), step - free)),
            }
        )
        asked = self._asked(steps, step == 0)
        points = asked.select(*_ID, "cap", "t").distinct()
        hits = count_dominated(self._priced, points, _ID, self._cuts)
        counted = (
            asked.join(hits, [*_ID, "cap", "t"], "left")
            .groupBy("req", "step")
            .agg(F.sum(F.coalesce("hits", F.lit(0))).alias("hits"))
        )
        reached = (
            counted.where(F.col("hits") >= cfg.k_min).groupBy("req").agg(F.min("step").cast("bigint").alias("stop"))
        )
        known = stage(self.requests.join(reached, "req", "left"), "known")

        # Only the budget is left to relax: the k-th cheapest listing tells how far it must rise.
        last_rating = F.element_at("ratings", -1)
        open_ = known.where(F.col("stop").isNull()).withColumns(
            {"scope": F.lit("any"), "q": F.lit(""), "want": F.col("prime"), "t": last_rating}
        )
        open_ = open_.join(self.groups, _GROUP)
        wanted = open_.select(*_ID, "t").distinct()
        needed = self._priced.join(wanted.select(_ID).distinct(), _ID, "left_semi")
        kth = kth_cost(needed, wanted, _ID, max(1, cfg.k_min))
        step_size = max(1, cfg.budget_relax_step_inr)
        raises = F.when(
            F.col("kth_cost") <= cfg.budget_relax_ceiling_inr,
            F.least(F.col("raises"), F.ceil((F.col("kth_cost") - F.col("cap")) / F.lit(step_size))),
        ).otherwise(F.col("raises"))
        budget_stop = open_.join(kth, [*_ID, "t"], "left").select("req", (last_free + raises).alias("late"))

        stop = F.coalesce("stop", "late")
        raised = F.greatest(F.lit(0).cast("bigint"), stop - last_free)
        resolved = known.join(budget_stop, "req", "left").withColumns({"stop": stop, "raised": raised})
        at_start = F.col("stop") == 0
        return resolved.select(
            "req",
            "stop",
            F.when(at_start | (F.col("loc_steps") == 0), F.col("q")).otherwise("").alias("q"),
            F.when((F.col("cuisine_steps") == 1) & (F.col("stop") >= free), F.col("prime"))
            .otherwise(F.col("want"))
            .alias("want"),
            F.when(
                F.col("raised") > 0,
                F.least(F.lit(cfg.budget_relax_ceiling_inr).cast("bigint"), F.col("cap") + F.col("raised") * step_size),
            )
            .otherwise(F.col("cap"))
            .alias("cap"),
            F.get(
                "ratings", F.greatest(F.lit(0), F.least(F.size("ratings") - 1, F.col("stop") - free)).cast("int")
            ).alias("t"),
            step_labels(F.col("stop")).alias("relaxations"),
        )

    def _final_questions(self) -> DataFrame:
        return self._asked(self.stops(), F.col("stop") == 0)

    def _funnel(self, asked: DataFrame) -> DataFrame:
        """Per request: listings left after each of the four filters. ``asked``: req, scope, q, gid, cap, t."""
        groups = asked.select(_ID).distinct()
        by_group = (
            self.cells.join(groups, _ID, "left_semi").groupBy(_ID).agg(F.sum("n").alias("after_cuisine"))
        )
        thresholds = asked.select(*_ID, "cap", "t")
        points = thresholds.unionByName(thresholds.withColumn("t", F.lit(_LOWEST))).distinct()
        needed = self._priced.join(groups, _ID, "left_semi")
        hits = stage(count_dominated(needed, points, _ID, self._cuts), "hits")
        unrated = hits.where(F.col("t") == _LOWEST).drop("t").withColumnRenamed("hits", "after_budget")

        def total(name: str) -> Column:
            return F.sum(F.coalesce(name, F.lit(0).cast("bigint"))).alias(f"total_{name}")

        return (
            asked.join(self.totals.withColumnRenamed("n", "after_location"), ["scope", "q"], "left")
            .join(by_group, _ID, "left")
            .join(unrated, [*_ID, "cap"], "left")
            .join(hits.withColumnRenamed("hits", "after_rating"), [*_ID, "cap", "t"], "left")
            .groupBy("req")
            .agg(total("after_location"), total("after_cuisine"), total("after_budget"), total("after_rating"))
        )

    def strict_funnel(self) -> DataFrame:
        """Per profile: the funnel of its own wishes, nothing relaxed."""
        wishes = self.requests.select("req", "q", "want", "cap", F.get("ratings", F.lit(0)).alias("t"))
        return self.profiles.join(self._funnel(self._asked(wishes, F.lit(True))), "req").drop("req")

    def report(self) -> DataFrame:
        """Per profile: funnel of the last pass, relaxations in order, stop step, truncation flag."""
        funnel = self._funnel(self._final_questions().select("req", "scope", "q", *_ID, "cap", "t"))
        per_request = self.stops().select("req", "stop", "relaxations").join(funnel, "req")
        return (
            self.profiles.join(per_request, "req")
            .drop("req")
            .withColumn("truncated", F.col("total_after_rating") > self.cfg.max_candidates)
        )

    def relaxations(self) -> DataFrame:
        return self.profiles.join(self.stops().select("req", "stop", "relaxations"), "req").drop("req")

    def _floors(self, parts: list, k: int) -> DataFrame:
        """(scope, q, tags, floors), where ``floors`` gives for each part of the costs the rating that ``k`` listings in the
        parts below it reach, NULL if there are not as many.

        A listing rated lower has ``k`` before it whatever the cap, so it answers no question.
        """
        key = ["scope", "q", "tags"]
        rated = self.scoped.where((F.col("cost") <= self._reach) & F.col("rating").isNotNull())
        summed = rated.groupBy(*key, bucket_of("cost", parts).alias("part"), "rating").agg(F.sum("n").alias("n"))
        above = summed.where(F.col("part") < len(parts)).withColumn(
            "part", F.explode(F.sequence(F.col("part") + 1, F.lit(len(parts))))
        )
        better = W.partitionBy(*key, "part").orderBy(F.col("rating").desc())
        reached = (
            above.groupBy(*key, "part", "rating")
            .agg(F.sum("n").alias("n"))
            .withColumn("upto", F.sum("n").over(better))
            .where(F.col("upto") >= k)
            .groupBy(*key, "part")
            .agg(F.max("rating").alias("floor"))
        )
        floors = F.array(*[F.max(F.when(F.col("part") == i, F.col("floor"))) for i in range(len(parts) + 1)])
        return stage(reached.groupBy(*key).agg(floors.alias("floors")), "floors")

    def _place_floors(self, by_place: DataFrame, floors: DataFrame, parts: list) -> DataFrame:
        """(place_city, hood, tags, floors): the lowest of the floors of all locations that a place is handed to."""
        handed = self.corpus.place_tags.join(by_place, _PLACE)
        met = handed.join(floors.where(F.col("scope") == "place").drop("scope"), ["q", "tags"], "left")

        def lowest(i: int) -> Column:
            floor = F.get("floors", F.lit(i))
            return F.when(F.count(floor) == F.count(F.lit(1)), F.min(floor))

        lows = F.array(*[lowest(i) for i in range(len(parts) + 1)]).alias("floors")
        found = met.groupBy(*_PLACE, "tags").agg(lows)
        return stage(found.where(F.exists("floors", lambda f: f.isNotNull())), "place-floors")

    def _ranked(self) -> DataFrame:
        """Per request: its first ``max_candidates`` listings, as (req, cand_pos, pos)."""
        order = [F.col("rating").desc(), F.col("rank_votes").desc(), F.col("lname"), F.col("pos")]
        k = self.cfg.max_candidates
        asked = stage(self._final_questions(), "final-questions")
        groups = asked.select("scope", "q", *_ID).distinct()

        # A listing beaten by k others of equal cost in the same place and cuisine list can answer no question.
        def trim(rows: DataFrame, keys: list[str]) -> DataFrame:
            slim = rows.select(*keys, "tags", "cost", "rating", "rank_votes", "lname", "pos")
            return keep_first(slim, [*keys, "tags", "cost"], order, k)

        # Parts that double: of every part but the first, as many listings as it holds lie below it.
        parts = [self._cuts[2**i - 1] for i in range(6) if 2**i <= len(self._cuts)]
        scopes = groups.select("scope", "q").distinct()
        places = _asked_places(self.places, scopes)
        floors = self._floors(parts, max(1, k))
        place_floors = self._place_floors(places.by_place, floors, parts)

        def prune(rows: DataFrame, floors: DataFrame, keys: list[str]) -> DataFrame:
            met = rows.join(floors, [*keys, "tags"], "left")
            floor = F.get("floors", bucket_of("cost", parts))
            return met.where(F.coalesce(F.col("rating") >= floor, F.lit(True))).drop("floors")

        scope = ["scope", "q"]
        rated = self.lean.where((F.col("cost") <= self._reach) & F.col("rating").isNotNull())
        located = rated.where(F.col("hood") != "")
        everywhere = trim(prune(_everywhere(rated, scopes), floors, scope), scope)
        kept = trim(prune(_at_asked(located, places.by_place), place_floors, _PLACE), _PLACE)
        at_place = prune(_handed_out(kept, places.by_place), floors, scope)
        at_address = trim(prune(_at_address(rated, places), floors, scope), scope)
        scoped = everywhere.unionByName(at_place).unionByName(at_address)
        matches = self.matches.join(groups, _ID, "left_semi")
        rows = scoped.join(matches, ["scope", "q", "tags"]).drop("scope", "q", "tags")
        costs = self._priced.join(groups, _ID, "left_semi").select(*_ID, "cost")
        best = top_within_cap(rows, costs, asked.select(*_ID, "cap"), _ID, order, k)
        # Rating leads the rank, so a minimum rating only cuts the tail of the list.
        answers = (
            asked.select("req", *_ID, "cap", "t")
            .join(best, [*_ID, "cap"])
            .where(F.col("rating") >= F.col("t"))
        )
        at = F.row_number().over(W.partitionBy("req").orderBy(*order))
        return (
            answers.withColumn("cand_pos", at)
            .where(F.col("cand_pos") <= k)
            .select("req", F.col("cand_pos").cast("int").alias("cand_pos"), "pos")
        )

    @cached_property
    def found(self) -> DataFrame:
        """Per request: the capped, ranked listings of the last pass, staged.

        What is shown of a listing is fetched once, however many requests list it.
        """
        ranked = stage(self._ranked(), "ranked")
        shown = self.lean.select("pos", *_PAYLOAD).join(ranked.select("pos").distinct(), "pos", "left_semi")
        found = ranked.join(stage(shown, "shown"), "pos")
        return stage(found.select("req", "cand_pos", "pos", *_PAYLOAD), "found")

    def candidates(self) -> DataFrame:
        """Per profile: the listings that its request found."""
        return self.profiles.join(self.found, "req").select("pref_id", "cand_pos", "pos", *_PAYLOAD)
