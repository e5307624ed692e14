"""A handful of profiles given as values, answered by two scans of the listings and no staged table.

The ladder of a profile is known before any listing is read, so a listing is a hit from one step on, up to a step at
which it drops out. The first scan counts such spans, which are as many as there are steps, however long the table; the
driver adds them up and knows the step at which each search ends. The second scan takes the listings of that step, its
caps and minimum ratings being literals that reach Parquet.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import MAX_TOP_K, AnswerConfig, SearchConfig
from ..operators import match
from ..operators.reconcile import WHY_FALLBACK
from ..operators.search import DROP_LOCATION, FIRST_CUISINE, LOWER_RATING, RAISE_BUDGET, RATING_SLACK
from ..sources.listings import has_required_fields
from .recommend import ITEM_COLUMNS

MOST = 32
_SHOWN = ["pos", "id", "name", "city", "neighborhood", "cuisines", "rating", "cost_for_two", "cost_tier", "votes"]


@dataclass(frozen=True)
class Profile:
    """A valid profile in normalised form, as ``operators.prefs.split_preferences`` gives it."""

    pref_id: int
    max_cost_for_two_inr: int
    min_rating: float
    location: str | None = None
    cuisines: tuple[str, ...] = ()
    top_k: int | None = None


@dataclass(frozen=True)
class Step:
    """What is in force at a step of the ladder."""

    location: str | None
    cuisines: tuple[str, ...]
    min_rating: float
    cap: int


class Ladder:
    """The steps of one profile: location off, first cuisine only, lower ratings, higher caps."""

    def __init__(self, profile: Profile, cfg: SearchConfig):
        self.profile, self.cfg = profile, cfg
        self.without_place = int(profile.location is not None)
        self.free = self.without_place + int(len(profile.cuisines) > 1)
        self.ratings = [float(profile.min_rating)]
        while self.ratings[-1] > cfg.min_rating_floor + RATING_SLACK:
            self.ratings.append(max(float(cfg.min_rating_floor), self.ratings[-1] - cfg.rating_relax_step))
        self.before_raises = self.free + len(self.ratings) - 1
        step, room = cfg.budget_relax_step_inr, cfg.budget_relax_ceiling_inr - profile.max_cost_for_two_inr
        self.raises = max(0, -(-room // step)) if step > 0 else 0
        self.steps = self.before_raises + self.raises + 1

    def at(self, step: int) -> Step:
        own = self.profile
        raised = max(0, step - self.before_raises)
        cap = own.max_cost_for_two_inr + raised * self.cfg.budget_relax_step_inr
        return Step(
            own.location if step < self.without_place or not self.without_place else None,
            own.cuisines[:1] if len(own.cuisines) > 1 and step >= self.free else own.cuisines,
            self.ratings[min(max(0, step - self.free), len(self.ratings) - 1)],
            min(cap, self.cfg.budget_relax_ceiling_inr) if raised else own.max_cost_for_two_inr,
        )

    def labels(self, step: int) -> list[str]:
        kinds = (
            [DROP_LOCATION] * self.without_place
            + [FIRST_CUISINE] * (self.free - self.without_place)
            + [LOWER_RATING] * (len(self.ratings) - 1)
        )
        return (kinds + [RAISE_BUDGET] * self.raises)[:step]

    def span(self) -> Column:
        """(place, gone, cheap, good) of a listing: the steps from which on its place, cost and rating fit, NULL for
        never, and the step at which its cuisines fit no longer, 0 for never."""
        own, cfg = self.profile, self.cfg
        cost, rating = F.col("cost_for_two"), F.col("rating")
        place = F.when(match.location_matches(own.location), 0).when(F.lit(self.without_place == 1), 1)
        primary = match.cuisine_matches(own.cuisines[:1])
        gone = F.when(primary, self.steps) if len(own.cuisines) > 1 else F.when(F.lit(True), self.steps)
        gone = F.when(match.cuisine_matches(own.cuisines), F.coalesce(gone, F.lit(self.free))).otherwise(0)
        cheap = F.when(cost <= own.max_cost_for_two_inr, 0)
        if self.raises:
            over = F.ceil((cost - own.max_cost_for_two_inr) / F.lit(cfg.budget_relax_step_inr))
            cheap = cheap.when(cost <= cfg.budget_relax_ceiling_inr, self.before_raises + over)
        good = F.when(rating >= self.ratings[0], 0)
        for i, lower in enumerate(self.ratings[1:], 1):
            good = good.when(rating >= lower, self.free + i)
        parts = {"place": place, "gone": gone, "cheap": cheap, "good": good}
        return F.struct(*[c.cast("int").alias(name) for name, c in parts.items()])


@dataclass
class FewProfiles:
    """Search and deterministic recommendations for at most 32 profiles over canonical ``listings``.

    The same results as ``Recommender`` gives for a table of these profiles. ``report`` needs counts after each filter
    and so reads every listing once; ``items`` and ``candidates`` read what the widest step can reach, and then what the
    last step allows. What reaches the driver is four counts per step and profile. Many profiles, or ones in a table,
    are work for ``Recommender``.
    """

    listings: DataFrame
    profiles: Sequence[Profile]
    search_config: SearchConfig = SearchConfig()
    answer_config: AnswerConfig = AnswerConfig()

    def __post_init__(self) -> None:
        if not 0 < len(self.profiles) <= MOST:
            raise ValueError(f"one to {MOST} profiles, not {len(self.profiles)}")
        if len({p.pref_id for p in self.profiles}) < len(self.profiles):
            raise ValueError("every profile needs a pref_id of its own")
        self.ladders = [Ladder(p, self.search_config) for p in self.profiles]

    def _counts(self, rows: DataFrame, filters: Sequence[int]) -> list[dict[int, list[int]]]:
        """Per profile and filter (1 to 4) the listings left after it, step by step."""
        each = [F.struct(F.lit(i).alias("p"), ladder.span().alias("s")) for i, ladder in enumerate(self.ladders)]
        seen = rows.select(F.explode(F.array(*each)).alias("x")).select("x.p", "x.s.*")
        seen = seen.groupBy("p", "place", "gone", "cheap", "good").agg(F.count(F.lit(1)).alias("n"))
        last = F.get(F.array(*[F.lit(ladder.steps) for ladder in self.ladders]), F.col("p"))
        marks = []
        for after, parts in enumerate((["place"], ["place"], ["place", "cheap"], ["place", "cheap", "good"]), 1):
            start = F.greatest(*parts) if len(parts) > 1 else F.col("place")
            fits = F.lit(True)
            for part in parts:
                fits = fits & F.col(part).isNotNull()
            end = last if after == 1 else F.col("gone")
            for at, delta in ((start, 1), (end, -1)) if after in filters else ():
                mark = F.struct(F.lit(after).alias("after"), at.alias("step"), F.lit(delta).alias("delta"))
                marks.append(F.when(fits & (start < end), mark))
        found = seen.select("p", "n", F.explode(F.array_compact(F.array(*marks))).alias("m"))
        changes = found.groupBy("p", "m.after", "m.step").agg(F.sum(F.col("n") * F.col("m.delta")).alias("change"))
        per_step = [{i: [0] * (ladder.steps + 1) for i in filters} for ladder in self.ladders]
        for p, after, step, change in changes.collect():
            per_step[p][after][step] += change
        return [{i: list(accumulate(steps))[:-1] for i, steps in own.items()} for own in per_step]

    @property
    def _usable(self) -> DataFrame:
        return self.listings.where(has_required_fields())

    def _within(self, steps: Sequence[Step]) -> DataFrame:
        """Usable listings that fit the highest cap and the lowest minimum rating; both reach the scan."""
        cap, floor = max(s.cap for s in steps), min(s.min_rating for s in steps)
        return self._usable.where(match.budget_matches(cap) & match.rating_matches(floor))

    def _stop(self, hits: Sequence[int]) -> int:
        return next((i for i, n in enumerate(hits) if n >= self.search_config.k_min), len(hits) - 1)

    @cached_property
    def _funnels(self) -> list[dict[int, list[int]]]:
        return self._counts(self._usable, (1, 2, 3, 4))

    @cached_property
    def stops(self) -> list[int]:
        """The step at which the search of each profile ends."""
        if "_funnels" in self.__dict__:
            return [self._stop(f[4]) for f in self._funnels]
        widest = [ladder.at(ladder.steps - 1) for ladder in self.ladders]
        return [self._stop(c[4]) for c in self._counts(self._within(widest), (4,))]

    def candidates(self) -> DataFrame:
        """Per profile its ranked listings, capped, as ``ProfileSearch.candidates``."""
        steps = [ladder.at(stop) for ladder, stop in zip(self.ladders, self.stops, strict=True)]
        fits = []
        for i, s in enumerate(steps):
            found = match.budget_matches(s.cap) & match.rating_matches(s.min_rating)
            fits.append(F.when(found & match.location_matches(s.location) & match.cuisine_matches(s.cuisines), F.lit(i)))
        rows = self._within(steps).select(*_SHOWN, F.explode(F.array_compact(F.array(*fits))).alias("p"))
        at = F.row_number().over(W.partitionBy("p").orderBy(*match.rank_order()))
        ranked = rows.withColumn("cand_pos", at).where(F.col("cand_pos") <= self.search_config.max_candidates)
        return ranked.select(self._literal([p.pref_id for p in self.profiles], "bigint").alias("pref_id"), "cand_pos", *_SHOWN)

    def items(self) -> DataFrame:
        """One row per recommendation, ranks counting from 1, as ``Recommender.items`` without answers."""
        sizes = [min(p.top_k or self.answer_config.top_k, MAX_TOP_K) for p in self.profiles]
        most = F.create_map(*[F.lit(x) for p, k in zip(self.profiles, sizes, strict=True) for x in (p.pref_id, k)])
        picks = self.candidates().where(F.col("cand_pos") <= F.try_element_at(most, F.col("pref_id")))
        told = picks.withColumns({"rank": F.col("cand_pos"), "explanation": F.lit(WHY_FALLBACK)})
        return told.select(*ITEM_COLUMNS)

    def report(self) -> DataFrame:
        """Per profile the funnel of the last pass, relaxations, stop step and truncation, as ``ProfileSearch.report``."""
        funnels = self._funnels
        rows = []
        for ladder, stop, own in zip(self.ladders, self.stops, funnels, strict=True):
            left = [own[i][stop] for i in (1, 2, 3, 4)]
            truncated = left[3] > self.search_config.max_candidates
            rows.append((ladder.profile.pref_id, stop, ladder.labels(stop), *left, truncated))
        shape = "pref_id bigint, stop bigint, relaxations array<string>, total_after_location bigint, "
        shape += "total_after_cuisine bigint, total_after_budget bigint, total_after_rating bigint, truncated boolean"
        return self.listings.sparkSession.createDataFrame(rows, shape)

    def _literal(self, values: list, kind: str) -> Column:
        return F.get(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("p"))
