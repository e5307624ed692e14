"""Recommendations kept between runs: a profile that was searched in this snapshot of the corpus is not searched again."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field
from hashlib import sha256
from json import dumps

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import AnswerConfig, IngestConfig, SearchConfig
from ..operators.search import Corpus
from ..schemas import CANONICAL
from ..sources.cache import newest, read_canonical
from ..sources.staging import stage, staging_path
from .recommend import ITEM_COLUMNS, Recommender

_ASKED = ["location", "max_cost_for_two_inr", "cuisines", "min_rating", "top_k"]
_KNOWN = "digest string"
_TYPES = {f.name: f.dataType for f in CANONICAL.fields} | {
    "digest": T.StringType(),
    "rank": T.IntegerType(),
    "explanation": T.StringType(),
}
_STORED = ["digest", *[c for c in ITEM_COLUMNS if c != "pref_id"]]


def profile_digest() -> Column:
    """Equal for normalised profiles that ask the same and want as many results."""
    return F.sha2(F.to_json(F.struct(*_ASKED), {"ignoreNullFields": "false"}), 256)


@dataclass(frozen=True)
class Reused:
    """``items`` of all profiles, and the ``searched`` profiles (``pref_id``): one for each new wish."""

    items: DataFrame
    searched: DataFrame


@dataclass(frozen=True)
class ResultStore:
    """Deterministic recommendations at ``path``, by profile digest.

    They lie in a folder per corpus snapshot and configuration, so a new snapshot or another knob finds nothing and
    searches anew; older folders are never read again and may be deleted. The corpus of the last snapshot that was searched
    stays staged for the next call.
    """

    path: str
    search_config: SearchConfig = SearchConfig()
    answer_config: AnswerConfig = AnswerConfig()
    _staged: dict = field(default_factory=dict, init=False, repr=False, compare=False)

    def _corpus(self, spark: SparkSession, cache_path: str, config: IngestConfig, snapshot: str) -> Corpus:
        # What is staged inside a ``scratch`` is found again inside that one only.
        key = (staging_path(spark, ""), cache_path, config, snapshot)
        if key not in self._staged:
            corpus = Corpus(read_canonical(spark, cache_path, config, snapshot))
            self._staged.clear()
            self._staged[key] = corpus
        return self._staged[key]

    def _folder(self, snapshot: str) -> str:
        knobs = dumps([asdict(self.search_config), asdict(self.answer_config)], sort_keys=True)
        return f"{self.path.rstrip('/')}/{snapshot}/{sha256(knobs.encode()).hexdigest()[:16]}"

    def recommend(
        self, spark: SparkSession, prefs: DataFrame, cache_path: str, config: IngestConfig = IngestConfig()
    ) -> Reused:
        """Items for validated ``prefs`` over the newest snapshot of the canonical cache.

        Digests that the store lacks are searched once each, however many profiles share them, and added: first their
        items, then, in a table of its own, the digests, also of profiles without items. So a run that breaks off leaves
        items that no digest vouches for; they are searched and written again, and read once. Two runs at a time may
        search the same profile twice, with equal results.
        """
        snapshot = newest(spark, cache_path, config)
        if snapshot is None:
            raise ValueError(f"{cache_path} has no snapshot for this configuration")
        folder = self._folder(snapshot)
        asked = stage(prefs.withColumn("digest", profile_digest()), "asked-digests")
        fresh = asked.dropDuplicates(["digest"]).join(_read(spark, f"{folder}/known", _KNOWN), "digest", "left_anti")
        fresh = stage(fresh, "fresh")
        if not fresh.isEmpty():
            corpus = self._corpus(spark, cache_path, config, snapshot)
            found = Recommender(fresh.drop("digest"), corpus, None, self.search_config, self.answer_config).items()
            items = found.join(fresh.select("pref_id", "digest"), "pref_id").select(*_STORED)
            items.write.mode("append").parquet(f"{folder}/items")
            fresh.select("digest").write.mode("append").parquet(f"{folder}/known")
        shape = T.StructType([T.StructField(c, _TYPES[c]) for c in _STORED])
        kept = _read(spark, f"{folder}/items", shape).dropDuplicates(["digest", "rank"])
        everything = asked.select("pref_id", "digest").join(kept, "digest")
        return Reused(everything.select(*ITEM_COLUMNS), fresh.select("pref_id"))


def _read(spark: SparkSession, path: str, schema) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)
