"""Model answers: obtain them through a caller's function, and read their loosely typed JSON."""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import parse, text

_FENCE_OPEN = rf"(?i)^```(?:json)?{text.SPACE}*"
_FENCE_CLOSE = rf"{text.SPACE}*```{text.SPACE}*$"
_FRACTIONS = ("DECIMAL", "DOUBLE", "FLOAT")
_WHOLE = ("BIGINT", "INT", "SMALLINT", "TINYINT")


@dataclass(frozen=True)
class Asking:
    """How a task calls a model: how often at most per prompt, how many prompts at once, and the wait before the second
    attempt in seconds, which doubles with every further one."""

    attempts: int = 1
    at_once: int = 1
    first_wait: float = 0.5

    def __post_init__(self) -> None:
        if self.attempts < 1 or self.at_once < 1 or self.first_wait < 0:
            raise ValueError("at least one attempt, one call at a time and no negative wait")

    def call(self, answer: Callable[..., str], row) -> tuple[str | None, str | None, int]:
        """(answer, reason of the last failure if there is no answer, calls made)."""
        messages = [{"role": "system", "content": row.system}, {"role": "user", "content": row.user}]
        failed = None
        for n in range(1, self.attempts + 1):
            try:
                said = answer(
                    messages, model=row.model, temperature=float(row.temperature), max_tokens=int(row.max_tokens)
                )
                return said, None, n
            except Exception as e:
                failed = f"{type(e).__name__}: {e}"
            if n < self.attempts:
                time.sleep(self.first_wait * 2 ** (n - 1))
        return None, failed, self.attempts

    def batches(self, answer: Callable[..., str], key: str):
        """For ``mapInPandas``: ``key, raw, error, calls, model``, rows in order, never more than ``at_once`` calls open."""

        def run(batches):
            with ThreadPoolExecutor(self.at_once) as pool:
                for batch in batches:
                    told = list(pool.map(lambda row: self.call(answer, row), batch.itertuples(index=False)))
                    raw, error, calls = zip(*told, strict=True) if told else ((), (), ())
                    yield batch[[key]].assign(raw=raw, error=error, calls=calls, model=batch["model"])

        return run


def complete(prompts: DataFrame, answer: Callable[..., str], asking: Asking = Asking()) -> DataFrame:
    """``pref_id, raw, error, model``: one ``answer(messages, model=, temperature=, max_tokens=)`` per prompt row.

    Runs in the tasks, batch by batch. A prompt whose last attempt raises leaves ``raw`` NULL, so that its profile falls
    back, and its reason in ``error``. Nothing is kept for a later run: see ``completions.complete_logged``.
    """
    shape = "pref_id bigint, raw string, error string, calls int, model string"
    return prompts.mapInPandas(asking.batches(answer, "pref_id"), shape).drop("calls")


def _strip_fence(raw: Column) -> Column:
    s = text.strip(raw)
    bare = text.strip(F.regexp_replace(F.regexp_replace(s, _FENCE_OPEN, ""), _FENCE_CLOSE, ""))
    return F.when(F.startswith(s, F.lit("```")), bare).otherwise(s)


def _field(v: Column, name: str) -> Column:
    """Object field as VARIANT; absent and JSON null are both NULL."""
    got = F.try_variant_get(v, f"$.{name}", "variant")
    return F.when(~F.is_variant_null(got), got)


def _once(c: Column) -> Column:
    """``c``, worked out once a row: Spark moves no filter below a column that counts rows, so a filter that names ``c``
    several times does not work it out as often."""
    return F.get(F.array(c), F.least(F.lit(0).cast("bigint"), F.monotonically_increasing_id()).cast("int"))


def _kind(v: Column) -> Column:
    return F.substring_index(F.substring_index(F.schema_of_variant(v), "(", 1), "<", 1)


def _is_object(v: Column) -> Column:
    """Without the types of all that it holds."""
    return F.try_variant_get(v, "$", "map<string,variant>").isNotNull()


def _as_text(v: Column) -> Column:
    """Strings as they are, truth values as True and False, numbers and anything nested as JSON."""
    plain = F.try_variant_get(v, "$", "string")
    truth = plain.isin("true", "false") & (_kind(v) == "BOOLEAN")
    return F.coalesce(F.when(truth, F.initcap(plain)).otherwise(plain), F.to_json(v))


def _is_nothing(v: Column) -> Column:
    """False, zero and empty lists or objects say nothing."""
    kind = _kind(v)
    return (
        F.when(kind == "BOOLEAN", ~F.try_variant_get(v, "$", "boolean"))
        .when(kind.isin(*_FRACTIONS, *_WHOLE), F.try_variant_get(v, "$", "double") == 0)
        .otherwise(F.to_json(v).isin("[]", "{}"))
    )


def _rank(v: Column, position: Column) -> Column:
    """Numbers are cut to whole ones, whole-number strings are read, all else is the place in the array."""
    kind = _kind(v)
    number = (
        F.when(kind.isin(*_FRACTIONS), F.try_variant_get(v, "$", "double").try_cast("bigint"))
        .when(kind == "STRING", parse.parse_int(F.try_variant_get(v, "$", "string")))
        .when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("bigint"))
        .when(kind.isin(*_WHOLE), F.try_variant_get(v, "$", "bigint"))
    )
    return F.coalesce(number, position)


def read_answers(responses: DataFrame) -> DataFrame:
    """``pref_id, ok, summary, model, entries``: is the answer usable, who gave it (a column ``model``, else NULL), and
    its raw entries as an array of VARIANT. An entry ranked beyond all numbers makes the answer unusable."""
    model = F.col("model") if "model" in responses.columns else F.lit(None).cast("string")
    parsed = responses.select(
        "pref_id", model.alias("model"), _once(F.try_parse_json(_strip_fence(F.col("raw")))).alias("v")
    )
    fields = parsed.select(
        "pref_id",
        "model",
        (F.col("v").isNotNull() & _is_object(F.col("v"))).alias("is_object"),
        _field(F.col("v"), "summary").alias("summary"),
        _field(F.col("v"), "recommendations").alias("listed"),
    )
    # Of the kinds of values only a list reads as one.
    entries = fields.withColumn("entries", F.try_variant_get("listed", "$", "array<variant>"))
    listed_ok = F.col("listed").isNull() | F.col("entries").isNotNull()
    endless = F.coalesce(F.exists("entries", _ranked_endless), F.lit(False))
    return entries.select(
        "pref_id",
        _once(F.coalesce(F.col("is_object") & listed_ok & ~endless, F.lit(False))).alias("ok"),
        _as_text(F.col("summary")).alias("summary"),
        "model",
        "entries",
    )


def _ranked_endless(e: Column) -> Column:
    rank = _field(e, "rank")
    endless = F.abs(F.try_variant_get(e, "$.rank", "double")) == float("inf")
    named = _field(e, "restaurant_id").isNotNull()
    return F.coalesce(F.when(endless, named & _kind(rank).isin(*_FRACTIONS)), F.lit(False))


def parse_entries(answers: DataFrame) -> DataFrame:
    """``pref_id, arr_pos, rank, restaurant_id, explanation`` of usable answers. Order: rank, then arr_pos."""
    entries = answers.where("ok").select("pref_id", F.posexplode("entries").alias("arr_pos", "e"))
    # Only an object has a field, so what has none of that name, object or not, ends at the filter on ``ref``.
    fields = entries.select(
        "pref_id",
        "arr_pos",
        _once(_field(F.col("e"), "restaurant_id")).alias("ref"),
        _field(F.col("e"), "rank").alias("rank"),
        _field(F.col("e"), "explanation").alias("why"),
    )
    why = F.when(F.col("why").isNotNull() & ~_is_nothing(F.col("why")), _as_text(F.col("why")))
    return fields.where(F.col("ref").isNotNull()).select(
        "pref_id",
        "arr_pos",
        _rank(F.col("rank"), (F.col("arr_pos") + 1).cast("bigint")).alias("rank"),
        text.strip(_as_text(F.col("ref"))).alias("restaurant_id"),
        text.strip(F.coalesce(why, F.lit(""))).alias("explanation"),
    )
