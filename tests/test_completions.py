"""Logged completions: nothing is asked twice, failures are asked again, what was answered survives a broken run."""

import threading
import time
from collections import Counter

import pytest

from venuesieve.operators.completions import complete_logged, latest, read_log
from venuesieve.operators.responses import Asking, complete

PROMPTS = "pref_id bigint, system string, user string, model string, temperature double, max_tokens int"


def prompts(spark, users):
    return spark.createDataFrame([(i, "s", u, "m", 0.5, 100) for i, u in enumerate(users)], PROMPTS).repartition(3)


def teller(folder, fails=lambda user, n: False):
    """A function that notes each call in ``folder`` and fails where ``fails(user, number of the call)``."""

    def answer(messages, *, model, temperature, max_tokens):
        import os
        import uuid

        user = messages[1]["content"]
        open(f"{folder}/{user}.{uuid.uuid4().hex}", "w").close()
        n = sum(f.startswith(f"{user}.") for f in os.listdir(folder))
        if fails(user, n):
            raise TimeoutError(f"{user} {n}")
        return f"{model} says {user}"

    return answer


def calls(folder):
    return Counter(f.name.split(".")[0] for f in folder.iterdir())


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "calls").mkdir()
    return tmp_path / "calls"


def test_each_prompt_is_asked_once(spark, tmp_path, folder):
    asked = prompts(spark, [f"u{i % 20}" for i in range(30)])
    log = str(tmp_path / "log")
    quick = Asking(attempts=3, at_once=4, first_wait=0.0)
    first = complete_logged(asked, teller(folder, lambda u, n: u in ("u3", "u7") and n == 1), log, 3, 2, quick)
    rows = {r.pref_id: r for r in first.collect()}
    assert len(rows) == 30 and all(rows[i].raw == f"m says u{i % 20}" and rows[i].error is None for i in rows)
    assert calls(folder) == {f"u{i}": 2 if i in (3, 7) else 1 for i in range(20)}
    assert {rows[3].calls, rows[23].calls, rows[7].calls} == {2} and rows[4].calls == 1
    more = complete_logged(prompts(spark, [f"u{i}" for i in range(25)]), teller(folder), log, 3, 2, quick)
    assert sorted(r.raw for r in more.collect()) == sorted(f"m says u{i}" for i in range(25))
    assert sum(calls(folder).values()) == 22 + 5


def test_failures_are_asked_by_the_next_run(spark, tmp_path, folder):
    asked, log = prompts(spark, ["a", "b"]), str(tmp_path / "log")
    quick = Asking(attempts=2, first_wait=0.0)
    rows = {r.pref_id: r for r in complete_logged(asked, teller(folder, lambda u, n: u == "b"), log, asking=quick).collect()}
    assert (rows[0].raw, rows[1].raw, rows[1].error, rows[1].calls) == ("m says a", None, "TimeoutError: b 2", 2)
    rows = {r.pref_id: r for r in complete_logged(asked, teller(folder), log, asking=quick).collect()}
    assert (rows[1].raw, rows[1].error, rows[1].calls) == ("m says b", None, 3)
    assert calls(folder) == {"a": 1, "b": 3}


def test_a_broken_run_keeps_its_waves(spark, tmp_path, folder):
    asked, log = prompts(spark, [f"u{i}" for i in range(40)]), str(tmp_path / "log")

    def breaks(messages, **_):
        import os

        if len(os.listdir(folder)) >= 25:
            os._exit(3)  # the worker dies, as with a lost executor
        return teller(folder)(messages, **_)

    with pytest.raises(Exception):
        complete_logged(asked, breaks, log, waves=8, tasks=1)
    kept = {r.raw.split()[-1] for r in read_log(spark, log).collect()}
    assert kept
    before = calls(folder)
    complete_logged(asked, teller(folder), log, waves=8, tasks=1)
    after = calls(folder)
    assert len(after) == 40 and all(after[u] == before[u] for u in kept)
    assert latest(read_log(spark, log)).count() == 40


def test_empty_and_invalid(spark, tmp_path):
    none = prompts(spark, ["x"]).limit(0)
    assert complete_logged(none, teller(tmp_path), str(tmp_path / "log")).collect() == []
    assert complete(none, teller(tmp_path)).collect() == []
    for wrong in ({"attempts": 0}, {"at_once": 0}, {"first_wait": -1.0}):
        with pytest.raises(ValueError):
            Asking(**wrong)


def test_calls_run_side_by_side_and_waits_grow(monkeypatch):
    import pandas as pd

    open_, most, lock = [0], [0], threading.Lock()

    def answer(messages, **_):
        with lock:
            open_[0] += 1
            most[0] = max(most[0], open_[0])
        time.sleep(0.02)
        with lock:
            open_[0] -= 1
        return "ok"

    batch = pd.DataFrame([(i, "s", "u", "m", 0.5, 1) for i in range(40)], columns=[c.split()[0] for c in PROMPTS.split(", ")])
    (out,) = Asking(at_once=5).batches(answer, "pref_id")([batch])
    assert list(out["pref_id"]) == list(range(40)) and set(out["raw"]) == {"ok"}
    assert 2 <= most[0] <= 5
    waits = []
    monkeypatch.setattr("venuesieve.operators.responses.time.sleep", waits.append)

    def down(messages, **_):
        raise OSError("down")

    row = next(batch.itertuples(index=False))
    assert Asking(attempts=4, first_wait=1.0).call(down, row) == (None, "OSError: down", 4)
    assert waits == [1.0, 2.0, 4.0]
