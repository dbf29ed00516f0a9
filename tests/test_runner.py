"""Live runs: gaps are repaired from the canonical table by the query itself, with attempts, backoff, stop and failure."""

import pytest
from barloom.streaming import runner

CANDLES = "run_id string, kind string, minute long, seq long, warmup int, message string"


def feed(spark, folder, name, rows):
    spark.createDataFrame(rows, CANDLES).coalesce(1).write.mode("overwrite").parquet(f"{folder}/feed/{name}")


def source(spark, folder):
    return spark.readStream.schema(CANDLES).option("recursiveFileLookup", "true").parquet(f"{folder}/feed")


def candles(run, minutes, warmup=1, at=0):
    return [(run, "candle", m, at + k, warmup, None) for k, m in enumerate(minutes)]


def canonical(spark, kept):
    return spark.createDataFrame([(r, m) for r, ms in kept.items() for m in ms], "run_id string, minute long")


def plainly(minutes, kept, size, warmup, retries):
    """(kind, minute, start, end, attempt) and the last state, one candle after another."""
    out, checkpoint, first, state, bars = [], None, None, "starting", 0
    for m in minutes:
        if state == "starting":
            state = "running" if warmup == 0 else "warming_up"
        if checkpoint is not None and m <= checkpoint:
            out.append(("dropped", m, None, None, None))
            continue
        if checkpoint is not None and m > checkpoint + 1:
            if not all(x in kept for x in range(checkpoint + 1, m)):
                out.append(("gave_up", m, checkpoint + 1, m, retries + 1))
                continue
            out.append(("repaired", m, checkpoint + 1, m, 1))
        first = m if first is None else first
        checkpoint = m
        out.append(("accepted", m, None, None, None))
        full = sum(all(x in range(first, m + 1) for x in range(b * size, b * size + size)) for b in range(first // size, m // size + 1))
        if full > bars:
            bars = full
            out.append(("bar", m, None, None, None))
        if state == "warming_up" and bars >= warmup:
            state = "running"
    return sorted(map(str, out)), state, checkpoint, bars


def told(events, run, kinds=("dropped", "gave_up", "repaired", "accepted", "bar")):
    return sorted(str((r["kind"], r["minute"], r["start_minute"], r["end_minute"], r["attempt"])) for r in events if r["run_id"] == run and r["kind"] in kinds)


def test_gaps_are_repaired_without_a_caller(spark, tmp_path):
    runs = {
        "mended": ([0, 1, 2, 6, 7, 7, 3, 12, 30, 31], range(0, 40)),
        "stuck": ([5, 6, 9, 10, 14, 15, 16], [7, 9, 10, 11, 12, 13]),
        "whole": (range(100, 110), []),
        "own": ([0, 4, 9], [1, 2, 3, 5, 6, 7, 8]),  # live minutes that aren't kept themselves
        "late": ([50, 49, 50, 52], [51]),
    }
    feed(spark, tmp_path, "a", [r for name, (ms, _) in runs.items() for r in candles(name, list(ms), 3)])
    live = runner.LiveRuns(source(spark, tmp_path), canonical(spark, {k: v for k, (_, v) in runs.items()}), f"{tmp_path}/out", 3, retries=2, backoff_ms=200)
    events = live.drain(120).collect()
    for name, (ms, kept) in runs.items():
        want, state, checkpoint, bars = plainly(list(ms), set(kept), 3, 3, 2)
        assert told(events, name) == want, name
        mine = [r for r in events if r["run_id"] == name]
        assert max((r["minute"] for r in mine if r["kind"] == "accepted"), default=None) == checkpoint
        assert max(r["bars"] for r in mine) == bars
        assert {"running": "running", "warming_up": "warming_up"}[state] in {r["state"] for r in mine if r["kind"] == "state"}
    asked = [r["attempt"] for r in events if r["run_id"] == "stuck" and r["kind"] == "repair"]
    assert sorted(asked) == [1, 2, 3]  # held candles share answers
    assert sorted(r["attempt"] for r in events if r["run_id"] == "stuck" and r["kind"] == "backoff") == [1, 2]


def test_rows_that_come_before_the_last_attempt_repair(spark, tmp_path):
    """The canonical table gets the missing minute while the run waits for its second attempt."""
    asked = []

    def table():
        asked.append(1)
        return canonical(spark, {"r": [3, 4] if len(asked) > 1 else [3]})

    feed(spark, tmp_path, "a", candles("r", [1, 2, 5, 6], 9))
    live = runner.LiveRuns(source(spark, tmp_path), table, f"{tmp_path}/out", 2, retries=1, backoff_ms=100)
    events = live.drain(120).collect()
    assert [(r["start_minute"], r["end_minute"], r["attempt"]) for r in events if r["kind"] == "repaired"] == [(3, 5, 2)]
    assert sorted(r["minute"] for r in events if r["kind"] == "accepted") == [1, 2, 5, 6] and not [r for r in events if r["kind"] == "gave_up"]


def test_stop_failure_and_restart(spark, tmp_path):
    first = [*candles("s", [0, 1]), ("s", "stop", None, 9, None, None), ("f", "candle", None, 0, 1, None), *candles("g", [0, 1]), ("g", "fail", None, 9, None, "disk"), *candles("k", [0, 1, 4], 0)]
    feed(spark, tmp_path, "a", first)
    kept = canonical(spark, {"k": [2, 3, 5]})
    events = runner.LiveRuns(source(spark, tmp_path), kept, f"{tmp_path}/out", 2, backoff_ms=50).drain(120).collect()
    states = {k: [r["state"] for r in events if r["run_id"] == k and r["kind"] == "state"] for k in "sfgk"}
    assert states == {"s": ["warming_up", "running", "stopping", "stopped"], "f": ["failed"], "g": ["warming_up", "running", "failed"], "k": ["warming_up", "running"]}
    assert {r["message"] for r in events if r["state"] == "failed"} == {"disk", "a candle without a minute, or without bars of warm-up"}
    feed(spark, tmp_path, "b", [*candles("s", [2], at=20), *candles("k", [6, 7], 0, 20)])
    again = runner.LiveRuns(source(spark, tmp_path), kept, f"{tmp_path}/out", 2, backoff_ms=50).drain(120).collect()
    assert len(again) > len(events) and told(again, "s", ("dropped",)) == [str(("dropped", 2, None, None, None))]
    assert told(again, "k") == plainly([0, 1, 4, 6, 7], {2, 3, 5}, 2, 0, 1)[0]


def test_no_candles(spark, tmp_path):
    feed(spark, tmp_path, "a", [])
    assert runner.LiveRuns(source(spark, tmp_path), canonical(spark, {"k": [2]}), f"{tmp_path}/out", 2).drain(60).count() == 0


def test_parameters(spark):
    for wrong in ((0, 1, 1), (1, -1, 1), (1, 1, -1)):
        with pytest.raises(ValueError, match="bar"):
            runner.LiveRunner(*wrong)


def test_candles_of_the_same_minute_are_one_entry_of_the_state():
    import pandas as pd

    class Kept:
        value = None
        exists = lambda self: self.value is not None
        get = lambda self: self.value

        def update(self, value):
            self.value = value

        put = update

        def clear(self):
            self.value = None

    class Handle:
        getValueState = getListState = lambda self, *_: Kept()

    class Now:
        getCurrentProcessingTimeInMs = lambda self: 0

    live = runner.LiveRunner(2, 1, 0)
    live.init(Handle())
    names = [c.split()[0] for c in runner.ROWS.split(", ")]
    minutes = [0] * 70_000 + [3] * 500 + [4] * 2 + [9] * 3

    def step(rows):
        frames = [*live.handleInputRows(("r",), iter([pd.DataFrame(rows, columns=names)]), Now())]
        assert max(map(len, frames)) <= runner.STEP_ROWS
        return pd.concat(frames)["kind"].value_counts().to_dict()

    first = step([("r", "candle", m, k, 1, None, None, None, None, None) for k, m in enumerate(minutes)])
    assert first == {"accepted": 1, "dropped": 69_999, "repair": 1, "state": 1}
    assert len(live.kept_candles.value) == 3
    answer = ("r", "answer", None, None, None, None, 1, 9, [1], [5])
    assert step([answer]) == {"answer": 1, "repaired": 1, "accepted": 2, "dropped": 500, "bar": 1, "state": 1, "repair": 1}
    assert step([(*answer[:6], 2, 9, [], [])]) == {"answer": 1, "gave_up": 3}
