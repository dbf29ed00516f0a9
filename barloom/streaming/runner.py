"""Live runs of strategies: contiguous candles, repair of gaps with retries and backoff, warm-up, stop and failure.

A run's state lives in `LiveRunner`, one key of `transformWithStateInPandas`. A candle that jumps is held, with all that come
after it, and the run asks for the minutes between. Each micro-batch's requests are answered from the canonical table by a join,
and the answers are files that the same query reads as a second source, so that a gap is mended without a caller. An
answer with a hole in it starts a timer, longer with each attempt; after the last one the candle is given up and the checkpoint stays.
A request reaches to the last candle held, so that all of them share its answer; to each it is an attempt.

Candles of the same minute that follow each other are one step and one entry of the state, with their number.

As only contiguous minutes are accepted, the bars that a run has seen follow from its first minute and its checkpoint.
"""

from __future__ import annotations

import time
from bisect import bisect_right
from collections import deque
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROWS = "run_id string, kind string, minute long, seq long, warmup int, message string, number long, until long, starts array<long>, ends array<long>"
EVENTS = "run_id string, kind string, minute long, start_minute long, end_minute long, attempt int, bars long, number long, state string, message string"
_NAMES = [c.split()[0] for c in EVENTS.split(", ")]
#: States in which candles are taken, and those that a run doesn't leave.
ACTIVE, ENDED = ("starting", "warming_up", "running"), ("stopped", "failed")
_LAST = 1 << 62
#: Rows that a run gives at once, at most.
STEP_ROWS = 1 << 16
_STORE = "spark.sql.streaming.stateStore.providerClass"


@dataclass
class Run:
    """What is kept of a run besides the candles it holds: `pending` is the number of the request that is not answered yet (0: none)."""

    checkpoint: int | None = None
    first: int | None = None
    state: str = "starting"
    warmup: int = 0
    bars: int = 0
    pending: int = 0
    asked: int = 0
    waiting: bool = False


class LiveRunner(StatefulProcessor):
    def __init__(self, minutes: int, retries: int, backoff_ms: int) -> None:
        if minutes < 1 or retries < 0 or backoff_ms < 0:
            raise ValueError("a bar has a minute at least, and retries and backoff aren't negative")
        self.minutes, self.retries, self.backoff_ms = minutes, retries, backoff_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept_run = handle.getValueState("run", "checkpoint long, first long, state string, warmup int, bars long, pending long, asked long, waiting boolean")
        self.kept_candles = handle.getListState("held", "minute long, answers int, count long")
        self.kept_islands = handle.getListState("islands", "start long, end long")

    def _load(self, key: tuple) -> None:
        self.key, self.out, self.times = key[0], [], []
        self.run = Run(*self.kept_run.get()) if self.kept_run.exists() else Run()
        self.held = deque(tuple(r) for r in self.kept_candles.get()) if self.kept_candles.exists() else deque()
        self.islands = [tuple(r) for r in self.kept_islands.get()] if self.kept_islands.exists() else []

    def _store(self) -> Iterator[pd.DataFrame]:
        self.kept_run.update(tuple(asdict(self.run).values()))
        for state, rows in ((self.kept_candles, self.held), (self.kept_islands, self.islands)):
            if rows:
                state.put([*rows])
            elif state.exists():
                state.clear()
        out = pd.DataFrame(self.out, columns=_NAMES)
        rows = np.repeat(np.arange(len(out)), np.array(self.times, np.int64))
        for at in range(0, max(1, len(rows)), STEP_ROWS):
            yield out.iloc[rows[at : at + STEP_ROWS]].reset_index(drop=True)

    def _say(self, kind: str, minute: int | None = None, start: int | None = None, end: int | None = None, attempt: int | None = None, message: str | None = None, count: int = 1) -> None:
        if count:
            self.out.append((self.key, kind, minute, start, end, attempt, self.run.bars, self.run.asked if kind in ("repair", "answer") else None, self.run.state, message))
            self.times.append(count)

    def _turn(self, state: str, message: str | None = None) -> None:
        self.run.state = state
        self._say("state", self.run.checkpoint, message=message)

    def _end(self, state: str, message: str | None = None) -> None:
        if self.run.pending:
            self._say("answer")
        if self.run.waiting:
            self._say("retry")
        self.run.pending, self.run.waiting, self.held, self.islands = 0, False, deque(), []
        self._turn(state, message)

    def _accept(self, minute: int) -> None:
        run = self.run
        if run.first is None:
            run.first = minute
        run.checkpoint = minute
        bars = max(0, (minute + 1) // self.minutes - -(-run.first // self.minutes))
        if bars > run.bars:
            run.bars = bars
            self._say("bar", minute)
        self._say("accepted", minute)
        if run.state == "warming_up" and run.bars >= run.warmup:
            self._turn("running")

    def _go_on(self, now_ms: int, ask: bool = True) -> None:
        """Take held candles as far as they are contiguous, repaired, late or given up; then ask, or wait to ask again, if it's time."""
        run = self.run
        while self.held:
            minute, answers, count = self.held[0]
            if run.checkpoint is not None and minute <= run.checkpoint:
                self._say("dropped", minute, count=count)
            elif run.checkpoint is None or minute == run.checkpoint + 1:
                self._accept(minute)
                self._say("dropped", minute, count=count - 1)
            else:
                start = run.checkpoint + 1
                if (k := bisect_right(self.islands, (start, _LAST))) and minute <= self.islands[k - 1][1]:
                    self._say("repaired", minute, start, minute, max(answers, 1))
                    self._accept(minute)
                    self._say("dropped", minute, count=count - 1)
                elif answers > self.retries:
                    self._say("gave_up", minute, start, minute, answers, count=count)
                elif run.pending or run.waiting or not ask:
                    return
                elif answers and self.backoff_ms:
                    run.waiting = True
                    self.handle.registerTimer(now_ms + answers * self.backoff_ms)
                    self._say("backoff", minute, start, minute, answers)
                    return
                else:
                    self._ask()
                    return
            self.held.popleft()
        self.islands = []

    def _ask(self) -> None:
        run = self.run
        run.asked += 1
        run.pending = run.asked
        self._say("repair", self.held[0][0], run.checkpoint + 1, max(m for m, *_ in self.held), self.held[0][1] + 1)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        self._load(key)
        now = timerValues.getCurrentProcessingTimeInMs()
        group = pd.concat(rows)
        group = group.assign(_order=(group["kind"] != "answer").astype(int)).sort_values(["_order", "seq"], kind="stable")
        # candles that say the same as the one before them are one step
        same = (group["kind"] == "candle") & (pd.to_numeric(group["warmup"]) >= 0) & group["minute"].notna()
        for c in ("kind", "minute", "warmup"):
            same &= group[c] == group[c].shift()
        first = np.flatnonzero(~same.to_numpy(bool))
        counts = np.diff(first, append=len(group)).tolist()
        group = group.iloc[first]
        columns = [group[c].astype(object).where(group[c].notna(), None).tolist() for c in ("kind", "minute", "warmup", "message", "number", "until", "starts", "ends")]
        for count, kind, minute, warmup, message, number, until, starts, ends in zip(counts, *columns, strict=True):
            run = self.run
            if kind == "answer":
                if number == run.pending and run.pending:
                    self._say("answer")
                    run.pending = 0
                    self.islands = [*zip(map(int, starts), map(int, ends), strict=True)]
                    self.held = deque((m, n + (m <= until), k) for m, n, k in self.held)
                    self._go_on(now, ask=False)
            elif run.state in ENDED:
                self._say("dropped", minute, count=count)
            elif kind == "stop":
                self._turn("stopping")
                self._end("stopped")
            elif kind == "fail" or minute is None or warmup is None or warmup < 0:
                self._end("failed", message or "a candle without a minute, or without bars of warm-up")
            else:
                if run.state == "starting":
                    run.warmup = int(warmup)
                    self._turn("warming_up")
                    if run.bars >= run.warmup:
                        self._turn("running")
                if self.held and self.held[-1][:2] == (int(minute), 0):
                    count += self.held.pop()[2]
                self.held.append((int(minute), 0, count))
                if len(self.held) == 1:
                    self._go_on(now, ask=False)
        self._go_on(now)
        yield from self._store()

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        self._load(key)
        if self.run.waiting:
            self.run.waiting = False
            self._say("retry")
            self._ask()
        yield from self._store()

    def close(self) -> None:
        pass


def islands(requests: DataFrame, canonical: DataFrame) -> DataFrame:
    """Answers to `requests` (run_id, number, start_minute, until): the stretches of contiguous minutes that `canonical` (run_id, minute) has."""
    # minutes outside of all requests are pruned by the scan
    low, high = requests.agg(F.min("start_minute"), F.max("until")).first()
    there = canonical.where(F.col("minute").between(low, high)).join(requests, "run_id").where("minute >= start_minute and minute < until").select("run_id", "number", "minute").distinct()
    order = Window.partitionBy("run_id", "number").orderBy("minute")
    stretches = there.withColumn("g", F.col("minute") - F.row_number().over(order)).groupBy("run_id", "number", "g").agg(F.min("minute").alias("a"), (F.max("minute") + 1).alias("b"))
    each = stretches.groupBy("run_id", "number").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("x"))
    none = F.array().cast("array<long>")
    return requests.join(each, ["run_id", "number"], "left").select("run_id", F.lit("answer").alias("kind"), "number", "until", F.coalesce("x.a", none).alias("starts"), F.coalesce("x.b", none).alias("ends"))


def _rows(df: DataFrame) -> DataFrame:
    """`df` with all columns of ROWS."""
    kinds = dict(c.split() for c in ROWS.split(", "))
    return df.select(*((F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()))


class LiveRuns:
    """A running query over `candles`, its events in `folder`/events, and what has been asked and not answered.

    `candles` is a stream of run_id, kind (candle, stop or fail), minute, seq (order within a run), warmup (bars, with a candle) and
    message (with fail). `canonical` (run_id, minute) is read anew for each micro-batch with requests: a table's frame, or a function
    that makes it, as of a table that others append to. The query goes on from `folder`/checkpoint after a stop or a crash: a micro-batch
    that is tried again replaces its events and its answers, and answers to former requests are passed over.
    """

    def __init__(self, candles: DataFrame, canonical: DataFrame, folder: str, minutes: int, retries: int = 1, backoff_ms: int = 1000, every: str = "0 seconds") -> None:
        self.spark: SparkSession = candles.sparkSession
        self.canonical, self.folder = canonical, folder
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/answers")
        self.fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        self.fs.mkdirs(path)
        answers = self.spark.readStream.schema(ROWS).option("recursiveFileLookup", "true").option("maxFileAge", "36500d").parquet(f"{folder}/answers")
        stream = _rows(candles).unionByName(answers).groupBy("run_id").transformWithStateInPandas(LiveRunner(minutes, retries, backoff_ms), EVENTS, "Append", "ProcessingTime")
        #: By micro-batch, requests and waits that it opened less those that it closed (before this query: of them all).
        self.open: dict[int, int] = {}
        if self.fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/events")):
            self.open[-1] = self._open(self.events())
        store = self.spark.conf.get(_STORE)
        self.spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")  # the only one with timers
        try:
            self.query: StreamingQuery = stream.writeStream.foreachBatch(self._batch).option("checkpointLocation", f"{folder}/checkpoint").trigger(processingTime=every).start()
        finally:
            self.spark.conf.set(_STORE, store)

    @staticmethod
    def _open(events: DataFrame) -> int:
        sign = F.when(F.col("kind").isin("repair", "backoff"), 1).when(F.col("kind").isin("answer", "retry"), -1).otherwise(0)
        return events.agg(F.coalesce(F.sum(sign), F.lit(0))).first()[0]

    def _batch(self, batch: DataFrame, number: int) -> None:
        path = f"{self.folder}/events/batch={number}"
        batch.write.mode("overwrite").parquet(path)
        events = self.spark.read.schema(EVENTS).parquet(path)
        requests = events.where("kind = 'repair'").select("run_id", "number", "start_minute", F.col("end_minute").alias("until"))
        if requests.limit(1).count():
            canonical = self.canonical() if callable(self.canonical) else self.canonical
            _rows(islands(requests, canonical)).write.mode("overwrite").parquet(f"{self.folder}/answers/batch={number}")
        self.open[number] = self._open(events)

    def events(self) -> DataFrame:
        return self.spark.read.schema(EVENTS).option("recursiveFileLookup", "true").parquet(f"{self.folder}/events")

    def drain(self, seconds: float = 3600) -> DataFrame:
        """The events once the sources have nothing new and nothing is asked or waited for; the query is stopped then."""
        until, quiet = time.monotonic() + seconds, 0
        try:
            while True:
                if failed := self.query.exception():
                    raise failed
                at, mine = self.query.lastProgress, [n for n in self.open if n >= 0]
                # the first one after a restart may be one that was planned before, and not look for new rows
                if at and at["numInputRows"] == 0 and min(mine, default=at["batchId"]) < at["batchId"] in mine and sum(self.open.values()) == 0:
                    return self.events()
                quiet = quiet + 1 if not mine and self.query.status["message"].startswith("Waiting") else 0
                if quiet > 10:  # there has never been a row
                    return self.spark.createDataFrame([], EVENTS)
                if time.monotonic() > until:
                    raise TimeoutError("the live runs' sources go on, or answers are out")
                time.sleep(0.1)
        finally:
            self.query.stop()
