"""Live candles: gap tracking and strict rollup as keyed state, and sinks by micro-batch (runs of strategies are in `runner`).

State is one small tuple a key. A key's rows of a micro-batch are taken in the order of `seq`; a live source's options bound
a micro-batch, and `in_order` bounds it for a table. What is late is decided by the state alone, so nothing that a repair
would accept is dropped by a watermark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

GAP_EVENTS = "symbol string, kind string, minute long, start_minute long, end_minute long"
BARS = "symbol string, idx long, open double, high double, low double, close double, volume double"
#: Rows of a table's micro-batch at most, and of those that a step takes and gives at once.
TRIGGER_ROWS, STEP_ROWS = 1 << 20, 1 << 16


def in_order(spark: SparkSession, rows: DataFrame, path: str) -> DataFrame:
    """A table as a stream in the order of `seq`, in micro-batches of at most TRIGGER_ROWS rows, by way of files in `path`.

    The file source takes files by their time of change, so the files get times in the order of their names.
    """
    order = F.col("seq").asc_nulls_last()
    rest = [c for c in rows.columns if c != "seq"]
    files = max(1, -(-rows.count() // TRIGGER_ROWS))
    rows.repartitionByRange(files, order).sortWithinPartitions(order, *rest).write.option("maxRecordsPerFile", TRIGGER_ROWS).parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    parts = sorted((f for f in fs.listStatus(folder) if f.getPath().getName().startswith("part-")), key=lambda f: f.getPath().getName())
    first = max((f.getModificationTime() for f in parts), default=0) - 1000 * len(parts)
    for k, f in enumerate(parts):
        fs.setTimes(f.getPath(), first + 1000 * k, -1)
    written = spark.read.schema(rows.schema).parquet(path)
    most = written.groupBy(F.col("_metadata.file_path")).count().agg(F.max("count")).first()[0] or 1
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", max(1, TRIGGER_ROWS // most)).option("maxFileAge", "36500d").parquet(path)


def observe(last: int | None, minute: int) -> tuple[int, tuple[str, int | None, int | None]]:
    """The last minute after this one, and what happened: accepted, duplicate, out_of_order, or gap [start, end)."""
    if last is None or minute == last + 1:
        return minute, ("accepted", None, None)
    if minute == last:
        return last, ("duplicate", None, None)
    if minute < last:
        return last, ("out_of_order", None, None)
    return minute, ("gap", last + 1, minute)


def _keyed(stream: DataFrame, key: str, step: Callable[[tuple | None, str, pd.DataFrame], tuple[tuple | None, list[tuple]]], out: str, state: str) -> DataFrame:
    names = [c.split()[0] for c in out.split(", ")]

    def run(k: tuple, chunks: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        now = held.get if held.exists else None
        group = pd.concat(chunks).sort_values("seq", kind="stable")
        for at in range(0, len(group), STEP_ROWS):
            now, rows = step(now, k[0], group.iloc[at : at + STEP_ROWS])
            yield pd.DataFrame(rows, columns=names)
        if now is not None:
            held.update(now)

    return stream.groupBy(key).applyInPandasWithState(run, out, state, "append", GroupStateTimeout.NoTimeout)


def track_gaps(candles: DataFrame) -> DataFrame:
    """What happened to each candle (symbol, minute, seq), and a fill task for each jump."""

    def step(now: tuple | None, symbol: str, chunk: pd.DataFrame) -> tuple[tuple | None, list[tuple]]:
        last, rows = (now[0] if now else None), []
        for minute in chunk["minute"].tolist():
            last, (kind, a, b) = observe(last, int(minute))
            rows.append((symbol, kind, int(minute), a, b))
        return (None if last is None else (last,)), rows

    return _keyed(candles, "symbol", step, GAP_EVENTS, "last long")


def rollup_strict_stream(candles: DataFrame, minutes: int) -> DataFrame:
    """Bars whose every minute came, in order; a bucket that another follows before it's full is lost.

    A minute that repeats or comes late is passed over.
    """

    def step(now: tuple | None, symbol: str, chunk: pd.DataFrame) -> tuple[tuple | None, list[tuple]]:
        rows = []
        for m, o, h, low, c, v in zip(*(chunk[x].tolist() for x in ("minute", "open", "high", "low", "close", "volume")), strict=True):
            m = int(m)
            if now and m <= now[1]:
                continue
            idx = m // minutes
            if now and now[0] == idx and m == now[1] + 1 and now[2]:
                now = (idx, m, now[2] + 1, now[3], max(now[4], h), min(now[5], low), c, now[7] + v)
            elif m % minutes == 0:
                now = (idx, m, 1, o, h, low, c, v)
            else:  # a bucket whose start was missed
                now = (idx, m, 0, o, h, low, c, v)
            if now[2] == minutes:
                rows.append((symbol, idx, *now[3:]))
        return now, rows

    return _keyed(candles, "symbol", step, BARS, "idx long, minute long, n int, open double, high double, low double, close double, volume double")


def write_batches(stream: DataFrame, path: str, checkpoint: str, every: str | None = None, transform: Callable[[DataFrame], DataFrame] = lambda df: df, most_rows: int = 0) -> StreamingQuery:
    """Each micro-batch as a folder of its own, so that one that is tried again replaces itself.

    `every` is the flush interval; without it all that is there is written and the query ends. A file of a flush has
    `most_rows` rows at most (0: any number); the source's options bound a micro-batch.
    """

    def flush(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").option("maxRecordsPerFile", most_rows).parquet(f"{path}/batch={number}")

    writer = stream.writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def windowed_bars(ticks: DataFrame, width: str, lateness: str) -> DataFrame:
    """Bars by event time (symbol, ts, price, volume, seq) that close when the watermark passes their end."""
    w = F.window("ts", width)
    order = F.struct("ts", "seq")
    return ticks.withWatermark("ts", lateness).groupBy("symbol", w).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("volume").alias("volume")
    )
