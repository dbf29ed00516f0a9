"""Bars: deduplication, dense grids, rollups, gaps and bounds, all as DataFrame operations.

A bar table has `symbol`, `idx` (its bucket's number since 1970, so neighbours differ by one), and open, high, low,
close, volume, of which a missing bar has NULLs.
"""

from __future__ import annotations

import re
from datetime import UTC, datetime

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.scalars import MINUTE_MS, finite

OHLCV = ("open", "high", "low", "close", "volume")


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row of each key that is greatest by `order` (the last columns break ties).

    An aggregate, so that a key with very many versions is reduced before the shuffle.
    """
    best = F.max_by(F.struct(*df.columns), F.struct(*order))
    return df.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(best.alias("r")).select("r.*")


def placed(table: DataFrame) -> DataFrame:
    """A Parquet table with `_row`, a row's number in its file, and `_file`, that file's number by path, for `rollup` to settle ties by."""
    files = sorted({re.sub(r"^(\w+):///", r"\1:/", f) for f in table.inputFiles()})  # as _metadata spells them
    if len(files) < 2:
        return table.select("*", F.col("_metadata.row_index").alias("_row"), F.lit(0).alias("_file"))
    numbers = table.sparkSession.createDataFrame([*enumerate(files)], "_file int, _path string")  # a row a file
    rows = table.select("*", F.col("_metadata.row_index").alias("_row"), F.col("_metadata.file_path").alias("_path"))
    return rows.join(F.broadcast(numbers), "_path", "left").drop("_path")


def rollup(ticks: DataFrame, idx: Column, price: Column, volume: Column, order: Sequence[str], symbol: Column) -> DataFrame:
    """Bars of trades: first, highest, lowest and last price of a bucket by `order`, and its volume.

    Of trades that `order` leaves equal the one that comes first in the files is both first and last, if `ticks` is `placed`.
    """
    place = [F.col("_file"), F.col("_row")] if {"_row", "_file"} <= {*ticks.columns} else []
    first, last = F.struct(*order, *place), F.struct(*order, *(-x for x in place))
    t = ticks.select(symbol.alias("symbol"), idx.alias("idx"), finite(price.cast("double")).alias("p"), volume.cast("double").alias("v"), first.alias("first"), last.alias("last"))
    return t.where("p is not null and symbol is not null and idx is not null").groupBy("symbol", "idx").agg(
        F.min_by("p", "first").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "last").alias("close"), F.sum("v").alias("volume")
    )


def rollup_best_effort(bars: DataFrame, factor: int) -> DataFrame:
    """Bars of `factor` times the timeframe, from those with a finite close; a bucket without one, or with a value
    that isn't finite, has no row."""
    b = bars.where(finite(F.col("close")).isNotNull()).withColumn("fine", F.col("idx")).withColumn("idx", F.floor(F.col("idx") / factor))
    out = b.groupBy("symbol", "idx").agg(
        F.min_by("open", "fine").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "fine").alias("close"), F.sum("volume").alias("volume")
    )
    whole = F.lit(True)
    for c in OHLCV:
        whole &= finite(F.col(c)).isNotNull()
    return out.where(whole)


def rollup_strict(bars: DataFrame, factor: int) -> DataFrame:
    """Bars of buckets of which every fine bar is there."""
    b = bars.where("close is not null").withColumn("fine", F.col("idx")).withColumn("idx", F.floor(F.col("idx") / factor))
    out = b.groupBy("symbol", "idx").agg(
        F.min_by("open", "fine").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "fine").alias("close"), F.sum("volume").alias("volume"),
        F.countDistinct("fine").alias("n"),
    )
    return out.where(F.col("n") == factor).drop("n")


def spine(bars: DataFrame, size: int = 65_536) -> DataFrame:
    """(symbol, idx) of every bucket from a symbol's first to its last, made in stretches of `size`."""
    ends = bars.groupBy("symbol").agg(F.min("idx").alias("lo"), F.max("idx").alias("hi"))
    stretch = ends.select("symbol", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / size), F.floor(F.col("hi") / size))).alias("s"))
    first, last = F.greatest("lo", F.col("s") * size), F.least("hi", F.col("s") * size + size - 1)
    return stretch.select("symbol", F.explode(F.sequence(first, last)).alias("idx"))


def dense(bars: DataFrame) -> DataFrame:
    """Every bucket of each symbol's range; those without a bar are NULL. Bars must be one a bucket."""
    return spine(bars).join(bars, ["symbol", "idx"], "left").select("symbol", "idx", *OHLCV)


def carry_forward(bars: DataFrame, size: int = 65_536) -> DataFrame:
    """Every bucket from a symbol's first bar on; an empty one takes the last close as its prices and has no volume.

    Each bar fills the buckets up to the next one, so no window runs over a whole history: the next bar comes from
    `lead` inside stretches of `size` buckets, and from the next stretch's first bar at their ends.
    """
    b = bars.where("close is not null").withColumn("s", F.floor(F.col("idx") / size))
    firsts = b.groupBy("symbol", "s").agg(F.min("idx").alias("first"))
    after = firsts.withColumn("after", F.lead("first").over(Window.partitionBy("symbol").orderBy("s"))).select("symbol", "s", "after")
    nxt = F.coalesce(F.lead("idx").over(Window.partitionBy("symbol", "s").orderBy("idx")), F.col("after"), F.col("idx") + 1)
    filled = b.join(after, ["symbol", "s"]).withColumn("next", nxt).withColumn("at", F.explode(F.sequence("idx", F.col("next") - 1)))
    own = F.col("at") == F.col("idx")
    price = lambda c: F.when(own, F.col(c)).otherwise(F.col("close")).alias(c)
    return filled.select("symbol", F.col("at").alias("new"), price("open"), price("high"), price("low"), F.col("close"), F.when(own, F.col("volume")).otherwise(F.lit(0.0)).alias("volume")).withColumnRenamed("new", "idx")


def in_range(bars: DataFrame, start_ms: int, end_ms: int, tf_ms: int) -> DataFrame:
    """Rolled bars of a load range: a bucket that closes at the end or later is out, and one that closes before the
    start is too; the first may be partial."""
    close = (F.col("idx") + 1) * tf_ms
    return bars.where((close < end_ms) & (close >= start_ms))


def rows_of(df: DataFrame, ts: str, start_ms: int, end_ms: int, tf_ms: int) -> DataFrame:
    """Rows of a table that whole bars closing in [start, end) are made of: bounds on the column itself, which reach its scan."""
    kind = dict(df.dtypes)[ts]
    zone = "" if kind == "timestamp_ntz" else "Z"
    bound = lambda ms: F.lit(f"{datetime.fromtimestamp(ms / 1000, UTC).replace(tzinfo=None).isoformat()}{zone}").cast(kind)
    first, last = -(-start_ms // tf_ms) - 1, -(-end_ms // tf_ms) - 1  # the first bar that closes in the range, and the first beyond it
    return df.where((F.col(ts) >= bound(first * tf_ms)) & (F.col(ts) < bound(last * tf_ms)))


def target_slice(bars: DataFrame, start_ms: int, end_ms: int, tf_ms: int) -> DataFrame:
    """Bars whose closing time is in [start, end)."""
    close = (F.col("idx") + 1) * tf_ms
    return bars.where((close >= start_ms) & (close < end_ms))


def load_range(start_ms: int, end_ms: int, tf_ms: int, warmup: int) -> tuple[int, int]:
    """Minute range to load for a target range and `warmup` bars before it."""
    start = start_ms - warmup * tf_ms
    return start - start % MINUTE_MS, -(-end_ms // MINUTE_MS) * MINUTE_MS


def gap_ranges(bars: DataFrame) -> DataFrame:
    """(symbol, start_idx, end_idx): runs of missing buckets between a symbol's bars, as [start, end).

    Found from neighbours of stretches, as in carry_forward; the missing buckets are never made.
    """
    b = bars.where("close is not null").select("symbol", "idx").distinct().withColumn("s", F.floor(F.col("idx") / 65_536))
    firsts = b.groupBy("symbol", "s").agg(F.min("idx").alias("first"))
    after = firsts.withColumn("after", F.lead("first").over(Window.partitionBy("symbol").orderBy("s"))).select("symbol", "s", "after")
    nxt = F.coalesce(F.lead("idx").over(Window.partitionBy("symbol", "s").orderBy("idx")), F.col("after"))
    pairs = b.join(after, ["symbol", "s"]).select("symbol", "idx", nxt.alias("next"))
    return pairs.where("next > idx + 1").select("symbol", (F.col("idx") + 1).alias("start_idx"), F.col("next").alias("end_idx"))


def bounds(bars: DataFrame, before_idx: int | None = None) -> DataFrame:
    """First and last bucket of each symbol, of those before `before_idx` if it's given."""
    b = bars.where("close is not null")
    b = b if before_idx is None else b.where(F.col("idx") < before_idx)
    return b.groupBy("symbol").agg(F.min("idx").alias("min_idx"), F.max("idx").alias("max_idx"))


def daily_counts(ticks: DataFrame, symbol: Column, ms: Column) -> DataFrame:
    """Exact number of distinct minutes of each symbol's days."""
    t = ticks.select(symbol.alias("symbol"), F.floor(ms / 86_400_000).alias("day"), F.floor(ms / MINUTE_MS).alias("minute")).distinct()
    return t.groupBy("symbol", "day").agg(F.count("*").alias("minutes"))


def gap_days(counts: DataFrame, first_minute: int, last_minute: int) -> DataFrame:
    """Days of [first, last) with fewer minutes than they should have; parts of days at the ends count as far as they reach."""
    days = counts.select("symbol").distinct().select("symbol", F.explode(F.sequence(F.lit(first_minute // 1440).cast("long"), F.lit((last_minute - 1) // 1440).cast("long"))).alias("day"))
    due = F.least((F.col("day") + 1) * 1440, F.lit(last_minute)) - F.greatest(F.col("day") * 1440, F.lit(first_minute))
    return days.join(counts, ["symbol", "day"], "left").select("symbol", "day", F.coalesce("minutes", F.lit(0)).cast("long").alias("minutes"), due.cast("long").alias("expected")).where("minutes < expected")


def day_slices(start_ms: int, end_ms: int, most_days: int = 7) -> list[tuple[int, int]]:
    """[start, end) cut at UTC midnights into slices of at most so many days."""
    out, at, day = [], start_ms, 86_400_000
    while at < end_ms:
        stop = min(end_ms, (at // day + most_days) * day)
        out.append((at, stop))
        at = stop
    return out


def new_rows(batch: DataFrame, existing: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows of a batch whose keys aren't there yet, the last of each key by `order`."""
    return latest_per_key(batch, keys, order).join(existing.select(*keys).distinct(), list(keys), "left_anti")


def valid_candles(df: DataFrame) -> DataFrame:
    """Rows that keep a candle's invariants: opens before it closes, high and low around both prices, no volume below 0."""
    return df.where("ts_open < ts_close and high >= greatest(open, close) and low <= least(open, close) and volume_base >= 0 and (volume_quote is null or volume_quote >= 0)")
