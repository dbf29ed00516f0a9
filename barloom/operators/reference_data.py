"""Reference data and ingestion plans: markets, instruments, and which minutes to load."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.scalars import instrument_key
from barloom.operators.bars import gap_ranges, latest_per_key

#: The markets (fixed values): id, exchange, type, code.
MARKETS = ((1, "binance", "spot", "binance:spot"), (2, "binance", "futures", "binance:futures"), (3, "bybit", "spot", "bybit:spot"), (4, "bybit", "futures", "bybit:futures"))
INSTRUMENT_KEY = ["market_id", "symbol"]


def seed_markets(existing: DataFrame) -> DataFrame:
    """The fixed markets that aren't there yet, to be appended."""
    rows = existing.sparkSession.createDataFrame(list(MARKETS), "market_id int, exchange_name string, market_type string, market_code string").withColumn("is_enabled", F.lit(1))
    return rows.join(existing.select("market_id").distinct(), "market_id", "left_anti")


def enabled_markets(markets: DataFrame) -> DataFrame:
    """Markets whose latest version is enabled, by id."""
    return latest_per_key(markets, ["market_id"], ["updated_at"]).where("is_enabled = 1").orderBy("market_id")


def enabled_instruments(instruments: DataFrame) -> DataFrame:
    """Instruments whose latest version is enabled and tradable: versions are chosen first, then filtered."""
    return latest_per_key(instruments, INSTRUMENT_KEY, ["updated_at"]).where("status = 'ENABLED' and is_tradable = 1")


def search_instruments(instruments: DataFrame, market_id: int, prefix: str = "", limit: int = 50) -> DataFrame:
    """Enabled instruments of a market by an upper-cased prefix, by symbol; at most 200."""
    if not 1 <= limit <= 200:
        raise ValueError("limit must be from 1 to 200")
    found = enabled_instruments(instruments).where((F.col("market_id") == market_id) & F.col("symbol").startswith(prefix.strip().upper()))
    return found.orderBy("symbol").limit(limit)


def with_key(df: DataFrame, exchange: str, market_type: str) -> DataFrame:
    return df.withColumn("instrument_key", instrument_key(F.col(exchange), F.col(market_type), F.col("symbol")))


def _differs(columns: Sequence[str]) -> Column:
    """Whether any of the columns differs from its twin `old_...`; a missing twin counts as different."""
    out = F.lit(False)
    for c in columns:
        out |= ~F.col(c).eqNullSafe(F.col(f"old_{c}"))
    return out


def changed_rows(target: DataFrame, current: DataFrame, columns: Sequence[str], keys: Sequence[str] = INSTRUMENT_KEY, order: Sequence[str] = ("updated_at",)) -> DataFrame:
    """Rows of `target` that are new or differ in `columns` from the latest version, to be appended."""
    old = latest_per_key(current, keys, order).select(*keys, *(F.col(c).alias(f"old_{c}") for c in columns), F.lit(True).alias("old"))
    return target.join(old, list(keys), "left").where(F.col("old").isNull() | _differs(columns)).select(*target.columns)


def whitelist_targets(whitelist: DataFrame) -> DataFrame:
    """Status and tradable flag that a whitelist's rows ask for; of repeated rows an enabled one wins."""
    w = whitelist.groupBy(F.col("market_id"), F.upper(F.trim("symbol")).alias("symbol")).agg(F.max(F.col("is_enabled").cast("int")).alias("on"))
    return w.select("market_id", "symbol", F.when(F.col("on") == 1, "ENABLED").otherwise("DISABLED").alias("status"), F.col("on").alias("is_tradable"))


METADATA = ("base_asset", "quote_asset", "price_step", "qty_step", "min_notional")


def enrichment(instruments: DataFrame, metadata: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Versions to append for enabled instruments whose metadata differ, and the instruments without metadata."""
    on = enabled_instruments(instruments)
    m = latest_per_key(metadata.withColumn("symbol", F.upper(F.trim("symbol"))), INSTRUMENT_KEY, [*METADATA])  # of repeated rows a fixed one
    fresh = on.select(*INSTRUMENT_KEY, "status", "is_tradable").join(m.select(*INSTRUMENT_KEY, *METADATA), INSTRUMENT_KEY)
    return changed_rows(fresh, instruments, METADATA), on.join(m, INSTRUMENT_KEY, "left_anti")


TASK = "market_id int, symbol string, reason string, start_minute long, end_minute long"


def backfill_tasks(instruments: DataFrame, bounds: DataFrame, earliest: DataFrame, now_minute: int, lookback: int) -> DataFrame:
    """Minutes [start, end) to load for each enabled instrument.

    Without any minute: all from the market's earliest one on (bootstrap). Else from there to the first minute kept,
    if it lies before (historical_backfill), and the last `lookback` minutes (scheduler_tail). Empty ranges go.
    """
    rows = instruments.select(*INSTRUMENT_KEY).join(F.broadcast(earliest.select("market_id", "earliest_minute")), "market_id").join(bounds.select(*INSTRUMENT_KEY, "min_minute", "max_minute"), INSTRUMENT_KEY, "left")
    none = F.col("min_minute").isNull()
    task = lambda reason, when, start, end: F.when(when, F.struct(F.lit(reason).alias("reason"), start.cast("long").alias("start_minute"), end.cast("long").alias("end_minute")))
    now = F.lit(now_minute)
    tasks = F.array_compact(F.array(
        task("bootstrap", none, F.col("earliest_minute"), now),
        task("historical_backfill", ~none, F.col("earliest_minute"), F.col("min_minute")),
        task("scheduler_tail", ~none, F.greatest(F.col("earliest_minute"), now - lookback), now),
    ))
    return rows.select(*INSTRUMENT_KEY, F.explode(tasks).alias("t")).select(*INSTRUMENT_KEY, "t.*").where("start_minute < end_minute")


def clamp_tasks(tasks: DataFrame, bounds: DataFrame, reasons: Sequence[str] = ("bootstrap", "historical_backfill")) -> DataFrame:
    """Tasks that fill history end at the first minute that's kept by now; what is empty then goes."""
    b = bounds.select(*INSTRUMENT_KEY, "min_minute")
    end = F.when(F.col("reason").isin(*reasons) & F.col("min_minute").isNotNull(), F.least("end_minute", "min_minute")).otherwise(F.col("end_minute"))
    return tasks.join(b, INSTRUMENT_KEY, "left").withColumn("end_minute", end).drop("min_minute").where("start_minute < end_minute")


def tail_tasks(instruments: DataFrame, bounds: DataFrame, now_minute: int, bootstrap: int) -> DataFrame:
    """After a reconnect: from the minute after the last one kept, or the last `bootstrap` minutes, to now."""
    start = F.coalesce(F.col("max_minute") + 1, F.lit(now_minute - bootstrap))
    return instruments.select(*INSTRUMENT_KEY).join(bounds.select(*INSTRUMENT_KEY, "max_minute"), INSTRUMENT_KEY, "left").select(*INSTRUMENT_KEY, F.lit("reconnect_tail").alias("reason"), start.cast("long").alias("start_minute"), F.lit(now_minute).cast("long").alias("end_minute")).where("start_minute < end_minute")


def catch_up_tasks(instruments: DataFrame, minutes: DataFrame, now_minute: int) -> DataFrame:
    """Minutes [start, end) that an instrument with history lacks: its tail up to now, and the gaps before it.

    `minutes` has market_id, symbol and minute of the candles kept. Instruments without any before now get no task: they
    need a first backfill (`backfill_tasks`).
    """
    kept = minutes.where(F.col("minute") < now_minute).join(instruments.select(*INSTRUMENT_KEY).distinct(), INSTRUMENT_KEY, "left_semi")
    last = kept.groupBy(*INSTRUMENT_KEY).agg(F.max("minute").alias("max_minute"))
    tail = last.select(*INSTRUMENT_KEY, F.lit("catch_up_tail").alias("reason"), (F.col("max_minute") + 1).cast("long").alias("start_minute"), F.lit(now_minute).cast("long").alias("end_minute"))
    key = F.struct(*INSTRUMENT_KEY).alias("symbol")
    gaps = gap_ranges(kept.select(key, F.col("minute").cast("long").alias("idx"), F.lit(0.0).alias("close")))
    fill = gaps.select("symbol.*", F.lit("gap_fill").alias("reason"), F.col("start_idx").alias("start_minute"), F.col("end_idx").alias("end_minute"))
    return tail.where("start_minute < end_minute").unionByName(fill)


def catch_up(instruments: DataFrame, kept: DataFrame, source: DataFrame, now_minute: int) -> DataFrame:
    """Rows of `source` (market_id, symbol, minute, ...) that `catch_up_tasks` ask for, without those that are kept by now."""
    tasks = catch_up_tasks(instruments, kept, now_minute)
    wanted = tasks.select(*INSTRUMENT_KEY, F.explode(F.sequence("start_minute", F.col("end_minute") - 1)).alias("minute")).distinct()
    key = [*INSTRUMENT_KEY, "minute"]
    return source.join(wanted, key, "left_semi").join(kept.select(*key).distinct(), key, "left_anti").dropDuplicates(key)


def pending(tasks: DataFrame) -> DataFrame:
    """Each (instrument, range, reason) once."""
    return tasks.dropDuplicates([*INSTRUMENT_KEY, "start_minute", "end_minute", "reason"])


def strategy_runs(runs: DataFrame, strategies: DataFrame) -> DataFrame:
    """Runs with their strategies; a run whose strategy is missing or deleted has failed."""
    s = strategies.select("strategy_id", F.col("is_deleted").alias("_deleted"), F.lit(True).alias("_there"))
    joined = runs.join(s, "strategy_id", "left")
    lost = F.col("_there").isNull() | (F.coalesce(F.col("_deleted").cast("int"), F.lit(0)) == 1)
    return joined.withColumn("state", F.when(lost, F.lit("failed")).otherwise(F.col("state"))).drop("_deleted", "_there")


#: States of a run and those that may follow (fixed values).
TRANSITIONS = {
    "starting": ("warming_up", "stopping", "failed"), "warming_up": ("running", "stopping", "failed"), "running": ("stopping", "failed"), "stopping": ("stopped", "failed"), "stopped": (), "failed": (),
}


def active_jobs(jobs: DataFrame, user_id: int | str) -> DataFrame:
    return jobs.where((F.col("user_id") == user_id) & F.col("state").isin("queued", "running")).agg(F.count("*").alias("n"))


def warmup_bars(spec: object) -> int:
    """The greatest positive number anywhere in an indicator's parameters, at least 1."""
    if isinstance(spec, bool):
        return 1
    if isinstance(spec, (int, float)):
        return max(1, int(spec))
    if isinstance(spec, dict):
        return max([1, *map(warmup_bars, spec.values())])
    if isinstance(spec, (list, tuple)):
        return max([1, *map(warmup_bars, spec)])
    return 1


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)
