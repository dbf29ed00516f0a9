"""The library's queries by name, over bars made from the star schema's tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.scalars import epoch_ms, rounded
from barloom.operators import asof, bars, execution, metrics, reference_data, search, signals
from barloom.operators.indicators import registry, registry_rows
from barloom.sources.candles import CANONICAL
from barloom.sources.scratch import materialize, scratch_path
from barloom.streaming import canonical, live, runner

HOUR, DAY = 3_600_000, 86_400_000
#: A target range in milliseconds.
TARGET = (1704326400000, 1704672000000)
Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_bars(spark: SparkSession, sf_dir: str, tf_ms: int = HOUR, closing: tuple[int, int] | None = None) -> DataFrame:
    """Bars of events: a symbol an event type, price the value, volume the number of events; of all, or of those that bars closing in a range need."""
    e = bars.placed(_read(spark, sf_dir, "events"))
    if closing:
        e = bars.rows_of(e, "ts", *closing, tf_ms)
    return bars.rollup(e, F.floor(epoch_ms("ts") / tf_ms), F.col("value"), F.lit(1.0), ["ts", "event_id"], F.col("event_type"))


def market_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = bars.placed(_read(spark, sf_dir, "lineitem")).withColumn("p", F.col("l_extendedprice") / F.nullif("l_quantity", F.lit(0.0)))
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    return bars.rollup(t, F.floor(epoch_ms("l_shipdate") / DAY), F.col("p"), F.col("l_quantity"), order, F.col("l_returnflag"))


def order_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = bars.placed(_read(spark, sf_dir, "orders"))
    return bars.rollup(t, F.floor(epoch_ms("o_orderdate") / DAY), F.col("o_totalprice"), F.lit(1.0), ["o_orderdate", "o_orderkey"], F.col("o_orderpriority"))


def dense_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars.dense(event_bars(spark, sf_dir))


def _rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select("symbol", F.col("idx").cast("long").alias("idx"), *(rounded(c, places).alias(c) for c in bars.OHLCV))


def _indicator(id_: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return registry()[id_](dense_bars(spark, sf_dir)).select("symbol", "idx", rounded("value", 6).alias("value"))

    return run


def _signal(id_: str, **params: object) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return signals.evaluate(dense_bars(spark, sf_dir), id_, **params).select("symbol", "idx", "signal")

    return run


def crossing_signals(b: DataFrame) -> DataFrame:
    """Bars with the conjunction of two comparisons with moving averages."""
    both = [signals.evaluate(b, "ma.sma", {"window": w}) for w in (3, 6)]
    long = reduce(DataFrame.unionByName, [s.select("symbol", "idx", "signal") for s in both])
    return b.join(signals.conjunction(long), ["symbol", "idx"])


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events to bars to moving averages to signals: how many bars of each symbol are long, short and neutral."""
    s = F.col("signal")
    n = lambda v: F.count(F.when(s == v, 1)).alias({1: "n_long", -1: "n_short", 0: "n_neutral"}[v])
    return crossing_signals(dense_bars(spark, sf_dir)).groupBy("symbol").agg(n(1), n(-1), n(0))


EXECUTION = execution.Execution(fee=0.00075, slippage=0.0001, stop_loss=0.2, take_profit=0.5)


def carried_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crossing_signals(bars.carry_forward(event_bars(spark, sf_dir))).select("symbol", "idx", "close", "signal")


def _search_parts() -> list[search.Part]:
    return [search.Part("ma.sma", {"window": [3, 5, 8]}), search.Part("momentum.roc", {"window": [2, 4]})]


def stage_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars.carry_forward(event_bars(spark, sf_dir))
    return search.stage_a(b, _search_parts(), EXECUTION, HOUR, preselect=10)[0].select("symbol", "variant", "key", rounded("total_return_pct", 4).alias("total_return_pct"))


def stage_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars.carry_forward(event_bars(spark, sf_dir))
    best, s = search.stage_a(b, _search_parts(), EXECUTION, HOUR, preselect=5)
    risks = search.risk_variants((None, 0.1), (None, 0.3))
    return search.stage_b(best, s, risks, EXECUTION, HOUR, top_k=8).select("symbol", "variant", "key", "risk", rounded("total_return_pct", 4).alias("total_return_pct"))


def _held(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buying and holding as an equity curve."""
    return event_bars(spark, sf_dir).select("symbol", F.lit(0).cast("long").alias("variant"), "idx", F.col("close").alias("equity"))


def _figures(df: DataFrame, places: int = 4) -> DataFrame:
    """Doubles to so many places; counts and times as longs."""
    kinds = {"double": lambda c: rounded(c, places), "bigint": F.col, "int": lambda c: F.col(c).cast("long")}
    return df.select(*(kinds.get(t, F.col)(c).alias(c) for c, t in df.dtypes))


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = carried_signals(spark, sf_dir)
    run = execution.Simulation(s, EXECUTION)
    return _figures(metrics.report(run.bars, run.trades(), run.equity_curve(), EXECUTION.cash, HOUR))


def _ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.ratios(_held(spark, sf_dir), HOUR).select("symbol", *(rounded(c, 4).alias(c) for c in ("annual_return", "sharpe", "sortino")))


def _drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = metrics.drawdowns(_held(spark, sf_dir), HOUR)
    return d.select("symbol", rounded("max_drawdown_pct", 4).alias("max_drawdown_pct"), rounded("avg_drawdown_pct", 4).alias("avg_drawdown_pct"), F.col("max_drawdown_ms").cast("long").alias("max_drawdown_ms"), F.col("avg_drawdown_ms").cast("long").alias("avg_drawdown_ms"))


def _new_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events")
    even, odd = e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1")
    return bars.new_rows(odd, even, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", rounded("value", 6).alias("value"))


def _latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars.latest_per_key(_read(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", rounded("value", 6).alias("value"))


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars.daily_counts(_read(spark, sf_dir, "events"), F.col("event_type"), epoch_ms("ts"))


def bar_queries() -> dict[str, Query]:
    long = lambda df: df.select("symbol", *(F.col(c).cast("long").alias(c) for c in df.columns if c != "symbol"))
    return {
        "flagship": flagship,
        "bars_event_hours": lambda s, d: _rounded(event_bars(s, d)),
        "bars_market_days": lambda s, d: _rounded(market_days(s, d), 8),
        "bars_order_days": lambda s, d: _rounded(order_days(s, d)),
        "bars_dense_spine": lambda s, d: _rounded(dense_bars(s, d)),
        "bars_rollup_best_effort": lambda s, d: _rounded(bars.rollup_best_effort(event_bars(s, d, 60_000), 60)),
        "bars_rollup_carry_forward": lambda s, d: _rounded(bars.carry_forward(event_bars(s, d))),
        "bars_rollup_strict": lambda s, d: _rounded(bars.rollup_strict(event_bars(s, d), 4)),
        "bars_gap_ranges": lambda s, d: long(bars.gap_ranges(event_bars(s, d))),
        "bars_bounds": lambda s, d: long(bars.bounds(event_bars(s, d))),
        "bars_daily_counts": lambda s, d: long(_counts(s, d)),
        "bars_gap_days": lambda s, d: long(bars.gap_days(_counts(s, d), 19723 * 1440 + 60, 19752 * 1440 + 720)),
        "bars_target_slice": lambda s, d: _rounded(bars.target_slice(event_bars(s, d, closing=TARGET), *TARGET, HOUR)),
        "bars_latest_per_key": _latest,
        "bars_new_rows": _new_rows,
    }


def signal_queries() -> dict[str, Query]:
    return {
        "sig_compare_price_to_output": _signal("ma.sma"),
        "sig_threshold_band": _signal("momentum.rsi", long_threshold=30, short_threshold=70),
        "sig_sign": _signal("momentum.macd"),
        "sig_delta_sign": _signal("volatility.atr", long_periods=2, short_periods=-3),
        "sig_compare_volume_to_output": _signal("volume.volume_sma"),
        "sig_candle_body_direction": _signal("candle_stats", threshold=0.5),
        "sig_pivot_events": _signal("pivots"),
        "sig_threshold_centered": _signal("trend.vortex", threshold=0.1),
        "sig_and_aggregate": lambda s, d: crossing_signals(dense_bars(s, d)).select("symbol", "idx", "signal"),
    }


def search_queries() -> dict[str, Query]:
    return {
        "exec_trades": lambda s, d: _figures(execution.trades(carried_signals(s, d), EXECUTION), 6),
        "exec_equity": lambda s, d: _figures(execution.equity_curve(carried_signals(s, d), EXECUTION), 6),
        "metrics_benchmark": lambda s, d: metrics.benchmark(event_bars(s, d)).select("symbol", rounded("benchmark_pct", 4).alias("benchmark_pct")),
        "metrics_drawdown": _drawdown,
        "metrics_ratios": _ratios,
        "metrics_trades": lambda s, d: _figures(metrics.trade_stats(execution.trades(carried_signals(s, d), EXECUTION), HOUR)),
        "metrics_report": _report,
        "search_grid": lambda s, d: search.grid(s, _search_parts()).select("variant", "key", F.posexplode("points").alias("part", "point")),
        "search_stage_a_topk": stage_a,
        "search_stage_b_topk": stage_b,
        "registry_listing": lambda s, d: s.createDataFrame(registry_rows(), "id string, family string, parameters string, outputs string, main string"),
    }


def _streamed(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """All that a stream's source has by now, through its state, as a table."""
    at = scratch_path(spark, name)
    live.write_batches(stream, f"{at}/rows", f"{at}/checkpoint").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/rows/batch=*")


def stream_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    minute = F.floor(epoch_ms("ts") / 60_000).cast("long")
    rows = _read(spark, sf_dir, "events").where("event_type is not null and ts is not null").select(F.col("event_type").alias("symbol"), minute.alias("minute"), F.col("event_id").alias("seq"))
    return _streamed(spark, live.track_gaps(live.in_order(spark, rows, scratch_path(spark, "events"))), "gaps")


def stream_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minute bars as a stream, rolled up to pairs of minutes that are both there."""
    minutes = event_bars(spark, sf_dir, 60_000).select("symbol", F.col("idx").cast("long").alias("minute"), *bars.OHLCV, F.col("idx").cast("long").alias("seq"))
    return _rounded(_streamed(spark, live.rollup_strict_stream(live.in_order(spark, minutes, scratch_path(spark, "minutes")), 2), "pairs"))


def stream_live_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days as minutes: a flag's orders dealt to three runs, whose candles are first lines and whose canonical rows are all lines."""
    lines = _read(spark, sf_dir, "lineitem").where("l_shipdate is not null and l_returnflag is not null and l_orderkey is not null")
    lines = lines.select(F.concat_ws("-", "l_returnflag", F.col("l_orderkey") % 3).alias("run_id"), F.floor(epoch_ms("l_shipdate") / DAY).cast("long").alias("minute"), "l_linenumber")
    candles = lines.where("l_linenumber = 1").select("run_id", F.lit("candle").alias("kind"), "minute", F.col("minute").alias("seq"), F.lit(RUN_WARMUP).alias("warmup"))
    at = scratch_path(spark, "live-runs")
    kept = materialize(lines.select("run_id", "minute").distinct(), "canonical", f"{at}/canonical")  # or each micro-batch would read all lines
    runs = runner.LiveRuns(live.in_order(spark, candles, f"{at}/candles"), kept, at, RUN_MINUTES, retries=1, backoff_ms=0)
    told = runs.drain().where(F.col("kind").isin("accepted", "dropped", "repaired", "gave_up", "bar", "state"))
    return told.select("run_id", "kind", "minute", "start_minute", "end_minute", F.col("attempt").cast("long").alias("attempt"), F.when(F.col("kind") == "bar", F.col("bars")).alias("bars"), F.when(F.col("kind") == "state", F.col("state")).alias("state"))


def stream_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as raw minutes, several versions of each, merged into a canonical table by micro-batches, and compacted once."""
    e = _read(spark, sf_dir, "events").where("event_type is not null and ts is not null")
    given = {"market_id": F.lit(1), "symbol": F.col("event_type"), "ts_open": F.date_trunc("minute", "ts"), "close": F.col("value"), "ingested_at": F.timestamp_seconds("event_id"), "source": F.lit("rest")}
    columns = [given.get(n, F.lit(None)).cast(t).alias(n) for n, t in (c.split() for c in CANONICAL.split(", "))]
    at = scratch_path(spark, "canonical")
    raw = live.in_order(spark, e.select(*columns, F.col("event_id").alias("seq")), f"{at}/raw")
    canonical.merge_stream(raw, "binance", f"{at}/table", f"{at}/checkpoint").awaitTermination()
    canonical.compact(spark, f"{at}/table")
    got = canonical.canonical_table(spark, f"{at}/table")
    return got.select("symbol", F.floor(epoch_ms("ts_open") / 60_000).cast("long").alias("minute"), rounded("close", 6).alias("close"), F.unix_seconds("ingested_at").alias("version"))


def asof_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event and the value of the last event of its type with a number that 7 divides, at or before it."""
    e = bars.placed(_read(spark, sf_dir, "events")).where("ts is not null")
    newest = F.struct("event_id", -F.col("_file"), -F.col("_row"))
    known = e.where("event_id % 7 = 0 and event_type is not null").groupBy("event_type", "ts").agg(F.max_by("value", newest).alias("known_value"), F.max("event_id").alias("known_id"))
    got = asof.asof_join(e.select("event_id", "event_type", "ts"), known, ["event_type"], "ts", ["known_value", "known_id"])
    return got.select("event_id", "event_type", rounded("known_value", 6).alias("known_value"), "known_id")


#: Minutes of a bar of the live runs, and bars of warm-up.
RUN_MINUTES, RUN_WARMUP = 7, 3


def _market(key: str) -> F.Column:
    return (F.col(key) % 4 + 1).cast("int").alias("market_id")


def upsert_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as instruments: those in the red are switched off, and suppliers are asked for as new ones."""
    c, s = _read(spark, sf_dir, "customer"), _read(spark, sf_dir, "supplier")
    on, off = F.lit("ENABLED").alias("status"), F.when(F.col("c_acctbal") < 0, "DISABLED").otherwise("ENABLED").alias("status")
    building = (F.col("c_mktsegment") == "BUILDING").cast("int").alias("is_tradable")
    current = c.select(_market("c_custkey"), F.col("c_name").alias("symbol"), on, building, F.lit(1).alias("updated_at"))
    target = c.select(_market("c_custkey"), F.col("c_name").alias("symbol"), off, building).unionByName(s.select(_market("s_suppkey"), F.col("s_name").alias("symbol"), on, F.lit(1).alias("is_tradable")))
    return reference_data.changed_rows(target, current, ["status", "is_tradable"])


FIRST_MINUTE, NOW_MINUTE = 19_722 * 1440, 19_730 * 1440


def backfill_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types as instruments of market 1 with minutes, nations as instruments of market 2 without any."""
    seen = _read(spark, sf_dir, "events").where("event_type is not null").groupBy(F.lit(1).alias("market_id"), F.col("event_type").alias("symbol"))
    minute = F.floor(epoch_ms("ts") / 60_000).cast("long")
    bounds = seen.agg(F.min(minute).alias("min_minute"), F.max(minute).alias("max_minute"))
    instruments = bounds.select("market_id", "symbol").unionByName(_read(spark, sf_dir, "nation").select(F.lit(2).alias("market_id"), F.col("n_name").alias("symbol")))
    earliest = spark.createDataFrame([(1, FIRST_MINUTE), (2, FIRST_MINUTE + 60)], "market_id int, earliest_minute long")
    return reference_data.backfill_tasks(instruments, bounds, earliest, NOW_MINUTE, 180)


def service_queries() -> dict[str, Query]:
    return {"ref_upsert_changed": upsert_changed, "plan_backfill_tasks": backfill_tasks, "stream_gap_tracker": stream_gaps, "stream_rollup": stream_rollup, "stream_live_runs": stream_live_runs, "stream_raw_to_canonical": stream_canonical, "join_asof": asof_values}


def queries() -> dict[str, Query]:
    from barloom.plans.indicator_ids import IDS

    return bar_queries() | {f"ind_{i.replace('.', '_')}": _indicator(i) for i in IDS} | signal_queries() | search_queries() | service_queries()
