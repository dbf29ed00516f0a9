"""Ingestion jobs for spark-submit: backfill from files, catch-up of tails and gaps, and instruments from a whitelist.

python -m barloom.jobs backfill|catch-up|sync ... prints a JSON line a step. Each day slice is committed by itself, and rows
that are kept already are not written again, so a job that was stopped is run again as it was.
"""

from __future__ import annotations

import argparse
import json
import uuid
from collections.abc import Iterator, Sequence
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.scalars import epoch_ms
from barloom.operators import bars, reference_data
from barloom.sources import candles
from barloom.streaming import canonical

INSTRUMENTS = "market_id int, symbol string, status string, is_tradable int, updated_at timestamp"


def _iso(ms: int) -> str:
    return datetime.fromtimestamp(ms / 1000, UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def _ms(text: str) -> int:
    at = datetime.fromisoformat(text.replace("Z", "+00:00"))
    if at.tzinfo is None:
        raise ValueError(f"{text} has no zone; times are UTC, as 2026-02-01T00:00:00Z")
    return int(at.timestamp() * 1000)


def _there(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(p) and len(fs.listStatus(p)) > 0


def _kept(spark: SparkSession, table: str) -> DataFrame:
    return canonical.canonical_table(spark, table) if _there(spark, table) else spark.createDataFrame([], candles.CANONICAL)


def _commit(rows: DataFrame, table: str) -> int:
    """Write new rows as a folder of the canonical table; how many there were."""
    spark, path = rows.sparkSession, f"{table}/job-{uuid.uuid4().hex}"
    canonical.write_rows(rows, path)
    return spark.read.schema(candles.CANONICAL).option("recursiveFileLookup", "true").parquet(path).count()


def backfill(spark: SparkSession, files: Sequence[str], market_id: int, symbol: str, start_ms: int, end_ms: int, table: str, most_days: int = 7) -> Iterator[dict]:
    """An instrument's candles in [start, end) from Parquet files into the canonical table, by slices of whole UTC days."""
    if market_id not in {m[0] for m in reference_data.MARKETS} or not symbol.strip() or start_ms >= end_ms:
        raise ValueError("market_id is one of the fixed markets, symbol isn't empty, and start is before end")
    for a, b in bars.day_slices(start_ms, end_ms, most_days):
        found = [candles.scan_candles(spark, f, market_id, symbol, _iso(a), _iso(b)) for f in files]
        rows = found[0]
        for more in found[1:]:
            rows = rows.unionByName(more)
        there = candles.read_canonical(_kept(spark, table), market_id, symbol, _iso(a), _iso(b))
        new = bars.new_rows(bars.valid_candles(rows), there, candles.CANDLE_KEY, canonical.VERSION)
        yield {"start": _iso(a), "end": _iso(b), "written": _commit(new, table)}


def catch_up(spark: SparkSession, instruments: DataFrame, source: DataFrame, now_ms: int, table: str) -> dict:
    """Tails and gaps of enabled instruments with history, from a source of canonical rows."""
    minute = F.floor(epoch_ms("ts_open") / 60_000).cast("long").alias("minute")
    key = reference_data.INSTRUMENT_KEY
    kept = _kept(spark, table).select(*key, minute)
    on = reference_data.enabled_instruments(instruments)
    rows = reference_data.catch_up(on, kept, bars.valid_candles(source).select("*", minute), now_ms // 60_000)
    tasks = reference_data.catch_up_tasks(on, kept, now_ms // 60_000).groupBy("reason").count().collect()
    return {"now": _iso(now_ms), "tasks": {r["reason"]: r["count"] for r in sorted(tasks)}, "written": _commit(rows.drop("minute"), table)}


def sync(spark: SparkSession, whitelist: str, path: str, now_ms: int) -> dict:
    """Append a version of each instrument whose status or tradable flag a whitelist changes."""
    target = reference_data.whitelist_targets(candles.read_whitelist(spark, whitelist))
    current = spark.read.schema(INSTRUMENTS).parquet(path) if _there(spark, path) else spark.createDataFrame([], INSTRUMENTS)
    changed = reference_data.changed_rows(target, current, ["status", "is_tradable"]).withColumn("updated_at", F.timestamp_millis(F.lit(now_ms)))
    rows = changed.select(*(F.col(n).cast(t).alias(n) for n, t in (c.split() for c in INSTRUMENTS.split(", "))))
    new = rows.persist()
    try:
        written = new.count()
        if written:
            new.write.mode("append").parquet(path)
    finally:
        new.unpersist()
    return {"listed": target.count(), "written": written}


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="barloom.jobs")
    jobs = parser.add_subparsers(dest="job", required=True)
    one = jobs.add_parser("backfill")
    one.add_argument("--parquet", action="append", required=True)
    one.add_argument("--market-id", type=int, required=True)
    for name in ("symbol", "start", "end", "table"):
        one.add_argument(f"--{name}", required=True)
    two = jobs.add_parser("catch-up")
    two.add_argument("--parquet", required=True)
    for name in ("instruments", "table", "now"):
        two.add_argument(f"--{name}", required=True)
    three = jobs.add_parser("sync")
    for name in ("whitelist", "instruments", "now"):
        three.add_argument(f"--{name}", required=True)
    a = parser.parse_args(argv)
    spark = spark or SparkSession.builder.appName(f"barloom {a.job}").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.job == "backfill":
        for report in backfill(spark, a.parquet, a.market_id, a.symbol.strip(), _ms(a.start), _ms(a.end), a.table):
            print(json.dumps(report), flush=True)
    elif a.job == "catch-up":
        source = candles.to_canonical(spark.read.parquet(a.parquet), "file")
        print(json.dumps(catch_up(spark, spark.read.schema(INSTRUMENTS).parquet(a.instruments), source, _ms(a.now), a.table)), flush=True)
    else:
        print(json.dumps(sync(spark, a.whitelist, a.instruments, _ms(a.now))), flush=True)


if __name__ == "__main__":
    main()
