"""Ingestion jobs: slices commit by themselves, and a job that is run again writes only what is missing."""

import json

import pytest
from barloom import jobs
from barloom.streaming import canonical
from pyspark.sql import functions as F

DAY = 86_400_000


def minutes(spark, symbol, first, last):
    """Minute candles of a market from one minute of 2026 to another."""
    rows = spark.range(first, last).select(F.lit(1).alias("market_id"), F.lit(symbol).alias("symbol"), F.timestamp_millis(F.lit(1767225600000) + F.col("id") * 60_000).alias("ts_open"))
    return rows.select("*", *(F.lit(1.0).alias(c) for c in ("open", "high", "low", "close", "volume_base")))


def out(capsys):
    return [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]


def test_backfill_by_day_slices(spark, tmp_path, capsys):
    minutes(spark, "A", 0, 12 * 1440).union(minutes(spark, "B", 0, 50)).union(minutes(spark, "A", 5, 6).withColumn("low", F.lit(9.0))).write.parquet(f"{tmp_path}/file")
    run = ["backfill", "--parquet", f"{tmp_path}/file", "--market-id", "1", "--symbol", "A", "--table", f"{tmp_path}/table", "--start", "2026-01-01T12:00:00Z"]
    jobs.main([*run, "--end", "2026-01-03T06:00:00Z"], spark)
    jobs.main([*run, "--end", "2026-01-09T00:00:00Z"], spark)
    assert out(capsys) == [
        {"start": "2026-01-01T12:00:00Z", "end": "2026-01-03T06:00:00Z", "written": 1440 + 1080},
        {"start": "2026-01-01T12:00:00Z", "end": "2026-01-08T00:00:00Z", "written": 5 * 1440 - 360},
        {"start": "2026-01-08T00:00:00Z", "end": "2026-01-09T00:00:00Z", "written": 1440},
    ]
    table = canonical.canonical_table(spark, f"{tmp_path}/table")
    assert table.count() == 8 * 1440 - 720 and [r["symbol"] for r in table.select("symbol").distinct().collect()] == ["A"]
    for wrong in (["--market-id", "9"], ["--end", "2026-01-01T12:00:00Z"], ["--start", "2026-01-01"]):
        with pytest.raises(ValueError):
            jobs.main([*run, "--end", "2026-01-09T00:00:00Z", *wrong], spark)


def test_sync_and_catch_up(spark, tmp_path, capsys):
    (tmp_path / "w.csv").write_text("market_id,symbol,is_enabled\n1,a,1\n1,B,1\n1,C,0\n")
    sync = ["sync", "--whitelist", f"{tmp_path}/w.csv", "--instruments", f"{tmp_path}/instruments", "--now"]
    jobs.main([*sync, "2026-01-01T00:00:00Z"], spark)
    jobs.main([*sync, "2026-01-02T00:00:00Z"], spark)
    (tmp_path / "w.csv").write_text("market_id,symbol,is_enabled\n1,a,1\n1,B,0\n1,C,0\n")
    jobs.main([*sync, "2026-01-03T00:00:00Z"], spark)
    assert [r["written"] for r in out(capsys)] == [3, 0, 1]
    minutes(spark, "A", 0, 100).union(minutes(spark, "B", 0, 100)).union(minutes(spark, "D", 0, 100)).write.parquet(f"{tmp_path}/file")
    for a, b in ((0, 20), (30, 60)):
        jobs.main(["backfill", "--parquet", f"{tmp_path}/file", "--market-id", "1", "--symbol", "A", "--table", f"{tmp_path}/table", "--start", f"2026-01-01T00:{a:02d}:00Z", "--end", f"2026-01-01T00:{b % 60:02d}:00Z" if b < 60 else "2026-01-01T01:00:00Z"], spark)
    out(capsys)
    run = ["catch-up", "--parquet", f"{tmp_path}/file", "--instruments", f"{tmp_path}/instruments", "--table", f"{tmp_path}/table", "--now", "2026-01-01T01:30:00Z"]
    jobs.main(run, spark)
    jobs.main(run, spark)
    assert [(r["tasks"], r["written"]) for r in out(capsys)] == [({"catch_up_tail": 1, "gap_fill": 1}, 40), ({}, 0)]
    assert canonical.canonical_table(spark, f"{tmp_path}/table").count() == 90
