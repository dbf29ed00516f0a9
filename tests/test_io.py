import json

import pytest
from pyspark.sql import functions as F

from barloom.operators import reference_data as R
from barloom.sources import candles as C
from barloom.streaming import live


def test_parquet_scan_filters_and_fills(spark, tmp_path):
    spark.sql("select 1 market_id, 'BTC' symbol, timestamp_ntz'2026-02-04 11:00:00' ts_open, 1D open, 2D high, 1D low, 2D close, 3D vol union all select 1, 'BTC', timestamp_ntz'2026-02-04 12:00:00', 1D, 2D, 1D, 2D, 3D").write.parquet(f"{tmp_path}/f")
    got = C.scan_candles(spark, f"{tmp_path}/f", 1, "BTC", "2026-02-04 11:00:00", "2026-02-04 12:00:00", {"volume_base": "vol"})
    r = got.select("*", F.unix_millis("ts_close").alias("c"), F.unix_millis("ts_open").alias("o")).collect()
    assert len(r) == 1 and r[0]["c"] - r[0]["o"] == 60_000 and r[0]["source"] == "file" and r[0]["volume_base"] == 3 and r[0]["volume_quote"] is None
    assert "PushedFilters: [IsNotNull" in got._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_ws_messages(spark):
    k = {"t": 60_000, "T": 119_999, "s": "BTCUSDT", "i": "1m", "o": "1", "c": "2", "h": "3", "l": "0.5", "v": "9", "n": 4, "x": True, "q": "18", "V": "1", "Q": "2"}
    msgs = [json.dumps({"e": "kline", "s": "BTCUSDT", "k": k}), json.dumps({"stream": "x", "data": {"e": "kline", "k": k | {"x": False}}}), json.dumps({"k": k | {"i": "5m"}}), "{broken"]
    m = spark.createDataFrame([(x,) for x in msgs], "value string")
    got = C.closed_binance(m, 1).collect()
    assert [(r["symbol"], r["close"], r["trades_count"], r["source"]) for r in got] == [("BTCUSDT", 2.0, 4, "ws")]
    assert C.dead_letters(m).count() == 1
    b = {"topic": "kline.1.ETHUSDT", "data": [{"start": 0, "open": "1", "close": "2", "high": "2", "low": "1", "volume": "3", "turnover": "6", "confirm": c} for c in (True, False)]}
    got = C.closed_bybit(spark.createDataFrame([(json.dumps(b),)], "value string"), 3).collect()
    assert [(r["symbol"], r["volume_quote"]) for r in got] == [("ETHUSDT", 6.0)]


def test_raw_tables(spark, tmp_path):
    rows = C.to_canonical(spark.createDataFrame([(1, "A", 1.0), (3, "B", 2.0)], "market_id int, symbol string, close double").withColumn("ts_open", F.timestamp_millis(F.lit(0))), "rest")
    C.write_raw(rows, str(tmp_path))
    a, b = (spark.read.parquet(f"{tmp_path}/{n}") for n in ("raw_binance_klines_1m", "raw_bybit_klines_1m"))
    assert [(r["symbol"], r["trades_count"]) for r in a.collect()] == [("A", 0)]
    got = C.raw_to_canonical(b, "bybit").collect()
    assert [(r["symbol"], r["trades_count"], r["source"]) for r in got] == [("B", None, "rest")]


def test_kline_pages(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps([[i * 60_000, "1", "2", "0.5", "1.5", "7", 0, "9", 3] for i in range(1500)]))
    spark.dataSource.register(C.KlineSource)
    df = spark.read.format("klines").options(path=str(tmp_path), start_ms=60_000, end_ms=1400 * 60_000).load()
    assert df.count() == 1399 and df.agg(F.min("open_ms"), F.sum("trades")).first() == (60_000, 1399 * 3)


def test_whitelist_and_upserts(spark, tmp_path):
    (tmp_path / "w.csv").write_text("market_id,symbol,is_enabled\n1,btc,1\n1,ETH,0\n")
    w = C.read_whitelist(spark, str(tmp_path / "w.csv"))
    assert C.read_whitelist(spark, str(tmp_path / "w.csv"), True).count() == 1
    now = spark.sql("select 1 market_id, 'BTC' symbol, 'ENABLED' status, 1 is_tradable, 1 updated_at union all select 1, 'ETH', 'ENABLED', 1, 1")
    got = R.changed_rows(R.whitelist_targets(w), now, ["status", "is_tradable"]).collect()
    assert [(r["symbol"], r["status"]) for r in got] == [("ETH", "DISABLED")]
    m = spark.sql("select 1 market_id, 'btc' symbol, 'BTC' base_asset, 'USDT' quote_asset, 0.1D price_step, 0.1D qty_step, 5D min_notional")
    have = now.select("*", *(F.lit(None).cast("double" if "_step" in c or c == "min_notional" else "string").alias(c) for c in R.METADATA))
    fresh, without = R.enrichment(have, m)
    assert [r["symbol"] for r in fresh.collect()] == ["BTC"] and [r["symbol"] for r in without.collect()] == ["ETH"]


def test_latest_version_is_chosen_before_the_filter(spark):
    i = spark.sql("select 1 market_id, 'BTC' symbol, 'ENABLED' status, 1 is_tradable, 1 updated_at union all select 1, 'BTC', 'DISABLED', 1, 2 union all select 1, 'BTX', 'ENABLED', 1, 1")
    assert [r["symbol"] for r in R.search_instruments(i, 1, "bt").collect()] == ["BTX"]
    assert R.seed_markets(spark.sql("select 2 market_id")).count() == 3


def test_plans(spark):
    i = spark.sql("select 1 market_id, 'A' symbol union all select 1, 'B'")
    b = spark.sql("select 1 market_id, 'A' symbol, 50L min_minute, 90L max_minute")
    e = spark.sql("select 1 market_id, 10L earliest_minute")
    t = R.backfill_tasks(i, b, e, 100, 20)
    got = sorted((r["symbol"], r["reason"], r["start_minute"], r["end_minute"]) for r in t.collect())
    assert got == [("A", "historical_backfill", 10, 50), ("A", "scheduler_tail", 80, 100), ("B", "bootstrap", 10, 100)]
    late = spark.sql("select 1 market_id, 'B' symbol, 70L min_minute")
    assert [r["end_minute"] for r in R.clamp_tasks(t.where("symbol = 'B'"), late).collect()] == [70]
    assert sorted((r["symbol"], r["start_minute"]) for r in R.tail_tasks(i, b, 100, 5).collect()) == [("A", 91), ("B", 95)]
    assert R.pending(t.unionByName(t)).count() == 3
    assert R.warmup_bars({"a": [1, {"w": 30}], "b": "x"}) == 30 and R.warmup_bars({}) == 1


def stream(spark, tmp_path, batches, schema):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 100).json(f"{tmp_path}/in")


def ran(spark, tmp_path, df):
    live.write_batches(df, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    return spark.read.parquet(f"{tmp_path}/out")


def test_gap_tracker_stream(spark, tmp_path):
    s = stream(spark, tmp_path, [[("a", 720, 1), ("a", 723, 2), ("a", 722, 3), ("a", 723, 4), ("a", 724, 5)]], "symbol string, minute long, seq long")
    got = [(r["kind"], r["start_minute"], r["end_minute"]) for r in ran(spark, tmp_path, live.track_gaps(s)).orderBy("minute").collect()]
    assert sorted(got, key=str) == sorted([("accepted", None, None), ("gap", 721, 723), ("out_of_order", None, None), ("duplicate", None, None), ("accepted", None, None)], key=str)


def test_strict_rollup_stream(spark, tmp_path):
    rows = [("a", m, float(m), float(m) + 1, float(m) - 1, float(m), 1.0, m) for m in (3, 4, 5, 6, 8, 9, 10, 10, 11)]
    s = stream(spark, tmp_path, [rows], "symbol string, minute long, open double, high double, low double, close double, volume double, seq long")
    got = sorted((r["idx"], r["open"], r["close"], r["volume"]) for r in ran(spark, tmp_path, live.rollup_strict_stream(s, 3)).collect())
    assert got == [(1, 3.0, 5.0, 3.0), (3, 9.0, 11.0, 3.0)]


def test_windowed_bars_stream(spark, tmp_path):
    rows = [("a", "2026-01-01T00:00:01Z", 1.0, 1.0, 1), ("a", "2026-01-01T00:00:09Z", 3.0, 1.0, 2), ("a", "2026-01-01T00:05:00Z", 9.0, 1.0, 3)]
    s = stream(spark, tmp_path, [rows], "symbol string, ts string, price double, volume double, seq long").withColumn("ts", F.col("ts").cast("timestamp"))
    got = ran(spark, tmp_path, live.windowed_bars(s, "1 minute", "10 seconds").select("symbol", "open", "close")).collect()
    assert ("a", 1.0, 3.0) in [tuple(r)[:3] for r in got]


def test_a_table_streams_in_order_in_bounded_micro_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(live, "TRIGGER_ROWS", 40)
    monkeypatch.setattr(live, "STEP_ROWS", 16)
    minutes = [(k * 7) % 150 if k % 5 == 0 else k for k in range(150)]
    rows = [("hot" if k % 3 else "cold", m, k) for k, m in enumerate(minutes)]
    df = spark.createDataFrame(rows[::-1], "symbol string, minute long, seq long").repartition(5)
    got = ran(spark, tmp_path, live.track_gaps(live.in_order(spark, df, f"{tmp_path}/files")))
    want, last = [], {}
    for symbol, m, _ in rows:
        last[symbol], (kind, a, b) = live.observe(last.get(symbol), m)
        want.append((symbol, kind, m, a, b))
    assert sorted(map(str, (tuple(r)[:5] for r in got.collect()))) == sorted(map(str, want))
    sizes = [r["count"] for r in got.groupBy("batch").count().collect()]
    assert len(sizes) >= 4 and max(sizes) <= 40


def test_the_registered_streams_bound_their_micro_batches(spark, monkeypatch):
    from barloom.plans import queries

    monkeypatch.setattr(live, "TRIGGER_ROWS", 300)
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").where("event_type is not null and ts is not null").count()
    got = queries.stream_gaps(spark, "/root/testdata/sf0.001")
    sizes = [r["count"] for r in got.groupBy(F.input_file_name().substr(F.lit(1), F.instr(F.input_file_name(), "/part-"))).count().collect()]
    assert events > 600 and sum(sizes) == events and max(sizes) <= 300


def test_instrument_metadata(spark, tmp_path):
    info = {"symbols": [{"symbol": "btcusdt", "baseAsset": "BTC", "quoteAsset": "USDT", "filters": [{"filterType": "PRICE_FILTER", "tickSize": "0.01"}, {"filterType": "LOT_SIZE", "stepSize": "0.001"}, {"filterType": "NOTIONAL", "minNotional": "5"}]}, {"symbol": "X", "filters": [{"filterType": "LOT_SIZE", "stepSize": "0"}]}, {"baseAsset": "Y"}]}
    (tmp_path / "a.json").write_text(json.dumps(info, indent=1))
    got = {r["symbol"]: tuple(r)[2:] for r in C.read_instrument_metadata(spark, f"{tmp_path}/a.json", "binance", 1).collect()}
    assert got == {"BTCUSDT": ("BTC", "USDT", 0.01, 0.001, 5.0), "X": (None, None, None, None, None)}
    bybit = {"retCode": 0, "result": {"list": [{"symbol": "ETHUSDT", "baseCoin": "ETH", "quoteCoin": "USDT", "priceFilter": {"tickSize": "0.1"}, "lotSizeFilter": {"minOrderAmt": "1", "minOrderQty": "9"}}]}}
    (tmp_path / "b.json").write_text(json.dumps(bybit))
    assert [tuple(r) for r in C.read_instrument_metadata(spark, f"{tmp_path}/b.json", "bybit", 3).collect()] == [(3, "ETHUSDT", "ETH", "USDT", 0.1, None, 1.0)]
    (tmp_path / "c.json").write_text(json.dumps({"retCode": 10001, "result": {"list": []}}))
    with pytest.raises(Exception, match="10001"):
        C.read_instrument_metadata(spark, f"{tmp_path}/c.json", "bybit", 3).collect()


def test_catch_up_is_the_tail_then_the_gaps(spark):
    kept = [("A", m) for m in (10, 11, 14, 15)] + [("B", 18), ("B", 25)]
    minutes = spark.createDataFrame([(1, s, m) for s, m in kept], "market_id int, symbol string, minute long")
    instruments = spark.createDataFrame([(1, s) for s in "ABC"], "market_id int, symbol string")
    got = {tuple(r) for r in R.catch_up_tasks(instruments, minutes, 20).collect()}
    assert got == {(1, "A", "catch_up_tail", 16, 20), (1, "A", "gap_fill", 12, 14), (1, "B", "catch_up_tail", 19, 20)}
    source = spark.range(0, 40).selectExpr("1 AS market_id", "explode(array('A', 'B', 'C')) AS symbol", "id AS minute", "1.0 AS close")
    assert {(r["symbol"], r["minute"]) for r in R.catch_up(instruments, minutes, source, 20).collect()} == {("A", m) for m in (12, 13, 16, 17, 18, 19)} | {("B", 19)}


def test_ranges_and_minutes(spark):
    from barloom.functions import scalars as S

    rows = spark.createDataFrame([(0, 10, 5, 20), (0, 5, 5, 9), (3, 3, 0, 9), (0, 9, 2, 4)], "a long, b long, c long, d long")
    cols = [F.col(x) for x in "abcd"]
    got = rows.select(S.overlaps(*cols).alias("o"), S.intersection(*cols).alias("i"), S.on_minute(F.col("a") * 60_000 + F.col("c") - 5).alias("m")).collect()
    assert [r["o"] for r in got] == [True, False, False, True] and [r["i"] and tuple(r["i"]) for r in got] == [(5, 10), None, None, (2, 4)]
    assert [r["m"] for r in got] == [True, True, False, False]


def test_default_grids(tmp_path):
    from barloom.operators import defaults

    spec = {"defaults": {"ma.sma": {"inputs": {"source": {"mode": "explicit", "values": ["close", "open"]}}, "params": {"window": {"mode": "range", "start": 5, "stop_incl": 9, "step": 2}}}, "zscore": {"params": {"x": {"mode": "range", "start": 0.1, "stop_incl": 0.3, "step": 0.1}}}}}
    (tmp_path / "d.json").write_text(json.dumps(spec))
    got = defaults.read_defaults(str(tmp_path / "d.json"))
    assert got == {"ma.sma": {"source": ["close", "open"], "window": [5, 7, 9]}, "zscore": {"x": [0.1, 0.2, 0.3]}}
    part = defaults.requested("ma.sma", got, {"window": [3]})
    assert part.size == 2 and part.points()[0] == {"source": "close", "window": 3}
    pytest.importorskip("yaml")
    (tmp_path / "d.yaml").write_text("defaults:\n  ma.sma:\n    params:\n      window: {mode: range, start: 5, stop_incl: 6, step: 1}\n")
    assert defaults.read_defaults(str(tmp_path / "d.yaml")) == {"ma.sma": {"window": [5, 6]}}
    with pytest.raises(ValueError):
        defaults.axis_values({"mode": "other"})


def test_ids_and_names_of_requests(spark, tmp_path):
    """Ids with their family, and parameters by requests' names, resolve and compute at their first point; signal defaults are read."""
    from barloom.operators import defaults, search, signals
    from barloom.operators.indicators import registry

    axis = lambda *v: {"mode": "explicit", "values": [*v]}
    entries = {
        "momentum.macd": {"fast_window": axis(2, 4), "slow_window": axis(4, 8), "signal_window": axis(3)},
        "momentum.ppo": {"fast_window": axis(2), "slow_window": axis(4), "signal_window": axis(3)},
        "momentum.stoch_rsi": {"rsi_window": axis(3), "k_window": axis(2), "smoothing": axis(2), "d_window": axis(2)},
        "momentum.trix": {"window": axis(2), "signal_window": axis(3)},
        "structure.candle_stats": {},
        "structure.candle_stats_atr_norm": {"atr_window": axis(2)},
        "structure.distance_to_ma_norm": {"window": axis(3)},
        "structure.percent_rank": {"window": axis(3)},
        "structure.pivots": {"left": axis(2), "right": axis(2)},
        "structure.zscore": {"window": axis(3)},
    }
    spec = {"defaults": {k: {"params": v} for k, v in entries.items()}}
    spec["defaults"]["structure.zscore"]["signals"] = {"v1": {"params": {"Long_threshold": -1, "short_threshold": {"mode": "range", "start": 1, "stop_incl": 2, "step": 1}}}}
    (tmp_path / "d.json").write_text(json.dumps(spec))
    path = str(tmp_path / "d.json")
    axes, signal = defaults.read_defaults(path), defaults.read_signal_defaults(path)
    assert signal == {"structure.zscore": {"long_threshold": [-1], "short_threshold": [1, 2]}}
    parts = defaults.requested_each("structure.zscore", axes, signal)
    assert [dict(p.signal) for p in parts] == [{"long_threshold": -1, "short_threshold": 1}, {"long_threshold": -1, "short_threshold": 2}]
    rows = [("a", i, 10.0 + i, 11.0 + i % 5 + i, 9.0 + i, 10.0 + i + (-1) ** i * 0.5, 5.0) for i in range(12)]
    bars = spark.createDataFrame(rows, "symbol string, idx long, open double, high double, low double, close double, volume double")
    for name in entries:
        point = defaults.requested(name, axes).points()[0]
        assert registry()[name](bars, **point).count() == 12 and signals.rule_of(name)
    own = {r["idx"]: r["value"] for r in registry()["momentum.macd"](bars, fast=2, slow=4).collect()}
    assert own == {r["idx"]: r["value"] for r in registry()["momentum.macd"](bars, fast_window=2, slow_window=4).collect()}
    assert search.point_signals(bars, [*parts, defaults.requested("momentum.macd", axes)]).first()["signals"] is not None
    assert signals.expand_dependencies(["structure.pivots"])[1:] == ["pivot_low", "pivot_high"]
    for wrong, params in (("structure.other", {}), ("momentum.macd", {"fast": 2, "fast_window": 2}), ("zscore", {"fast_window": 2})):
        with pytest.raises((KeyError, ValueError)):
            registry()[wrong](bars, **params)
