"""REST pages from a local server, the feed with offsets, the insert buffer, the canonical table by micro-batches, and as-of joins."""

import json
import os
import random
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from barloom.operators.asof import asof_join
from barloom.sources import candles, feed, rest
from barloom.streaming import canonical
from pyspark.sql import functions as F

MINUTE = 60_000


class Exchange(BaseHTTPRequestHandler):
    """Minutes 0 to 4999 but for 2000 to 2999; `asked` has each request's range in minutes."""

    asked: list = []
    broken: int = 0

    def do_GET(self):  # noqa: N802
        at = urlparse(self.path)
        q = {k: v[0] for k, v in parse_qs(at.query).items()}
        bybit = at.path.startswith("/v5")
        start, end = (int(q[k]) for k in (("start", "end") if bybit else ("startTime", "endTime")))
        Exchange.asked.append((start // MINUTE, end // MINUTE + 1, int(q["limit"])))
        if Exchange.broken:
            Exchange.broken -= 1
            self.send_response(503)
            self.end_headers()
            return
        minutes = [m for m in range(start // MINUTE, min(end // MINUTE + 1, 5000)) if m * MINUTE >= start and not 2000 <= m < 3000][: int(q["limit"])]
        if bybit:
            body = {"retCode": 0 if q["symbol"] != "BAD" else 10001, "retMsg": "no such symbol", "result": {"list": [[str(m * MINUTE), "1", "2", "0.5", "1.5", "7", "9"] for m in reversed(minutes)]}}
        else:
            body = [[m * MINUTE, "1", "2", "0.5", "1.5", "7", 0, "9", 3] for m in minutes]
        self.send_response(200)
        self.end_headers()
        self.wfile.write(json.dumps(body).encode())

    def log_message(self, *_):
        pass


@pytest.fixture
def exchange(spark):
    server = ThreadingHTTPServer(("127.0.0.1", 0), Exchange)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    Exchange.asked.clear()
    Exchange.broken = 0
    spark.dataSource.register(rest.RestKlines)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    yield f"http://127.0.0.1:{server.server_port}"
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    server.shutdown()


@pytest.mark.parametrize("name", ["binance", "bybit"])
def test_only_pages_of_the_filtered_range_are_asked_for(spark, exchange, name):
    klines = spark.read.format("rest_klines").options(url=exchange, symbol="BTC", exchange=name, wait="0.01").load()
    got = klines.where((F.col("open_ms") >= 500 * MINUTE) & (F.col("open_ms") < 3700 * MINUTE) & (F.col("close") > 1)).select("open_ms", "close").collect()
    assert sorted(r["open_ms"] // MINUTE for r in got) == [*range(500, 2000), *range(3000, 3700)]
    assert sorted(Exchange.asked) == [(500, 1500, 1000), (1500, 2500, 1000), (2500, 3500, 1000), (3500, 3700, 1000)]
    Exchange.asked.clear()
    assert klines.where((F.col("open_ms") > 2100 * MINUTE) & (F.col("open_ms") <= 2105 * MINUTE)).count() == 0  # an empty page
    assert klines.where(F.col("open_ms") == 42 * MINUTE).count() == 1 and (42, 43, 1000) in Exchange.asked
    assert spark.read.format("rest_klines").options(url=exchange, symbol="BTC", exchange=name, start_ms=9 * MINUTE, end_ms=9 * MINUTE).load().count() == 0


def test_answers_that_fail(spark, exchange):
    read = lambda **o: spark.read.format("rest_klines").options(url=exchange, start_ms=0, end_ms=MINUTE, wait="0.01", **o).load()
    Exchange.broken = 2
    assert read(symbol="BTC").count() == 1 and len(Exchange.asked) == 3  # tried again
    Exchange.broken = 9
    with pytest.raises(Exception, match="503"):
        read(symbol="BTC").count()
    Exchange.broken = 0
    with pytest.raises(Exception, match="10001"):
        read(symbol="BAD", exchange="bybit").count()
    with pytest.raises(Exception, match="range"):
        spark.read.format("rest_klines").options(url=exchange, symbol="BTC").load().count()


def test_page_ranges():
    assert [(p.start // MINUTE, p.end // MINUTE) for p in rest.pages(1, 2500 * MINUTE + 1)] == [(1, 1001), (1001, 2001), (2001, 2501)] and rest.pages(5, 5) == []


def append(folder, segment, lines, end="\n"):
    with open(os.path.join(folder, segment), "a", encoding="utf-8") as f:
        f.write("\n".join(lines) + end)


def drained(spark, source, to, checkpoint, schema):
    query = spark.readStream.format("candle_feed").load(str(source)).writeStream.format("insert_buffer").option("path", str(to)).option("max_rows", 3).option("checkpointLocation", str(checkpoint)).start()
    query.processAllAvailable()
    query.stop()
    return feed.read_inserted(spark, str(to), schema)


def test_a_restart_loses_and_repeats_nothing(spark, tmp_path):
    source, to = tmp_path / "log", tmp_path / "rows"
    source.mkdir()
    for kind in (feed.CandleFeed, feed.InsertBuffer):
        spark.dataSource.register(kind)
    append(source, "000.jsonl", [f"a{k}" for k in range(10)])
    append(source, "001.jsonl", ["b0", "b1"])
    append(source, "001.jsonl", ["half of"], "")
    got = drained(spark, source, to, tmp_path / "checkpoint", feed.MESSAGES)
    assert sorted(r["value"] for r in got.collect()) == sorted([*(f"a{k}" for k in range(10)), "b0", "b1"])
    append(source, "001.jsonl", [" a line", "ünd"])
    append(source, "002.jsonl", ["c0"])
    got = drained(spark, source, to, tmp_path / "checkpoint", feed.MESSAGES).collect()
    assert sorted(r["value"] for r in got) == sorted([*(f"a{k}" for k in range(10)), "b0", "b1", "half of a line", "ünd", "c0"])
    assert len({(r["segment"], r["position"]) for r in got}) == len(got)
    sizes = [spark.read.parquet(f"file://{to}/{n}").count() for n in os.listdir(to) if n.startswith("rows-")]
    assert max(sizes) <= 3 and not [n for n in os.listdir(to) if n.startswith(".rows")]


def test_an_aborted_batch_is_written_once(spark, tmp_path):
    from pyspark.sql.types import StructType

    schema = StructType().add("k", "long")
    writer = feed.BufferWriter({"path": str(tmp_path), "max_rows": "2"}, schema)
    rows = [(k,) for k in range(5)]
    first = writer.write(iter(rows))
    writer.abort([first, None], 7)
    assert os.listdir(tmp_path) == []
    assert feed.read_inserted(spark, str(tmp_path), schema).count() == 0
    again = writer.write(iter(rows))
    writer.commit([again, None], 7)
    writer.commit([writer.write(iter(rows))], 7)  # the manifest is there, Spark's own log isn't yet
    assert len(again.names) == 3 and sorted(r["k"] for r in feed.read_inserted(spark, str(tmp_path), schema).collect()) == [0, 1, 2, 3, 4]
    slow = feed.BufferWriter({"path": str(tmp_path), "flush_ms": "0"}, schema)
    assert len(slow.write(iter(rows)).names) == 5


def test_dead_letters_of_both_exchanges(spark):
    kline = {"topic": "kline.1.BTC", "ts": 1, "data": [{"start": 0, "confirm": False}]}
    lines = ["{", "", json.dumps({"topic": "trades.BTC", "data": []}), json.dumps({"topic": "kline.1.BTC"}), json.dumps(kline | {"data": [{"start": 1}]}), json.dumps(kline), json.dumps(kline | {"topic": "kline.5.BTC"})]
    got = candles.dead_letters(spark.createDataFrame([(x,) for x in lines], "value string"), "bybit").collect()
    assert [r["value"] for r in got] == lines[:5]


RAW = [(m, "A", f"2026-01-01 00:{m:02d}:00", float(v), f"2026-01-02 00:00:{v:02d}") for m, v in [(0, 1), (1, 2), (1, 3), (2, 4), (0, 5), (3, 6), (2, 1)]]


def raw_rows(spark, rows):
    df = spark.createDataFrame(rows, "n int, symbol string, ts_open string, close double, ingested_at string")
    return candles.to_canonical(df.select(F.lit(3).alias("market_id"), "symbol", F.col("ts_open").cast("timestamp").alias("ts_open"), "close", F.col("ingested_at").cast("timestamp").alias("ingested_at")), "rest")


def test_canonical_by_micro_batches_is_the_batch_form(spark, tmp_path):
    def state():
        return sorted((r["ts_open"], r["close"], r["ts_close"]) for r in canonical.canonical_table(spark, str(tmp_path)).collect())

    want = sorted((r["ts_open"], r["close"], r["ts_close"]) for r in canonical.latest_per_key(candles.raw_to_canonical(raw_rows(spark, RAW), "bybit"), candles.CANDLE_KEY, canonical.VERSION).collect())
    for number, rows in enumerate((RAW[:3], RAW[3:5], RAW[5:])):
        canonical.merge_batch(raw_rows(spark, rows), number, "bybit", str(tmp_path))
    assert state() == want
    canonical.merge_batch(raw_rows(spark, RAW[3:5]), 1, "bybit", str(tmp_path))  # tried again
    canonical.merge_batch(raw_rows(spark, RAW[:3]), 9, "bybit", str(tmp_path))  # the same rows in another one
    assert state() == want
    canonical.compact(spark, str(tmp_path))
    assert state() == want and len(os.listdir(tmp_path)) == 1
    canonical.merge_batch(raw_rows(spark, [(0, "A", "2026-01-01 00:00:00", 99.0, "2026-01-03 00:00:00")]), 10, "bybit", str(tmp_path))
    assert [x[1] for x in state()] == [99.0, 3.0, 4.0, 6.0]


def test_asof_join_against_a_loop(spark):
    deal = random.Random(3)
    left = [(i, deal.choice(["a", "b", None]), deal.choice([None, *range(0, 90)])) for i in range(200)]
    right = [(deal.choice(["a", "b", None, "c"]), deal.choice([None, *range(-20, 90, 7)]), deal.choice([None, 1.0, 2.0, 3.0])) for _ in range(40)]
    l_, r_ = spark.createDataFrame(left, "id long, k string, t long"), spark.createDataFrame(right, "k string, t long, v double")
    got = {r["id"]: r["v"] for r in asof_join(l_.repartition(3), r_, ["k"], "t", ["v"], width=8).collect()}
    order = lambda v: (v is not None, v or 0)
    for i, k, t in left:
        met = [(u, order(v), v) for q, u, v in right if q is not None and q == k and u is not None and t is not None and u <= t]
        assert got[i] == (max(met)[2] if met else None), (i, k, t)
    assert len(got) == 200 and asof_join(l_.limit(0), r_, ["k"], "t", ["v"]).count() == 0
    assert {r["v"] for r in asof_join(l_, r_.limit(0), ["k"], "t", ["v"]).collect()} == {None}
    with pytest.raises(ValueError, match="already"):
        asof_join(l_.withColumn("V", F.lit(1)), r_, ["k"], "t", ["v"])
