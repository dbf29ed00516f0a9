"""Candle sources and sinks: files, exchange payloads, whitelists, raw and canonical tables."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from barloom.operators.bars import latest_per_key

CANONICAL = (
    "market_id int, symbol string, instrument_key string, ts_open timestamp, ts_close timestamp, open double, high double, low double, close double, volume_base double, "
    "volume_quote double, trades_count long, taker_buy_volume_base double, taker_buy_volume_quote double, source string, ingested_at timestamp, ingest_id string"
)
CANDLE_KEY = ["market_id", "symbol", "ts_open"]
_NAMES = [c.split()[0] for c in CANONICAL.split(", ")]
_TYPES = dict(c.split() for c in CANONICAL.split(", "))


def _utc(ts: Column) -> Column:
    """A timestamp; one without a zone is UTC in whatever zone the session is."""
    return F.to_utc_timestamp(ts.cast("timestamp"), F.current_timezone())


def scan_candles(spark: SparkSession, path: str, market_id: int, symbol: str, start: str, end: str, renames: Mapping[str, str] | None = None) -> DataFrame:
    """One-minute candles of an instrument in [start, end) from Parquet; only needed columns and row groups are read.

    `renames` maps a canonical name to the file's. A missing closing time is a minute after the opening; missing
    columns are NULL; the source is `file`.
    """
    df = spark.read.parquet(path)
    for name, there in (renames or {}).items():
        df = df.withColumnRenamed(there, name)
    kind = dict(df.dtypes)["ts_open"]
    bound = lambda x: F.lit(x).cast(kind)
    df = df.where((F.col("market_id") == market_id) & (F.col("symbol") == symbol) & (F.col("ts_open") >= bound(start)) & (F.col("ts_open") < bound(end)))
    return to_canonical(df, "file")


def to_canonical(df: DataFrame, source: str | None) -> DataFrame:
    """Canonical columns and types; `source` None keeps the rows' own."""
    there = dict(df.dtypes)
    col = lambda c: F.col(c) if c in there else F.lit(None)
    ts = lambda c: _utc(F.col(c)) if there.get(c) == "timestamp_ntz" else col(c).cast("timestamp")
    special = {
        "ts_open": ts("ts_open"), "ts_close": F.coalesce(ts("ts_close"), ts("ts_open") + F.expr("INTERVAL 1 MINUTE")), "source": col("source") if source is None else F.lit(source),
        "ingested_at": F.coalesce(ts("ingested_at"), F.current_timestamp()),
    }
    return df.select(*(special.get(c, col(c)).cast(_TYPES[c]).alias(c) for c in _NAMES))


def read_canonical(candles: DataFrame, market_id: int, symbol: str, start: str, end: str) -> DataFrame:
    """An instrument's candles in [start, end), the version ingested last of each minute."""
    c = candles.where((F.col("market_id") == market_id) & (F.col("symbol") == symbol) & (F.col("ts_open") >= F.lit(start).cast("timestamp")) & (F.col("ts_open") < F.lit(end).cast("timestamp")))
    return latest_per_key(c, CANDLE_KEY, ["ingested_at", "ingest_id"])


def read_whitelist(spark: SparkSession, path: str, enabled_only: bool = False) -> DataFrame:
    df = spark.read.csv(path, header=True, schema="market_id int, symbol string, is_enabled int")
    return df.where("is_enabled = 1") if enabled_only else df


BYBIT_WS = "topic string, ts long, data array<struct<start: long, end: long, interval: string, open: string, close: string, high: string, low: string, volume: string, turnover: string, confirm: boolean, timestamp: long>>"


def _payload() -> Column:
    """A message's payload; a combined stream's message has it in `data`."""
    return F.coalesce(F.get_json_object("value", "$.data"), F.col("value"))


def closed_binance(messages: DataFrame, market_id: int) -> DataFrame:
    """Closed one-minute bars of Binance kline messages (column `value`); others, and broken ones, go.

    Fields are taken by path, because their names differ by case alone.
    """
    field = lambda c: F.get_json_object("p", f"$.k.{c}")
    num = lambda c: field(c).try_cast("double")
    k = messages.select(_payload().alias("p")).where((field("i") == "1m") & (field("x") == "true"))
    start = field("t").try_cast("long")
    rows = k.select(
        F.lit(market_id).alias("market_id"), F.upper(field("s")).alias("symbol"), F.timestamp_millis(start).alias("ts_open"), F.timestamp_millis(start + 60_000).alias("ts_close"), num("o").alias("open"), num("h").alias("high"), num("l").alias("low"), num("c").alias("close"),
        num("v").alias("volume_base"), num("q").alias("volume_quote"), field("n").try_cast("long").alias("trades_count"), num("V").alias("taker_buy_volume_base"), num("Q").alias("taker_buy_volume_quote"),
    )
    return to_canonical(rows, "ws").where("ts_open is not null and open is not null and close is not null")


def closed_bybit(messages: DataFrame, market_id: int) -> DataFrame:
    """Confirmed one-minute bars of Bybit kline messages; the symbol is the topic's last part."""
    m = messages.select(F.from_json("value", BYBIT_WS).alias("m")).where("m.topic like 'kline.1.%'").select("m.topic", F.explode("m.data").alias("d")).where("d.confirm")
    num = lambda c: F.expr(f"try_cast(d.{c} as double)")
    rows = m.select(
        F.lit(market_id).alias("market_id"), F.upper(F.substring_index("topic", ".", -1)).alias("symbol"), F.timestamp_millis(F.col("d.start")).alias("ts_open"), F.timestamp_millis(F.col("d.start") + 60_000).alias("ts_close"),
        num("open").alias("open"), num("high").alias("high"), num("low").alias("low"), num("close").alias("close"), num("volume").alias("volume_base"), num("turnover").alias("volume_quote"),
    )
    return to_canonical(rows, "ws").where("open is not null and close is not null")


def dead_letters(messages: DataFrame, exchange: str = "binance") -> DataFrame:
    """Messages that are no kline of the exchange; what is a kline and isn't closed, or has another length, is none of them."""
    if exchange == "bybit":
        m = F.from_json("value", BYBIT_WS)
        klines = m["topic"].like("kline.%") & F.forall(m["data"], lambda d: d["start"].isNotNull() & d["confirm"].isNotNull())
        return messages.where(~F.coalesce(klines, F.lit(False)))
    return messages.where(F.get_json_object(_payload(), "$.k.t").try_cast("long").isNull())


def split_raw(candles: DataFrame) -> dict[str, DataFrame]:
    """Rows of each raw table: markets 1 and 2, and 3 and 4. Counters that those tables need are 0 where missing."""
    filled = candles.withColumn("day", F.date_format("ts_open", "yyyyMMdd"))
    for c in ("volume_quote", "trades_count", "taker_buy_volume_base", "taker_buy_volume_quote"):
        filled = filled.withColumn(c, F.coalesce(c, F.lit(0).cast(_TYPES[c])))
    return {"raw_binance_klines_1m": filled.where("market_id in (1, 2)"), "raw_bybit_klines_1m": filled.where("market_id in (3, 4)")}


def write_raw(candles: DataFrame, path: str) -> None:
    for name, rows in split_raw(candles).items():
        rows.write.mode("append").partitionBy("day").parquet(f"{path}/{name}")


def raw_to_canonical(raw: DataFrame, exchange: str) -> DataFrame:
    """Canonical rows of a raw table; Bybit's have no counters and close a minute after they open."""
    df = raw
    if exchange == "bybit":
        df = df.drop("ts_close")
        for c in ("trades_count", "taker_buy_volume_base", "taker_buy_volume_quote"):
            df = df.withColumn(c, F.lit(None).cast(_TYPES[c]))
    return to_canonical(df, None)


class _Page(InputPartition):
    def __init__(self, file: str) -> None:
        self.file = file


class KlineReader(DataSourceReader):
    """Minutes of [start, end) from recorded pages in place of an exchange's address: one partition a page, each read once.

    `path` is a folder that driver and executors share.
    """

    def __init__(self, options: Mapping[str, str]) -> None:
        self.path, self.start, self.end = options["path"], int(options["start_ms"]), int(options["end_ms"])
        self.exchange = options.get("exchange", "binance")

    def partitions(self) -> list[_Page]:
        import os

        return [_Page(os.path.join(self.path, name)) for name in sorted(os.listdir(self.path)) if name.endswith(".json")] or [_Page("")]

    def read(self, page: _Page) -> Iterator[tuple]:
        import json

        if not page.file:
            return
        with open(page.file, encoding="utf-8") as f:
            body = json.load(f)
        if self.exchange == "bybit":
            if body.get("retCode") != 0:
                raise ValueError(f"the exchange answered {body.get('retCode')}: {body.get('retMsg')}")
            rows = [(int(r[0]), *map(float, r[1:7]), None) for r in body["result"]["list"]]
        else:
            rows = [(int(r[0]), float(r[1]), float(r[2]), float(r[3]), float(r[4]), float(r[5]), float(r[7]), int(r[8])) for r in body]
        yield from (r for r in sorted(rows) if self.start <= r[0] < self.end)


class KlineSource(DataSource):
    """spark.read.format("klines"): exchange pages as rows; register with spark.dataSource.register(KlineSource)."""

    @classmethod
    def name(cls) -> str:
        return "klines"

    def schema(self) -> str:
        return "open_ms long, open double, high double, low double, close double, volume double, quote_volume double, trades long"

    def reader(self, schema: object) -> KlineReader:
        return KlineReader(self.options)


BINANCE_INFO = "symbols array<struct<symbol: string, baseAsset: string, quoteAsset: string, filters: array<struct<filterType: string, tickSize: string, stepSize: string, minNotional: string>>>>"
BYBIT_INFO = (
    "retCode string, result struct<list: array<struct<symbol: string, baseCoin: string, quoteCoin: string, priceFilter: struct<tickSize: string>, "
    "lotSizeFilter: struct<qtyStep: string, minNotionalValue: string, minOrderAmt: string, minOrderQty: string>>>>"
)


def _positive(text: Column) -> Column:
    number = text.try_cast("double")
    return F.when(number > 0, number)


def read_instrument_metadata(spark: SparkSession, path: str, exchange: str, market_id: int) -> DataFrame:
    """Instruments of a market (assets, steps, least notional) from recorded exchange answers; missing numbers are NULL."""
    there = lambda c: F.nullif(F.trim(c), F.lit(""))
    if exchange == "binance":
        rows = spark.read.schema(BINANCE_INFO).json(path, multiLine=True).select(F.explode("symbols").alias("i"))
        first = lambda kind, name: F.get(F.transform(F.filter("i.filters", lambda f: f["filterType"] == kind), lambda f: f[name]), 0)
        numbers = [first("PRICE_FILTER", "tickSize"), first("LOT_SIZE", "stepSize"), F.coalesce(first("MIN_NOTIONAL", "minNotional"), first("NOTIONAL", "minNotional"))]
        assets = ["i.baseAsset", "i.quoteAsset"]
    else:
        answers = spark.read.schema(BYBIT_INFO).json(path, multiLine=True)
        bad = F.raise_error(F.concat(F.lit("the exchange answered "), F.col("retCode")))
        rows = answers.select(F.explode(F.when(F.coalesce("retCode", F.lit("0")) == "0", F.col("result.list")).otherwise(bad)).alias("i"))
        lot = "i.lotSizeFilter"
        numbers = [F.col("i.priceFilter.tickSize"), F.col(f"{lot}.qtyStep"), F.coalesce(*(there(F.col(f"{lot}.{c}")) for c in ("minNotionalValue", "minOrderAmt", "minOrderQty")))]
        assets = ["i.baseCoin", "i.quoteCoin"]
    named = [there(F.col(c)).alias(n) for c, n in zip(assets, ("base_asset", "quote_asset"), strict=True)] + [_positive(x).alias(n) for x, n in zip(numbers, ("price_step", "qty_step", "min_notional"), strict=True)]
    return rows.select(F.lit(market_id).alias("market_id"), F.upper(there(F.col("i.symbol"))).alias("symbol"), *named).where("symbol is not null")
