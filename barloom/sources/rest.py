"""REST klines: pages of 1000 minutes of [start, end), planned from the filters that reach the source.

spark.dataSource.register(RestKlines); spark.read.format("rest_klines").options(url=..., exchange=..., symbol=...).load().where("open_ms >= ... and open_ms < ...")
needs spark.sql.python.filterPushdown.enabled; without it the options start_ms and end_ms say what to ask for.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterable, Iterator, Mapping
from urllib.parse import urlencode

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

MINUTE = 60_000
#: Minutes of a page, tries of a request, and seconds between them, times the try (parameters of the exchanges' limits).
PAGE, TRIES, WAIT = 1000, 3, 0.5
SCHEMA = "symbol string, open_ms long, open double, high double, low double, close double, volume double, quote_volume double, trades long"


class Range(InputPartition):
    def __init__(self, start: int, end: int) -> None:
        self.start, self.end = start, end


def pages(start: int, end: int, minutes: int = PAGE) -> list[Range]:
    """The whole minutes of [start, end) in milliseconds, so many a page."""
    start, end = -(-start // MINUTE) * MINUTE, -(-end // MINUTE) * MINUTE
    step = minutes * MINUTE
    return [Range(a, min(a + step, end)) for a in range(start, end, step)]


class RestReader(DataSourceReader):
    def __init__(self, options: Mapping[str, str]) -> None:
        self.url, self.symbol, self.exchange = options["url"].rstrip("/"), options["symbol"], options.get("exchange", "binance")
        if self.exchange not in ("binance", "bybit"):
            raise ValueError(f"exchange is binance or bybit, not {self.exchange}")
        self.category, self.minutes, self.wait = options.get("category", "spot"), int(options.get("page", PAGE)), float(options.get("wait", WAIT))
        self.start, self.end = (int(options[k]) if k in options else None for k in ("start_ms", "end_ms"))

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Bounds on open_ms narrow the range; all other filters are Spark's."""
        for f in filters:
            if getattr(f, "attribute", None) != ("open_ms",) or not isinstance(getattr(f, "value", None), int):
                yield f
                continue
            low = {GreaterThanOrEqual: f.value, GreaterThan: f.value + 1, EqualTo: f.value}.get(type(f))
            high = {LessThan: f.value, LessThanOrEqual: f.value + 1, EqualTo: f.value + 1}.get(type(f))
            if low is None and high is None:
                yield f
            if low is not None:
                self.start = low if self.start is None else max(self.start, low)
            if high is not None:
                self.end = high if self.end is None else min(self.end, high)

    def partitions(self) -> list[Range]:
        if self.start is None or self.end is None:
            raise ValueError("klines need a range: filters on open_ms, or the options start_ms and end_ms")
        return pages(self.start, self.end, self.minutes) or [Range(0, 0)]

    def _ask(self, page: Range) -> object:
        if self.exchange == "binance":
            query = {"symbol": self.symbol, "interval": "1m", "startTime": page.start, "endTime": page.end - 1, "limit": self.minutes}
            address = f"{self.url}/api/v3/klines?{urlencode(query)}"
        else:
            query = {"category": self.category, "symbol": self.symbol, "interval": "1", "start": page.start, "end": page.end - 1, "limit": self.minutes}
            address = f"{self.url}/v5/market/kline?{urlencode(query)}"
        for attempt in range(1, TRIES + 1):
            try:
                with urllib.request.urlopen(address, timeout=30) as answer:
                    return json.load(answer)
            except (urllib.error.URLError, TimeoutError) as e:
                refused = isinstance(e, urllib.error.HTTPError) and e.code < 500 and e.code not in (418, 429)
                if refused or attempt == TRIES:
                    raise
                time.sleep(attempt * self.wait)

    def read(self, page: Range) -> Iterator[tuple]:
        """Rows of a page by time; an empty one has none, and what an exchange sends beyond it isn't kept."""
        if page.start >= page.end:
            return
        body = self._ask(page)
        if self.exchange == "bybit":
            if body.get("retCode") != 0:
                raise ValueError(f"the exchange answered {body.get('retCode')}: {body.get('retMsg')}")
            rows = [(self.symbol, int(r[0]), *map(float, r[1:7]), None) for r in body["result"]["list"]]
        else:
            rows = [(self.symbol, int(r[0]), *map(float, r[1:6]), float(r[7]), int(r[8])) for r in body]
        yield from (r for r in sorted(rows, key=lambda r: r[1]) if page.start <= r[1] < page.end)


class RestKlines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "rest_klines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> RestReader:
        return RestReader(self.options)
