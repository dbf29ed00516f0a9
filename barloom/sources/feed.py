"""The live feed as a stream with offsets, and the insert buffer as a streaming sink.

A listener appends each exchange message as a line to the last segment of a log, a folder that driver and executors share.
`CandleFeed` reads it as a stream: an offset is a place in the log, so a query that starts again from its checkpoint loses and
repeats nothing. `InsertBuffer` writes rows to files, each of so many rows or milliseconds at most, and publishes a micro-batch's
files together: one that failed is cleared and tried first again, and one that was published is not published twice.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, DataSourceStreamWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

MESSAGES = "value string, segment string, position long"


class Piece(InputPartition):
    """Bytes of a segment."""

    def __init__(self, segment: str, start: int, end: int) -> None:
        self.segment, self.start, self.end = segment, start, end


class FeedReader(DataSourceStreamReader):
    """Offsets are a segment (by name, in order) and a number of bytes in it, always at a line's end."""

    def __init__(self, options: Mapping[str, str]) -> None:
        self.path = options["path"]

    def _segments(self) -> list[str]:
        return sorted(n for n in os.listdir(self.path) if n.endswith(".jsonl"))

    def _whole(self, segment: str) -> int:
        """Bytes up to the last whole line."""
        with open(os.path.join(self.path, segment), "rb") as f:
            at = f.seek(0, os.SEEK_END)
            while at > 0:
                step = min(at, 1 << 16)
                f.seek(at - step)
                found = f.read(step).rfind(b"\n")
                if found >= 0:
                    return at - step + found + 1
                at -= step
        return 0

    def initialOffset(self) -> dict:
        return {"segment": "", "bytes": 0}

    def latestOffset(self) -> dict:
        segments = self._segments()
        return {"segment": segments[-1], "bytes": self._whole(segments[-1])} if segments else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> Sequence[Piece]:
        out = []
        for s in self._segments():
            if start["segment"] <= s <= end["segment"]:
                a = start["bytes"] if s == start["segment"] else 0
                b = end["bytes"] if s == end["segment"] else self._whole(s)  # an older segment doesn't grow any more
                if a < b:
                    out.append(Piece(s, a, b))
        return out

    def read(self, piece: Piece) -> Iterator[tuple]:
        with open(os.path.join(self.path, piece.segment), "rb") as f:
            at = f.seek(piece.start)
            while at < piece.end:
                line = f.readline()
                yield line.rstrip(b"\r\n").decode("utf-8", "replace"), piece.segment, at
                at += len(line)


class CandleFeed(DataSource):
    """spark.readStream.format("candle_feed").load(path): register with spark.dataSource.register(CandleFeed)."""

    @classmethod
    def name(cls) -> str:
        return "candle_feed"

    def schema(self) -> str:
        return MESSAGES

    def streamReader(self, schema: StructType) -> FeedReader:
        return FeedReader(self.options)


@dataclass
class Files(WriterCommitMessage):
    names: list[str]


class BufferWriter(DataSourceStreamWriter):
    def __init__(self, options: Mapping[str, str], schema: StructType) -> None:
        from pyspark.sql.pandas.types import to_arrow_schema

        self.path, self.most_rows, self.most_ms = options["path"], int(options.get("max_rows", 50_000)), int(options.get("flush_ms", 1000))
        if self.most_rows < 1:
            raise ValueError("a file has a row at least")
        self.schema = to_arrow_schema(schema)
        os.makedirs(self.path, exist_ok=True)

    def write(self, iterator: Iterator) -> Files:
        names, rows, since = [], [], 0.0

        def flush() -> None:
            name = f"rows-{uuid.uuid4().hex}.parquet"
            columns = [*zip(*rows, strict=True)]
            pq.write_table(pa.table([pa.array(c, f.type) for c, f in zip(columns, self.schema, strict=True)], schema=self.schema), os.path.join(self.path, f".{name}"))
            names.append(name)
            rows.clear()

        for row in iterator:
            if not rows:
                since = time.monotonic()
            rows.append(tuple(row))
            if len(rows) >= self.most_rows or (time.monotonic() - since) * 1000 >= self.most_ms:
                flush()
        if rows:
            flush()
        return Files(names)

    def _manifest(self, batch: int) -> str:
        return os.path.join(self.path, f"batch-{batch:012d}.json")

    def commit(self, messages: list[Files | None], batchId: int) -> None:
        """Files get their names, then the manifest its own: readers see all of a micro-batch or nothing."""
        names = [n for m in messages if m for n in m.names]
        if os.path.exists(self._manifest(batchId)):  # published before a crash, and tried again
            self.abort(messages, batchId)
            return
        for n in names:
            os.replace(os.path.join(self.path, f".{n}"), os.path.join(self.path, n))
        new = f"{self._manifest(batchId)}.{uuid.uuid4().hex}"
        with open(new, "w", encoding="utf-8") as f:
            json.dump(names, f)
        os.replace(new, self._manifest(batchId))

    def abort(self, messages: list[Files | None], batchId: int) -> None:
        for n in (n for m in messages if m for n in m.names):
            staged = os.path.join(self.path, f".{n}")
            if os.path.exists(staged):
                os.remove(staged)


class InsertBuffer(DataSource):
    """df.writeStream.format("insert_buffer").option("path", ...): options max_rows and flush_ms bound a file, the trigger a micro-batch."""

    @classmethod
    def name(cls) -> str:
        return "insert_buffer"

    def streamWriter(self, schema: StructType, overwrite: bool) -> BufferWriter:
        return BufferWriter(self.options, schema)


def read_inserted(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Rows of all published micro-batches; files of others are passed over."""
    manifests = spark.read.schema("value string").option("wholetext", "true").text(f"file://{path}/batch-*.json") if any(n.startswith("batch-") and n.endswith(".json") for n in os.listdir(path)) else None
    names = sorted(n for r in manifests.collect() for n in json.loads(r["value"])) if manifests is not None else []  # a name a file
    return spark.read.schema(schema).parquet(*(f"file://{path}/{n}" for n in names)) if names else spark.createDataFrame([], schema)
