"""Raw candles into the canonical table as they come.

Each micro-batch is a folder of its own, which a retry replaces, with one version of each minute. The table is the version ingested
last of each minute in all folders, so a batch that comes twice, or rows that come again in another one, change nothing.
`compact` puts folders together; until the old ones are gone rows are there twice, and that changes nothing either.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from barloom.operators.bars import latest_per_key
from barloom.sources.candles import CANDLE_KEY, CANONICAL, raw_to_canonical

VERSION = ["ingested_at", "ingest_id"]


def write_rows(rows: DataFrame, path: str) -> None:
    """Canonical rows as a folder of the table, by day."""
    rows.withColumn("day", F.date_format("ts_open", "yyyyMMdd")).write.mode("overwrite").partitionBy("day").parquet(path)


def merge_batch(batch: DataFrame, number: int, exchange: str, path: str) -> None:
    """One micro-batch of a raw table; the same number again replaces it."""
    write_rows(latest_per_key(raw_to_canonical(batch, exchange), CANDLE_KEY, VERSION), f"{path}/batch-{number:012d}")


def merge_stream(raw: DataFrame, exchange: str, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """All micro-batches of a raw table's stream; without `every`, those that are there now."""
    writer = raw.writeStream.foreachBatch(lambda batch, number: merge_batch(batch, number, exchange, path)).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def canonical_table(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(CANONICAL).option("recursiveFileLookup", "true").parquet(path)
    return latest_per_key(rows, CANDLE_KEY, VERSION)


def compact(spark: SparkSession, path: str) -> None:
    """Put what is there now into one folder; micro-batches may go on meanwhile."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    there = [f.getPath() for f in fs.listStatus(folder) if f.isDirectory() and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))]
    if len(there) < 2:
        return
    rows = spark.read.schema(CANONICAL).option("recursiveFileLookup", "true").parquet(*(p.toString() for p in there))
    write_rows(latest_per_key(rows, CANDLE_KEY, VERSION), f"{path}/base-{uuid.uuid4().hex}")
    for p in there:
        fs.delete(p, True)
