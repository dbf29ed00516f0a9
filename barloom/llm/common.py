"""Shared helpers: text as Arrow batches, samples by hash, and names that no column has."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.sources.scratch import materialize, remove, scratch_path, scratch_scope, shared_dir

__all__ = ["materialize", "remove", "scratch_path", "scratch_scope", "shared_dir", "table", "doc_hash", "text_steps", "texts_of", "smallest_hashes", "unused"]

#: UTF-8 bytes of text that a Python task handles at once.
STEP_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_hash(col: str) -> F.Column:
    """crc32 of an id written as text; null for a null id."""
    return F.crc32(F.col(col).cast("string").cast("binary"))


def text_steps(batches: Iterator[pa.RecordBatch], limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into slices of about `limit` bytes, so that long texts don't pile up; then give memory back."""
    for batch in batches:
        rows = batch.num_rows
        if rows == 0:
            continue
        step = max(1, int(rows * limit / max(batch.nbytes, 1)))
        for at in range(0, rows, step):
            yield batch.slice(at, step)
        pa.default_memory_pool().release_unused()


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """Texts of a batch; a null one is empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def smallest_hashes(df: DataFrame, key: str, n: int) -> list[int]:
    """The n distinct keys of smallest hashes, to sample by.

    Of many keys, only those below a bound that about 3 n of them meet are sorted, so that what partitions send to
    the driver doesn't grow with their number.
    """
    keys = df.select(key).where(F.col(key).isNotNull()).distinct()
    h = F.xxhash64(key)
    total = keys.count()
    if total > 4 * n:
        keys = keys.where(h < int(-(2**63) + 3 * n / total * 2**64))
    return [r[0] for r in keys.orderBy(h, key).limit(n).collect()]


def unused(df: DataFrame, name: str) -> str:
    """`name`, with underscores until no column of `df` is called so in any case."""
    there = {c.lower() for c in df.columns}
    while name.lower() in there:
        name += "_"
    return name


def check_unused(df: DataFrame, name: str) -> None:
    if name.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"there is a column {name} already; name the result otherwise")
