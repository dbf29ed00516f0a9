"""Token-id store: documents' ids, each compressed alone with one shared zstandard dictionary.

A store is a folder of three Parquet tables, so every file system that Spark writes to can hold it, and Spark's
commit protocol makes it whole when executors are lost:

* ``dictionary``: one row, the dictionary's bytes and their SHA-256, and the width of an id.
* ``blocks``: about 1 MiB of compressed documents each, in ascending doc_id order, with the offset index beside the
  payload: for every document its id, its place in the payload, its number of ids and its start among the ids of the
  block's part. Parquet's statistics of ``first_doc_id`` and ``last_doc_id`` lead a lookup to few blocks.
* ``parts``: the ids before each part (one row per range partition), which makes starts global.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import materialize, remove, scratch_path, smallest_hashes, text_steps, texts_of
from barloom.llm.tokens import encoder

#: Documents that the dictionary is trained on, bytes of a span of one, spans of a longer one (at hashed places of the
#: whole array), and the dictionary's bytes. The sample bounds ratios only; compression is lossless.
DICT_DOCS, SPAN_BYTES, SPANS, DICT_BYTES = 1000, 16 << 10, 4, 64 << 10
#: Ranges of ids at most that a lookup's filter has.
RANGES = 64
BLOCK_BYTES = 1 << 20
LEVEL = 3

FRAMES = "doc_id long, n_tokens long, ids_crc32 long, frame binary"
BLOCKS = (
    "part int, block int, first_doc_id long, last_doc_id long, dict_sha256 string, doc_ids array<long>, "
    "n_tokens array<long>, starts array<long>, offsets array<long>, payload binary"
)
DOCS = "doc_id long, start long, n_tokens long, ids binary"


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    """A trained dictionary, or raw content, as the bytes' first ones tell."""
    return zstandard.ZstdCompressionDict(data) if data else None


def _spans(ids: bytes, width: int) -> bytes:
    """A document's serialized ids; of a long one SPANS spans, one at a hashed place of each of as many equal parts."""
    if len(ids) <= SPANS * SPAN_BYTES:
        return ids
    part = len(ids) // SPANS
    at = [(k * part + zlib.crc32(ids[k * part : (k + 1) * part]) % (part - SPAN_BYTES + 1)) // width * width for k in range(SPANS)]
    return b"".join(ids[i : i + SPAN_BYTES] for i in at)


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int) -> bytes:
    """A dictionary from the documents with the smallest hashes of their ids; raw content where there are too few to train on.

    Of the rows of one id the least serialized array counts, so the sample doesn't depend on any order.
    """
    wanted = smallest_hashes(docs, "doc_id", DICT_DOCS)
    if not wanted:
        return b""

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        end, width = np.array([end_id], dtype=enc.dtype).tobytes(), enc.dtype.itemsize
        for b in text_steps(batches):
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array([_spans(x + end, width) for x in enc.encode_bytes(texts_of(b))], pa.binary())], names=["doc_id", "x"])

    rows = docs.where(F.col("doc_id").isin(wanted)).select("doc_id", "text").mapInArrow(ids, "doc_id long, x binary").groupBy("doc_id").agg(F.min("x").alias("x")).collect()  # DICT_DOCS rows
    samples = sorted(bytes(r["x"]) for r in rows)
    parts = [x[i : i + SPAN_BYTES] for x in samples for i in range(0, len(x), SPAN_BYTES)]
    try:
        return zstandard.train_dictionary(DICT_BYTES, parts).as_bytes()
    except (zstandard.ZstdError, MemoryError):
        return b"".join(parts)[:DICT_BYTES]


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    """Encode every row's whole text, append `end_id`, and write the store at `path`.

    Rows are ordered by (doc_id, number of ids, checksum); a null doc_id comes first, a null text is an empty one,
    repeated rows are documents of their own, and an empty table gives a store without blocks.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    data = train_dictionary(docs, tokenizer, end_id)
    sha = hashlib.sha256(data).hexdigest()

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shared = encoder(tokenizer), _dictionary(data)
        end, width = np.array([end_id], dtype=enc.dtype).tobytes(), enc.dtype.itemsize
        if shared:
            shared.precompute_compress(level=LEVEL)
        zip_ = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared)
        for b in text_steps(batches):
            ids = [x + end for x in enc.encode_bytes(texts_of(b))]
            crc = [zlib.crc32(np.frombuffer(x, enc.dtype).astype("<u4")) for x in ids]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(pa.int64()), pa.array([len(x) // width for x in ids], pa.int64()), pa.array(crc, pa.int64()), pa.array([zip_.compress(x) for x in ids], pa.binary())],
                names=["doc_id", "n_tokens", "ids_crc32", "frame"],
            )

    frames_at = scratch_path(spark, "frames")
    frames = materialize(docs.mapInArrow(compress, FRAMES), "frames", frames_at)

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        at, number, docs_, sizes, starts, offsets, payload = 0, 0, [], [], [], [], bytearray()

        def cut() -> pa.RecordBatch:
            known = [d for d in docs_ if d is not None] or [None]
            row = (part, number, known[0], known[-1], sha, docs_, sizes, starts, offsets + [len(payload)], bytes(payload))
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), *[pa.list_(pa.int64())] * 4, pa.binary()), strict=True)], names=[x.split()[0] for x in BLOCKS.split(", ")])

        for b in batches:
            for doc, n, frame in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if payload and len(payload) + len(frame.as_buffer()) > BLOCK_BYTES:
                    yield cut()
                    number, docs_, sizes, starts, offsets, payload = number + 1, [], [], [], [], bytearray()
                docs_.append(doc)
                sizes.append(n)
                starts.append(at)
                offsets.append(len(payload))
                payload += frame.as_buffer()
                at += n
        if docs_:
            yield cut()

    order = ["doc_id", "n_tokens", "ids_crc32"]
    ranged = frames.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "n_tokens", "frame")
    ranged.mapInArrow(block, BLOCKS).write.parquet(f"{path}/blocks")
    remove(spark, frames_at)
    # one row per range partition, whatever the number of documents
    totals = spark.read.schema(BLOCKS).parquet(f"{path}/blocks").groupBy("part").agg(F.sum(F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).orderBy("part").collect()
    bases, before = [], 0
    for r in totals:
        bases.append((r["part"], before))
        before += r["n"]
    spark.createDataFrame(bases, "part int, base long").coalesce(1).write.parquet(f"{path}/parts")
    width = encoder(tokenizer).dtype.itemsize
    spark.createDataFrame([(bytearray(data), sha, width)], "dictionary binary, dict_sha256 string, id_bytes int").coalesce(1).write.parquet(f"{path}/dictionary")


def id_ranges(ids: Iterable[int], most: int = RANGES) -> list[tuple[int, int]]:
    """At most so many ranges [low, high] that hold all of `ids`, cut at the widest gaps between them."""
    x = np.unique(np.fromiter(ids, np.int64))
    if not len(x):
        return []
    cuts = np.sort(np.argsort(-np.diff(x.astype(float)), kind="stable")[: most - 1])
    return [(int(a[0]), int(a[-1])) for a in np.split(x, cuts + 1)]


def _read_blocks(spark: SparkSession, path: str, wanted: DataFrame | None, ranges: list[tuple[int, int]] | None, ids: bool) -> DataFrame:
    head = spark.read.parquet(f"{path}/dictionary").first()
    data, sha, width = bytes(head[0]), head[1], head[2]
    if hashlib.sha256(data).hexdigest() != sha:
        raise ValueError(f"{path}: the dictionary doesn't have its SHA-256")
    bases = {r[0]: r[1] for r in spark.read.schema("part int, base long").parquet(f"{path}/parts").collect()}
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    if ranges is not None:
        near = F.lit(False)
        for low, high in ranges:
            near |= (F.col("first_doc_id") <= high) & (F.col("last_doc_id") >= low)
        blocks = blocks.where(near)
    if wanted is None:
        blocks = blocks.withColumn("keep", F.lit(None).cast("array<long>"))
    else:
        # the index alone tells which blocks hold wanted documents; only their payloads are moved
        there = blocks.select("part", "block", F.explode("doc_ids").alias("doc_id")).join(wanted.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "doc_id")
        blocks = blocks.join(there.groupBy("part", "block").agg(F.collect_set("doc_id").alias("keep")), ["part", "block"])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor(dict_data=_dictionary(data))
        kind = np.dtype(f"<u{width}")
        for b in batches:
            for k in range(b.num_rows):
                row = {n: b.column(i)[k] for i, n in enumerate(b.schema.names)}
                if row["dict_sha256"].as_py() != sha:
                    raise ValueError(f"{path}: a block was written with another dictionary")
                payload, offsets = row["payload"].as_buffer(), row["offsets"].as_py()
                docs, some = row["doc_ids"].as_py(), row["keep"].as_py()
                some = some if some is None else set(some)
                keep = [i for i, d in enumerate(docs) if some is None or d in some]
                starts, base = row["starts"].as_py(), bases[row["part"].as_py()]
                raw = [np.frombuffer(unzip.decompress(payload[offsets[i] : offsets[i + 1]]), kind).astype("<u4") for i in keep]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([docs[i] for i in keep], pa.int64()), pa.array([base + starts[i] for i in keep], pa.int64()), pa.array([len(x) for x in raw], pa.int64()),
                     pa.array([x.tobytes() for x in raw], pa.binary()) if ids else pa.array([zlib.crc32(x) for x in raw], pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids" if ids else "ids_crc32"],
                )

    names = ["part", "dict_sha256", "doc_ids", "starts", "offsets", "payload", "keep"]
    return blocks.select(*names).mapInArrow(unpack, DOCS if ids else "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_documents(spark: SparkSession, path: str, doc_ids: Iterable[int] | DataFrame | None = None) -> DataFrame:
    """Documents of a store with their ids (little-endian unsigned 32-bit): all, or those of `doc_ids`.

    A lookup reads the index of blocks that may hold one of at most RANGES ranges of ids, and the payloads of those that do.
    `doc_ids` may be a DataFrame with a doc_id column, of any size. Ids that aren't there, and null ones, give no rows.
    """
    if doc_ids is None or isinstance(doc_ids, DataFrame):
        return _read_blocks(spark, path, doc_ids, None, True)
    some = [int(i) for i in doc_ids if i is not None]
    return _read_blocks(spark, path, spark.createDataFrame(pd.DataFrame({"doc_id": np.array(some, np.int64)}), "doc_id long"), id_ranges(some), True)


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and the checksum of every document's ids, from the stored bytes."""
    return _read_blocks(spark, path, None, None, False)


def op2_zstd_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place and digest, read back; a null text has its end id alone, and null ids come first."""
    import public_tokenizers

    path = scratch_path(spark, "token-store")
    write_store(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("byte_bpe_50k.json"), 2)
    return read_digests(spark, path)
