"""Bounded-space online best-fit packing of documents into token sequences.

Each task takes pieces in the order of a hash and keeps at most OPEN_BINS bins open. A bitset has bit f set while an
open bin with f free places exists, so the tightest bin for a piece of n tokens is the lowest set bit at or above n.
When a piece fits nowhere and all bins are open, the fullest bin closes. Bins still open when a task ends are taken
apart and packed again by fewer tasks, until one task's worth is left, so that tasks cost no part-filled sequences.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import materialize, text_steps, texts_of
from barloom.llm.tokens import encoder

#: Bins that a task keeps open; tokens that a task packs in the first round; tasks of a round that become one.
OPEN_BINS, TASK_TOKENS, FAN_IN = 256, 8 << 20, 8

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, row long, ids binary"
#: A piece's columns; `row` numbers the documents, whatever their ids are.
KEYS = ["doc_id", "piece", "start", "length", "ids_crc32", "row"]
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, row long, sequence_id long, offset long, open boolean"


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int, size: int) -> DataFrame:
    """Each row's ids and `end_id`, cut into pieces of at most `size`: every piece but the last is full.

    A null text is empty (one piece, the end id), a null doc_id is kept, repeated rows are documents of their own.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        row = TaskContext.get().partitionId() << 40
        for b in text_steps(batches):
            rows = []
            for doc, raw in zip(b.column(0).to_pylist(), enc.encode_bytes(texts_of(b)), strict=True):
                ids = np.append(np.frombuffer(raw, enc.dtype).astype("<u4"), np.uint32(end_id))
                for k, at in enumerate(range(0, len(ids), size)):
                    part = ids[at : at + size]
                    rows.append((doc, k, at, len(part), zlib.crc32(part), row, part.astype(enc.dtype).tobytes()))
                row += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)],
                names=[*KEYS, "ids"],
            )

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES)


class OpenBins:
    """At most `limit` open bins of `size` places; `add` gives the bins that closed, as lists of items."""

    def __init__(self, size: int, limit: int) -> None:
        self.size, self.limit, self.count, self.bits = size, limit, 0, 0
        self.by_free: list[list[list]] = [[] for _ in range(size + 1)]

    def _pop(self, free: int) -> list:
        bins = self.by_free[free]
        out = bins.pop()
        self.count -= 1
        if not bins:
            self.bits &= ~(1 << free)
        return out

    def _push(self, free: int, items: list) -> None:
        self.by_free[free].append(items)
        self.bits |= 1 << free
        self.count += 1

    def add(self, item: object, length: int) -> list[list]:
        closed = []
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            items = self._pop(free)
        else:
            free, items = self.size, []
            if length < self.size and self.count >= self.limit:
                closed.append(self._pop((self.bits & -self.bits).bit_length() - 1))
        items.append(item)
        if free == length:
            closed.append(items)
        else:
            self._push(free - length, items)
        return closed

    def rest(self) -> Iterator[list]:
        while self.bits:
            yield self._pop((self.bits & -self.bits).bit_length() - 1)


def pack(pieces: DataFrame, size: int, open_bins: int = OPEN_BINS, task_tokens: int = TASK_TOKENS) -> DataFrame:
    """Place every piece: the columns of KEYS with sequence_id and offset. `pieces` must be a written table.

    Null doc_ids and repeated rows are placed each; without pieces there are no sequences.
    """
    todo = pieces.select(*KEYS)
    total = todo.agg(F.sum("length")).first()[0] or 0
    tasks, step, done = max(1, -(-total // task_tokens)), 0, []
    while True:
        last = tasks == 1

        def place(batches: Iterator[pd.DataFrame], step: int = step, last: bool = last) -> Iterator[pd.DataFrame]:
            bins, number = OpenBins(size, open_bins), (step << 56) | (TaskContext.get().partitionId() << 32)

            def rows(closed: list[list], is_open: bool) -> Iterator[tuple]:
                nonlocal number
                for items in closed:
                    offset = 0
                    for item in items:
                        yield (*item, number, offset, is_open)
                        offset += item[3]
                    number += 1

            for b in batches:
                out = []
                # object columns keep null ids as None and other ids as exact integers
                for item in zip(*(b[c].astype(object).where(b[c].notna(), None) for c in KEYS), strict=True):
                    item = tuple(None if x is None else int(x) for x in item)
                    out += rows(bins.add(item, item[3]), False)
                yield frame(out)
            yield frame(list(rows(bins.rest(), not last)))

        def frame(out: list[tuple]) -> pd.DataFrame:
            f = pd.DataFrame(out, columns=[*KEYS, "sequence_id", "offset", "open"])
            return f.astype({"doc_id": "Int64", "piece": "int32"} | dict.fromkeys(("start", "length", "ids_crc32", "row", "sequence_id", "offset"), "int64") | {"open": "bool"})

        order = F.xxhash64(*KEYS)
        placed = materialize(todo.repartition(tasks).sortWithinPartitions(order, *KEYS).mapInPandas(place, PLACED), f"packed{step}")
        done.append(placed if last else placed.where(~F.col("open")))
        if last:
            break
        todo, tasks, step = placed.where("open").select(*KEYS), max(1, tasks // FAN_IN), step + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.drop("open")


def sequences(pieces: DataFrame, placed: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id, n_tokens, ids (little-endian, as wide as `pieces` has them), the
    doc_ids in them, and their pieces (doc_id, row, piece, start, length, offset) in order.

    Pieces meet their places by `row` and `piece`, so documents with null or repeated ids are there each. A sequence has
    at most `size` pieces, so no group is unbounded.
    """
    joined = placed.join(pieces.select("row", "piece", "ids"), ["row", "piece"])
    each = F.array_sort(F.collect_list(F.struct("offset", "length", "doc_id", "row", "piece", "start", "ids")))
    got = joined.groupBy("sequence_id").agg(each.alias("p"))
    ids = F.unhex(F.array_join(F.transform("p", lambda x: F.hex(x["ids"])), ""))
    where = F.transform("p", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["row"].alias("row"), x["piece"].alias("piece"), x["start"].alias("start"), x["length"].alias("length"), x["offset"].alias("offset")))
    n = F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x["length"])
    return got.select("sequence_id", n.alias("n_tokens"), ids.alias("ids"), F.array_distinct(F.transform("p", lambda x: x["doc_id"])).alias("doc_ids"), where.alias("pieces"))


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, size: int = 4096) -> tuple[DataFrame, DataFrame]:
    """Pieces with their ids (a written table) and each piece's place. Other columns of `docs` are ignored."""
    pieces = materialize(cut_pieces(docs, tokenizer, end_id, size), "pieces")
    return pieces, pack(pieces, size)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each piece's place; a null text is the end id alone, and null ids and repeated rows are packed each."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))[1]
