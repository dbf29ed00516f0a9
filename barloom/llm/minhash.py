"""HyperMinHash near-duplicate detection.

Each of BANDS * ROWS buckets keeps the least value of its own hash over a document's shingles, compressed to the
number of leading zeros and the MANTISSA bits after the first one. (Buckets that split one hash's range, as the sketch
was first described, would stay empty in short documents and make them all alike; so each has a hash of its own.)
Bands of ROWS registers give candidates: a pair of similarity 0.8 shares a band with a chance of 0.999997. Estimates
from all registers, corrected for chance collisions, drop hopeless candidates, and full shingle sets decide.

Steps, so that no group's pairs are written out:
1. Texts of one shingle set become one node, that of the smallest doc_id.
2. In each band's bucket, every node is tried against the bucket's smallest node; components follow.
3. Buckets whose nodes still are of several components are tried in full, as blocks of about BLOCK nodes against
   blocks of the nodes outside of the bucket's largest component. Blocks are compared by registers alone. Where few pairs
   are hopeful, as nearly everywhere, these pairs come out, once however many buckets they share, and meet their shingle
   sets in joins; a block with more than HOPEFUL of them a node gets its sets instead, and only its links come out.

Shingle sets are made for the nodes of crowded buckets alone, where the texts are: a bitset of bounded size tells which
documents may be such nodes, so that no text is moved.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import materialize, scratch_path, scratch_scope, text_steps, texts_of
from barloom.llm.components import connected_components

BANDS, ROWS, MANTISSA = 32, 5, 10
#: Candidates are verified from an estimate of SIMILARITY - SLACK, five standard deviations of it, on.
SLACK = 0.16
#: Nodes of a block (about), and hopeful pairs a node up to which a block gives them out.
BLOCK, HOPEFUL = 256, 4
#: Cached words and their bytes.
MAX_WORDS, MAX_BYTES = 200_000, 32 << 20
#: Bits of the bitset at most (what it lets pass in vain is dropped by a join), and of one of its chunks.
MOST_BITS, CHUNK_BITS = 1 << 27, 1 << 15
#: Copies from which a set's rows are dealt over SALTS keys, and places in the table that tells such sets.
COPIES, SALTS, PLACES = 256, 64, 1 << 16

_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)
_rng = np.random.default_rng(20240607)
_A = (_rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_B = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32)


def _stir(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads all of them."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


class Shingler(dict):
    """64-bit hashes of words, and from them of a text's distinct shingles."""

    def __init__(self, words: int) -> None:
        super().__init__()
        self.words, self.bytes = words, 0

    def __missing__(self, word: bytes) -> int:
        self.bytes += len(word)
        self[word] = h = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return h

    def shingles(self, text: str) -> np.ndarray:
        """Sorted distinct hashes of `words` words in a row; of all words where there are fewer; none without words.

        bytes.lower and bytes.split take exactly A-Z and the six white space characters of ASCII.
        """
        parts = text.encode().lower().split()
        if not parts:
            return np.empty(0, np.uint64)
        if len(self) > MAX_WORDS or self.bytes > MAX_BYTES:
            self.clear()
            self.bytes = 0
        h = np.fromiter(map(self.__getitem__, parts), np.uint64, len(parts))
        n = min(self.words, len(h))
        out = np.full(len(h) - n + 1, n, np.uint64)
        for k in range(n):
            out = (out ^ _stir(h[k : len(h) - n + 1 + k])) * np.uint64(_MIX[k % 5])
        return np.unique(_stir(out))


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, BANDS * ROWS) of uint16; no set may be empty."""
    if not sets:
        return np.empty((0, BANDS * ROWS), np.uint16)
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    sizes = np.array([len(s) for s in sets])
    starts = np.cumsum(sizes) - sizes
    least = np.empty((BANDS * ROWS, len(sets)), np.uint32)
    room = np.empty_like(x)
    for i in range(BANDS * ROWS):
        np.multiply(x, _A[i], out=room)
        np.add(room, _B[i], out=room)
        np.minimum.reduceat(room, starts, out=least[i])
    length = np.frexp(least.astype(np.float64))[1].astype(np.int64)  # bits of the value
    zeros = 32 - length
    below = least.astype(np.int64) ^ np.where(length > 0, 1 << np.maximum(length - 1, 0), 0)
    shift = length - 1 - MANTISSA
    mantissa = np.where(shift >= 0, below >> np.maximum(shift, 0), below << np.maximum(-shift, 0))
    return ((zeros << MANTISSA) | np.where(length > 0, mantissa, 0)).astype(np.uint16).T.copy()


@lru_cache(maxsize=None)
def chance(bits: int) -> float:
    """Chance that a register of two unrelated sets of 2**bits shingles is the same."""
    n, total = float(1 << bits), 0.0
    for zeros in range(32):
        edges = 2.0 ** -(zeros + 1) * (1 + np.arange((1 << MANTISSA) + 1) / (1 << MANTISSA))
        above = np.exp(n * np.log1p(-np.minimum(edges, 1 - 1e-16)))
        total += float((np.diff(-above) ** 2).sum())
    return total


def estimates(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard estimates of rows of registers (shapes broadcast), corrected for chance collisions."""
    same = (a == b).mean(axis=-1)
    size = np.log2(np.maximum(np.minimum(n_a, n_b), 1)).astype(np.int64)
    by_size = np.array([chance(k) for k in range(int(size.max(initial=0)) + 1)])
    e = by_size[size]
    return (same - e) / (1 - e)


def similar(common: np.ndarray | int, n_a: np.ndarray | int, n_b: np.ndarray | int, percent: int) -> np.ndarray | bool:
    return 100 * common >= percent * (n_a + n_b - common)


def _print(s: np.ndarray) -> tuple[np.uint64, np.uint64]:
    """Two sums over a set that tell it from others."""
    return s.sum(dtype=np.uint64), (_stir(s ^ np.uint64(_MIX[0])) * np.uint64(_MIX[1])).sum(dtype=np.uint64)


SET = ["set_a", "set_b", "n_shingles"]
SIGNATURES = "doc_id long, n_shingles long, set_a long, set_b long, registers binary"


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """Size, fingerprint and registers of each row's shingle set; no registers for an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Shingler(words)
        for b in text_steps(batches, 1 << 20):
            sets = [make.shingles(t) for t in texts_of(b)]
            full = [i for i, s in enumerate(sets) if len(s)]
            regs: list[bytes | None] = [None] * len(sets)
            for i, r in zip(full, registers([sets[i] for i in full]), strict=True):
                regs[i] = r.tobytes()
            prints = [_print(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), *(pa.array(np.array([p[k] for p in prints], np.uint64).astype(np.int64)) for k in (0, 1)), pa.array(regs, pa.binary())],
                names=[x.split()[0] for x in SIGNATURES.split(", ")],
            )

    return docs.select("doc_id", "text").mapInArrow(run, SIGNATURES)


def _bits_of(ids: np.ndarray, bits: int) -> np.ndarray:
    """(2, ids): each id's two places among `bits`, a power of two."""
    h = _stir(ids.astype(np.int64).view(np.uint64) * np.uint64(_MIX[2]))
    return np.stack([h, h >> np.uint64(32)]).astype(np.int64) & (bits - 1)


def _bitset(ids: DataFrame, count: int) -> np.ndarray:
    """A bitset of a table of ids: 16 bits each, MOST_BITS at most. Chunks are merged on Spark; the driver gets the result."""
    bits = min(MOST_BITS, max(CHUNK_BITS, 1 << (16 * max(count, 1)).bit_length()))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(bits // 8, np.uint8)
        for b in batches:
            at = _bits_of(b.column(0).to_numpy(), bits).ravel()
            np.bitwise_or.at(own, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
        chunks = own.reshape(-1, CHUNK_BITS // 8)
        used = np.flatnonzero(chunks.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([chunks[i].tobytes() for i in used], pa.binary())], names=["chunk", "bits"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[int, np.ndarray] = {}  # at most MOST_BITS
        for b in batches:
            for i, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                out[i] = out.get(i, 0) | np.frombuffer(x.as_buffer(), np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int32()), pa.array([x.tobytes() for x in out.values()], pa.binary())], names=["chunk", "bits"])

    whole, schema = np.zeros((bits // CHUNK_BITS, CHUNK_BITS // 8), np.uint8), "chunk int, bits binary"
    for r in ids.mapInArrow(mark, schema).repartition("chunk").mapInArrow(merge, schema).collect():
        whole[r["chunk"]] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return whole.ravel()


def _sets(docs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """(node, hashes) of `nodes`, a written table."""
    shared = docs.sparkSession.sparkContext.broadcast(_bitset(nodes.select("node"), nodes.count()))  # MOST_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, there = Shingler(words), shared.value
        for b in batches:
            b = b.filter(b.column(0).is_valid())
            at = _bits_of(b.column(0).cast(pa.int64()).to_numpy(), 8 * len(there))
            b = b.filter(pa.array((there[at >> 3] >> (at & 7).astype(np.uint8) & 1).all(0)))
            for part in text_steps([b], 1 << 20):
                sets = [s for t in texts_of(part) if len(s := make.shingles(t))]
                prints = np.array([_print(s) for s in sets], np.uint64).reshape(-1, 2).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(prints[:, 0]), pa.array(prints[:, 1]), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=[*SET, "hashes"])

    made = docs.select("doc_id", "text").mapInArrow(run, "set_a long, set_b long, n_shingles long, hashes binary")
    known = nodes.select(*SET, "node", "registers", "n_shingles")  # registers go with the sets, so that blocks meet both in one join
    return materialize(made.groupBy(*SET).agg(F.first("hashes").alias("hashes")).join(known, SET).select("node", "registers", "n_shingles", "hashes"), "sets")


def _estimate_pairs(pairs: DataFrame, regs: DataFrame, least: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            r = [np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint16).reshape(b.num_rows, -1) for k in (2, 3)]
            n = [b.column(k).to_numpy() for k in (4, 5)]
            keep = pa.array(estimates(*r, *n) >= least)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], names=["a", "b"])

    left = regs.select(F.col("node").alias("a"), F.col("registers").alias("ra"), F.col("n_shingles").alias("na"))
    right = regs.select(F.col("node").alias("b"), F.col("registers").alias("rb"), F.col("n_shingles").alias("nb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "ra", "rb", "na", "nb").mapInArrow(run, "a long, b long")


def _verify_pairs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of `pairs` (a, b) whose sets are similar enough. Only sets of their nodes are moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_steps(batches, 8 << 20):
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                s, t = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([s, t])
                both.sort()
                keep.append(bool(similar(int((both[1:] == both[:-1]).sum()), len(s), len(t), percent)))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(mask), b.column(1).filter(mask)], names=["a", "b"])

    of = lambda side: sets.join(pairs.select(F.col(side).alias("node")).distinct(), "node", "left_semi").select(F.col("node").alias(side), F.col("hashes").alias(f"h{side}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "ha", "hb").mapInArrow(run, "a long, b long").distinct()


def _blocks(members: DataFrame) -> DataFrame:
    """(bucket, block, side, node, component, probe) of `members` (bucket, node, component).

    A node stands in one block of its bucket, and outside of the largest component in one side as well; every block meets
    every side, so that a group holds about BLOCK nodes and BLOCK probes, however large the bucket is.
    """
    sizes = members.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    tops = sizes.groupBy("bucket").agg(F.max(F.struct("n", "component"))["component"].alias("top"), F.sum("n").alias("total"))
    odd = sizes.join(tops, "bucket").where("component <> top").groupBy("bucket").agg(F.sum("n").alias("odd"))
    ceil = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    rows = members.join(tops, "bucket").join(odd, "bucket").withColumns({"blocks": ceil("total"), "sides": ceil("odd")})
    part = lambda n: F.pmod(F.xxhash64("node", "bucket"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = rows.select("bucket", part("blocks").alias("block"), every("sides").alias("side"), "node", "component", F.lit(False).alias("probe"))
    probes = rows.where("component <> top").select("bucket", every("blocks").alias("block"), part("sides").alias("side"), "node", "component", F.lit(True).alias("probe"))
    return own.unionByName(probes)


GROUP = ["bucket", "block", "side"]


def _by_group(rows: DataFrame, columns: list[str], found: Callable[[list[tuple]], list[tuple]], schema: str) -> DataFrame:
    """`found` of each group's rows (node, component, probe, n_shingles, registers, and maybe hashes), a group's at a time.

    What is found gets the group's key before it.
    """
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [{"long": pa.int64(), "int": pa.int32()}[x.split()[1]] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group = None, []

        def batch(rows_: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows_], t) for k, t in enumerate(kinds)], names=names)

        def close() -> list[tuple]:
            return [(*key, *r) for r in found(group)] if group else []

        for b in text_steps(batches, 8 << 20):
            out: list[tuple] = []
            cols = [b.column(i).to_pylist() for i in range(7)]
            for i, (bucket, block, side, *row) in enumerate(zip(*cols, strict=True)):
                if (bucket, block, side) != key:
                    out += close()
                    key, group = (bucket, block, side), []
                arrays = [np.frombuffer(b.column(k)[i].as_buffer(), kind) for k, kind in zip(range(7, b.num_columns), (np.uint16, np.uint64), strict=False)]
                group.append((*row, *arrays))
            yield batch(out)
        yield batch(close())

    return rows.repartition(*GROUP).sortWithinPartitions(*GROUP).select(*GROUP, *columns).mapInArrow(run, schema)


def _hopeful(group: list[tuple], percent: int, least: float) -> Iterator[tuple[tuple, list[tuple]]]:
    """Each probe of a group with those of its nodes, of other components, that its registers may link it to."""
    own = [r for r in group if not r[2]]
    if not own:
        return
    regs, n = np.stack([r[4] for r in own]), np.array([r[3] for r in own])
    comp = np.array([r[1] for r in own])
    for p in (r for r in group if r[2]):
        might = np.flatnonzero((comp != p[1]) & (100 * np.minimum(n, p[3]) >= percent * np.maximum(n, p[3])))
        if len(might):
            might = might[estimates(regs[might], p[4][None], n[might], np.full(len(might), p[3])) >= least]
        if len(might):
            yield p, [own[i] for i in might]


def _verify_blocks(members: DataFrame, regs: DataFrame, sets: DataFrame, percent: int, least: float) -> DataFrame:
    """Links between different components inside buckets of `members` (bucket, node, component)."""
    each = materialize(_blocks(members), "blocks")
    columns = ["node", "component", "probe", "n_shingles", "registers"]

    def pairs(group: list[tuple]) -> list[tuple]:
        out: list[tuple] = []
        for p, nodes in _hopeful(group, percent, least):
            out += [(p[0], x[0]) for x in nodes]
            if len(out) > HOPEFUL * len(group):
                return [(None, None)]  # too many to be written
        return out

    def links(group: list[tuple]) -> list[tuple]:
        out = set()
        for p, nodes in _hopeful(group, percent, least):
            flat = np.concatenate([x[5] for x in nodes])
            at = np.minimum(np.searchsorted(p[5], flat), len(p[5]) - 1)
            lengths = np.array([len(x[5]) for x in nodes])
            common = np.add.reduceat((p[5][at] == flat).astype(np.int64), np.cumsum(lengths) - lengths)
            out.update((p[0], x[0]) for x, ok in zip(nodes, similar(common, lengths, len(p[5]), percent), strict=True) if ok)
        return list(out)

    schema = "bucket long, block int, side int, a long, b long"
    slim = regs.select("node", "registers", "n_shingles")
    found = materialize(_by_group(each.join(slim, "node"), columns, pairs, schema), "block-pairs")
    few = materialize(found.where("a is not null").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "few-pairs")
    full = each.join(found.where("a is null").select(*GROUP), GROUP, "left_semi").join(sets, "node")
    many = _by_group(full, [*columns, "hashes"], links, schema).select("a", "b").distinct()
    return _verify_pairs(few, sets, percent).unionByName(many)


def _salted(rows: DataFrame, nodes: DataFrame, big: list[int]) -> tuple[DataFrame, DataFrame]:
    """Both tables with a salt, so that rows of a set of many copies spread over SALTS keys.

    `big` are the places of such sets; nodes that stand there (by chance, too) are there once a salt.
    """
    there = F.pmod("set_a", F.lit(PLACES)).cast("int").isin(big)
    salt = F.when(there, F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).otherwise(0)
    salts = F.explode(F.when(there, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))
    return rows.withColumn("salt", salt), nodes.withColumn("salt", salts)


def _all_links(docs: DataFrame, nodes: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, b): links that connect `nodes` as all pairs of similar sets would."""
    least = percent / 100 - SLACK
    band = 2 * ROWS
    keys = F.array(*(F.xxhash64(F.lit(k), F.expr(f"substring(registers, {band * k + 1}, {band})")) for k in range(BANDS)))
    members = nodes.select("node", F.explode(keys).alias("bucket"))
    shared = members.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high")
    crowded = materialize(members.join(shared.select("bucket", "low"), "bucket"), "crowded")
    tries = crowded.where("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b")).distinct()
    regs = materialize(nodes.join(crowded.select("node").distinct(), "node", "left_semi"), "crowded-nodes")
    hopeful = materialize(_estimate_pairs(tries, regs, least), "hopeful")
    sets = _sets(docs, regs, words)
    links = materialize(_verify_pairs(hopeful, sets, percent), "links")

    first = connected_components(links)
    placed = crowded.join(first.withColumnRenamed("id", "node"), "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component"))
    mixed = placed.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("bucket")
    rest = materialize(placed.join(mixed, "bucket"), "mixed")
    more = _verify_blocks(rest, regs, sets, percent, least)
    return first.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more)


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row.

    Words are lower-cased in A-Z and cut at ASCII white space; a document is its set of distinct runs of `words`
    words, or of all its words if fewer. Documents link when 100 * intersection >= percent * union.

    A null or blank text has an empty set and links with nothing. Rows of one doc_id are one document: any of its texts
    can link it, and all that have shingles get one component. Repeated rows come back as often as they came. A row with
    a null doc_id links with nothing, has a null component, and is kept. Other columns are ignored. An empty table gives
    an empty result.
    """
    sigs = materialize(signatures(docs, words), "signatures")
    usable = sigs.where("n_shingles > 0 and doc_id is not null")
    nodes = materialize(usable.groupBy(*SET).agg(F.min("doc_id").alias("node"), F.count("*").alias("copies"), F.first("registers").alias("registers")), "nodes")

    links_at = scratch_path(docs.sparkSession, "all-links")
    with scratch_scope(docs.sparkSession):
        links = materialize(_all_links(docs, nodes, words, percent), "all-links", links_at)

    # a doc_id with several sets links their nodes
    several = usable.groupBy("doc_id").agg(F.min(F.struct(*SET)).alias("x"), F.max(F.struct(*SET)).alias("y")).where("x <> y").select("doc_id")
    own = usable.join(several, "doc_id").select("doc_id", *SET).join(nodes.select(*SET, "node"), SET).where("doc_id <> node")
    final = connected_components(links.unionByName(own.select(F.col("doc_id").alias("a"), F.col("node").alias("b"))))
    settled = nodes.join(final.withColumnRenamed("id", "node"), "node", "left").select(*SET, F.coalesce("component", "node").alias("component"))
    big = [r[0] for r in nodes.where(F.col("copies") >= COPIES).select(F.pmod("set_a", F.lit(PLACES)).cast("int")).distinct().collect()]  # PLACES numbers at most
    rows, settled = _salted(sigs.select("doc_id", *SET), settled, big)
    out = rows.join(settled, [*SET, "salt"], "left").select("doc_id", "n_shingles", F.coalesce(F.when(F.col("doc_id").isNotNull(), F.col("component")), "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op7_hyperminhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents by runs of four words, as `near_duplicates` has them."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=4, percent=80)
