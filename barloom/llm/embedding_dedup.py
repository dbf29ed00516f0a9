"""Embedding near-duplicates: random-hyperplane signs in several tables, exact cosines, connected components.

A table's key of a vector is its label and the signs of its products with BITS random normals. Pairs that share a key
in any table are candidates, met in blocks of about BLOCK vectors of a bucket. A block's members come with a sketch, their
first SKETCH signs, and pairs of too many different signs are dropped. Where few pairs are left, as nearly everywhere,
these come out, once however many tables they share, and meet their vectors in joins, in double precision.

Members of a block with more than HOPEFUL such pairs a vector are heavy. Pairs of two heavy vectors are compared inside the
blocks instead, with their vectors, and counted in the first table whose key they share; such blocks give sums and a
spanning forest of their links, never the pairs.

The number of bits follows the largest label (its binary logarithm and EXTRA_BITS), so that buckets stay small; the
number of tables follows from it so that a pair at the threshold is missed with a chance of MISSED.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import materialize
from barloom.llm.components import connected_components

BLOCK, EXTRA_BITS, MOST_BITS, MISSED, SEED = 256, 3, 28, 1e-5, 90210
#: Signs of a sketch, standard deviations over the threshold's mean number of different ones that a pair may have, and
#: hopeful pairs a vector up to which a block gives them out.
SKETCH, DEVIATIONS, HOPEFUL = 256, 5.5, 4
#: Members of a block up to which blocks are compared many at a time.
FEW = 8


def tables_for(largest: int, threshold: float) -> tuple[int, int]:
    """Bits of a key and number of tables for so many vectors of one label."""
    bits = min(MOST_BITS, max(6, math.ceil(math.log2(max(largest, 2))) + EXTRA_BITS))
    agree = (1 - math.acos(min(max(threshold, -1.0), 1.0)) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(MISSED) / math.log1p(-agree))) if agree < 1 else 1


def most_different(threshold: float) -> int:
    """Different signs of SKETCH that a pair at the threshold has at most, but for a chance far below MISSED."""
    p = math.acos(min(max(threshold, -1.0), 1.0)) / math.pi
    return math.ceil(SKETCH * p + DEVIATIONS * math.sqrt(SKETCH * p * (1 - p)))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(float)
    x /= np.abs(x).max(1, keepdims=True)  # no square under- or overflows
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _signs(x: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """(vectors, signs) of unit vectors, SKETCH of them at least; planes depend on the dimension alone."""
    planes = np.random.default_rng([SEED, x.shape[1]]).standard_normal((max(SKETCH, bits * tables), x.shape[1]))
    return x @ planes.T > 0


def _keys(signs: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """(vectors, tables) of int32 keys."""
    return (signs[:, : bits * tables].reshape(len(signs), tables, bits) * (1 << np.arange(bits))).sum(-1).astype(np.int32)


def _compare(x: np.ndarray, keys: np.ndarray, y: np.ndarray, other: np.ndarray, table: int, threshold: float) -> np.ndarray:
    """Which pairs link, share the key of `table`, and none of a table before it."""
    hit = (x @ y.T >= threshold) & (keys[:, None, table] == other[None, :, table])
    i, j = np.nonzero(hit)
    if table and len(i):
        for at in range(0, len(i), 1 << 16):
            some = slice(at, at + (1 << 16))
            seen = (keys[i[some], :table] == other[j[some], :table]).any(1)
            hit[i[some][seen], j[some][seen]] = False
    return hit


GROUP = ["bucket", "i", "j"]
PAIRS = "a long, b long"


def _hopeful_pairs(rows: DataFrame, most: int) -> DataFrame:
    """Pairs (a, b) of vectors in a common block whose sketches differ in `most` signs at most; or (a, null) for each
    member of a block with too many of them. `rows` has GROUP, mine, id and the sketch s0, s1, ..."""
    words = SKETCH // 64

    def pairs(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of rows (bucket, i, j, mine, id, sketch) of whole groups."""
        starts = np.flatnonzero(np.append(True, (part[1:, :3] != part[:-1, :3]).any(1)))
        sizes = np.diff(np.append(starts, len(part)))
        group = np.repeat(np.arange(len(starts)), sizes)
        a: list[np.ndarray] = []
        b: list[np.ndarray] = []

        def meet(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            fit = (part[x, 1] == part[x, 2]) | (part[x, 3] != part[y, 3])
            x, y = x[fit], y[fit]
            near = np.bitwise_count((part[x, 5:] ^ part[y, 5:]).view(np.uint64)).sum(1) <= most
            return np.stack([x[near], y[near]])

        small = np.flatnonzero(sizes[group] <= FEW)
        for d in range(1, FEW):
            x = small[small + d < len(part)]
            x = x[group[x] == group[x + d]]
            got = meet(x, x + d)
            a.append(got[0])
            b.append(got[1])
        for g in np.flatnonzero(sizes > FEW):
            place = np.arange(starts[g], starts[g] + sizes[g])
            found = [meet(np.full(len(place) - k - 1, p), place[k + 1 :]) for k, p in enumerate(place)]
            got = np.concatenate(found, axis=1)
            a.append(got[0])
            b.append(got[1])
        a_, b_ = np.concatenate(a), np.concatenate(b)
        heavy = np.bincount(group[a_], minlength=len(starts)) > HOPEFUL * sizes
        light = ~heavy[group[a_]]
        members = np.unique(part[heavy[group], 4])
        x, y = part[a_[light], 4], part[b_[light], 4]
        return np.concatenate([np.minimum(x, y), members]), np.concatenate([np.maximum(x, y), np.full(len(members), -1)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((0, 5 + words), np.int64)

        def out(part: np.ndarray) -> pa.RecordBatch:
            a, b = pairs(part) if len(part) else (np.empty(0, np.int64),) * 2
            one = np.unique(np.stack([a, b]), axis=1) if len(a) else np.empty((2, 0), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(one[0]), pa.array(one[1], mask=one[1] < 0)], names=["a", "b"])

        for batch in batches:
            held = np.concatenate([held, np.stack([c.to_numpy().astype(np.int64) for c in batch.columns], axis=1)])
            if len(held):  # the last group may go on in the next batch
                last = np.flatnonzero((held[:, :3] != held[-1, :3]).any(1))
                cut = last[-1] + 1 if len(last) else 0
                yield out(held[:cut])
                held = held[cut:]
        yield out(held)

    columns = [*GROUP, "mine", "id", *(f"s{k}" for k in range(words))]
    return rows.select(*columns).repartition(*GROUP).sortWithinPartitions(*GROUP).mapInArrow(run, PAIRS)


def _linked(pairs: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of those `pairs` whose cosine reaches the threshold; only vectors of their ids are moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                b = batch.slice(at, 4096)
                keep = np.zeros(b.num_rows, bool)
                sizes = [b.column(k).value_lengths().to_numpy() for k in (2, 3)]
                ends = [np.cumsum(n) for n in sizes]
                flat = [b.column(k).flatten().to_numpy() for k in (2, 3)]
                for size in np.unique(sizes[0]):
                    k = np.flatnonzero((sizes[0] == size) & (sizes[1] == size))
                    if len(k):
                        u, w = (_unit(f[(e[k] - size)[:, None] + np.arange(size)]) for f, e in zip(flat, ends, strict=True))
                        keep[k] = (u * w).sum(1) >= threshold
                mask = pa.array(keep)
                yield pa.RecordBatch.from_arrays([b.column(0).filter(mask), b.column(1).filter(mask)], names=["a", "b"])

    of = lambda side: vectors.join(pairs.select(F.col(side).alias("id")).distinct(), "id", "left_semi").select(F.col("id").alias(side), F.col("x").alias(f"x{side}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "xa", "xb").mapInArrow(run, PAIRS)


def near_duplicate_vectors(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row.

    Rows link when their labels are equal and not null, their vectors are equally long and their cosine is at least
    `threshold`. Null, empty and zero vectors and those with a null, NaN or infinite component link with nothing, and
    neither does a row with a null vec_id. Equal vectors of one label are one node and link with each other;
    repeated rows count and come back each, and rows of one vec_id with different vectors are vectors of their own. Other columns are ignored. An empty table gives an empty result.
    """
    kind = vectors.schema["embedding"].dataType.elementType.simpleString()
    x = F.col("x")
    finite = ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists(x, lambda v: v != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast(f"array<{kind if kind in ('float', 'double') else 'double'}>").alias("x"))
    rows = rows.withColumn("usable", F.coalesce(finite & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.lit(False)))
    # two hashes tell a label's vectors apart; rows are joined by them, not by whole vectors
    hashes = [F.when(F.col("usable"), F.xxhash64(F.lit(k), "label", "x")).alias(f"h{k}") for k in (1, 2)]
    marks = materialize(rows.select("vec_id", "usable", *hashes), "vector-marks")
    keys = ["h1", "h2"]
    good = rows.where("usable").select("vec_id", "label", "x", *hashes)
    nodes = good.groupBy(*keys).agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"), F.first(F.struct("label", "x")).alias("v")).select(*keys, "node", "copies", "v.*")
    nodes = materialize(nodes.withColumn("id", F.monotonically_increasing_id()), "vectors")
    largest = nodes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    bits, tables = tables_for(largest, threshold)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                b = batch.slice(at, 2048)
                vecs = b.column(2).to_pylist()
                keys_: list = [None] * len(vecs)
                sketch = np.zeros((len(vecs), SKETCH // 64), np.int64)
                for size in {len(v) for v in vecs}:
                    k = [i for i, v in enumerate(vecs) if len(v) == size]
                    signs = _signs(_unit(np.array([vecs[i] for i in k])), bits, tables)
                    sketch[k] = np.packbits(signs[:, :SKETCH], axis=1).view(np.int64)
                    for i, row in zip(k, _keys(signs, bits, tables), strict=True):
                        keys_[i] = row.tobytes()
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(keys_, pa.binary()), *(pa.array(c) for c in sketch.T.copy())], names=["id", "place", "keys", *(f"s{k}" for k in range(SKETCH // 64))])

    sketches = ", ".join(f"s{k} long" for k in range(SKETCH // 64))
    signed = materialize(nodes.select("id", F.xxhash64("label", F.size("x")).alias("place"), "x").mapInArrow(sign, f"id long, place long, keys binary, {sketches}"), "signed")
    # a bucket's number holds its table, and 40 bits of a hash of the rest; vectors that meet by chance are told apart later
    width = max(1, (tables - 1).bit_length())
    bucket = lambda t: F.shiftleft(F.shiftrightunsigned(F.xxhash64(F.lit(t), "place", F.expr(f"substring(keys, {4 * t + 1}, 4)")), 24), width).bitwiseOR(F.lit(t).cast("long"))
    members = signed.select("id", F.explode(F.array(*(bucket(t) for t in range(tables)))).alias("bucket"))
    full = members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    crowded = members.join(full, "bucket").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("mine", F.pmod(F.xxhash64("id", "bucket"), "blocks").cast("int"))
    # block pairs (i, j) with i <= j: a vector of block i meets every block, itself included
    meets = crowded.select("id", "bucket", "mine", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with"))
    groups = materialize(meets.select("id", "bucket", F.least("mine", "with").alias("i"), F.greatest("mine", "with").alias("j"), "mine"), "vector-blocks")
    found = materialize(_hopeful_pairs(groups.join(signed.drop("keys", "place"), "id"), most_different(threshold)), "hopeful-vectors")
    heavy = materialize(found.where("b is null").select("a").distinct(), "heavy-vectors")
    is_heavy = lambda side: heavy.select(F.col("a").alias(side), F.lit(True).alias(f"heavy_{side}"))
    light = found.where("b is not null").distinct().join(is_heavy("a"), "a", "left").join(is_heavy("b"), "b", "left").where("heavy_a is null or heavy_b is null").select("a", "b")
    # vectors of different labels that met by chance go: their hashes' place differs
    place = lambda side: signed.select(F.col("id").alias(side), F.col("place").alias(f"place_{side}"))
    light = materialize(light.join(place("a"), "a").join(place("b"), "b").where("place_a = place_b").select("a", "b"), "light-pairs")
    pairs = materialize(_linked(light, nodes.select("id", "x"), threshold), "linked-vectors")

    each = groups.join(heavy.select(F.col("a").alias("id")), "id", "left_semi").join(signed.select("id", "place", "keys"), "id").join(nodes.select("id", "x", "copies"), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group = None, []

        def found() -> list[tuple[int, int, int]]:
            """(id, copies of linked vectors, least linked id) of a block pair's members with links."""
            if not group:
                return []
            table, i, j = now[0] & ((1 << width) - 1), now[1], now[2]
            out: list[tuple[int, int, int]] = []
            for kind in {(r[5], len(r[3])) for r in group}:
                rows_ = [r for r in group if (r[5], len(r[3])) == kind]
                left = [r for r in rows_ if r[1] == i]
                right = left if i == j else [r for r in rows_ if r[1] == j]
                if left and right:
                    out += links(left, right, table, i == j)
            return out

        def links(left: list[tuple], right: list[tuple], table: int, same: bool) -> list[tuple[int, int, int]]:
            part = lambda rows: (_unit(np.array([r[3] for r in rows])), np.stack([r[2] for r in rows]), np.array([r[4] for r in rows]), np.array([r[0] for r in rows]))
            (x, kx, cx, nx), (y, ky, cy, ny) = part(left), part(right)
            hit = _compare(x, kx, y, ky, table, threshold)
            if same:
                np.fill_diagonal(hit, False)
            out = []
            for mine, hits, weights in ((nx, hit, cy), (ny, hit.T, cx))[: 1 if same else 2]:
                sums = hits @ weights
                out += [(int(mine[k]), int(sums[k])) for k in np.flatnonzero(hits.any(1))]
            if not out:
                return []
            # the block's links among themselves: a forest by repeated least labels, so that no link is lost
            ids = nx if same else np.concatenate([nx, ny])
            low = ids.copy()
            a, b = np.nonzero(hit)
            b = b + (0 if same else len(nx))
            while len(a):
                least = np.minimum(low[a], low[b])
                before = low.copy()
                np.minimum.at(low, a, least)
                np.minimum.at(low, b, least)
                if (before == low).all():
                    break
            forest = dict(zip(ids.tolist(), low.tolist(), strict=True))
            return [(n, s, forest[n]) for n, s in out]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], names=["id", "links", "low"])

        for b in batches:
            rows: list[tuple] = []
            bucket_, i_, j_, mine, id_, place_, copies, vec = (b.column(k).to_pylist() for k in (0, 1, 2, 3, 4, 5, 6, 8))
            for r, key in enumerate(zip(bucket_, i_, j_, strict=True)):
                if key != now:
                    rows += found()
                    now, group = key, []
                group.append((id_[r], mine[r], np.frombuffer(b.column(7)[r].as_buffer(), np.int32), vec[r], copies[r], place_[r]))
            yield batch(rows)
        yield batch(found())

    ordered = each.repartition(*GROUP).sortWithinPartitions(*GROUP).select(*GROUP, "mine", "id", "place", "copies", "keys", "x")
    many = materialize(ordered.mapInArrow(run, "id long, links long, low long"), "vector-links")
    copies = nodes.select(F.col("id").alias("b"), "copies")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).join(copies, "b").select(F.col("a").alias("id"), F.col("copies").alias("links"))
    counts = both.unionByName(many.select("id", "links")).groupBy("id").agg(F.sum("links").alias("links"))
    final = connected_components(pairs.unionByName(many.select(F.col("id").alias("a"), F.col("low").alias("b"))))

    # a component's number is its least vec_id
    settled = nodes.select("id", *keys, "node", "copies").join(counts, "id", "left").join(final.withColumnRenamed("component", "c"), "id", "left")
    settled = settled.select(*keys, "node", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("c", "id").alias("c"))
    settled = materialize(settled, "settled-vectors")
    least = settled.groupBy("c").agg(F.min("node").alias("component"))
    known = settled.join(least, "c").select(*keys, "links", "component")
    out = marks.join(known, keys, "left").select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op9_hyperplane_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings of equal labels; rows without a usable vector link with nothing."""
    return near_duplicate_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 0.93)
