"""Brown class-based bigram scoring: P(word | previous) = P(class | previous class) * P(word | class).

Every training word that occurs EVIDENCE times or more gets its class by exchange clustering. The HEAD most frequent ones
seed the classes; these are split into more as the vocabulary grows, and then all words move in parallel rounds on Spark:
each word's neighbours over all training text are kept together, and it goes to the class that raises the corpus's
likelihood most. As many move at once, gains are weighed with counts of chance, or all would go to the smallest classes. Only words with fewer occurrences, and unseen ones, are classed by their endings. Their emissions are
smoothed so that each ending's class has room for unseen words, and the model is mixed with smoothed unigrams; both parts
sum to one over all words and the end of text.

Ids of the WORDS most frequent words (a bounded table) are broadcast; the other tokens meet theirs in one join. Classes
are broadcast as two bytes a clustered word.
"""

from __future__ import annotations

import hashlib
import pickle
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import doc_hash, materialize, remove, scratch_path, text_steps, texts_of

#: Words that seed the classes, the seeds, classes of endings, words in the broadcast table, and the length from which a
#: word stands there by its hash.
HEAD, CLASSES, ENDINGS, WORDS, LONGEST = 6000, 64, 32, 150_000, 64
#: Occurrences from which a word is clustered; rounds of the seeds; rounds of all words at most, and the share of words
#: that have to move in two of them for more.
EVIDENCE, ROUNDS, MOVES, FEW = 4, 5, 10, 0.01
#: Tokens that a task gathers before it counts their pairs, pairs in a bucket (about), and cells of a step of `assign`.
PAIR_TOKENS, BUCKET_PAIRS, CELLS = 4 << 20, 2 << 20, 1 << 18
#: Counts of chance, as a share of all, that moves are weighed with.
BACKGROUND = 0.5
#: Counts of a neighbour's class whose gains are looked up, and cells of that table: fewer counts where there are many classes.
LOOKED_UP, LOOKUP_CELLS = 8, 16 << 20
#: Counts of a word on one side below which their losses are looked up, and cells of a step of `best_classes`, which stay in a core's cache.
TAKEN, STEP_CELLS = 64, 1 << 19
#: Classes per seed at most, so that a task's tables stay below 250 MB however large the vocabulary is.
MOST_SPLIT = 32
#: Weight of the unigrams, and prior counts of a class transition.
MIX, PRIOR = 0.1, 5.0
FLUSH = 250_000
END = ""
#: Ids: words of the head, then the end of text, then endings; as classes: CLASSES, then the end, then endings.
END_ID, IDS = HEAD, HEAD + 1 + ENDINGS
KINDS = CLASSES + 1 + ENDINGS


def words_of(text: str) -> list[bytes]:
    """Words in lower case: bytes.lower and bytes.split take exactly A-Z and ASCII's six white space characters."""
    return text.encode().lower().split()


def ending(word: bytes) -> int:
    return zlib.crc32(word.rstrip(b".,;:!?\"')]}")[-2:]) % ENDINGS


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n): how often each word stands in all texts; the empty word is the end of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([w.decode() for w in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
            counts.clear()
            return out

        for b in text_steps(batches):
            for t in texts_of(b):
                counts.update(words_of(t))
                if len(counts) > FLUSH:
                    yield flush()
            counts[b""] += b.num_rows
        if counts:
            yield flush()

    return docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(vocabulary: DataFrame, most: int) -> list:
    """The most frequent words, at most so many, and all of one count or none; by count, then by word.

    The least count comes from a histogram (exact up to 1024, then 64 bins to a doubling), so that the driver gets
    no more than the result.
    """
    level = F.when(F.col("n") < 1024, F.col("n")).otherwise(1024 + F.floor((F.log2(F.col("n").cast("double")) - 10) * 64)).cast("long")
    levels = vocabulary.withColumn("level", level)
    least, sum_ = None, 0
    for r in sorted(levels.groupBy("level").count().collect(), key=lambda r: -r["level"]):
        sum_ += r["count"]
        if sum_ > most:
            break
        least = r["level"]
    if least is None:
        return []
    return sorted(levels.where(F.col("level") >= least).select("word", "n").collect(), key=lambda r: (-r["n"], r["word"]))


def _key(word: bytes) -> bytes:
    """A word in the broadcast table: itself, or its hash if it is long."""
    return word if len(word) <= LONGEST else b"#" + hashlib.sha256(word).hexdigest().encode() + b"#"


def _pack(x: np.ndarray) -> bytes:
    return pa.compress(x.tobytes(), codec="zstd", asbytes=True) if len(x) else b""


def _unpack(raw: bytes | None, kind: str, n: int) -> np.ndarray:
    """`n` numbers of `kind` that _pack wrote."""
    return np.frombuffer(pa.decompress(raw, n * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind) if n else np.empty(0, kind)


class Ids:
    """Ids of words: the broadcast ones, the end of text, rare words by ending and count, then other clustered words."""

    def __init__(self, known: int) -> None:
        self.known = self.end = known
        self.rare = known + 1
        self.more = self.rare + ENDINGS * EVIDENCE

    def low(self, tails: np.ndarray) -> np.ndarray:
        """Numbers below IDS by id: the head's own, the end, or an ending; `tails` are those of known and other words."""
        rare = np.repeat(np.arange(ENDINGS), EVIDENCE)
        out = END_ID + 1 + np.concatenate([tails[: self.known], [-1], rare, tails[self.known :]])
        head = min(HEAD, self.known)
        out[:head] = np.arange(head)
        return out.astype(np.int32)


def other_words(vocabulary: DataFrame, known: DataFrame, ids: Ids) -> tuple[DataFrame, np.ndarray]:
    """(word, n, id) of clustered words that aren't known, and their endings in the order of ids."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            ends = [ending(w.encode()) for w in b.column(0).to_pylist()]
            k = b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * k, pa.int32()), pa.array(range(at, at + k), pa.int64()), pa.array(ends, pa.int32())], names=["word", "n", "part", "i", "ending"])
            at += k

    rows = vocabulary.where((F.col("n") >= EVIDENCE) & (F.col("word") != END)).withColumn("key", _key_column()).join(known, "key", "left_anti").select("word", "n")
    rows = materialize(rows.mapInArrow(number, "word string, n long, part int, i long, ending int"), "brown-words")
    first, starts = 0, []
    for r in sorted(rows.groupBy("part").count().collect()):
        starts.append((r["part"], first))
        first += r["count"]
    starts = vocabulary.sparkSession.createDataFrame(starts, "part int, first long")
    out = rows.join(F.broadcast(starts), "part").select("word", "n", (F.col("first") + F.col("i") + ids.more).cast("int").alias("id"), "ending")
    ends = np.zeros(first, np.int8)  # a byte a word

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.column(0).to_numpy().astype("<i4").tobytes()]), pa.array([b.column(1).to_numpy().astype("i1").tobytes()])], names=["id", "ending"])

    for r in out.select("id", "ending").mapInArrow(blocks, "id binary, ending binary").collect():
        ends[np.frombuffer(bytes(r["id"]), "<i4") - ids.more] = np.frombuffer(bytes(r["ending"]), "i1")
    return out.drop("ending"), ends


def _key_column() -> F.Column:
    return F.when(F.octet_length("word") <= LONGEST, F.col("word")).otherwise(F.concat(F.lit("#"), F.sha2(F.col("word").cast("binary"), 256), F.lit("#")))


CODED = "row long, doc_id long, held_out boolean, training boolean, length int, ids binary, missing array<string>"
STITCHED = "doc_id long, held_out boolean, training boolean, length int, ids binary, more int, counts binary"


def encode(docs: DataFrame, words: dict[bytes, int], others: DataFrame, vocabulary: DataFrame, ids: Ids) -> DataFrame:
    """STITCHED: each text's ids, and the counts of those of its words that aren't known, in their order.

    `docs` has doc_id, held_out, training and text.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(pickle.dumps(words))  # at most WORDS keys of LONGEST + 2 bytes

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = pickle.loads(shared.value).get
        row = TaskContext.get().partitionId() << 40
        for b in text_steps(batches, 4 << 20):
            out: list[tuple] = []
            for t in texts_of(b):
                ws = words_of(t)
                at = np.fromiter(map(get, ws, repeat(-1)), np.int32, len(ws))
                missing = []
                for i in np.flatnonzero(at < 0).tolist():
                    w = ws[i]
                    if len(w) > LONGEST:
                        at[i] = get(_key(w), -1)
                    if at[i] < 0:
                        missing.append(w.decode())
                out.append((row, len(at), _pack(at), missing))
                row += 1
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *b.columns[:3], pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.list_(pa.string()))], names=[x.split()[0] for x in CODED.split(", ")])

    coded_at = scratch_path(spark, "brown-coded")
    coded = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", "training", "text").mapInArrow(code, CODED), "brown-coded", coded_at)

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, int] = {}
        for b in batches:
            if len(cache) > FLUSH:
                cache = {}
            n, at = b.column(3).to_pylist(), b.column(4).to_pylist()
            for i, w in enumerate(b.column(2).to_pylist()):
                if at[i] is None:
                    e = cache.get(w)
                    if e is None:
                        cache[w] = e = ending(w.encode())
                    at[i] = ids.rare + e * EVIDENCE + n[i]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(at, pa.int32()), b.column(3)], names=["row", "pos", "id", "n"])

    each = coded.select("row", F.posexplode("missing").alias("pos", "word"))
    table_ = vocabulary.where((F.col("n") < EVIDENCE) & (F.col("word") != END)).select("word", "n", F.lit(None).cast("int").alias("id")).unionByName(others)
    met = each.join(table_, "word", "left").select("row", "pos", "word", F.coalesce("n", F.lit(0)).alias("n"), "id")
    found = met.mapInArrow(rare, "row long, pos int, id int, n long").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("pos", "id", "n"))).alias("found"))

    def stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_steps(batches, 4 << 20):
            blobs, more, counts = [], [], []
            for raw, n, f, m in zip(*(b.column(i).to_pylist() for i in (4, 3, 5, 6)), strict=True):
                at = _unpack(raw, "<i4", n).copy()
                at[at < 0] = f or []
                blobs.append(_pack(at))
                more.append(len(m or []))
                counts.append(_pack(np.array(m or [], "<i8")))
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(blobs, pa.binary()), pa.array(more, pa.int32()), pa.array(counts, pa.binary())], names=[x.split()[0] for x in STITCHED.split(", ")])

    whole = coded.drop("missing").join(found, "row", "left").select("doc_id", "held_out", "training", "length", "ids", F.col("found.id").alias("found"), F.col("found.n").alias("n"))
    out = materialize(whole.mapInArrow(stitch, STITCHED), "brown-ids")
    remove(spark, coded_at)
    return out


def _streams(batches: Iterator[pa.RecordBatch], end: int, limit: int = 1 << 20) -> Iterator[np.ndarray]:
    """Ids of texts one after another (length, ids), with `end` before, between and after them."""
    for b in text_steps(batches, limit):
        parts = [np.array([end], "<i4")]
        for n, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            parts += [_unpack(raw, "<i4", n), parts[0]]
        yield np.concatenate(parts)


def neighbours(edges: DataFrame, kinds: np.ndarray, low: np.ndarray) -> np.ndarray:
    """(IDS, 2, KINDS): how often each class stands before and after each number of `low`; before, of the head's words only."""
    shared = edges.sparkSession.sparkContext.broadcast((kinds, low))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, low_ = shared.value
        each, low_ = kind[low_].astype(np.int64), low_.astype(np.int64)
        total = np.zeros((2, IDS * KINDS))
        for b in batches:
            for raw in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                code, n = _read_pairs(*raw)
                word, after = low_[code >> 32], (code >> 31) & 1 == 1
                cell = word * KINDS + each[code & 0x7FFFFFFF]
                for side, some in enumerate((~after & (word < HEAD), after)):
                    total[side] += np.bincount(cell[some], n[some], IDS * KINDS)
        both = np.ascontiguousarray(total.astype(np.int64).reshape(2, IDS, KINDS).transpose(1, 0, 2))
        used = np.flatnonzero(both.any((1, 2)))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([both[i].tobytes() for i in used], pa.binary())], names=["id", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}  # at most IDS of them
        for b in batches:
            for i, c in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                sums[i] = sums.get(i, 0) + np.frombuffer(c.as_buffer(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["id", "counts"])

    schema = "id int, counts binary"
    out = np.zeros((IDS, 2, KINDS), np.int64)
    for r in edges.mapInArrow(count, schema).repartition("id").mapInArrow(add, schema).collect():  # IDS rows at most
        out[r["id"]] = np.frombuffer(bytes(r["counts"]), np.int64).reshape(2, KINDS)
    return out


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.where(x > 0, x, 1))


def exchange(counts: np.ndarray, kinds: np.ndarray, movable: np.ndarray) -> np.ndarray:
    """Kinds after moving each movable word to the class that makes the classes' likelihood largest."""
    kinds = kinds.copy()
    table = np.zeros((KINDS, KINDS))
    np.add.at(table, kinds, counts[:, 1].astype(float))
    sums = table.sum(1)
    for w in movable:
        before, after = counts[w].astype(float)
        n = after.sum()
        if not n:
            continue
        a = kinds[w]
        table[a] -= after
        table[:, a] -= before
        sums[a] -= n
        np.maximum(table[a], 0, out=table[a])
        np.maximum(table[:, a], 0, out=table[:, a])
        rows, cols = table[:CLASSES], table[:, :CLASSES].T
        some, others = np.flatnonzero(after), np.flatnonzero(before)
        gain = (_xlogx(rows[:, some] + after[some]) - _xlogx(rows[:, some])).sum(1) + (_xlogx(cols[:, others] + before[others]) - _xlogx(cols[:, others])).sum(1)
        gain -= 2 * (_xlogx(np.maximum(sums[:CLASSES], 0) + n) - _xlogx(np.maximum(sums[:CLASSES], 0)))
        b = int(gain.argmax())
        kinds[w] = b
        table[b] += after
        table[:, b] += before
        sums[b] += n
    return kinds


def seed(edges: DataFrame, size: int, low: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Classes of the `size` words of the head after `rounds` of exchange; the first ones go by rank."""
    kinds = np.concatenate([np.arange(HEAD) % CLASSES, np.arange(CLASSES, KINDS)]).astype(np.int32)
    for k in range(rounds):
        counts = neighbours(edges, kinds, low)
        # neighbours' classes are those of the last count, so only every other word moves at once
        kinds = exchange(counts, kinds, np.arange(k % 2, size, 2) if k else np.arange(size))
    return kinds[:size]


def pairs(texts: DataFrame, ids: Ids, tokens: int, path: str) -> DataFrame:
    """(n, codes, counts), a table in `path`: each word's neighbours over all of `texts`, a word's all in one row.

    A code is word << 32 | side << 31 | neighbour; side 1 is after. Of the end of text and rare words only what follows
    is there, dealt by the follower.
    """
    buckets = max(1, -(-tokens // BUCKET_PAIRS))

    def sums(code: np.ndarray, n: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        order = None if n is None else np.argsort(code)
        code = np.sort(code) if n is None else code[order]
        first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
        return code[first], np.diff(np.append(first, len(code))) if n is None else np.add.reduceat(n[order], first)

    def write(code: np.ndarray, n: np.ndarray) -> tuple[int, bytes, bytes]:
        return len(code), _pack(np.concatenate([(code >> 32).astype("<u4"), (code & 0xFFFFFFFF).astype("<u4")])), _pack(n.astype("<i8"))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            stream = np.concatenate(kept).astype(np.int64)  # texts end with the end, so that two of them meet between slices
            kept.clear()
            left, right = stream[:-1], stream[1:]
            real = (left != ids.end) | (right != -1)
            left, right = left[real & (left >= 0)], right[real & (left >= 0)]
            code, n = sums(np.concatenate([left << 32 | 1 << 31 | right, right[_movable(right, ids)] << 32 | left[_movable(right, ids)]]), None)
            word = code >> 32
            at = np.where(_movable(word, ids), word, code & 0x7FFFFFFF) % buckets
            order = np.argsort(at.astype(np.uint16) if buckets <= 1 << 16 else at, kind="stable")  # sixteen bits are sorted by radix
            code, n, at = code[order], n[order], at[order]
            first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
            out = [(int(at[a]), *write(code[a:b], n[a:b])) for a, b in zip(first, np.append(first[1:], len(at)), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "n", "codes", "counts"])

        held = 0
        for stream in _streams(batches, ids.end):
            kept += [stream, np.array([-1], "<i4")]  # no pair goes over a slice's end
            held += len(stream)
            if held > PAIR_TOKENS:
                yield from flush()
                held = 0
        if held:
            yield from flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        last = None

        def flush() -> pa.RecordBatch:
            code, n = sums(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
            parts.clear()
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(write(code, n), (pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["n", "codes", "counts"])

        for b in batches:
            for bucket, *raw in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if parts and bucket != last:
                    yield flush()
                last = bucket
                parts.append(_read_pairs(*raw))
                if sum(len(p[0]) for p in parts[1:]) > len(parts[0][0]) + BUCKET_PAIRS:
                    parts[:] = [sums(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))]
        if parts:
            yield flush()

    blobs = texts.select("length", "ids").mapInArrow(gather, "bucket int, n long, codes binary, counts binary")
    return materialize(blobs.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(merge, "n long, codes binary, counts binary"), "brown-pairs", path)


def _read_pairs(n: int, codes: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    halves = _unpack(codes, "<u4", 2 * n).astype(np.int64)
    return halves[:n] << 32 | halves[n:], _unpack(counts, "<i8", n)


def _movable(word: np.ndarray, ids: Ids) -> np.ndarray:
    return (word < ids.known) | (word >= ids.more)


def transitions(edges: DataFrame, kinds: np.ndarray, size: int) -> np.ndarray:
    """(size, size): how often each class follows each."""
    shared = edges.sparkSession.sparkContext.broadcast(kinds)  # two bytes a word

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, out = shared.value, np.zeros(size * size)
        for b in batches:
            for raw in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                code, n = _read_pairs(*raw)
                after = (code >> 31) & 1 == 1
                code, n = code[after], n[after]
                out += np.bincount(kind[code >> 32].astype(np.int64) * size + kind[code & 0x7FFFFFFF], n, size * size)
        row = out.reshape(size, size)
        used = np.flatnonzero(row.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([row[i].astype("<f8").tobytes() for i in used], pa.binary())], names=["kind", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[int, np.ndarray] = {}  # at most `size` of them
        for b in batches:
            for k, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows[k] = rows.get(k, 0) + np.frombuffer(raw, "<f8")
        yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.int32()), pa.array([x.tobytes() for x in rows.values()], pa.binary())], names=["kind", "n"])

    out = np.zeros((size, size))
    for r in edges.mapInArrow(count, "kind int, n binary").repartition("kind").mapInArrow(add, "kind int, n binary").collect():  # size rows
        out[r["kind"]] = np.frombuffer(bytes(r["n"]), "<f8")
    return out


def likelihood(table: np.ndarray) -> float:
    return float(_xlogx(table).sum() - _xlogx(table.sum(0)).sum() - _xlogx(table.sum(1)).sum())


class Gains:
    """What a word's neighbours gain in each class, made once a task: `both` counts by side (0: before), class, and neighbour's class."""

    def __init__(self, table: np.ndarray, classes: int) -> None:
        self.size, self.classes = len(table), classes
        self.both = np.stack([table[:, :classes].T, table[:classes]])
        self.sums = self.both.sum(2)
        #: The same by side, neighbour's class and class, and its logarithms.
        self.rows = np.ascontiguousarray(self.both.transpose(0, 2, 1))
        self.plain = _xlogx(self.rows)
        #: What a word of so many counts on a side loses in each class; counts from TAKEN on take the zeros in the last row.
        self.taken = [np.append(self.takes(s, np.arange(TAKEN)), np.zeros((1, classes)), axis=0) for s in range(2)]
        rows = 2 * self.size
        self.most = max(1, min(LOOKED_UP, LOOKUP_CELLS // max(rows * classes, 1)))
        #: Gains by count, side and neighbour's class; counts above `most` take the zeros in the last row.
        self.looked = np.zeros((self.most * rows + 1, classes), np.float32)
        for a in range(1, self.most + 1):
            self.looked[(a - 1) * rows : a * rows] = (_xlogx(self.rows + a) - self.plain).reshape(-1, classes)

    def takes(self, side: int, counts: np.ndarray) -> np.ndarray:
        return _xlogx(self.sums[side] + counts[:, None]) - _xlogx(self.sums[side])

    def sums_of(self, rows: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Sums of the looked-up rows between each two of `bounds`, those of as many rows together."""
        counts, out = np.diff(bounds), np.zeros((len(bounds) - 1, self.classes))
        order = np.argsort(counts, kind="stable")
        sizes, first = np.unique(counts[order], return_index=True)
        for m, a, b in zip(sizes.tolist(), first.tolist(), [*first[1:].tolist(), len(order)], strict=True):
            step = max(1, CELLS // max(m * self.classes, 1))
            for i in range(a, b, step):
                some = order[i : min(i + step, b)]
                out[some] = self.looked.take(rows[bounds[some][:, None] + np.arange(m)], axis=0).sum(1)
        return out


def best_classes(words: np.ndarray, side: np.ndarray, kind: np.ndarray, n: np.ndarray, own: np.ndarray, gains: Gains, names: np.ndarray) -> np.ndarray:
    """The class of each word that raises the likelihood most; entries (words, side, kind, n) are sorted by word from 0.

    `own` are the words' present classes; one from `classes` on is no class to stay in. As all move at once, each may
    take only one of the empty classes, by its id in `names`, or all would take the first.
    """
    both, sums, looked, classes = gains.both, gains.sums, gains.looked, gains.classes
    rows = np.where(n > gains.most, len(looked) - 1, ((n - 1) * 2 + side) * gains.size + kind)
    empty = np.flatnonzero(sums.sum(0) == 0)
    out = own.copy()
    bounds = np.searchsorted(words, np.arange(len(own) + 1))
    at = 0
    while at < len(own):
        to = min(len(own), at + max(1, STEP_CELLS // classes))
        e = slice(bounds[at], bounds[to])
        w, d, k, a = words[e] - at, side[e], kind[e], n[e]
        total = gains.sums_of(rows[e], bounds[at : to + 1] - bounds[at])
        every = np.flatnonzero(a > gains.most)
        for big in np.split(every, np.arange(0, len(every), max(1, CELLS // classes))[1:]) if len(every) else ():
            first = np.flatnonzero(np.diff(w[big], prepend=-1))
            total[w[big][first]] += np.add.reduceat(_xlogx(gains.rows[d[big], k[big]] + a[big, None]) - gains.plain[d[big], k[big]], first, axis=0)
        settled = np.flatnonzero(own[at:to] < classes)
        present = own[at:to][settled]
        # in its own class a word's counts are there already
        stay = np.flatnonzero(own[at:to][w] < classes)
        x = both[d[stay], own[at:to][w[stay]], k[stay]]
        less = 2 * _xlogx(x) - _xlogx(np.maximum(x - a[stay], 0)) - _xlogx(x + a[stay])
        total[settled, present] += np.bincount(w[stay], less, to - at)[settled]
        for s in range(2):
            m = np.bincount(w[d == s], a[d == s], to - at)
            total -= gains.taken[s].take(np.minimum(m, TAKEN).astype(np.int64), axis=0)
            large = np.flatnonzero(m >= TAKEN)
            if len(large):
                sizes, which = np.unique(m[large], return_inverse=True)
                total[large] -= gains.takes(s, sizes)[which]
            x, m = sums[s][present], m[settled]
            total[settled, present] -= 2 * _xlogx(x) - _xlogx(np.maximum(x - m, 0)) - _xlogx(x + m)
        # a class that stands both before and after the word: both counts go to one cell
        key, prior, later = w * classes + k, np.flatnonzero((d == 0) & (k < classes)), np.flatnonzero((d == 1) & (k < classes))
        twice, y, z = np.intersect1d(key[prior], key[later], assume_unique=True, return_indices=True)
        i, c, y, z = twice // classes, twice % classes, a[prior][y], a[later][z]
        x = both[1][c, c]
        sign = np.where(own[at:to][i] == c, -1, 1)
        y, z = sign * y, sign * z
        total[i, c] += sign * (_xlogx(np.maximum(x + y + z, 0)) - _xlogx(np.maximum(x + y, 0)) - _xlogx(np.maximum(x + z, 0)) + _xlogx(x))
        if len(empty):
            i, c = np.arange(to - at), empty[names[at:to] * 2654435761 % 2**32 % len(empty)]
            one = total[i, c]
            total[:, empty] = -np.inf
            total[i, c] = one
        out[at:to] = total.argmax(1)
        at = to
    return out


def with_background(table: np.ndarray) -> np.ndarray:
    """`table` and BACKGROUND of its counts once more, dealt as if kinds followed each other by chance.

    To a class of few words any word would seem a gain, and all that move at once would go there, where they lose.
    """
    share = (table.sum(0) / max(table.sum(), 1) + 1 / len(table)) / 2
    return table + BACKGROUND * table.sum() * np.outer(share, share)


def assign(edges: DataFrame, kinds: np.ndarray, table: np.ndarray, classes: int, ids: Ids, turn: tuple[int, int] | None) -> tuple[np.ndarray, int]:
    """Kinds after the words whose turn it is have moved (all that have no class yet, without one), and how many moved."""
    size = len(table)
    shared = edges.sparkSession.sparkContext.broadcast((kinds, with_background(table)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, table_ = shared.value
        gains = Gains(table_, classes)
        for b in batches:
            for raw in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                code, n = _read_pairs(*raw)
                word = code >> 32
                go = _movable(word, ids) & ((kind[word] >= classes) if turn is None else ((word * 2654435761 >> 16) % turn[1] == turn[0]))
                code, n, word = code[go], n[go], word[go]
                if not len(code):
                    continue
                new = np.append(True, word[1:] != word[:-1])  # codes are sorted by word
                names, at = word[new], np.cumsum(new) - 1
                cell = (at * 2 + ((code >> 31) & 1)) * size + kind[code & 0x7FFFFFFF]
                cells, inverse = np.unique(cell, return_inverse=True)
                own = kind[names].astype(np.int64)
                best = best_classes(cells // (2 * size), cells // size % 2, cells % size, np.bincount(inverse, n).astype(np.int64), own, gains, names)
                moved = np.flatnonzero(best != own)
                yield pa.RecordBatch.from_arrays([pa.array([names[moved].astype("<i4").tobytes()]), pa.array([best[moved].astype("<i2").tobytes()])], names=["id", "kind"])

    kinds, moves = kinds.copy(), 0
    for r in edges.mapInArrow(run, "id binary, kind binary").collect():  # six bytes a moved word
        at = np.frombuffer(bytes(r["id"]), "<i4")
        kinds[at] = np.frombuffer(bytes(r["kind"]), "<i2")
        moves += len(at)
    return kinds, moves


def class_count(words: int) -> int:
    """Classes of so many clustered words: each seed is split as the cube root of their number grows."""
    return CLASSES * min(MOST_SPLIT, max(1, round((words / 6000) ** (1 / 3))))


def cluster(texts: DataFrame, ids: Ids, tails: np.ndarray, tokens: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Kinds by id (classes, the end, endings), transitions between them, and the number of classes.

    `tails` are endings of known and other words. A round that lowers the likelihood is taken back, and fewer words move at
    once from then on.
    """
    low, words, head = ids.low(tails), len(tails), min(HEAD, ids.known)
    classes = class_count(words)
    kinds = classes + low - END_ID
    path = scratch_path(texts.sparkSession, "brown-pairs")
    edges = pairs(texts, ids, tokens, path)
    seeds = seed(edges, head, low) if head else np.empty(0, np.int64)
    kinds[:head] = seeds * (classes // CLASSES) + np.arange(head) % (classes // CLASSES)
    kinds = kinds.astype(np.int16)
    size = classes + 1 + ENDINGS
    kinds, _ = assign(edges, kinds, transitions(edges, kinds, size), classes, ids, None)
    table, quiet = transitions(edges, kinds, size), 0
    parts = 2  # of the words one part moves at once
    for k in range(MOVES if words else 0):
        new, moves = assign(edges, kinds, table, classes, ids, (k % parts, parts))
        after = transitions(edges, new, size)
        if likelihood(after) < likelihood(table):
            parts *= 2
            continue
        kinds, table, quiet = new, after, quiet + 1 if moves * parts <= FEW * words else 0
        if quiet == 2:
            break
    remove(texts.sparkSession, path)
    return kinds, table, classes


class Model:
    """Class bigrams mixed with unigrams: counts of known words and the end, kinds by id, and transitions between kinds.

    `types` are the numbers of different words in the endings' classes, of which each has room for half an unseen one, as the
    unigrams have for all unseen words together.
    """

    def __init__(self, counts: np.ndarray, kinds: np.ndarray, table: np.ndarray, classes: int, types: np.ndarray, total: int, words: int) -> None:
        into = table.sum(0)
        prior = (into + 1) / (into.sum() + len(into))
        self.counts, self.kinds, self.classes, self.of_kind = counts, kinds, classes, np.maximum(into, 1)
        self.mix = MIX if total else 1.0
        self.step = (1 - self.mix) * (table + PRIOR * prior) / (table.sum(1, keepdims=True) + PRIOR)
        self.room = total + 0.5 * (words + 1)
        self.rare_room = into[classes + 1 :] + 0.5 * (types + 1)

    def probabilities(self, ids: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Chances of a text's tokens, of `n` training occurrences each, under the unigrams and under the model."""
        kind = self.kinds[ids].astype(np.int64)
        rare = kind > self.classes
        emit = n / self.of_kind[kind]
        emit[rare] = (n[rare] + 0.5) / self.rare_room[kind[rare] - self.classes - 1]
        base = (n + 0.5) / self.room
        return base, self.step[np.append(self.classes, kind[:-1]), kind] * emit + self.mix * base


def score_documents(docs: DataFrame, training: F.Column, held_out: F.Column) -> DataFrame:
    """Scores of every row under a model of the rows in `training`.

    A null text is an empty one: only the end is scored. Rows with equal ids, and repeated rows, are scored each.
    Without training rows every token's chance is that of the smoothed unigrams. Other columns are ignored.
    """
    spark = docs.sparkSession
    vocabulary = materialize(count_words(docs.where(training)), "vocabulary")
    ends = F.sum(F.when(F.col("word") == END, F.col("n")))
    total, kinds_of_words, texts_learnt = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.coalesce(ends, F.lit(0))).first()
    keyed = vocabulary.where((F.col("word") != END) & (F.col("n") >= EVIDENCE))
    known = frequent(keyed.select(_key_column().alias("word"), F.col("n")), WORDS)
    words = {r["word"].encode(): i for i, r in enumerate(known)}
    ids = Ids(len(known))
    keys = spark.createDataFrame([(r["word"],) for r in known], "key string")
    long = {}  # ends of long words by their key, for their endings
    if any(len(w) > LONGEST for w in words):
        ends_of = keyed.where(F.octet_length("word") > LONGEST).withColumn("key", _key_column()).join(keys, "key").select("key", F.expr("right(word, 64)").alias("end"))
        long = {r["key"].encode(): r["end"].encode() for r in ends_of.collect()}
    others, tails = other_words(vocabulary, keys, ids)
    tails = np.concatenate([np.array([ending(long.get(w, w)) for w in words], np.int8), tails])

    texts = encode(docs.select("doc_id", held_out.alias("held_out"), F.coalesce(training, F.lit(False)).alias("training"), "text"), words, others, vocabulary, ids)
    kinds, table, classes = cluster(texts.where("training"), ids, tails, total)

    # sizes of the endings' classes: numbers of their tokens, from the counts, and of their words
    def endings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = np.zeros(ENDINGS, np.int64)
        for b in batches:
            for w in b.column(0).to_pylist():
                sizes[ending(w.encode())] += 1
        yield pa.RecordBatch.from_arrays([pa.array(range(ENDINGS), pa.int32()), pa.array(sizes)], names=["ending", "n"])

    types = np.zeros(ENDINGS)
    for r in vocabulary.where((F.col("word") != END) & (F.col("n") < EVIDENCE)).select("word").mapInArrow(endings, "ending int, n long").groupBy("ending").agg(F.sum("n").alias("n")).collect():
        types[r["ending"]] = r["n"]
    known_counts = np.array([r["n"] for r in known] + [texts_learnt], float)
    model = Model(known_counts, kinds, table, classes, types, total, kinds_of_words)
    shared = spark.sparkContext.broadcast(model)  # eight bytes a known word and two a clustered one

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in text_steps(batches, 2 << 20):
            out: list[tuple] = []
            for length, raw, more, counts in zip(*(b.column(i).to_pylist() for i in (2, 3, 4, 5)), strict=True):
                at = np.append(_unpack(raw, "<i4", length), ids.end)
                n = np.empty(len(at))
                easy = at <= ids.end
                n[easy] = m.counts[at[easy]]
                n[~easy] = _unpack(counts, "<i8", more)
                base, p = m.probabilities(at, n)
                out.append((len(at), int((n > 0).sum()), total, float(np.log10(base).sum()), float(np.log10(p).sum())))
            kinds_ = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns[:2], *(pa.array([r[i] for r in out], t) for i, t in enumerate(kinds_))], names=[x.split()[0] for x in SCORED.split(", ")])

    return texts.select("doc_id", "held_out", "length", "ids", "more", "counts").mapInArrow(run, SCORED)


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def op5_brown_class_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every text of `documents` under a model of four in five of them; a null text is its end alone.

    A row with a null doc_id is a training row; rows with equal ids, and repeated rows, are scored each.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.coalesce(doc_hash("doc_id") % 5 == 1, F.lit(False))
    return score_documents(docs, ~held, held)
