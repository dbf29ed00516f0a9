"""Runs of repeated words by Stoye and Gusfield's method: branching tandem repeats from a suffix tree, rotated and merged.

The texts of a batch share one suffix tree, in which each text's words are symbols of their own, so that it is the union of
the texts' trees. It is kept as suffix array and lengths of common prefixes; an inner node is a stretch of the array, cut in
two at each place of its least common prefix. Of the two sides the smaller one's leaves are listed: for leaf i under a node of depth
d, i + d or i - d on the other side makes a tandem repeat of period d whose next word breaks the period (a branching one).
All others are rotations of these to the left. Rotating as far as words allow gives the whole run, and of repeats that give the same
run the one of the shortest period is it.

Suffixes are sorted by doubling: ranks of all places by their next 1, 2, 4, ... words, of which each step sorts only what is
still tied. The ranks stay: two places agree on as many words as the ranks say, which gives common prefixes and rotations.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array
from collections.abc import Iterator, Sequence
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from barloom.llm.common import table, text_steps

#: A run has at least so many words and so many periods (the contract's).
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Bytes of text that a Python task handles at once, bytes that are split into words at once, and leaves listed at once.
STEP, PART, LISTED = 4 << 20, 1 << 20, 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


class Numbers(dict):
    """Numbers words in the order in which they are first asked for."""

    def __missing__(self, word: bytes) -> int:
        self[word] = new = len(self)
        return new


def words_of(text: bytes) -> tuple[np.ndarray, list[bytes]]:
    """The numbers of a text's words, dealt in the order of their first places, and the words by number."""
    number = Numbers()
    get, out, at = number.__getitem__, array("i"), 0
    while at < len(text):
        to = len(text)
        if to - at > PART and (cut := _SPACE.search(text, at + PART)):
            to = cut.start()
        words = (text if to - at == len(text) else text[at:to]).split()  # ASCII white space: \x20 and \x09 to \x0D
        out.extend([*map(get, words)])
        at = to
    return np.frombuffer(out, np.int32), [*number]


class SuffixTree:
    """Suffix array, common prefixes and ranks of several sequences of numbers."""

    def __init__(self, sequences: Sequence[np.ndarray]) -> None:
        sizes = np.array([len(s) + 1 for s in sequences], np.int64)
        #: Where each sequence starts; each ends with a symbol of its own.
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        symbols, base = [], 0
        for s in sequences:
            top = int(s.max()) + 1 if len(s) else 0
            symbols += [s.astype(np.int64) + base, [base + top]]
            base += top + 1
        symbol = np.concatenate(symbols).astype(np.int64) if symbols else np.zeros(0, np.int64)
        n = len(symbol)
        order = np.argsort(symbol, kind="stable")
        rank, tied = self._ranked(symbol[order], order, np.zeros(n, np.int32), np.zeros(n, np.int64))
        #: ranks[k][i] == ranks[k][j]: places i and j have the same next 2 ** k symbols.
        self.ranks = [rank]
        width = 1
        while len(tied):
            before = rank
            key = before[tied].astype(np.int64) * n + before[tied + width]  # a tied place's next symbols are all of its sequence
            by = np.argsort(key)
            rank, tied = self._ranked(key[by], tied[by], before.copy(), before[tied[by]])
            self.ranks.append(rank)
            width *= 2
        self.rank = rank
        self.suffixes = np.empty(n, np.int32)
        self.suffixes[rank] = np.arange(n, dtype=np.int32)
        #: Words that a suffix shares with the one before it in the array.
        self.common = np.zeros(n, np.int32)
        if n:
            self.common[1:] = self.shared(self.suffixes[:-1], self.suffixes[1:])

    @staticmethod
    def _ranked(key: np.ndarray, place: np.ndarray, rank: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks with places in the order of their keys ranked anew from the ranks of their groups, and the places still tied."""
        m = len(key)
        if not m:
            return rank, place
        new = np.ones(m, bool)
        new[1:] = key[1:] != key[:-1]
        first = np.flatnonzero(new)
        size = np.diff(first, append=m)
        of_group = np.ones(m, bool)
        of_group[1:] = group[1:] != group[:-1]
        at = np.arange(m)
        start = np.maximum.accumulate(np.where(of_group, at, 0))
        rank[place] = group + np.repeat(first, size) - start
        return rank, np.sort(place[np.repeat(size > 1, size)])

    def shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the suffixes at a and b, which differ."""
        out = np.zeros(len(a), np.int32)
        for k in reversed(range(len(self.ranks))):
            rank = self.ranks[k]
            out += (rank[a + out] == rank[b + out]).astype(np.int32) << k
        return out

    def rotations(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words before a that are those before b."""
        out = np.zeros(len(a), np.int64)
        for k in reversed(range(len(self.ranks))):
            rank, x = self.ranks[k], a - out - (1 << k)
            there = x >= 0
            out += (there & (rank[np.where(there, x, 0)] == rank[np.where(there, b - out - (1 << k), 1)])).astype(np.int64) << k
        return out

    def _cuts(self) -> tuple[np.ndarray, ...]:
        """Each cut of an inner node: its place, the node's depth, and the first and last place of its two sides."""
        n = len(self.common)
        low, high = [0] * n, [n - 1] * n
        stack: list[tuple[int, int]] = []  # depths, ever greater, and places
        depth = bottom = 0
        for k, h in enumerate(self.common.tolist()):
            while depth > h:
                high[stack.pop()[1]] = k - 1
                depth = stack[-1][0] if stack else 0
            if h:
                low[k] = stack[-1][1] if stack else bottom
                stack.append((h, k))
                depth = h
            else:
                bottom = k
        place = np.flatnonzero(self.common)
        return place, self.common[place].astype(np.int64), np.array(low, np.int64)[place], np.array(high, np.int64)[place]

    def branching_repeats(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Starts and periods of branching tandem repeats."""
        cut, depth, low, high = self._cuts()
        left = cut - low <= high - cut + 1  # the smaller side
        first, last = np.where(left, low, cut), np.where(left, cut - 1, high)
        other, until = np.where(left, cut, low), np.where(left, high, cut - 1)
        size = last - first + 1
        total, n = np.cumsum(size), len(self.suffixes)
        bounds = np.searchsorted(total, np.arange(0, (total[-1] if len(total) else 0) + LISTED, LISTED))
        for x, y in pairwise([*np.unique(bounds).tolist(), len(size)]):
            if x == y:
                continue
            count = size[x:y]
            node = np.repeat(np.arange(x, y), count)
            leaf = self.suffixes[first[node] + np.arange(len(node)) - np.repeat(np.cumsum(count) - count, count)].astype(np.int64)
            d = depth[node]
            for step, start in ((d, leaf), (-d, leaf - d)):
                there = leaf + step
                inside = np.flatnonzero((there >= 0) & (there < n))
                found = self.rank[there[inside]]
                hit = inside[(found >= other[node[inside]]) & (found <= until[node[inside]])]
                yield start[hit], d[hit]

    def runs(self, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, length and period of each run of at least so many words and (two or more) periods, by start, then period."""
        found = [*zip(*self.branching_repeats(), strict=True)] or [[np.zeros(0, np.int64)]] * 2
        end, period = (np.concatenate(x) for x in found)
        back = self.rotations(end, end + period)
        start, length = end - back, back + 2 * period
        order = np.lexsort((period, length, start))
        start, length, period = start[order], length[order], period[order]
        once = np.ones(len(start), bool)
        once[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])  # of the same stretch, the shortest period
        keep = once & (length >= np.maximum(least_words, least_periods * period))
        start, length, period = start[keep], length[keep], period[keep]
        order = np.lexsort((period, start))
        return start[order], length[order], period[order]


def runs_of(sequences: Sequence[np.ndarray]) -> list[np.ndarray]:
    """For each sequence its runs, a row of start, length and period each, by start, then period."""
    tree = SuffixTree(sequences)
    start, length, period = tree.runs()
    owner = np.searchsorted(tree.starts, start, side="right") - 1
    rows = np.stack([start - tree.starts[owner], length, period], axis=1)
    bounds = np.searchsorted(owner, np.arange(len(sequences) + 1))
    return [rows[a:b] for a, b in pairwise(bounds)]


def planted(doc_id: int | None, words: np.ndarray) -> np.ndarray:
    """Words with a periodic end in one of ten documents, by the contract's rule; a null id has none."""
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + np.arange(n - a) % p
    return words[at]


def strongest(runs: np.ndarray) -> tuple[int, int, int] | tuple[None, None, None]:
    """The run of most periods, compared exactly; of equal ones the first, then that of the shortest period."""
    best = None
    for start, length, period in runs.tolist():
        if best is None or length * best[2] > best[1] * period:  # rows are by start, then period
            best = (start, length, period)
    return best or (None, None, None)


def collapsed(n: int, runs: np.ndarray) -> np.ndarray:
    """Places of the words that stay when each run keeps its first period."""
    if not len(runs):
        return np.arange(n)
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.flatnonzero(np.cumsum(change[:n]) == 0)


def joined(words: np.ndarray, names: list[bytes]) -> Iterator[bytes]:
    """Words with a blank between, in parts."""
    for at in range(0, len(words), PART):
        yield (b" " if at else b"") + b" ".join([names[w] for w in words[at : at + PART].tolist()])


SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _steps(batches: Iterator[pa.RecordBatch], plant: bool) -> Iterator[tuple[list, list[np.ndarray], list[list[bytes]], list[np.ndarray]]]:
    """doc_ids, word numbers, words and runs of each step's rows."""
    for b in text_steps(batches, STEP):
        ids, numbers, names = b.column(0).to_pylist(), [], []
        for doc_id, text in zip(ids, b.column(1), strict=True):
            words, known = words_of(text.as_buffer().to_pybytes() if text.is_valid else b"")
            numbers.append(planted(doc_id, words) if plant else words)
            names.append(known)
        yield ids, numbers, names, runs_of(numbers)


def find_runs(docs: DataFrame) -> DataFrame:
    """Every run of each text: doc_id, start (word number from 0), length and period in words.

    Words are what stands between ASCII white space. Texts without runs (null, empty or short ones, too) have no rows;
    null ids and repeated rows are documents each; other columns are ignored. A task holds a batch of texts, or one long text,
    with about 150 bytes a word (a text of 2 million words took 310 MB).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, _, runs in _steps(batches, False):
            rows = np.concatenate(runs)
            owner = np.repeat(np.arange(len(ids)), [len(r) for r in runs])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()).take(pa.array(owner)), *(pa.array(rows[:, k], pa.int64()) for k in range(3))], names=["doc_id", "start", "length", "period"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, start long, length long, period long")


def collapse(docs: DataFrame) -> DataFrame:
    """doc_id and text of each row with every run's first period kept and the rest dropped, words joined by one blank; rows as `find_runs` reads them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, numbers, names, runs in _steps(batches, False):
            texts = [b"".join(joined(w[collapsed(len(w), r)], n)) for w, n, r in zip(numbers, names, runs, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "text"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, text string")


def digest_runs(docs: DataFrame) -> DataFrame:
    """SCHEMA of each row, with runs planted by the contract's rule: counts, the strongest run, digests of runs and of the collapsed text.

    A null text has no words, and a null id nothing planted; repeated rows come back each; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, numbers, names, runs in _steps(batches, True):
            out = []
            for doc_id, words, known, found in zip(ids, numbers, names, runs, strict=True):
                start, length, period = strongest(found)
                kept = hashlib.sha256()
                for part in joined(words[collapsed(len(words), found)], known):
                    kept.update(part)
                listed = "".join([f"{a},{b},{c}\n" for a, b, c in found.tolist()])
                out.append((doc_id, len(found), start, length, period, length and 1000 * length // period, hashlib.sha256(listed.encode()).hexdigest(), kept.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k > 5 else pa.int64()) for k, c in enumerate(zip(*out, strict=True))], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, SCHEMA)


def op12_suffix_tree_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every text of `documents` by its contract, with runs planted in one of ten; nulls and repeated rows as `digest_runs` has them."""
    return digest_runs(table(spark, sf_dir, "documents"))
