"""BPE by speculation: greedy longest match, vectorised checks of adjacent pairs, exact merging where a check fails.

A sequence of tokens is what BPE makes of a word if and only if every token encodes to itself and every adjacent pair
does: merges apply in the order of their ranks, so a cut between two tokens is crossed only by a merge of what
stands on both sides of it at some time, and that depends on the two tokens alone. `_pairs_hold` walks that history
backwards for all pairs of a batch at once; matching and merging go through all short words of a batch side by side, too.

Encoding follows the file's own parts: NFC, lower case, the word pattern, byte-level characters and the suffix of a
word's end. Decoding without a decoder in the file is tokens joined by a blank, as the tokenizers library does it.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession

from barloom.llm.common import text_steps, texts_of
from barloom.llm.tokens import byte_characters, lower_nfc, windows, word_chunks

NEVER = np.iinfo(np.int64).max
#: Characters from which a text is encoded window by window.
LONG = 1 << 20
#: Characters of a word from which it is encoded span by span.
SPAN = 1 << 14
#: Characters of a word up to which it is encoded side by side with others.
SHORT = 256
#: Characters of words that are merged side by side.
SIDE = 1 << 17
#: Ids that are decoded at once.
DECODED = 1 << 20


class Table:
    """Values of integer keys from 0 on, for whole arrays of them: open addressing, one probe for most."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, missing: int) -> None:
        bits = (4 * len(keys)).bit_length()
        self.shift = np.uint64(64 - bits)
        self.keys = np.full((1 << bits) + len(keys), -1, np.int64)
        self.values = np.full(len(self.keys), missing, np.int64)
        at = self._places(keys)
        while len(keys):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[free]
            there = self.keys[at] == keys
            self.values[at[there]] = values[there]
            keys, values, at = keys[~there], values[~there], at[~there] + 1

    def _places(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def __getitem__(self, keys: np.ndarray) -> np.ndarray:
        at = self._places(keys)
        there, out = self.keys[at], self.values[at]
        other = np.flatnonzero((there != keys) & (there >= 0))
        at = at[other]
        while len(other):
            at = at + 1
            there = self.keys[at]
            out[other] = self.values[at]
            more = (there != keys[other]) & (there >= 0)
            other, at = other[more], at[more]
        return out


def runs_of(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Stretches of `flat`, one after another."""
    ends = np.cumsum(sizes)
    return flat[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]


class SpeculativeBpe:
    """Encoder and decoder for a tokenizers file of word BPE with a suffix at word ends."""

    def __init__(self, path: str, max_chunks: int = 200_000, max_bytes: int = 32 << 20) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        steps = [x["type"] for x in spec["normalizer"]["normalizers"]]
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        if steps != ["NFC", "Replace", "Lowercase"] or split["behavior"] != "Removed" or not self.suffix or spec.get("decoder") or spec.get("post_processor"):
            raise ValueError(f"{path}: not a tokenizer of this kind")
        #: Of chunks in lines; their only white space is the lines' ends, which are found, too.
        self.split = regex.compile(split["pattern"]["Regex"].replace(r"[^\s\p{L}", r"[^\n\p{L}") + r"|\n")
        vocab: dict[str, int] = model["vocab"]
        self.specials: dict[str, int] = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.specials, key=len, reverse=True)) + ")")
        size = max([*vocab.values(), *self.specials.values()]) + 1
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.left, self.right = np.full(size, -1), np.full(size, -1)
        self.rank = np.full(size, -1)
        self.merge: dict[int, int] = {}  # left * size + right -> rank
        self.made: list[int] = []  # token of each rank
        ends = np.zeros(size, bool)
        for s, i in vocab.items():
            ends[i] = len(s) > 1 and s.endswith(self.suffix) and len(s) == len(self.suffix) + 1
        for r, (a, b) in enumerate(merges):
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            self.merge.setdefault(x * size + y, r)
            self.made.append(z)
            if self.rank[z] < 0:
                self.left[z], self.right[z], self.rank[z], ends[z] = x, y, r, ends[y]
        self.inner = {s: i for s, i in vocab.items() if not ends[i]}
        self.final = {s[: -len(self.suffix)]: i for s, i in vocab.items() if ends[i]}
        self.longest, self.longest_final = max(map(len, self.inner)), max(map(len, self.final))
        self.size = size
        self.pairs = Table(np.array([*self.merge], np.int64), np.array([*self.merge.values()], np.int64), NEVER)
        self.made_of = np.array(self.made, np.int64)
        self.whole = self._whole()
        #: Characters that each token stands for.
        self.sizes = np.zeros(size, np.int64)
        for s, i in vocab.items():
            self.sizes[i] = len(s) - (len(self.suffix) if ends[i] else 0)
        self.characters = byte_characters()
        #: Each byte's character as a number; a line's end is a word's end, 0.
        self.symbols = np.array([0 if b == 10 else self.characters[b] for b in range(256)], np.int64)
        self._grow_trie()
        strings = {i: s for s, i in vocab.items()} | {i: s for s, i in self.specials.items()}
        self.strings = pa.array([strings.get(i, "").encode() for i in range(size)], pa.binary())
        #: Numbers of the chunks that are kept, and for each of them where its ids are, its bytes and when it was last used.
        self.chunks: defaultdict[str, int] = defaultdict(count().__next__)
        self.flat = np.zeros(0, self.dtype)
        self.starts, self.counts, self.costs, self.used = (np.zeros(0, np.int64) for _ in range(4))
        self.max_chunks, self.max_bytes, self.bytes, self.step = max_chunks, max_bytes, 0, 0
        self.checked = self.failed = 0

    def _grow_trie(self) -> None:
        """Tokens by their characters; those of a word's end have a 0 behind them."""
        self.alphabet = 1 + max(*self.symbols, *(ord(c) for s in self.inner for c in s))
        edges: dict[int, int] = {}  # node * alphabet + character -> node
        token = {}
        for some, end in ((self.inner, ""), (self.final, "\0")):
            for s, i in some.items():
                node = 0
                for c in s + end:
                    node = edges.setdefault(node * self.alphabet + ord(c), len(edges) + 1)
                token[node] = i
        self.edges = Table(np.array([*edges], np.int64), np.array([*edges.values()], np.int64), -1)
        self.token = np.full(len(edges) + 2, -1)  # the last for -1, no node
        self.token[[*token]] = [*token.values()]
        #: Tokens of single characters, inside and at the end of a word.
        self.one, self.one_final = np.full(self.alphabet, -1), np.full(self.alphabet, -1)
        for some, ones in ((self.inner, self.one), (self.final, self.one_final)):
            for s, i in some.items():
                if len(s) == 1:
                    ones[ord(s)] = i

    def _pair_ranks(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return self.pairs[x * self.size + y]

    def _pairs_hold(self, a: np.ndarray, b: np.ndarray, until: np.ndarray | int = NEVER) -> np.ndarray:
        """Whether no merge of a rank below `until` crosses the cut between tokens a and b.

        x and y are what stands left and right of the cut, from the end of merging backwards; each lives until the
        merge that takes it up. A merge across goes first if its rank is below both, or is that of y's, which is
        further to the right.
        """
        x, y = a.copy(), b.copy()
        x_until, y_until = np.broadcast_to(np.asarray(until), x.shape).copy(), np.broadcast_to(np.asarray(until), x.shape).copy()
        holds = np.ones(len(x), bool)
        live = np.arange(len(x))
        while len(live):
            lx, ly = x[live], y[live]
            r = self._pair_ranks(lx, ly)
            crossed = (r < x_until[live]) & (r <= y_until[live]) & (r < NEVER)
            holds[live[crossed]] = False
            rx, ry = self.rank[lx], self.rank[ly]
            more = ~crossed & ((rx >= 0) | (ry >= 0))
            back_y = more & (ry >= rx)  # of equal ranks, the left merge comes first
            back_x = more & ~back_y
            i = live[back_y]
            y_until[i], y[i] = self.rank[y[i]], self.left[y[i]]
            i = live[back_x]
            x_until[i], x[i] = self.rank[x[i]], self.right[x[i]]
            live = live[more]
        return holds

    def _whole(self) -> np.ndarray:
        """Which tokens BPE makes of their own text: those whose two halves are whole and meet at their own merge."""
        made = np.flatnonzero(self.rank >= 0)
        meets = np.zeros(self.size, bool)
        meets[made] = self._pairs_hold(self.left[made], self.right[made], self.rank[made])
        whole = self.rank < 0
        for t in made[np.argsort(self.rank[made])]:
            whole[t] = meets[t] and whole[self.left[t]] and whole[self.right[t]]
        return whole

    def propose(self, word: str, ends: bool = True) -> list[int]:
        """Greedy longest match; the last token must hold the word's end (where it isn't a span of one). Takes time in proportion to the word's length."""
        out, at, n = [], 0, len(word)
        final, inner = self.final, self.inner
        while not ends and at < n:
            for stop in range(min(n, at + self.longest), at, -1):
                token = inner.get(word[at:stop])
                if token is not None:
                    break
            out.append(token)
            at = stop
        while ends:
            if n - at <= self.longest_final:
                token = final.get(word[at:])
                if token is not None:
                    out.append(token)
                    return out
            for stop in range(min(n - 1, at + self.longest), at, -1):
                token = inner.get(word[at:stop])
                if token is not None:
                    break
            out.append(token)
            at = stop
        return out

    def merge_exactly(self, word: str, ends: bool = True) -> list[int]:
        """BPE by the rule: the lowest rank first, the leftmost of equal ones.

        Tokens are a linked list and pairs wait in a heap by rank and place; one whose tokens have changed is passed over.
        """
        ids, size, rank = [self.inner[c] for c in word], self.size, self.merge.get
        if ends:
            ids[-1] = self.final[word[-1]]
        n = len(ids)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i) for i in range(n - 1) if (r := rank(ids[i] * size + ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or rank(ids[i] * size + ids[j]) != r:
                continue
            ids[i], ids[j] = self.made[r], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (more := rank(ids[i] * size + ids[k])) is not None:
                    heapq.heappush(heap, (more, i))
            if (h := before[i]) >= 0 and (more := rank(ids[h] * size + ids[i])) is not None:
                heapq.heappush(heap, (more, h))
        return [x for x in ids if x >= 0]

    def _propose_short(self, symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What `propose` does, for words side by side, a character each in a step; a 0 ends each word. Ids and the number of each word's."""
        symbols = np.append(symbols, 0)
        word, at = np.arange(len(starts)), starts
        node, best, stop = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64), starts
        words, ids = [], []
        while len(word):
            symbol = symbols[at]
            node = self.edges[node * self.alphabet + symbol]
            at = at + 1
            token = self.token[node]
            fits = (token >= 0) & ((symbol == 0) | (symbols[at] != 0))
            best, stop = np.where(fits, token, best), np.where(fits, at, stop)
            over = (node < 0) | (symbol == 0)
            words.append(word[over])
            ids.append(best[over])
            at, node = np.where(over, stop, at), np.where(over, 0, node)
            more = np.flatnonzero(~over | (symbols[stop - 1] != 0))
            word, at, node, best, stop = word[more], at[more], node[more], best[more], stop[more]
        of = np.concatenate([*words, np.zeros(0, np.int64)])
        return np.concatenate([*ids, np.zeros(0, np.int64)])[np.argsort(of, kind="stable")], np.bincount(of, minlength=len(starts))

    def _merge_short(self, symbols: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What `merge_exactly` does, for words side by side, a merge each in a step."""
        n, width = len(starts), int(sizes.max())
        row = np.arange(width)[:, None]
        inside = row < sizes
        at = symbols[np.where(inside, starts + row, 0)]
        ids = np.where(row == sizes - 1, self.one_final[at], np.where(inside, self.one[at], -1))
        none = len(self.made)
        rank = lambda x, y: np.where(y >= 0, np.minimum(self._pair_ranks(x, np.maximum(y, 0)), none), none)
        ranks = np.full((width, n), none)
        ranks[:-1] = rank(ids[:-1].ravel(), ids[1:].ravel()).reshape(width - 1, n)
        out, word = np.full((width, n), -1), np.arange(n)
        while True:
            first = (ranks * width + row).min(axis=0)
            r, k = first // width, first % width
            more = r < none
            if not more.all():
                out[:, word[~more]] = ids[:, ~more]
                word, ids, ranks, r, k = word[more], ids[:, more], ranks[:, more], r[more], k[more]
            if not len(word):
                break
            column, after = np.arange(len(word)), row[:-1] > k
            ids[k, column] = self.made_of[r]
            ids[:-1], ids[-1] = np.where(after, ids[1:], ids[:-1]), -1
            ranks[:-1], ranks[-1] = np.where(after, ranks[1:], ranks[:-1]), none
            ranks[k, column] = rank(ids[k, column], ids[k + 1, column])
            column, k = column[k > 0], k[k > 0]
            ranks[k - 1, column] = rank(ids[k - 1, column], ids[k, column])
        out = out.T
        return out[out >= 0], (out >= 0).sum(axis=1)

    def _encode_short(self, symbols: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of words side by side: all ids, and where each word's begin and how many they are."""
        flat, counts = self._propose_short(symbols, starts)
        begins = np.cumsum(counts) - counts
        bad = self._fail(flat, np.repeat(np.arange(len(starts)), counts), len(starts))
        self.checked += len(starts)
        self.failed += int(bad.sum())
        parts = [flat]
        total, low = len(flat), 0
        for high in (8, 12, 16, 24, 32, 64, 96, 128, 192, SHORT):  # words of like length together
            alike = np.flatnonzero(bad & (sizes > low) & (sizes <= high))
            low = high
            for k in range(0, len(alike), SIDE // high):
                some = alike[k : k + SIDE // high]
                ids, n = self._merge_short(symbols, starts[some], sizes[some])
                parts.append(ids)
                begins[some], counts[some] = total + np.cumsum(n) - n, n
                total += len(ids)
        return np.concatenate(parts).astype(self.dtype), begins, counts

    def encode_words(self, words: list[str]) -> list[list[int] | np.ndarray]:
        """Ids of words in byte-level characters."""
        out: list[list[int] | np.ndarray | None] = [None] * len(words)
        short = [i for i, w in enumerate(words) if len(w) <= min(SHORT, SPAN)]
        if short:
            sizes = np.array([len(words[i]) for i in short])
            symbols = np.frombuffer("".join([words[i] + "\0" for i in short]).encode("utf-32-le"), "<u4").astype(np.int64)
            flat, begins, counts = self._encode_short(symbols, np.cumsum(sizes + 1) - sizes - 1, sizes)
            for i, a, n in zip(short, begins.tolist(), counts.tolist(), strict=True):
                out[i] = flat[a : a + n].tolist()
        longer = [i for i, w in enumerate(words) if SHORT < len(w) <= SPAN]
        for i, ids in zip(longer, self._encode_parts([words[i] for i in longer], [True] * len(longer)), strict=True):
            out[i] = ids
        for i, w in enumerate(words):
            if len(w) > SPAN:
                out[i] = self._encode_long(w)
        return out

    def _fail(self, flat: np.ndarray, word: np.ndarray, n: int) -> np.ndarray:
        """Which of n words BPE makes otherwise; ids and the word of each."""
        bad = np.zeros(n, bool)
        bad[word[~self.whole[flat]]] = True
        inside = np.flatnonzero(word[1:] == word[:-1])
        bad[word[inside[~self._pairs_hold(flat[inside], flat[inside + 1])]]] = True
        return bad

    def _encode_parts(self, words: list[str], ends: list[bool]) -> list[list[int]]:
        """Ids of words, or of spans of them that don't hold their ends."""
        ids = [self.propose(w, e) for w, e in zip(words, ends, strict=False)]
        sizes = np.array([len(x) for x in ids], np.int64)
        flat = np.array([i for x in ids for i in x], np.int64)
        bad = self._fail(flat, np.repeat(np.arange(len(ids)), sizes), len(ids))
        for i in np.flatnonzero(bad):
            ids[i] = self.merge_exactly(words[i], ends[i])
        self.checked += len(ids)
        self.failed += int(bad.sum())
        return ids

    def _encode_long(self, word: str) -> np.ndarray:
        """Ids of a long word from overlapping spans: each begins at a token of the one before, after a pair that holds; of the whole word at once where spans don't meet."""
        n, done, at = len(word), [], 0
        (ids,) = self._encode_parts([word[:SPAN]], [n <= SPAN])
        while at + SPAN < n:
            stops = at + np.cumsum([self.sizes[x] for x in ids])
            for k in range(len(ids) * 3 // 4, max(len(ids) * 3 // 4 - 64, 0), -1):
                to = int(stops[k - 1])
                (after,) = self._encode_parts([word[to : to + SPAN]], [to + SPAN >= n])
                if after[0] == ids[k] or self._pairs_hold(np.array([ids[k - 1]]), np.array([after[0]]))[0]:
                    break
            else:
                return np.array(self.merge_exactly(word), self.dtype)
            done.append(np.array(ids[:k], self.dtype))
            ids, at = after, to
        return np.concatenate([*done, np.array(ids, self.dtype)])

    def _learn(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks one after another, and the number of each one's. Each distinct word is encoded once."""
        found: list[str | int] = []
        for part in self.special.split("\n".join([*chunks, ""])):
            found += [self.specials[part]] if part in self.specials else self.split.findall(lower_nfc(part))
        numbers: defaultdict[str | int, int] = defaultdict(count(1).__next__, {"\n": 0})
        at = np.fromiter(map(numbers.__getitem__, found), np.int64, len(found))
        keys = [*numbers]
        begins, counts = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        text = [w.encode() if isinstance(w, str) else b"" for w in keys[1:]]
        sizes = np.fromiter(map(len, text), np.int64, len(text))
        symbols = self.symbols[np.frombuffer(b"\n".join([*text, b""]), np.uint8)]
        short = np.flatnonzero((sizes > 0) & (sizes <= SHORT))
        flat, begins[short + 1], counts[short + 1] = self._encode_short(symbols, (np.cumsum(sizes + 1) - sizes - 1)[short], sizes[short])
        parts, total = [flat], len(flat)
        longer = np.flatnonzero(sizes > SHORT).tolist()
        special = np.flatnonzero(sizes == 0).tolist()
        coded = self.encode_words([text[i].decode("latin-1").translate(self.characters) for i in longer])
        for i, ids in zip([*longer, *special], [*coded, *([keys[i + 1]] for i in special)], strict=True):
            parts.append(np.array(ids, self.dtype))
            begins[i + 1], counts[i + 1] = total, len(ids)
            total += len(ids)
        ends = np.cumsum(counts[at])[at == 0]
        return runs_of(np.concatenate(parts), begins[at], counts[at]), np.diff(ends, prepend=0)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of whole texts; long ones are taken window by window."""
        short = [t for t in texts if len(t) <= LONG]
        some = iter(self._encode(short))
        return [next(some) if len(t) <= LONG else np.concatenate([self._encode([w])[0] for w in windows(t)]) for t in texts]

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        """Chunks seen before are looked up."""
        parts = [word_chunks(t) for t in texts]
        known, sizes = len(self.chunks), np.fromiter(map(len, parts), np.int64, len(parts))
        at = np.fromiter(map(self.chunks.__getitem__, chain.from_iterable(parts)), np.int64, int(sizes.sum()))
        if new := [*islice(self.chunks, known, None)]:
            flat, counts = self._learn(new)
            costs = 2 * (np.fromiter(map(len, new), np.int64, len(new)) + counts * self.dtype.itemsize)
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(counts) - counts])
            self.flat, self.counts, self.costs = np.concatenate([self.flat, flat]), np.concatenate([self.counts, counts]), np.concatenate([self.costs, costs])
            self.used = np.concatenate([self.used, np.zeros(len(new), np.int64)])
            self.bytes += int(costs.sum())
        self.step += 1
        self.used[at] = self.step
        counts = self.counts[at]
        ends = np.append(0, np.cumsum(counts))[np.cumsum(sizes)]
        out = np.split(runs_of(self.flat, self.starts[at], counts), ends[:-1]) if texts else []
        if len(self.chunks) > 2 * self.max_chunks or self.bytes > self.max_bytes:
            self._forget()
        return out

    def _forget(self) -> None:
        """Keep the `max_chunks` chunks used last, and of these as many as half of `max_bytes` holds."""
        last = np.argsort(-self.used, kind="stable")[: self.max_chunks]
        keep = np.sort(last[np.cumsum(self.costs[last]) <= self.max_bytes // 2])
        chunks = [*self.chunks]
        self.chunks = defaultdict(count(len(keep)).__next__, {chunks[i]: k for k, i in enumerate(keep.tolist())})
        self.flat, self.counts = runs_of(self.flat, self.starts[keep], self.counts[keep]), self.counts[keep]
        self.starts, self.costs, self.used = np.cumsum(self.counts) - self.counts, self.costs[keep], self.used[keep]
        self.bytes = int(self.costs.sum())

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of ids as UTF-8, special tokens included."""
        return b" ".join(x.as_py() for at in range(0, len(ids), DECODED) for x in self._decode([ids[at : at + DECODED]]))

    def _decode(self, ids: list[np.ndarray]) -> pa.Array:
        flat = pa.array(np.concatenate(ids).astype(np.int32))
        ends = np.cumsum([0, *map(len, ids)])
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), self.strings.take(flat)), b" ")

    def decoded_digests(self, ids: list[np.ndarray]) -> list[str]:
        """SHA-256 of each text that `decode` makes."""
        out: list[str] = []
        at = 0
        while at < len(ids):
            some = ids[at : at + 1]
            if len(some[0]) > DECODED:
                sha = hashlib.sha256()
                for k in range(0, len(some[0]), DECODED):
                    sha.update(b" " * (k > 0) + self.decode(some[0][k : k + DECODED]))
                out.append(sha.hexdigest())
            else:
                total = len(some[0])
                while at + len(some) < len(ids) and (total := total + len(ids[at + len(some)])) <= DECODED:
                    some.append(ids[at + len(some)])
                out += [hashlib.sha256(x.as_buffer()).hexdigest() for x in self._decode(some)]
            at += len(some)
        return out


_coders: dict[str, SpeculativeBpe] = {}


def coder(path: str) -> SpeculativeBpe:
    if path not in _coders:
        _coders[path] = SpeculativeBpe(path)
    return _coders[path]


def encode_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit) and decoded text of each row.

    A null text is an empty one and has no ids; null ids and repeated rows stay as they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(tokenizer)
        for b in text_steps(batches, 2 << 20):
            ids = bpe.encode(texts_of(b))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(pa.int64()), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()), pa.array([bpe.decode(x).decode() for x in ids], pa.string())], names=["doc_id", "ids", "decoded"]
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary, decoded string")


def digest_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Number of ids and digests of ids and decoded text of each row, made where they are, so that neither is moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(tokenizer)
        for b in text_steps(batches, 2 << 20):
            ids = bpe.encode(texts_of(b))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).cast(pa.int64()), pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x.astype("<u4")).hexdigest() for x in ids], pa.string()), pa.array(bpe.decoded_digests(ids), pa.string()),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_speculative_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every text of `documents`; a null text has no ids, and null ids and repeated rows come back each."""
    import public_tokenizers

    return digest_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
