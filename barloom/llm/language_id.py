"""Language identification: averaged hashed subword embeddings and a linear softmax, trained by SGD in numpy.

A text's vector is the mean of the embeddings of all subwords of its words (the word and its character 2- to 4-grams,
hashed into BUCKETS). Because softmax's input is linear in that mean, each distinct word's sum of logits is looked up
and a text's logits are a mean over its words, whatever its length. Beside them the mean logarithm of the subwords'
frequencies in training tells how familiar a text is: text of no learned language has rare subwords.
"""

from __future__ import annotations

import pickle
import string
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import check_unused, doc_hash, smallest_hashes, text_steps, texts_of
from barloom.llm.tokens import windows

BUCKETS, WIDTH = 1 << 16, 16
#: Characters of words whose subwords are hashed at once.
SPAN = 1 << 18
#: Bound of the training sample: labelled documents, each with all of its subwords.
TRAIN_DOCS = 4000
#: Passes over the sample, and updates that a small one gets at least.
EPOCHS, LEAST_STEPS, RATE, CALIBRATION_SHARE = 6, 6000, 0.5, 0.2
#: Share of rightly named calibration documents that each of the two thresholds may lose, and the least threshold of scores.
LOST, LOWEST = 0.001, 0.3
#: Rightly named calibration documents without which nothing but a low score is rejected: fewer say nothing of the rest.
ENOUGH = 20
MAX_WORDS, MAX_BYTES = 200_000, 32 << 20
UNKNOWN = "und"

_EDGES = string.punctuation + string.digits
_LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")


_PRIME, _SPREAD = np.uint32(16777619), np.uint32(2654435761)


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket) of each lower-case word, with marks at both ends, and of its character 2- to 4-grams; all words at once."""
    codes = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-32-le", "surrogatepass"), "<u4")
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    owner = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(codes))
    left = np.repeat(np.cumsum(sizes), sizes) - place  # characters to a word's end, this one included
    powers = np.cumprod(np.full(int(sizes.max(initial=1)), _PRIME, np.uint32), dtype=np.uint32)
    whole = np.bincount(owner, (codes * powers[left - 1]).astype(np.float64), len(words)).astype(np.int64).astype(np.uint32)
    owners, hashes = [np.arange(len(words))], [whole]
    h = codes
    for n in (2, 3, 4):
        h = h[:-1] * _PRIME + codes[n - 1 :] if len(h) else h
        inside = left[: len(h)] >= n
        owners.append(owner[: len(h)][inside])
        hashes.append(h[inside] + np.uint32(n))
    return np.concatenate(owners), (np.concatenate(hashes) * _SPREAD) >> np.uint32(16)


def _of_long_word(word: str) -> Iterator[np.ndarray]:
    """Buckets of the subwords of one long word, span by span; grams that go over a span's end are the span's where they begin."""
    word = f"<{word}>"
    whole = 0
    powers = np.cumprod(np.full(SPAN, _PRIME, np.uint32), dtype=np.uint32)
    for at in range(0, len(word), SPAN):
        codes = np.frombuffer(word[at : at + SPAN + 3].encode("utf-32-le", "surrogatepass"), "<u4")
        n = min(SPAN, len(word) - at)
        rest = int((codes[:n] * powers[:n][::-1]).sum(dtype=np.uint32))
        whole = (whole * int(powers[n - 1]) + rest) & 0xFFFFFFFF
        h = codes
        for k in (2, 3, 4):
            h = h[:-1] * _PRIME + codes[k - 1 :] if len(h) else h
            yield ((h[:n] + np.uint32(k)) * _SPREAD) >> np.uint32(16)
    yield (np.array([whole], np.uint32) * _SPREAD) >> np.uint32(16)


def subword_parts(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word, bucket) of all words' subwords, of about SPAN characters at a time, whatever words are long."""
    at = 0
    while at < len(words):
        to, held = at, 0
        while to < len(words) and held + len(words[to]) <= SPAN:
            held += len(words[to]) + 2
            to += 1
        if to > at:
            owner, bucket = subwords(words[at:to])
            yield owner + at, bucket
        else:
            to = at + 1
            for bucket in _of_long_word(words[at]):
                yield np.full(len(bucket), at), bucket
        at = to


def letters(chunk: str) -> list[str]:
    """A chunk's words: runs of letters and their marks."""
    return [chunk] if chunk.isalpha() else _LETTERS.findall(chunk)


@dataclass
class Model:
    """Logits of each subword before averaging, the logarithm of its frequency, bias, temperature, least score and least
    familiarity of an accepted text, and the languages."""

    logits: np.ndarray
    rarity: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float
    familiar: float
    languages: list[str]


class _Words(dict):
    """Row of each chunk in a growing table of summed logits, summed log frequencies and numbers of subwords."""

    def __init__(self, model: Model) -> None:
        super().__init__()
        self.of_bucket = np.column_stack([model.logits, model.rarity, np.ones(BUCKETS)])
        self.table, self.used, self.bytes = np.zeros((1024, self.of_bucket.shape[1])), 0, 0

    def learn(self, chunks: Iterable[str]) -> None:
        """Rows for chunks that have none; marks and digits at a chunk's ends are in no subword."""
        cores = {c: c.strip(_EDGES) for c in chunks if c not in self}
        new = list({x for x in cores.values() if x not in self})
        if self.used + len(new) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros((max(len(self.table), len(new)), self.table.shape[1]))])
        words = [letters(x) for x in new]
        chunk = np.repeat(np.arange(len(new)), [len(w) for w in words])
        for word, bucket in subword_parts([w for ws in words for w in ws]):
            for k in range(self.table.shape[1]):
                self.table[self.used : self.used + len(new), k] += np.bincount(chunk[word], self.of_bucket[bucket, k], len(new))
        self.update(zip(new, range(self.used, self.used + len(new)), strict=True))
        self.used += len(new)
        self.bytes += sum(map(len, cores)) + sum(map(len, new))
        self.update((c, self[x]) for c, x in cores.items())


def predict(model: Model, words: _Words, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the best language, -1 for a text without letters, its calibrated probability (0 there), and familiarity."""
    total = np.zeros((len(texts), words.table.shape[1]))
    parts = [(i, w.lower().split()) for i, t in enumerate(texts) for w in windows(t)]
    words.learn({c for _, p in parts for c in p})
    get = words.__getitem__
    for i, p in parts:
        if p:
            total[i] += words.table[np.fromiter(map(get, p), np.int64, len(p))].sum(0)
    best, score, familiar = np.full(len(texts), -1), np.zeros(len(texts)), np.full(len(texts), -np.inf)
    full = np.flatnonzero(total[:, -1])
    mean = total[full] / total[full, -1:]
    p = _softmax((mean[:, :-2] + model.bias) / model.temperature)
    best[full], score[full], familiar[full] = p.argmax(1), p.max(1), mean[:, -2]
    return best, score, familiar


def least(values: np.ndarray, lost: float = LOST) -> float:
    """A threshold that loses the share `lost` of `values`; further down where they are too few to tell."""
    low, middle = np.quantile(values, [lost, 0.5])
    return float(low - (middle - low) / (1 + len(values) * lost))


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def fit(features: list[tuple[np.ndarray, np.ndarray]], labels: list[str], seed: int = 7) -> Model:
    """Train on (subword, share) pairs of documents; CALIBRATION_SHARE of them calibrate scores and set the thresholds."""
    languages = sorted(set(labels))
    y = np.array([languages.index(x) for x in labels], np.int64)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    held = order[: int(len(y) * CALIBRATION_SHARE)]
    train = order[len(held) :] if len(order) > len(held) else order
    emb = rng.uniform(-0.1, 0.1, (BUCKETS, WIDTH))
    out, bias = np.zeros((WIDTH, len(languages))), np.zeros(len(languages))
    epochs = max(EPOCHS, -(-LEAST_STEPS // max(len(train), 1)))
    steps, at = epochs * len(train), 0
    for _ in range(epochs):
        for i in rng.permutation(train):
            ids, share = features[i]
            if not len(ids):
                continue
            rate = RATE * (1 - at / max(steps, 1))
            at += 1
            h = share @ emb[ids]
            g = _softmax((h @ out + bias)[None])[0]
            g[y[i]] -= 1
            back = out @ g
            out -= rate * np.outer(h, g)
            bias -= rate * g
            emb[ids] -= np.outer(share, rate * 20 * back)  # a mean over many subwords moves each a little
    logits = emb @ out
    seen = np.zeros(BUCKETS)
    for i in train:
        seen[features[i][0]] += features[i][1]
    rarity = np.log((seen + 1e-3) / (seen + 1e-3).sum())
    model = Model(logits, rarity, bias, 1.0, 0.0, -np.inf, languages)
    known = [i for i in (held if len(held) else order) if len(features[i][0])]
    if known:
        z = np.array([features[i][1] @ logits[features[i][0]] + bias for i in known])
        right, n = y[known], len(known)
        sure = (n + 1) / (n + 2)  # Platt's target, or separable rows would sharpen scores without end

        def loss(t: float) -> float:
            p = _softmax(z / t)[np.arange(n), right]
            return float(-(sure * np.log(p + 1e-12) + (1 - sure) * np.log(1 - p + 1e-12)).mean())

        model.temperature = float(min(np.geomspace(0.05, 20, 60), key=loss))
        p = _softmax(z / model.temperature)
        good = np.flatnonzero(p.argmax(1) == right)
        if len(good) < ENOUGH:
            model.threshold = LOWEST
        else:
            top = np.clip(p.max(1)[good], 1e-12, 1 - 1e-12)
            model.threshold = max(LOWEST, float(1 / (1 + np.exp(-least(np.log(top / (1 - top)))))))
            model.familiar = least(np.array([features[known[k]][1] @ rarity[features[known[k]][0]] for k in good]))
    return model


def train(docs: DataFrame, usable: F.Column) -> Model | None:
    """Fit on TRAIN_DOCS usable rows with a language, those of smallest hashes of ids; None if there are none.

    Of the rows of one id that of the least hash of text and language counts, so the sample doesn't depend on any order.
    Null ids, null languages and, as they have no subwords, letterless texts teach nothing.
    """
    rows = docs.where(usable & F.col("lang").isNotNull()).select("doc_id", "lang", "text")
    ids = smallest_hashes(rows, "doc_id", TRAIN_DOCS)
    if not ids:
        return None

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_steps(batches):
            out = []
            for t in texts_of(b):
                counts = np.zeros(BUCKETS, np.int64)
                for w in windows(t):
                    for _, bucket in subword_parts([x for c in w.lower().split() for x in letters(c)]):
                        counts += np.bincount(bucket, minlength=BUCKETS)
                hashes = np.flatnonzero(counts)
                share = counts[hashes] / max(1, counts.sum())
                out.append((hashes.astype("<u2").tobytes(), share.astype("<f4").tobytes()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in out], pa.binary()), pa.array([x for _, x in out], pa.binary())], names=["lang", "h", "n"])

    one = F.min_by(F.struct("lang", "text"), F.struct(F.xxhash64("lang", "text"), "lang", "text")).alias("r")
    chosen = rows.where(F.col("doc_id").isin(ids)).groupBy("doc_id").agg(one).select("r.lang", "r.text")
    got = chosen.mapInArrow(features, "lang string, h binary, n binary").collect()  # TRAIN_DOCS rows of at most 6 x BUCKETS bytes
    got = sorted(got, key=lambda r: (r["lang"], bytes(r["h"]), bytes(r["n"])))
    return fit([(np.frombuffer(bytes(r["h"]), "<u2").astype(np.int32), np.frombuffer(bytes(r["n"]), "<f4")) for r in got], [r["lang"] for r in got])


RESULT = "struct<lang_pred:string,score:double,lang_accepted:boolean>"


def identify(docs: DataFrame, model: Model | None, to: str = "language") -> DataFrame:
    """`docs` with a column `to` of lang_pred, score and lang_accepted (neither threshold rejects it).

    A null or letterless text is `und` with score 0 and is rejected; so is everything without a model (no labels). All
    columns of `docs` come back as they are, with repeated rows; a name for `to` that is taken is an error.
    """
    check_unused(docs, to)
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))  # BUCKETS x (languages + 1) doubles
    names, text = docs.columns, docs.columns.index("text")
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("lang_accepted", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = pickle.loads(shared.value)
        words = m and _Words(m)
        for b in text_steps(batches, 2 << 20):
            texts = [t or "" for t in b.column(text).to_pylist()]
            if m:
                best, score, familiar = predict(m, words, texts)
                if len(words) > MAX_WORDS or words.bytes > MAX_BYTES:
                    words = _Words(m)
                rows = [(m.languages[i] if i >= 0 else UNKNOWN, float(s), bool(i >= 0 and s >= m.threshold and f >= m.familiar)) for i, s, f in zip(best, score, familiar, strict=True)]
            else:
                rows = [(UNKNOWN, 0.0, False)] * len(texts)
            parts = [pa.array([r[k] for r in rows], f.type) for k, f in enumerate(kind)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.StructArray.from_arrays(parts, fields=list(kind))], names=[*names, to])

    from pyspark.sql.types import StructType, _parse_datatype_string

    return docs.mapInArrow(run, StructType([*docs.schema.fields]).add(to, _parse_datatype_string(RESULT)))


def op10_subword_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's language, by a model of the rows that aren't held out; null ids are in training, unlabelled."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, F.coalesce(doc_hash("doc_id") % 5 != 0, F.lit(True)))
    got = identify(docs.select("doc_id", "text"), model)
    return got.select("doc_id", F.coalesce(doc_hash("doc_id") % 5 == 0, F.lit(False)).alias("held_out"), "language.*")
