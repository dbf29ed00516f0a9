"""Quality by co-training: a text classifier and a metadata classifier teach each other, then decide together.

The text view has shares and moments of a text's characters and words, its repetition, and the hashed shapes of its
words; the metadata view has source, language and length as the row states them. Both are logistic regressions. In each round
each view labels all unlabelled documents, and its most confident labels (calibrated, a bounded number of each class)
join the other view's training rows. Labelled rows are dealt into four parts: one trains, one calibrates the views, one
weighs them, and one sets the threshold.

Views are computed once a document and written beside it; rounds and the final scores read them.
"""

from __future__ import annotations

import math
import pickle
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.llm.common import check_unused, materialize, scratch_scope, smallest_hashes, text_steps, unused
from barloom.llm.tokens import windows

#: Bound of the sample of labelled rows, and rows that a view teaches the other a round: this share of the unlabelled ones, at most so
#: many, and of each class in its share of the labelled rows.
LABELLED, TAUGHT, TAUGHT_SHARE = 6000, 400, 0.1
ROUNDS = 4
#: Shares of the labelled rows that train, calibrate each view, weigh both, and set the threshold.
PARTS = (0.64, 0.12, 0.12, 0.12)
SHAPES, PLACES = 32, 64
#: Share of good held-back documents that the threshold may reject, and its limits.
LOST, LOWEST, HIGHEST = 0.002, 0.02, 0.5
MAX_WORDS, MAX_BYTES = 200_000, 32 << 20

_SHAPE = ((re.compile(r"[^\W\d_a-zà-ÿß]+"), "A"), (re.compile(r"[^\W\d_A]+"), "a"), (re.compile(r"\d+"), "0"))
#: Per word: characters, letters, capitals, digits, other marks, marks at its end; then its shape.
_PER_WORD = 6


def word_features(word: str) -> tuple[list[int], int]:
    letters = sum(map(str.isalpha, word))
    capitals = sum(map(str.isupper, word))
    digits = sum(map(str.isdigit, word))
    end = len(word) - len(word.rstrip("!?.,;:*#%&$@~^=+-_"))
    shape = word
    for pattern, mark in _SHAPE:
        shape = pattern.sub(mark, shape)
    return [len(word), letters, capitals, digits, len(word) - letters - digits, end], zlib.crc32(shape.encode()) % SHAPES


class _Words(dict):
    """Row of each word in a growing table of its features."""

    def __init__(self) -> None:
        super().__init__()
        self.table, self.shape, self.used, self.bytes = np.zeros((1024, _PER_WORD)), np.zeros(1024, np.int64), 0, 0

    def __missing__(self, word: str) -> int:
        if self.used == len(self.table):
            self.table, self.shape = np.concatenate([self.table, np.zeros_like(self.table)]), np.concatenate([self.shape, np.zeros_like(self.shape)])
        self.table[self.used], self.shape[self.used] = word_features(word)
        self[word] = self.used
        self.bytes += len(word)
        self.used += 1
        return self.used - 1


TEXT_SIZE = 15 + SHAPES


def text_view(words: _Words, text: str) -> np.ndarray:
    """Features of a whole text; zeros where it has no words."""
    out = np.zeros(TEXT_SIZE)
    rows = np.concatenate([np.fromiter(map(words.__getitem__, w.split()), np.int32) for w in windows(text)])
    if not len(rows):
        return out
    n = len(rows)
    sums = words.table[rows].sum(0)
    ids, counts = np.unique(rows, return_counts=True)
    lines = [x for x in text.split("\n") if x.strip()]
    out[:15] = (
        math.log1p(n), sums[0] / n, sums[1] / sums[0], sums[2] / max(sums[1], 1), sums[3] / sums[0], sums[4] / sums[0], sums[5] / n,
        len(ids) / n, len(ids) / math.sqrt(n), counts.max() / n, (rows[1:] == rows[:-1]).mean() if n > 1 else 0, math.log1p(len(lines)), len(set(lines)) / max(len(lines), 1),
        (counts[counts > 1].sum()) / n, words.table[rows, 0].std(),
    )
    out[15:] = np.bincount(words.shape[rows], minlength=SHAPES) / n
    return out


META_SIZE = 2 * PLACES + 26


def metadata_places(source: str | None, lang: str | None, n_chars: int | None) -> tuple[int, int, int]:
    """The places of a row's source, language and length's octave that are one in its metadata view."""
    return zlib.crc32((source or "").encode()) % PLACES, PLACES + zlib.crc32((lang or "").encode()) % PLACES, 2 * PLACES + min(25, int(max(n_chars or 0, 0)).bit_length())


def metadata_views(places: np.ndarray) -> np.ndarray:
    """(rows, META_SIZE) of (rows, 3) places."""
    out = np.zeros((len(places), META_SIZE))
    np.put_along_axis(out, places.astype(np.int64), 1, axis=1)
    return out


@dataclass
class Logistic:
    """Logistic regression on standardised features, and Platt's line from its margin to log odds."""

    mean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: np.ndarray = field(default_factory=lambda: np.ones(0))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = 0.0
    platt: tuple[float, float] = (1.0, 0.0)

    def fit(self, x: np.ndarray, y: np.ndarray, ridge: float = 2.0, steps: int = 25) -> Logistic:
        self.mean, self.scale = x.mean(0), x.std(0)
        self.scale = np.where(self.scale > 1e-9, self.scale, 1.0)
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        z1 = np.hstack([z, np.ones((len(z), 1))])
        w = np.zeros(z1.shape[1])
        penalty = np.append(np.full(z.shape[1], ridge), 1e-6)
        for _ in range(steps):  # Newton's method
            p = _expit(z1 @ w)
            move = np.linalg.solve((z1 * (p * (1 - p))[:, None]).T @ z1 + np.diag(penalty), z1.T @ (p - y) + penalty * w)
            w -= move
            if np.abs(move).max() < 1e-6:
                break
        self.weights, self.bias = w[:-1], float(w[-1])
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights + self.bias

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        line = Logistic().fit(self.margin(x)[:, None], y, ridge=0.1)
        self.platt = (float(line.weights[0] / line.scale[0]), float(line.bias - line.weights[0] * line.mean[0] / line.scale[0]))

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return self.platt[0] * self.margin(x) + self.platt[1]


def _expit(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    """Both views, the weights of their log odds, the threshold, and the prior where there are no two classes."""

    text: Logistic | None
    meta: Logistic | None
    mix: Logistic | None
    threshold: float
    prior: float
    taught: int = 0
    #: Rows that each view taught the other, by view and class.
    lessons: dict[tuple[str, float], int] = field(default_factory=dict)

    def probability(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        if self.text is None:
            return np.full(len(text), self.prior)
        return _expit(self.mix.margin(np.column_stack([self.text.log_odds(text), self.meta.log_odds(meta)])))


def _least(log_odds: np.ndarray) -> float:
    """The probability that the share LOST of these log odds lies under; further down where they are too few to tell."""
    low, middle = np.quantile(log_odds, [LOST, 0.5])
    return float(_expit(np.array(low - (middle - low) / (1 + len(log_odds) * LOST))))


def deal(y: np.ndarray, seed: int = 11) -> list[np.ndarray] | None:
    """Rows of each part of PARTS, both classes alike; None if a part would lack one."""
    r = np.random.default_rng(seed)
    edges = np.cumsum(PARTS)[:-1]
    dealt = [np.split(rows := r.permutation(np.flatnonzero(y == c)), np.round(edges * len(rows)).astype(int)) for c in (0, 1)]
    parts = [np.sort(np.concatenate(p)) for p in zip(*dealt, strict=True)]
    return parts if all(len(p) for rows in dealt for p in rows) else None


#: What a view teaches: rows' views (text, meta) and its calibrated chances that they are good.
Taught = tuple[np.ndarray, np.ndarray, np.ndarray]
#: From both views' regressions: what text teaches meta, and what meta teaches text. It remembers what it has taught.
Teach = Callable[[Logistic, Logistic], tuple[Taught, Taught]]


def cotrain(text: np.ndarray, meta: np.ndarray, y: np.ndarray, teach: Teach, rounds: int = ROUNDS) -> Model:
    """`y`: 0 or 1 of the labelled rows. With too few of a class for each part of them, only a prior."""
    prior = float(y.mean()) if len(y) else 1.0
    parts = deal(y)
    if parts is None:
        return Model(None, None, None, 0.0, prior)
    train, calibrate, weigh, last = parts
    x_text, x_meta = text[train], meta[train]
    y_text = y_meta = y[train]
    taught = 0
    for k in range(rounds + 1):
        views = Logistic().fit(x_text, y_text), Logistic().fit(x_meta, y_meta)
        for v, x in zip(views, (text, meta), strict=True):
            v.calibrate(x[calibrate], y[calibrate])
        if k == rounds:
            break
        of_text, of_meta = teach(*views)
        x_meta, y_meta = np.vstack([x_meta, of_text[1]]), np.concatenate([y_meta, of_text[2]])
        x_text, y_text = np.vstack([x_text, of_meta[0]]), np.concatenate([y_text, of_meta[2]])
        taught += len(of_text[2]) + len(of_meta[2])
    odds = lambda rows: np.column_stack([views[0].log_odds(text[rows]), views[1].log_odds(meta[rows])])
    mix = Logistic().fit(odds(weigh), y[weigh], ridge=1.0)
    good = mix.margin(odds(last))[y[last] == 1]
    return Model(*views, mix, float(np.clip(_least(good), LOWEST, HIGHEST)), prior, taught)


VIEWS = "struct<text:binary,meta:binary>"


def with_views(docs: DataFrame, to: str = "views", keep: list[str] | None = None) -> DataFrame:
    """`docs` (its columns `keep`, or all) with a column `to` of both views.

    A null text counts as an empty one; null metadata is a value of its own; null ids and repeated rows stay.
    """
    check_unused(docs, to)
    names = docs.columns if keep is None else keep
    fields = [docs.schema[n] for n in names]
    there = len(names)
    read = [F.col(n).cast(t).alias(unused(docs, f"_{n}")) for n, t in (("text", "string"), ("source", "string"), ("lang", "string"), ("n_chars", "long"))]
    inputs = docs.select(*(F.col(f"`{n}`") for n in names), *read)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for b in text_steps(batches, 2 << 20):
            texts, *rest = (b.column(there + k).to_pylist() for k in range(4))
            meta = pa.array([np.array(metadata_places(*r), "<u2").tobytes() for r in zip(*rest, strict=True)], pa.binary())
            text = pa.array([text_view(words, t or "").astype("<f4").tobytes() for t in texts], pa.binary())
            if len(words) > MAX_WORDS or words.bytes > MAX_BYTES:
                words = _Words()
            yield pa.RecordBatch.from_arrays([*b.columns[:there], pa.StructArray.from_arrays([text, meta], ["text", "meta"])], names=[*names, to])

    from pyspark.sql.types import StructType, _parse_datatype_string

    return inputs.mapInArrow(run, StructType(fields).add(to, _parse_datatype_string(VIEWS)))


def _matrices(text: list[bytes], meta: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(text), "<f4").reshape(-1, TEXT_SIZE).astype(float), metadata_views(np.frombuffer(b"".join(meta), "<u2").reshape(-1, 3))


TEACHING = "view string, label double, sure double, doc_id long, text binary, meta binary"


def quotas(rows: int, prior: float) -> dict[float, int]:
    """Rows of each class that a view teaches a round, of so many unlabelled ones: as many of a class as its share of the labelled rows."""
    total = min(TAUGHT, round(TAUGHT_SHARE * rows))
    return {1.0: max(1, round(total * prior)), 0.0: max(1, round(total * (1 - prior)))}


def _most_confident(pool: DataFrame, text: Logistic, meta: Logistic, given: dict[str, set[int]], quota: dict[float, int]) -> list:
    """The `quota` most confident rows of each view and class that the view hasn't given yet; ties by id, then views."""
    models = {"text": text, "meta": meta}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = {name: np.array(sorted(ids), np.int64) for name, ids in given.items()}
        for b in batches:
            if not b.num_rows:
                continue
            ids, texts, metas = (b.column(k).to_pylist() for k in range(3))
            views = dict(zip(models, _matrices(texts, metas), strict=True))
            for name, m in models.items():
                p = _expit(m.log_odds(views[name]))
                new = np.flatnonzero(~np.isin(ids, before[name]))
                for label, sure in ((1.0, p), (0.0, 1 - p)):
                    at = new
                    if len(at) > quota[label]:  # rows of equal confidence as the last one are left for the ranking
                        at = at[sure[at] >= np.sort(sure[at])[-quota[label]]]
                    n = len(at)
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in (([name] * n, pa.string()), ([label] * n, pa.float64()), (sure[at], pa.float64()), ([ids[i] for i in at], pa.int64()), ([texts[i] for i in at], pa.binary()), ([metas[i] for i in at], pa.binary()))], names=[x.split()[0] for x in TEACHING.split(", ")])

    best = Window.partitionBy("view", "label").orderBy(F.desc("sure"), "doc_id", "text", "meta")
    most = F.when(F.col("label") == 1.0, quota[1.0]).otherwise(quota[0.0])
    return pool.mapInArrow(run, TEACHING).withColumn("k", F.row_number().over(best)).where(F.col("k") <= most).collect()  # both quotas of both views


def train(featured: DataFrame, labels: DataFrame, views: str = "views") -> Model:
    """Fit on LABELLED labelled rows, those of smallest hashes of ids, and on what the views teach each other over all others.

    `featured` is a written table of `with_views`. Of labels of one doc_id the mean decides (half is good); null labels
    and ids don't count. Of rows of one id, the least by both views is its document here.
    """
    spark = featured.sparkSession
    marks = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    rows = featured.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{views}`").alias("v"))
    sampled = smallest_hashes(rows.select("doc_id").join(marks, "doc_id", "left_semi"), "doc_id", LABELLED)
    frame = F.broadcast(spark.createDataFrame([(i,) for i in sampled], "doc_id long"))
    known = sorted(rows.join(frame, "doc_id").join(marks, "doc_id").groupBy("doc_id").agg(F.min("v").alias("v"), F.first("y").alias("y")).collect(), key=lambda r: r["doc_id"])  # LABELLED rows
    pool = materialize(rows.join(marks, "doc_id", "left_anti").groupBy("doc_id").agg(F.min("v").alias("v")).select("doc_id", "v.*"), "quality-pool")
    y = np.array([r["y"] for r in known], float)
    quota = quotas(pool.count(), float(y.mean()) if len(y) else 1.0)
    given: dict[str, set[int]] = {"text": set(), "meta": set()}
    lessons: Counter = Counter()

    def teach(text: Logistic, meta: Logistic) -> tuple[Taught, Taught]:
        got = sorted(_most_confident(pool, text, meta, given, quota), key=lambda r: (r["view"], r["label"], r["k"]))
        out = []
        for name in ("text", "meta"):
            mine = [r for r in got if r["view"] == name]
            given[name].update(r["doc_id"] for r in mine)
            lessons.update((name, r["label"]) for r in mine)
            good = np.array([r["sure"] if r["label"] else 1 - r["sure"] for r in mine])
            out.append((*_matrices([bytes(r["text"]) for r in mine], [bytes(r["meta"]) for r in mine]), good))
        return out[0], out[1]

    text, meta = _matrices([bytes(r["v"]["text"]) for r in known], [bytes(r["v"]["meta"]) for r in known])
    model = cotrain(text, meta, y, teach)
    model.lessons = dict(lessons)
    return model


def score(featured: DataFrame, model: Model, views: str = "views", to: str = "quality") -> DataFrame:
    """`featured` with a column `to` of score (0 to 1) and accepted in place of the views.

    Ids don't matter, and repeated rows are scored alike. Without a model of two classes all rows have the labels' mean as
    score and are accepted.
    """
    check_unused(featured, to)
    shared = featured.sparkSession.sparkContext.broadcast(pickle.dumps(model))  # a few thousand numbers
    at = featured.columns.index(views)
    names = [n for n in featured.columns if n != views]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = pickle.loads(shared.value)
        for b in text_steps(batches):
            v = b.column(at)
            p = m.probability(*_matrices(v.field("text").to_pylist(), v.field("meta").to_pylist()))
            rest = [c for k, c in enumerate(b.columns) if k != at]
            yield pa.RecordBatch.from_arrays([*rest, pa.StructArray.from_arrays([pa.array(p, pa.float64()), pa.array(p >= m.threshold, pa.bool_())], ["score", "accepted"])], names=[*names, to])

    from pyspark.sql.types import StructType, _parse_datatype_string

    kept = StructType([f for f in featured.schema.fields if f.name != views])
    return featured.mapInArrow(run, kept.add(to, _parse_datatype_string("struct<score:double,accepted:boolean>")))


def classify(docs: DataFrame, labels: DataFrame, to: str = "quality", keep: list[str] | None = None) -> DataFrame:
    """Train on `docs` and `labels`, and score all of `docs`: its columns (or those of `keep`) and `to`, as `score` has it.

    All columns come back as they are; a name for `to` that is taken is an error. An empty table gives an empty result.
    """
    check_unused(docs, to)
    views = unused(docs, "views")
    featured = materialize(with_views(docs, views, keep), "quality-views")
    with scratch_scope(docs.sparkSession):
        model = train(featured, labels, views)
    return score(featured, model, views, to)


def op1_cotraining_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality; a null text counts as an empty one, and null ids and repeated rows are scored each."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "labels"))
    return classify(docs, labels, keep=["doc_id"]).select("doc_id", F.col("quality.score").alias("score"), F.col("quality.accepted").alias("kept"))
