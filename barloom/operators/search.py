"""Search over parameter grids: guards, signals of all variants, simulation, and two stages of ranking.

A grid is numbers: `spark.range` and mixed radix make its variants, never the driver. A bar's signals of all points of all
parts are one array column, so that variants are places in it, and blocks of variants are simulated side by side.
"""

from __future__ import annotations

import re
import time
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import cached_property
from itertools import groupby, product
from math import prod

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.functions.scalars import canonical_json, decode_radix, div
from barloom.operators.execution import Execution, figures, tasks_of
from barloom.operators.indicators import registry
from barloom.operators.lengths import grid_signals, has_kernel
from barloom.operators.signals import column_signals, evaluate
from barloom.sources.scratch import materialize

MOST_VARIANTS, MOST_BYTES = 600_000, 5 << 30
#: Points whose windows are one stage, and stages after which a plan is cut by a table.
SHARED, STAGES = 64, 16
#: Ranking columns and whether more is better (fixed values).
RANKINGS = {"total_return_pct": True, "max_drawdown_pct": False, "return_over_max_drawdown": True, "profit_factor": True}


@dataclass(frozen=True)
class Part:
    """An indicator with a grid of its parameters, and its signal rule's parameters."""

    indicator: str
    axes: Mapping[str, Sequence] = field(default_factory=dict)
    signal: Mapping[str, object] = field(default_factory=dict)

    @property
    def size(self) -> int:
        """Number of points; axes are checked."""
        for name, values in self.axes.items():
            if not len(values) or len(set(values)) != len(values):
                raise ValueError(f"axis {name} of {self.indicator} needs values, each once")
        return prod(map(len, self.axes.values()))

    @cached_property
    def _points(self) -> list[dict]:
        return [dict(zip(self.axes, p, strict=True)) for p in product(*self.axes.values())]

    def points(self) -> list[dict]:
        """All combinations, the last axis fastest, each once."""
        return self._points if self.size else []


def merge_defaults(axes: Mapping[str, Sequence], defaults: Mapping[str, Sequence]) -> dict[str, Sequence]:
    """Default axes, those of a request in place of them."""
    return {**defaults, **axes}


def risk_variants(stop_loss: Sequence[float | None] = (None,), take_profit: Sequence[float | None] = (None,)) -> list[tuple[float | None, float | None]]:
    """All pairs, losses outside; a disabled side is one None."""
    return list(product(stop_loss or (None,), take_profit or (None,)))


def estimate(parts: Sequence[Part], bars: int, risks: int = 1) -> dict[str, int]:
    """Number of variants and bytes for so many bars: 28 a bar, 4 a value, and a reserve."""
    n, values = prod(p.size for p in parts), sum(p.size for p in parts)
    held = 28 * bars + 4 * bars * values
    return {"variants": n * risks, "bytes": held + max(64 << 20, held // 5)}


def enforce_guards(estimated: Mapping[str, int], most_variants: int = MOST_VARIANTS, most_bytes: int = MOST_BYTES) -> None:
    """Raise before any job runs if a request is too large."""
    if estimated["variants"] > most_variants:
        raise ValueError(f"{estimated['variants']} variants; at most {most_variants} are allowed")
    if estimated["bytes"] > most_bytes:
        raise ValueError(f"{estimated['bytes']} bytes; at most {most_bytes} are allowed")


def grid(spark: SparkSession, parts: Sequence[Part]) -> DataFrame:
    """(variant, key, points): each variant's point of each part, by number. The key is the SHA-256 of its canonical JSON."""
    sizes = [p.size for p in parts]
    out = spark.range(prod(sizes)).select(F.col("id").alias("variant"), *(c.cast("int").alias(f"p{k}") for k, c in enumerate(decode_radix(F.col("id"), sizes))))
    names = sorted((f"{k}:{p.indicator}", k) for k, p in enumerate(parts))
    for name, k in names:  # one row a point of a part, so their number is a sum, not a product
        some = [(i, f"{canonical_json(name, True)}:{canonical_json(point | dict(parts[k].signal), True)}") for i, point in enumerate(parts[k].points())]
        out = out.join(F.broadcast(spark.createDataFrame(some, f"p{k} int, j{k} string")), f"p{k}")
    json = F.concat(F.lit("{"), F.concat_ws(",", *(F.col(f"j{k}") for _, k in names)), F.lit("}"))
    return out.select("variant", F.sha2(json, 256).alias("key"), F.array(*(f"p{k}" for k in range(len(parts)))).alias("points"))


def point_signals(bars: DataFrame, parts: Sequence[Part]) -> DataFrame:
    """(symbol, idx, close, signals): each bar's signals of all points of the first part, then of the second, and so on."""
    if not parts:
        raise ValueError("a search needs at least one indicator")
    columns = bars.columns
    out, stages = bars.withColumn("_sig", F.array().cast("array<byte>")), 0
    for kernel, some in groupby(parts, lambda p: has_kernel(p.indicator)):
        if kernel:  # windows of all lengths of all of them in one pass
            out = grid_signals(out, [(p.indicator, p.points(), p.signal) for p in some], "_sig")
            continue
        for p in some:
            points, indicator = p.points(), registry()[p.indicator]
            step = SHARED if indicator.many else 1
            for at in range(0, len(points), step):
                few = points[at : at + step]
                wide = column_signals(out, p.indicator, few, **p.signal) if indicator.many else None
                if wide is None:
                    for point in few:
                        s = evaluate(out, p.indicator, point, **p.signal)
                        out = s.select(*columns, F.concat("_sig", F.array("signal")).alias("_sig"))
                else:
                    out = wide[0].select(*columns, F.concat("_sig", F.array(*wide[1])).alias("_sig"))
                stages += 1
                if stages % STAGES == 0:
                    out = materialize(out, "point-signals")
    return out.select("symbol", "idx", "close", F.col("_sig").alias("signals"))


def score(variants: DataFrame, signals: DataFrame, execution: Execution) -> DataFrame:
    """The four ranking figures and the number of trades of each (symbol, variant), from one pass over the bars."""
    f = figures(variants, signals, execution)
    total, deepest = 100 * (F.col("final") / execution.cash - 1), 100 * F.col("max_drawdown")
    return f.select(
        "symbol", "variant", total.alias("total_return_pct"), deepest.alias("max_drawdown_pct"), div(F.col("won"), F.col("lost")).alias("profit_factor"), "num_trades", div(total, deepest).alias("return_over_max_drawdown")
    )


def ranking(primary: str, secondary: str | None = None) -> list[Column]:
    """Sort order: the primary figure, the secondary one, then the variant's key; missing figures last."""
    order = []
    for name in (primary, secondary):
        if name is not None:
            if name not in RANKINGS:
                raise ValueError(f"{name} is no ranking figure; one of {', '.join(RANKINGS)}")
            order.append(F.desc_nulls_last(name) if RANKINGS[name] else F.asc_nulls_last(name))
    return [*order, F.asc("key"), F.asc("symbol")]


def stage_a(bars: DataFrame, parts: Sequence[Part], execution: Execution, tf_ms: int, preselect: int = 20_000, primary: str = "total_return_pct", secondary: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The best `preselect` variants without stops, and the signals of all points; both are written, as stage B reads them again."""
    sizes = [p.size for p in parts]
    if prod(sizes) > MOST_VARIANTS:
        raise ValueError(f"{prod(sizes)} variants; at most {MOST_VARIANTS} are allowed")
    signals = materialize(point_signals(bars, parts), "search-signals")
    firsts = [sum(sizes[:k]) for k in range(len(sizes))]
    places = F.array(*(F.col("points")[k] + F.lit(n) for k, n in enumerate(firsts)))
    total, symbols = prod(sizes), signals.select("symbol").distinct()
    per = -(-total // tasks_of(total, symbols.count(), bars.sparkSession.sparkContext.defaultParallelism)) or 1  # variants of a block
    variants = grid(bars.sparkSession, parts).select("variant", "key", places.alias("points"), F.floor(F.col("variant") / per).alias("block"))
    stops = [F.lit(None).cast("double").alias(c) for c in ("stop_loss", "take_profit")]
    every = symbols.select("symbol", F.explode(F.sequence(F.lit(0).cast("long"), F.lit((total - 1) // per).cast("long"))).alias("b"))  # every symbol runs every variant
    every = every.select("symbol", F.explode(F.sequence(F.col("b") * per, F.least((F.col("b") + 1) * per, F.lit(total)) - 1)).alias("variant"))
    each = every.join(variants.select("variant", "points", "block", *stops), "variant")
    scored = score(each, signals, replace(execution, stop_loss=None, take_profit=None)).join(variants.select("variant", "key", "points"), "variant")
    return materialize(scored.orderBy(*ranking(primary, secondary)).limit(preselect), "shortlist"), signals


def stage_b(shortlist: DataFrame, signals: DataFrame, risks: Sequence[tuple[float | None, float | None]], execution: Execution, tf_ms: int, top_k: int = 300, primary: str = "total_return_pct", secondary: str | None = None) -> DataFrame:
    """The best `top_k` of the shortlist with every pair of stops, None being none. A variant's new id counts its pairs too."""
    pairs = F.array(*(F.struct(F.lit(i).alias("risk"), F.lit(a).cast("double").alias("stop_loss"), F.lit(b).cast("double").alias("take_profit")) for i, (a, b) in enumerate(risks)))
    chosen = shortlist.select("symbol", "variant", "key", "points", F.explode(pairs).alias("r")).select("symbol", (F.col("variant") * len(risks) + F.col("r.risk")).alias("variant"), "key", "points", "r.*")
    # places among a symbol's, so that blocks are full however sparse the shortlist's ids are
    n, symbols = chosen.agg(F.count("*"), F.countDistinct("symbol")).first()
    per = max(1, -(-n // max(symbols, 1)))  # a symbol's rows, about
    blocks = tasks_of(per, symbols, shortlist.sparkSession.sparkContext.defaultParallelism)
    place = F.row_number().over(Window.partitionBy("symbol").orderBy("variant")) - 1  # the shortlist is bounded by stage A
    numbered = chosen.select("symbol", "variant", "points", "stop_loss", "take_profit", (place % blocks).cast("long").alias("block"))
    scored = score(numbered, signals, replace(execution, stop_loss=None, take_profit=None))
    order = ranking(primary, secondary)
    return scored.join(chosen.drop("points"), ["symbol", "variant"]).orderBy(*order, F.asc("risk")).limit(top_k)


def merge_top(best: DataFrame | None, more: DataFrame, k: int, primary: str, secondary: str | None = None) -> DataFrame:
    """The best k of what was kept and a new block of variants."""
    both = more if best is None else best.unionByName(more)
    return both.orderBy(*ranking(primary, secondary)).limit(k)


def _last_snapshot(spark: SparkSession, path: str, blocks: int) -> tuple[int, str | None]:
    """How many blocks the newest whole snapshot in `path` holds, and its folder."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    for f in fs.listStatus(folder) if fs.exists(folder) else ():
        name = re.fullmatch(r"blocks=(\d+)-of-(\d+)", f.getPath().getName())
        if name and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS")):
            if int(name[2]) != blocks:
                raise ValueError(f"{path} has snapshots of another search: of {name[2]} blocks, not {blocks}")
            found.append((int(name[1]), f.getPath().toString()))
    return max(found, default=(0, None))


def snapshots(
    shortlist: DataFrame, signals: DataFrame, risks: Sequence[tuple[float | None, float | None]], execution: Execution, tf_ms: int, path: str, block: int = 4096, every: int = 4, top_k: int = 300, primary: str = "total_return_pct", secondary: str | None = None, seconds: float | None = None
) -> DataFrame:
    """Stage B by blocks of about `block` rows of the shortlist, whose best so far are written after `every` blocks, after `seconds`, and at the end.

    The shortlist is bounded by stage A's limit; a snapshot is a folder of its own in `path`, so a reader always has a whole one.
    A run with the same shortlist and `path` goes on after the newest snapshot: its blocks are not run again.
    """
    spark, blocks = shortlist.sparkSession, max(1, -(-shortlist.count() // block))
    done, last = _last_snapshot(spark, path, blocks)
    best, since = spark.read.parquet(last) if last else None, time.monotonic()
    for k in range(done, blocks):
        some = shortlist.where(F.pmod(F.xxhash64("symbol", "variant"), F.lit(blocks)) == k)
        best = materialize(merge_top(best, stage_b(some, signals, risks, execution, tf_ms, top_k, primary, secondary), top_k, primary, secondary), "best")
        if k + 1 - done >= every or k + 1 == blocks or (seconds is not None and time.monotonic() - since >= seconds):
            best.write.mode("overwrite").parquet(f"{path}/blocks={k + 1}-of-{blocks}")
            done, since = k + 1, time.monotonic()
    return best


def page(df: DataFrame, size: int, after: tuple | None = None) -> DataFrame:
    """Rows by (created_at, job_id) from the newest on, after a cursor; one more than `size` tells whether there's a next page."""
    if after is not None:
        df = df.where(F.struct("created_at", "job_id") < F.struct(F.lit(after[0]), F.lit(after[1])))
    return df.orderBy(F.desc("created_at"), F.desc("job_id")).limit(size + 1)
