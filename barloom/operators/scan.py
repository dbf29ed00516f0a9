"""Order-dependent operations over a symbol's bars, spread over stretches of its history.

* `rolled`: windows of bounded length. A stretch of SIZE buckets gets copies of the rows before (and after) it that
  its windows reach, so that one symbol's history is many partitions.
* `linear_scans`: y = decay * y + gain * x, which starts with y = x and starts anew after a missing x. What a row leaves
  after some rows is less than a double can tell, so a stretch gets copies of as many rows before it, as windows do, and
  all scans of an indicator, those of others' outputs too, are one pass over it in numpy.
* `running_sums` and `running_max`: windows inside stretches, and what the stretches before carry over (a row a stretch).
* `stretched_scan`: a state machine over stretches side by side. Each starts from what rows before it make of a cold start;
  where that isn't what the stretch before leaves, it is run again from there, until all agree.
* `ordered_scan`: any state machine, streamed in order with a carried state; a key's rows meet in one task, in batches.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from barloom.sources.scratch import materialize

SIZE = 65_536


class Rolling:
    """Window expressions inside a stretch. A value is NULL unless its frame has `w` rows that aren't."""

    def __init__(self) -> None:
        self.order = Window.partitionBy("symbol", "_s").orderBy("idx")
        #: Place of a row in its stretch, negative before it.
        self.place = F.col("idx") - F.col("_s") * SIZE

    def frame(self, w: int):
        return self.order.rowsBetween(-(w - 1), 0)

    def full(self, x: Column, w: int, value: Column) -> Column:
        return F.when(F.count(x).over(self.frame(w)) == w, value)

    def agg(self, f: Callable[[Column], Column], x: Column, w: int) -> Column:
        return self.full(x, w, f(x).over(self.frame(w)))

    def mean(self, x: Column, w: int) -> Column:
        return self.agg(F.avg, x, w)

    def sum(self, x: Column, w: int) -> Column:
        return self.agg(F.sum, x, w)

    def max(self, x: Column, w: int) -> Column:
        return self.agg(F.max, x, w)

    def min(self, x: Column, w: int) -> Column:
        return self.agg(F.min, x, w)

    def std(self, x: Column, w: int) -> Column:
        return self.agg(F.stddev_pop, x, w)

    def var(self, x: Column, w: int) -> Column:
        return self.agg(F.var_pop, x, w)

    def wma(self, x: Column, w: int) -> Column:
        """Linear weights, the newest heaviest."""
        f = self.frame(w)
        return self.full(x, w, (F.sum(self.place * x).over(f) - (self.place - w) * F.sum(x).over(f)) / (w * (w + 1) / 2))

    def lag(self, x: Column, n: int = 1) -> Column:
        return F.lag(x, n).over(self.order)

    def lead(self, x: Column, n: int = 1) -> Column:
        return F.lead(x, n).over(self.order)


def rolled(df: DataFrame, back: int, f: Callable[[DataFrame, Rolling], DataFrame], ahead: int = 0) -> DataFrame:
    """`f` over stretches in which every row has `back` rows before it and `ahead` rows after it, where there are any."""
    idx = F.col("idx")
    copies = F.sequence(F.floor((idx - ahead) / SIZE), F.floor((idx + back) / SIZE))
    out = f(df.withColumn("_s", F.explode(copies)), Rolling())
    return out.where(F.floor(idx / SIZE) == F.col("_s")).drop("_s")


#: What a row's share of y may shrink to before its stretch forgets it, and rows of a block of `recurrence`.
FORGOTTEN, BLOCK = 1e-19, 256


def recurrence(x: np.ndarray, decay: float, gain: float) -> np.ndarray:
    """The scan of x; NaN in x is missing. Blocks go side by side, and then each gets what the one before carries over."""
    n = len(x)
    rows = -(-n // BLOCK)
    missing = np.isnan(x)
    starts = missing.copy()
    starts[1:] |= missing[:-1]
    starts[:1] = True
    a, u = np.zeros(rows * BLOCK), np.zeros(rows * BLOCK)
    a[:n] = np.where(starts, 0.0, decay)
    u[:n] = np.where(missing, 0.0, np.where(starts, x, gain * x))
    y, left = u.reshape(rows, BLOCK).T.copy(), a.reshape(rows, BLOCK).T.copy()  # one row a place in the blocks
    for k in range(1, BLOCK):
        y[k] += left[k] * y[k - 1]
        left[k] *= left[k - 1]
    carry, c = np.empty(rows), 0.0
    for k, (keep, more) in enumerate(zip(left[-1].tolist(), y[-1].tolist(), strict=True)):
        carry[k] = c
        c = keep * c + more
    out = (y + left * carry).T.ravel()[:n]
    out[missing] = np.nan
    return out


def _memory(decay: float) -> int:
    """Rows after which a row's share is forgotten."""
    return 1 if decay <= 0 else math.ceil(math.log(FORGOTTEN) / math.log(decay))


def linear_scans(df: DataFrame, scans: Sequence[tuple[str, str, float, float]]) -> DataFrame:
    """`df` with a column for each (input, output, decay, gain), decay below 1; an input may be an output before it."""
    back: dict[str, int] = {}
    for name, to, decay, _ in scans:
        back[to] = back.get(name, 0) + _memory(decay)
    idx, most, size = F.col("idx"), max(back.values()), SIZE
    columns = df.columns

    def run(part: pa.Table) -> pa.Table:
        at = part["idx"].to_numpy()
        part = part.take(pa.array(np.argsort(at, kind="stable")))
        keep = pa.array(part["idx"].to_numpy() // size == part["_s"][0].as_py())
        values: dict[str, np.ndarray] = {}
        for name, to, decay, gain in scans:
            x = values[name] if name in values else part[name].to_numpy().astype(float)
            values[to] = recurrence(x, decay, gain)
        part = part.select(columns).filter(keep)
        for to, y in values.items():
            part = part.append_column(to, pa.array(y, from_pandas=True).filter(keep))
        return part

    schema = StructType([*df.schema.fields])
    for _, to, _, _ in scans:
        schema = schema.add(to, "double")
    cut = df.withColumn("_s", F.explode(F.sequence(F.floor(idx / SIZE), F.floor((idx + most) / SIZE))))
    return cut.groupBy("symbol", "_s").applyInArrow(run, schema)


def running_sums(df: DataFrame, sums: Sequence[tuple[str, str]]) -> DataFrame:
    """`df` with the sum so far for each (input, output); it is missing where the input is, and starts anew after that."""
    stretch, before = Window.partitionBy("symbol", "_s").orderBy("idx"), Window.partitionBy("symbol").orderBy("_s")
    d = df.withColumn("_s", F.floor(F.col("idx") / SIZE))
    for k, (name, _) in enumerate(sums):
        x = F.col(name)
        d = d.withColumn(f"_r{k}", F.count(F.when(x.isNull(), 1)).over(stretch))
        d = d.withColumn(f"_y{k}", F.when(x.isNotNull(), F.sum(x).over(Window.partitionBy("symbol", "_s", f"_r{k}").orderBy("idx"))))
    ends = [e for k in range(len(sums)) for e in (F.coalesce(F.max_by(f"_y{k}", "idx"), F.lit(0.0)).alias(f"_e{k}"), F.max(f"_r{k}").alias(f"_n{k}"))]
    carry = d.groupBy("symbol", "_s").agg(*ends)
    for k in range(len(sums)):
        # stretches since the last one with a missing input, that one's rest included
        carry = carry.withColumn(f"_g{k}", F.count(F.when(F.col(f"_n{k}") > 0, 1)).over(before))
        carry = carry.withColumn(f"_c{k}", F.sum(f"_e{k}").over(Window.partitionBy("symbol", f"_g{k}").orderBy("_s")))
        carry = carry.withColumn(f"_c{k}", F.coalesce(F.lag(f"_c{k}").over(before), F.lit(0.0)))
    d = d.join(carry.select("symbol", "_s", *(f"_c{k}" for k in range(len(sums)))), ["symbol", "_s"])
    whole = [(F.col(f"_y{k}") + F.when(F.col(f"_r{k}") == 0, F.col(f"_c{k}")).otherwise(0.0)).alias(to) for k, (_, to) in enumerate(sums)]
    return d.select(*df.columns, *whole)


def running_max(df: DataFrame, keys: Sequence[str], value: Column, to: str, inclusive: bool) -> DataFrame:
    """`df` with the greatest `value` of a key's rows so far, by idx, with or without the row's own."""
    d = df.withColumns({"_s": F.floor(F.col("idx") / SIZE), "_v": value})
    before = Window.partitionBy(*keys).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    carry = d.groupBy(*keys, "_s").agg(F.max("_v").alias("_m")).withColumn("_m", F.max("_m").over(before))
    here = F.max("_v").over(Window.partitionBy(*keys, "_s").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1))
    return d.join(carry, [*keys, "_s"]).withColumn(to, F.greatest(here, "_m")).select(*df.columns, to)


def ewma(df: DataFrame, *scans: tuple[str, str, float]) -> DataFrame:
    """Exponential averages: (input, output, alpha) each, starting with the first value."""
    return linear_scans(df, [(x, y, 1 - a, a) for x, y, a in scans])


def ordered_scan(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], start: Callable[[tuple], object], step: Callable[[object, tuple], list[tuple]], schema: str | StructType, end: Callable[[object], list[tuple]] | None = None) -> DataFrame:
    """Rows of each key in order through `step(state, row)`, whose rows come out; `end(state)` after the key's last row.

    `start(key)` makes a mutable state. A task holds one batch and one state, however long a key's history is.
    """
    names = [x.split()[0] for x in schema.split(", ")] if isinstance(schema, str) else schema.names

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for b in batches:
            out: list[tuple] = []
            cols = [b[c].astype(object).where(b[c].notna(), None).tolist() for c in (*keys, *columns)]
            for row in zip(*cols, strict=True):
                k = row[: len(keys)]
                if k != key:
                    if end and key is not None:
                        out += end(state)
                    key, state = k, start(k)
                out += step(state, row[len(keys) :])
            yield pd.DataFrame(out, columns=names)
        if end and key is not None:
            yield pd.DataFrame(end(state), columns=names)

    ordered = df.select(*dict.fromkeys([*keys, *columns, *order])).repartition(*keys).sortWithinPartitions(*keys, *order)
    return ordered.mapInPandas(run, schema)


#: Rows before a stretch from which its entry state is guessed.
WARM = 4096
Start, Step, End = Callable[[tuple], dict], Callable[[dict, tuple], list[tuple]], Callable[[dict], list[tuple]]


def pack(state: dict) -> bytes:
    """A state as bytes, the same for equal ones; what is under names with an underscore belongs to a stretch, not to the state."""
    return pickle.dumps(sorted((k, v) for k, v in state.items() if not k.startswith("_")))


def unpack(raw: bytes) -> dict:
    return dict(pickle.loads(raw))


def _values(part: pa.Table, names: Sequence[str]) -> list[tuple]:
    """Rows of `names` in the order of idx; NaN is missing."""
    part = part.take(pa.array(np.argsort(part["idx"].to_numpy(), kind="stable")))
    return [*zip(*([None if x != x else x for x in part[n].to_pylist()] for n in names), strict=True)]


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = [*zip(*rows, strict=True)] or [[]] * len(schema)
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


class Stretches:
    """Rows of each key, by idx, cut into stretches of SIZE; they are written once, and every pass reads them as they are.

    A group of a pass is a stretch, with WARM rows more in the first one, whatever a key's history is. Rows of a key have
    different idx; nulls and repeated keys are keys of their own.
    """

    SETTLED = pa.schema([("_key", pa.string()), ("_s", pa.int64()), ("entry", pa.binary()), ("exit", pa.binary()), ("summary", pa.binary())])

    def __init__(self, df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> None:
        self.keys, self.columns, self.size = [*keys], [*columns], SIZE
        # Spark keeps a table's own columns by name, so a key may be a column of the rows, too
        d = df.select(*dict.fromkeys([*keys, "idx", *columns])).withColumn("_key", F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}))
        self.rows = materialize(d, "stretches").withColumn("_s", F.floor(F.col("idx") / self.size))
        ends = self.rows.groupBy("_key").agg((F.max("_s") - F.min("_s")).alias("more"))
        self.several = bool(ends.agg(F.coalesce(F.max("more"), F.lit(0))).first()[0])

    def settle(self, start: Start, step: Step, summary: Callable[[dict], object] = lambda state: None) -> DataFrame:
        """(_key, _s, entry, exit, summary) of each stretch, written: states before and after it, and what `summary` says at its end."""
        keys, columns, size, schema, last = self.keys, self.columns, self.size, self.SETTLED, WARM

        def run(key: tuple, s: int, part: pa.Table, entry: bytes | None) -> tuple:
            rows = _values(part, [*keys, "idx", *columns])
            own, width = rows[0][: len(keys)], len(keys)
            state = start(own) if entry is None else unpack(entry)
            if entry is None:
                for r in rows:
                    if r[width] < s * size:
                        step(state, r[width + 1 :])
                state = unpack(pack(state))
            entry = pack(state)
            for r in rows:
                if r[width] >= s * size:
                    step(state, r[width + 1 :])
            return key, s, entry, pack(state), pickle.dumps(summary(state))

        def guess(key: tuple, part: pa.Table) -> pa.Table:
            s = key[1].as_py()
            own = part["idx"].to_numpy().max() >= s * size  # else only copies that reach beyond the key's last stretch, or into a hole
            return _table([run(key[0].as_py(), s, part, None)] if own else [], schema)

        def again(key: tuple, part: pa.Table, known: pa.Table) -> pa.Table:
            return _table([run(key[0].as_py(), key[1].as_py(), part, known["entry"][0].as_py())] if len(known) and len(part) else [], schema)

        kind, idx = "_key string, _s long, entry binary, exit binary, summary binary", F.col("idx")
        group = ("_key", "_s")
        copies = self.rows.withColumn("_s", F.explode(F.sequence(F.col("_s"), F.floor((idx + last) / size))))
        done = materialize(copies.groupBy(*group).applyInArrow(guess, kind), "settled")
        while True:
            before = F.lag("exit").over(Window.partitionBy("_key").orderBy("_s"))  # a row a stretch
            wrong = materialize(done.withColumn("due", before).where("due is not null and due <> entry").select("_key", "_s", F.col("due").alias("entry")), "unsettled")
            if not wrong.limit(1).count():
                return done
            rows = self.rows.join(wrong.select(*group), [*group], "left_semi")
            mended = rows.groupBy(*group).cogroup(wrong.groupBy(*group)).applyInArrow(again, kind)
            done = materialize(done.join(wrong, [*group], "left_anti").unionByName(mended), "settled")

    def emit(self, entries: DataFrame | None, load: Callable[[tuple, bytes | None], object], step: Callable[[object, tuple], list[tuple]], schema: str | StructType, end: Callable[[object, bool], list[tuple]] | None = None) -> DataFrame:
        """Rows of all stretches from their entry states (`entries`: _key, _s, entry; none: every key is one stretch), as `ordered_scan` has them.

        `end` is told whether a stretch is its key's last.
        """
        from pyspark.sql.pandas.types import to_arrow_schema
        from pyspark.sql.types import _parse_datatype_string

        keys, columns = self.keys, self.columns
        out = to_arrow_schema(_parse_datatype_string(schema) if isinstance(schema, str) else schema)

        def run(part: pa.Table, entry: bytes | None, last: bool) -> pa.Table:
            rows, width, made = _values(part, [*keys, *columns]), len(keys), []
            if rows:
                state = load(rows[0][:width], entry)
                for r in rows:
                    made += step(state, r[width:])
                if end:
                    made += end(state, last)
            return _table(made, out)

        if entries is None:
            return self.rows.groupBy("_key").applyInArrow(lambda part: run(part, None, True), schema)

        def one(key: tuple, part: pa.Table, known: pa.Table) -> pa.Table:
            return run(part, known["entry"][0].as_py(), known["last"][0].as_py()) if len(known) else _table([], out)

        known = entries.withColumn("last", F.lead("_s").over(Window.partitionBy("_key").orderBy("_s")).isNull()).select("_key", "_s", "entry", "last")
        return self.rows.groupBy("_key", "_s").cogroup(known.groupBy("_key", "_s")).applyInArrow(one, schema)


def stretched_scan(df: DataFrame, keys: Sequence[str], columns: Sequence[str], start: Start, step: Step, schema: str | StructType, end: End | None = None) -> DataFrame:
    """What `ordered_scan` gives by idx, with a key's history spread over tasks. A state is a dict of plain values.

    The first stretch of a key starts as `start` says, so its states are right, and each round makes at least the next
    one's right: the result doesn't depend on guesses. A machine that forgets needs one or two rounds; one that
    remembers forever needs as many as there are stretches.
    """
    cut = Stretches(df, keys, columns)
    load = lambda key, entry: start(key) if entry is None else unpack(entry)
    return cut.emit(cut.settle(start, step) if cut.several else None, load, step, schema, end and (lambda state, last: end(state) if last else []))
