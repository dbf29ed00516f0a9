"""Close-fill trade simulation: one state machine for each (symbol, variant), over its bars in order.

On a bar's close, first the stops (loss before gain), then an exit by signal, then an entry where flat and where the
signal differs from the bar before, and at the last bar whatever is open is closed.

A history is many tasks. Which positions are held doesn't depend on money, and is known again after a position's end: stretches of
bars settle it side by side (`Decisions`). A stretch's money then is a linear map of what enters it, known from its fills; the
maps are chained, a row a stretch, and each stretch is simulated from the account that enters it. Only where an amount is fixed
(sizing `fixed_quote`) the map isn't linear, and a history goes through one task.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators.scan import Stretches, ordered_scan, unpack

#: Default fees by market, in percent (fixed values).
FEES_PCT = {1: 0.075, 2: 0.1, 3: 0.075, 4: 0.1}
DIRECTIONS = ("long-only", "short-only", "long-short")
SIZINGS = ("fixed_quote", "all_in", "strategy_compound", "strategy_compound_profit_lock")
TRADES = (
    "symbol string, variant long, trade_id int, direction string, entry_idx long, exit_idx long, entry_fill double, exit_fill double, qty double, "
    "entry_quote double, exit_quote double, entry_fee double, exit_fee double, gross_pnl double, net_pnl double, locked double, reason string"
)
EQUITY = "symbol string, variant long, idx long, equity double, in_position boolean, exposure double"


@dataclass(frozen=True)
class Execution:
    """How trades are filled and sized. Rates are fractions; stop levels are relative to the fill price."""

    cash: float = 1000.0
    direction: str = "long-short"
    sizing: str = "all_in"
    fixed_quote: float = 0.0
    fee: float = 0.0
    slippage: float = 0.0
    safe_percent: float = 0.0
    stop_loss: float | None = None
    take_profit: float | None = None

    def __post_init__(self) -> None:
        if self.direction not in DIRECTIONS or self.sizing not in SIZINGS:
            raise ValueError(f"direction is one of {DIRECTIONS}, sizing one of {SIZINGS}")
        if self.cash <= 0:
            raise ValueError("cash must be above 0")


class Account:
    """State of one simulation: money free and set aside, the open position, and the signal before."""

    __slots__ = ("e", "free", "safe", "open", "before", "count", "stop_loss", "take_profit")

    def __init__(self, e: Execution, stop_loss: float | None, take_profit: float | None) -> None:
        self.e, self.free, self.safe, self.open, self.before, self.count = e, e.cash, 0.0, None, 0, 0
        self.stop_loss, self.take_profit = stop_loss, take_profit

    def enter(self, idx: int, close: float, side: int) -> None:
        quote = self.free if self.e.sizing != "fixed_quote" else min(self.free, self.e.fixed_quote)
        if quote <= 0 or (side > 0 and self.e.direction == "short-only") or (side < 0 and self.e.direction == "long-only"):
            return
        fill = close * (1 + side * self.e.slippage)
        fee = quote * self.e.fee
        self.free -= quote + fee  # the fee comes on top
        self.count += 1
        self.open = (self.count, side, idx, fill, quote / fill, quote, fee)

    def leave(self, idx: int, close: float, reason: str) -> tuple:
        number, side, entry, fill, qty, quote, fee = self.open
        exit_fill = close * (1 - side * self.e.slippage)
        got = qty * exit_fill
        exit_fee = got * self.e.fee
        gross = side * (got - quote)
        net = gross - fee - exit_fee
        locked = net * self.e.safe_percent / 100 if self.e.sizing == "strategy_compound_profit_lock" and net > 0 else 0.0
        self.free += quote + gross - exit_fee - locked
        self.safe += locked
        self.open = None
        return (number, "long" if side > 0 else "short", entry, idx, fill, exit_fill, qty, quote, got, fee, exit_fee, gross, net, locked, reason)

    def stop(self, close: float) -> str | None:
        side, fill = self.open[1], self.open[3]
        if self.stop_loss is not None and side * (close - fill * (1 - side * self.stop_loss)) <= 0:
            return "sl"
        if self.take_profit is not None and side * (close - fill * (1 + side * self.take_profit)) >= 0:
            return "tp"
        return None

    def bar(self, idx: int, close: float, signal: int) -> list[tuple]:
        out = []
        if self.open and (reason := self.stop(close)):
            out.append(self.leave(idx, close, reason))
        if self.open and signal != self.open[1]:
            out.append(self.leave(idx, close, "signal_exit"))
        if not self.open and signal != self.before and signal:
            self.enter(idx, close, signal)
        self.before = signal
        return out

    def value(self, close: float) -> float:
        if not self.open:
            return self.free + self.safe
        _, side, _, _, qty, quote, _ = self.open
        return self.free + self.safe + quote + side * (qty * close - quote)


def _stops(e: Execution, key: tuple) -> tuple[float | None, float | None]:
    """The stops' rates, which may come with the variant."""
    return e.stop_loss if key[2] is None else key[2], e.take_profit if key[3] is None else key[3]


def _account(e: Execution, key: tuple, entry: bytes | None) -> Account:
    """A new account, or the one that enters a stretch."""
    account = Account(e, *_stops(e, key))
    if entry is not None:
        s = unpack(entry)
        account.free, account.safe, account.before, account.count = s["free"], s["safe"], s["before"], s["count"]
        if s["side"]:
            account.open = (s["count"], s["side"], s["idx"], s["fill"], s["quote"] / s["fill"], s["quote"], s["quote"] * e.fee)
    return account


class Decisions:
    """Positions without money: what `Account` holds and when, as long as there is money to enter with.

    Beside them goes what a stretch does to money, as sums of what entered it (free, safe, and in the open position). A trade
    that loses all that is free ends all entries.
    """

    def __init__(self, e: Execution) -> None:
        self.e = e

    def start(self, key: tuple) -> dict:
        stop_loss, take_profit = _stops(self.e, key)
        return {"side": 0, "idx": None, "fill": None, "before": 0, "stop_loss": stop_loss, "take_profit": take_profit}

    def step(self, s: dict, row: tuple) -> list[tuple]:
        idx, close, signal, e = int(row[0]), float(row[1]), int(row[2]), self.e
        if "_free" not in s:
            s.update(_free=(1.0, 0.0, 0.0), _safe=(0.0, 1.0, 0.0), _quote=(0.0, 0.0, 1.0), _count=0, _broke=False)
        side, fill = s["side"], s["fill"]
        if side:
            loss, gain = s["stop_loss"], s["take_profit"]
            out = (loss is not None and side * (close - fill * (1 - side * loss)) <= 0) or (gain is not None and side * (close - fill * (1 + side * gain)) >= 0)
            if out or signal != side:
                ratio = close * (1 - side * e.slippage) / fill
                rate = side * (ratio - 1) - e.fee - ratio * e.fee
                locked = rate * e.safe_percent / 100 if e.sizing == "strategy_compound_profit_lock" and rate > 0 else 0.0
                back = 1 + side * (ratio - 1) - ratio * e.fee - locked
                s["_free"] = tuple(x + back * q for x, q in zip(s["_free"], s["_quote"], strict=True))
                s["_safe"] = tuple(x + locked * q for x, q in zip(s["_safe"], s["_quote"], strict=True))
                s["_quote"] = (0.0, 0.0, 0.0)
                s["_broke"] = s["_broke"] or back - e.fee <= 0
                s.update(side=0, idx=None, fill=None)
        if not s["side"] and signal != s["before"] and signal and not s["_broke"] and not (e.direction == "short-only" and signal > 0) and not (e.direction == "long-only" and signal < 0):
            s["_quote"] = s["_free"]
            s["_free"] = tuple(-e.fee * x for x in s["_free"])
            s["_count"] += 1
            s.update(side=signal, idx=idx, fill=close * (1 + signal * e.slippage))
        s["before"] = signal
        return []

    @staticmethod
    def summary(s: dict) -> tuple:
        return s["_free"], s["_safe"], s["_quote"], s["_count"], s["_broke"]

    def entries(self, cut: Stretches) -> DataFrame:
        """(_key, _s, entry): the account that enters each stretch."""
        settled, cash = cut.settle(self.start, self.step, self.summary), self.e.cash

        def step(s: dict, row: tuple) -> list[tuple]:
            at, entry, summary = row
            state, (free, safe, quote, count, broke) = unpack(bytes(entry)), pickle.loads(bytes(summary))
            money = (s["free"], s["safe"], s["quote"])
            if s["broke"]:
                state.update(side=0, idx=None, fill=None)
            known = {k: v for k, v in state.items() if k in ("side", "idx", "fill", "before")}
            out = (s["key"], at, pickle.dumps([*known.items(), ("free", money[0]), ("safe", money[1]), ("quote", money[2]), ("count", s["count"])]))
            if not s["broke"]:
                s["free"], s["safe"], s["quote"] = (sum(a * b for a, b in zip(form, money, strict=True)) for form in (free, safe, quote))
                s["count"], s["broke"] = s["count"] + count, broke
            return [out]

        return ordered_scan(settled, ["_key"], ["_s"], ["_s", "entry", "summary"], lambda key: {"key": key[0], "free": cash, "safe": 0.0, "quote": 0.0, "count": 0, "broke": False}, step, "_key string, _s long, entry binary")


def _prepared(signals: DataFrame) -> DataFrame:
    """Bars of the target range with a close, and a variant and its stops (NULL: the execution's own)."""
    df = signals
    for name, kind in (("variant", "long"), ("stop_loss", "double"), ("take_profit", "double")):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(0 if name == "variant" else None).cast(kind))
    return df.where("close is not null")


KEYS, COLUMNS = ("symbol", "variant", "stop_loss", "take_profit"), ("idx", "close", "signal")


class Simulation:
    """The simulations of `signals` (symbol, idx, close, signal, and maybe variant, stop_loss, take_profit): their bars, and the accounts that enter their stretches."""

    def __init__(self, signals: DataFrame, execution: Execution) -> None:
        self.bars, self.execution, self.cut, self.entering = _prepared(signals), execution, None, None
        if execution.sizing != "fixed_quote":
            self.cut = Stretches(self.bars, KEYS, COLUMNS)
            self.entering = Decisions(execution).entries(self.cut) if self.cut.several else None

    def _run(self, load: Callable[[tuple, bytes | None], list], step: Callable[[list, tuple], list[tuple]], schema: str, end: Callable[[list, bool], list[tuple]]) -> DataFrame:
        if self.cut is None:
            return ordered_scan(self.bars, KEYS, ["idx"], COLUMNS, lambda key: load(key, None), step, schema, lambda s: end(s, True))
        return self.cut.emit(self.entering, load, step, schema, end)

    def trades(self) -> DataFrame:
        """Trades, numbered by entry; two may end on one bar (a reversal on the last one), in that order."""
        execution = self.execution

        def load(key: tuple, entry: bytes | None) -> list:
            return [key, _account(execution, key, entry), None]

        def step(s: list, row: tuple) -> list[tuple]:
            s[2] = (int(row[0]), float(row[1]))
            return [(*s[0][:2], *t) for t in s[1].bar(*s[2], int(row[2]))]

        def end(s: list, last: bool) -> list[tuple]:
            return [(*s[0][:2], *s[1].leave(*s[2], "forced_close"))] if last and s[1].open else []

        return self._run(load, step, TRADES, end)

    def equity_curve(self) -> DataFrame:
        """Value of each account at each bar's close, whether a trade covers the bar, and its entry's share of the value.

        A trade covers its bars from entry to exit, both included; at the last bar it's closed, with its costs.
        """
        execution = self.execution

        def load(key: tuple, entry: bytes | None) -> list:
            return [key, _account(execution, key, entry), None, 0.0]

        def row(s: list) -> list[tuple]:
            account, (idx, close), quote = s[1], s[2], s[3]
            value = account.value(close)
            return [(*s[0][:2], idx, value, quote > 0, quote / value if value else 0.0)]

        def step(s: list, new: tuple) -> list[tuple]:
            out = row(s) if s[2] else []  # a bar's row waits until it's known not to be the last
            done = s[1].bar(int(new[0]), float(new[1]), int(new[2]))
            s[2] = (int(new[0]), float(new[1]))
            s[3] = s[1].open[5] if s[1].open else done[-1][7] if done else 0.0
            return out

        def end(s: list, last: bool) -> list[tuple]:
            if last and s[1].open:
                s[1].leave(*s[2], "forced_close")
            return row(s)

        return self._run(load, step, EQUITY, end)


def trades(signals: DataFrame, execution: Execution) -> DataFrame:
    return Simulation(signals, execution).trades()


def equity_curve(signals: DataFrame, execution: Execution) -> DataFrame:
    return Simulation(signals, execution).equity_curve()


class Accounts:
    """Many simulations side by side, as arrays: a bar changes all of them at once by the rules of `Account`."""

    def __init__(self, e: Execution, stop_loss: np.ndarray, take_profit: np.ndarray) -> None:
        n = len(stop_loss)
        self.e, self.stop_loss, self.take_profit = e, stop_loss, take_profit  # NaN: none
        self.free, self.safe, self.peak, self.deepest = np.full(n, e.cash), np.zeros(n), np.full(n, -np.inf), np.zeros(n)
        self.side, self.before, self.count = np.zeros(n), np.zeros(n), np.zeros(n, np.int64)
        self.fill, self.qty, self.quote, self.fee, self.won, self.lost = (np.zeros(n) for _ in range(6))
        self.close: float | None = None

    def leave(self, close: float, who: np.ndarray) -> None:
        side, quote, e = self.side[who], self.quote[who], self.e
        got = self.qty[who] * (close * (1 - side * e.slippage))
        fee = got * e.fee
        gross = side * (got - quote)
        net = gross - self.fee[who] - fee
        locked = np.where(net > 0, net * e.safe_percent / 100, 0.0) if e.sizing == "strategy_compound_profit_lock" else np.zeros(len(net))
        self.free[who] += quote + gross - fee - locked
        self.safe[who] += locked
        self.won[who] += np.maximum(net, 0)
        self.lost[who] += np.maximum(-net, 0)
        self.count[who] += 1
        self.side[who] = 0

    def value(self) -> np.ndarray:
        return self.free + self.safe + np.where(self.side != 0, self.quote + self.side * (self.qty * self.close - self.quote), 0.0)

    def settle(self) -> np.ndarray:
        """Count the bar before into peaks and drawdowns."""
        value = self.value()
        np.maximum(self.peak, value, out=self.peak)
        np.maximum(self.deepest, 1 - value / self.peak, out=self.deepest)
        return value

    def bar(self, close: float, signal: np.ndarray) -> None:
        if self.close is not None:
            self.settle()
        side, fill, e = self.side, self.fill, self.e
        held = side != 0
        with np.errstate(invalid="ignore"):
            out = held & ((side * (close - fill * (1 - side * self.stop_loss)) <= 0) | (side * (close - fill * (1 + side * self.take_profit)) >= 0) | (signal != side))
        if out.any():
            self.leave(close, np.flatnonzero(out))
        quote = self.free if e.sizing != "fixed_quote" else np.minimum(self.free, e.fixed_quote)
        enter = (self.side == 0) & (signal != self.before) & (signal != 0) & (quote > 0)
        if e.direction != "long-short":
            enter &= signal == (1 if e.direction == "long-only" else -1)
        who = np.flatnonzero(enter)
        if len(who):
            way, paid = signal[who], quote[who]
            self.side[who], self.quote[who], self.fee[who] = way, paid, paid * e.fee
            self.fill[who] = close * (1 + way * e.slippage)
            self.qty[who] = paid / self.fill[who]
            self.free[who] -= paid + self.fee[who]
        self.before, self.close = signal, close

    def end(self) -> np.ndarray:
        """Close what is open, and give the last values."""
        self.leave(self.close, np.flatnonzero(self.side != 0))
        return self.settle()


#: Variants of a symbol that are worth a task of their own, and those that a task simulates side by side at most.
TOGETHER, MOST_TOGETHER = 2048, 131_072
FIGURES = "symbol string, variant long, final double, max_drawdown double, won double, lost double, num_trades long"


def tasks_of(variants: int, symbols: int, slots: int) -> int:
    """Tasks that share a symbol's variants: enough for two a slot over all symbols, but each a copy of the symbol's bars, however many variants there are."""
    most = -(-variants // TOGETHER)
    return max(1, min(most, max(-(-2 * slots // max(symbols, 1)), -(-variants // MOST_TOGETHER))))


def packed(signals: DataFrame) -> DataFrame:
    """(symbol, idx, close, signals) with a bar's signals as bits: those that are long, then those that are short."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                sig = b.column(3).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                bits = np.hstack([np.packbits(sig == 1, axis=1), np.packbits(sig == -1, axis=1)])
                ends = np.arange(b.num_rows + 1, dtype=np.int32) * bits.shape[1]
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(bits))])], names=["symbol", "idx", "close", "signals"])

    return signals.select("symbol", "idx", "close", "signals").mapInArrow(run, "symbol string, idx long, close double, signals binary")


def _unpacked(column: pa.Array) -> np.ndarray:
    """(bars, points): -1, 0 or 1, and zeros beyond the last point."""
    bits = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), 2, -1)
    both = np.unpackbits(bits, axis=2).view(np.int8)
    return both[:, 0] - both[:, 1]


def figures(variants: DataFrame, signals: DataFrame, execution: Execution) -> DataFrame:
    """FIGURES of each variant after one pass over its symbol's bars.

    `variants` has symbol, block, variant, points (places in a bar's `signals`, joined by AND) and stops (NULL: the
    execution's own); `tasks_of` says how many blocks a symbol's variants should be. `signals` has symbol, idx, close and signals, an array.
    A block's variants come first, then its bars stream by in order: a task holds one batch of them and the accounts. Bars move
    once a block, with two bits a point.
    """
    bars = packed(signals.where("close is not null"))
    blocks = variants.select("symbol", "block").distinct()
    stop = lambda c: F.coalesce(F.col(c), F.lit(getattr(execution, c)).cast("double")).alias(c)
    none = lambda kind: F.lit(None).cast(kind)
    first = variants.select("symbol", "block", F.lit(False).alias("bar"), F.col("variant").alias("at"), none("double").alias("close"), F.col("points"), none("binary").alias("signals"), stop("stop_loss"), stop("take_profit"))
    rest = bars.join(blocks, "symbol").select("symbol", "block", F.lit(True).alias("bar"), F.col("idx").alias("at"), "close", none("array<int>").alias("points"), "signals", none("double").alias("stop_loss"), none("double").alias("take_profit"))
    names = ["symbol", "block", "bar", "at", "close", "points", "signals", "stop_loss", "take_profit"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, known, accounts, points = None, [], None, None

        def finish() -> Iterator[pa.RecordBatch]:
            if accounts is not None:
                final, n = accounts.end(), len(known)
                cols = [pa.array([now[0]] * n, pa.string()), pa.array([k[0] for k in known], pa.int64()), *(pa.array(x) for x in (final, accounts.deepest, accounts.won, accounts.lost, accounts.count))]
                yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in FIGURES.split(", ")])

        for b in batches:
            at = 0
            symbols, blocks_, is_bar = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()
            while at < b.num_rows:
                key = (symbols[at], blocks_[at])
                if key != now:
                    yield from finish()
                    now, known, accounts, points = key, [], None, None
                to = at
                while to < b.num_rows and (symbols[to], blocks_[to]) == key and is_bar[to] == is_bar[at]:
                    to += 1
                part = b.slice(at, to - at)
                if not is_bar[at]:
                    known += zip(*(part.column(k).to_pylist() for k in (3, 5, 7, 8)), strict=True)
                elif known:
                    if accounts is None:
                        stops = np.array([[np.nan if x is None else x for x in k[2:]] for k in known], float)
                        most = max(len(k[1]) for k in known)
                        points = np.array([[*k[1], *[k[1][0]] * (most - len(k[1]))] for k in known], np.int64)  # one signal more than once is one
                        accounts = Accounts(execution, stops[:, 0].copy(), stops[:, 1].copy())
                    rows = _unpacked(part.column(6))
                    for close, row in zip(part.column(4).to_pylist(), rows, strict=True):
                        each = row[points]
                        low, high = each.min(1), each.max(1)
                        accounts.bar(close, np.where(low == 1, 1.0, np.where(high == -1, -1.0, 0.0)))
                at = to
        yield from finish()

    return first.unionByName(rest).repartition("symbol", "block").sortWithinPartitions("symbol", "block", "bar", "at").select(*names).mapInArrow(run, FIGURES)


def fee_rate(market_id: int) -> float:
    return FEES_PCT[market_id] / 100
