"""Windows of many lengths in one pass: all points of a grid from a stretch's arrays, and their signals as bytes.

A stretch is sorted once and held as numpy arrays with the rows before (and after) it that the longest window reaches. Means of any
length come from one array of running sums, highest and lowest values from one table of doubling widths, and weighted sums
and variances from a convolution each; a second stage reads the first one's array. So a grid costs a pass, not a plan a point.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.scalars import sqrt_floor
from barloom.operators import scan
from barloom.operators.indicators import canonical, registry
from barloom.operators.signals import check_parameters, own_names, rule_of


def over(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a / b, missing where b is 0."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(b == 0, np.nan, a / b)


class Lengths:
    """Windows over a stretch's rows in order; NaN is missing, and a frame with a missing value, or too few rows, gives one."""

    def __init__(self, columns: Mapping[str, np.ndarray]) -> None:
        o, h, low, c, v = (columns[n] for n in ("open", "high", "low", "close", "volume"))
        self.series = {"open": o, "high": h, "low": low, "close": c, "volume": v, "hl2": (h + low) / 2, "hlc3": (h + low + c) / 3, "ohlc4": (o + h + low + c) / 4}
        self.kept: dict[tuple, object] = {}

    def _keep(self, key: tuple, make: Callable[[], object]) -> object:
        if key not in self.kept:
            self.kept[key] = make()
        return self.kept[key]

    @staticmethod
    def _at_end(values: np.ndarray, w: int, n: int) -> np.ndarray:
        """Values of whole frames, each at its last row."""
        out = np.full(n, np.nan)
        out[w - 1 :] = values
        return out

    def full(self, x: np.ndarray, w: int) -> np.ndarray:
        """Whether each row's frame of w rows has all values."""
        known = np.concatenate([[0], np.cumsum(~np.isnan(x))])
        out = np.zeros(len(x), bool)
        if len(x) >= w:
            out[w - 1 :] = known[w:] - known[:-w] == w
        return out

    def _summed(self, name: str) -> tuple[np.ndarray, np.ndarray, float]:
        """Running sums of a series less its mean (so that they stay small), those of known values, and the mean."""

        def make() -> tuple:
            x = self.series[name]
            known = ~np.isnan(x)
            mean = float(x[known].mean()) if known.any() else 0.0
            return np.concatenate([[0.0], np.cumsum(np.where(known, x - mean, 0.0))]), np.concatenate([[0], np.cumsum(known)]), mean

        return self._keep(("sums", name), make)

    def mean(self, name: str, w: int) -> np.ndarray:
        sums, known, mean = self._summed(name)
        n = len(sums) - 1
        if n < w:
            return np.full(n, np.nan)
        out = self._at_end(np.where(known[w:] - known[:-w] == w, mean + (sums[w:] - sums[:-w]) / w, np.nan), w, n)
        high = self.max(name, w)
        return np.where(high == self.min(name, w), high, out)  # exact where all values are one, as of no volume

    def sum(self, name: str, w: int) -> np.ndarray:
        return self.mean(name, w) * w

    def _extreme(self, name: str, w: int, sign: int) -> np.ndarray:
        levels = self._keep(("extremes", name, sign), lambda: [sign * self.series[name]])
        n = len(levels[0])
        if n < w:
            return np.full(n, np.nan)
        k = w.bit_length() - 1
        while len(levels) <= k:
            step = 1 << (len(levels) - 1)
            levels.append(np.maximum(levels[-1][step:], levels[-1][:-step]))  # NaN in it is NaN
        m = levels[k]
        return self._at_end(sign * np.maximum(m[: n - w + 1], m[w - (1 << k) : w - (1 << k) + n - w + 1]), w, n)

    def max(self, name: str, w: int) -> np.ndarray:
        return self._extreme(name, w, 1)

    def min(self, name: str, w: int) -> np.ndarray:
        return self._extreme(name, w, -1)

    def wma(self, x: np.ndarray, w: int) -> np.ndarray:
        """Linear weights, the newest heaviest."""
        if len(x) < w:
            return np.full(len(x), np.nan)
        known = np.where(np.isnan(x), 0.0, x)
        out = self._at_end(np.correlate(known, np.arange(1.0, w + 1), "valid") / (w * (w + 1) / 2), w, len(x))
        return np.where(self.full(x, w), out, np.nan)

    def var(self, name: str, w: int) -> np.ndarray:
        """Population variance; exactly 0 where a frame's values are all one."""
        x = self.series[name]
        n = len(x)
        if n < w:
            return np.full(n, np.nan)
        y = np.where(np.isnan(x), 0.0, x - self._summed(name)[2])
        ones = np.ones(w)
        mean = np.correlate(y, ones, "valid") / w
        out = self._at_end(np.maximum(np.correlate(y * y, ones, "valid") / w - mean * mean, 0.0), w, n)
        out[self.max(name, w) == self.min(name, w)] = 0.0
        return np.where(self.full(x, w), out, np.nan)

    def std(self, name: str, w: int) -> np.ndarray:
        return np.sqrt(self.var(name, w))

    def lag(self, x: np.ndarray, k: int) -> np.ndarray:
        out = np.full(len(x), np.nan)
        if k < len(x):
            out[k:] = x[: len(x) - k]
        return out

    def lead(self, x: np.ndarray, k: int) -> np.ndarray:
        return self.lag(x[::-1], k)[::-1]

    def product(self, name: str, a: str, b: str) -> str:
        """A series of two others' products, by name; it is missing where one is."""
        if name not in self.series:
            self.series[name] = self.series[a] * self.series[b]
        return name


@dataclass(frozen=True)
class Kernel:
    """An indicator's values at one point, and how many rows before and after a row they read."""

    values: Callable[[Lengths, dict], np.ndarray]
    back: Callable[[dict], int] = lambda p: p["window"]
    ahead: Callable[[dict], int] = lambda p: 0


def _hma(s: Lengths, p: dict) -> np.ndarray:
    x, w = s.series[p["source"]], p["window"]
    return s.wma(2 * s.wma(x, max(1, w // 2)) - s.wma(x, w), sqrt_floor(w))


def _vwma(s: Lengths, p: dict) -> np.ndarray:
    if "v|c" not in s.series:
        s.series["v|c"] = np.where(np.isnan(s.series["close"]), np.nan, s.series["volume"])
    return over(s.sum(s.product("cv", "close", "volume"), p["window"]), s.sum("v|c", p["window"]))


def _place(s: Lengths, x: np.ndarray, w: int) -> np.ndarray:
    low, high = s.min("low", w), s.max("high", w)
    return over(x - low, high - low)


def _stoch(s: Lengths, p: dict) -> np.ndarray:
    raw, w = 100 * _place(s, s.series["close"], p["k_window"]), p["smoothing"]
    whole = s.full(raw, w)
    sums = np.concatenate([[0.0], np.cumsum(np.where(np.isnan(raw), 0.0, raw - 50))])
    out = np.full(len(raw), np.nan)
    if len(raw) >= w:
        out[w - 1 :] = 50 + (sums[w:] - sums[:-w]) / w
    return np.where(whole, out, np.nan)


def _fisher(s: Lengths, p: dict) -> np.ndarray:
    n = np.clip(2 * _place(s, s.series["hl2"], p["window"]) - 1, -0.999, 0.999)
    return 0.5 * np.log((1 + n) / (1 - n))


def _ichimoku(s: Lengths, p: dict) -> np.ndarray:
    mid = lambda w: s._keep(("mid", w), lambda: (s.max("high", w) + s.min("low", w)) * 0.5)
    return s.lead((mid(p["conversion_window"]) + mid(p["base_window"])) * 0.5, p["displacement"])


def _percent_b(s: Lengths, p: dict) -> np.ndarray:
    mean, half = s.mean(p["source"], p["window"]), p["mult"] * s.std(p["source"], p["window"])
    return over(s.series[p["source"]] - (mean - half), 2 * half)


_WMA = Kernel(lambda s, p: s.wma(s.series[p["source"]], p["window"]))
_MEAN = Kernel(lambda s, p: s.mean(p["source"], p["window"]))
KERNELS: dict[str, Kernel] = {
    "ma.sma": _MEAN,
    "ma.wma": _WMA,
    "ma.lwma": _WMA,
    "ma.hma": Kernel(_hma, lambda p: p["window"] + sqrt_floor(p["window"])),
    "ma.vwma": Kernel(_vwma),
    "momentum.roc": Kernel(lambda s, p: 100 * (over(s.series[p["source"]], s.lag(s.series[p["source"]], p["window"])) - 1)),
    "momentum.williams_r": Kernel(lambda s, p: -100 * over(s.max("high", p["window"]) - s.series["close"], s.max("high", p["window"]) - s.min("low", p["window"]))),
    "momentum.fisher": Kernel(_fisher),
    "momentum.stoch": Kernel(_stoch, lambda p: p["k_window"] + p["smoothing"]),
    "trend.donchian": Kernel(lambda s, p: (s.max("high", p["window"]) + s.min("low", p["window"])) / 2),
    "trend.ichimoku": Kernel(_ichimoku, lambda p: max(p["conversion_window"], p["base_window"]), lambda p: p["displacement"]),
    "volatility.bbands": _MEAN,
    "volatility.bbands_percent_b": Kernel(_percent_b),
    "volume.volume_sma": Kernel(lambda s, p: s.mean("volume", p["window"])),
    "volume.vwap": Kernel(lambda s, p: over(s.sum(s.product("tpv", "hlc3", "volume"), p["window"]), s.sum("volume", p["window"]))),
    "zscore": Kernel(lambda s, p: over(s.series[p["source"]] - s.mean(p["source"], p["window"]), s.std(p["source"], p["window"]))),
}


def _sides(long: np.ndarray, short: np.ndarray) -> np.ndarray:
    return (long & ~short).astype(np.int8) - (short & ~long).astype(np.int8)


#: Signals of values, a stretch's series, a point and the rule's parameters; NaN compares as false.
RULES: dict[str, Callable[[np.ndarray, Mapping[str, np.ndarray], dict, dict], np.ndarray]] = {
    "compare_price_to_output": lambda v, s, p, q: _sides(s[p.get("source", "close")] > v, s[p.get("source", "close")] < v),
    "threshold_band": lambda v, s, p, q: _sides(v <= q["long_threshold"], v >= q["short_threshold"]) if q["long_threshold"] <= q["short_threshold"] else _sides(v >= q["long_threshold"], v <= q["short_threshold"]),
    "sign": lambda v, s, p, q: _sides(v > 0, v < 0),
    "compare_volume_to_output": lambda v, s, p, q: _sides(s["volume"] > v, s["volume"] < v),
}


def has_kernel(indicator: str) -> bool:
    return canonical(indicator) in KERNELS and rule_of(indicator) in RULES


def _pass(df: DataFrame, grids: Sequence[tuple[str, list[dict], dict]], to: str, kind: str, made: Callable[[Lengths, int, int], np.ndarray]) -> DataFrame:
    """`df` with an array column `to` (after what it holds already) of one value a point; `made` gives the k-th point's of the g-th grid."""
    from pyspark.sql.types import StructType, _parse_datatype_string

    kernels = [KERNELS[canonical(name)] for name, _, _ in grids]
    back = max((k.back(p) for k, (_, points, _) in zip(kernels, grids, strict=True) for p in points), default=0)
    ahead = max((k.ahead(p) for k, (_, points, _) in zip(kernels, grids, strict=True) for p in points), default=0)
    size, total = scan.SIZE, sum(len(points) for _, points, _ in grids)
    if total * size >= 1 << 31:
        raise ValueError(f"{total} points; a pass takes at most {(1 << 31) // size - 1}")
    columns = [n for n in df.columns if n != to]
    numbers = [len(points) for _, points, _ in grids]

    def run(part: pa.Table) -> pa.Table:
        part = part.take(pa.array(np.argsort(part["idx"].to_numpy(), kind="stable")))
        keep = part["idx"].to_numpy() // size == part["_s"][0].as_py()
        series = Lengths({n: part[n].to_numpy().astype(float) for n in ("open", "high", "low", "close", "volume")})
        n, at = int(keep.sum()), 0
        before = part[to].combine_chunks().filter(pa.array(keep)) if to in part.column_names else None
        held = len(before.flatten()) // max(n, 1) if before is not None else 0
        out = np.empty((n, held + total), np.int8 if kind == "byte" else np.float64)
        if held:
            out[:, :held] = before.flatten().to_numpy(zero_copy_only=False).reshape(n, held)
        for g, many in enumerate(numbers):
            for k in range(many):
                out[:, held + at] = made(series, g, k)[keep]
                at += 1
        offsets = pa.array(np.arange(n + 1, dtype=np.int64) * (held + total), pa.int32())
        values = pa.array(out.ravel(), from_pandas=kind != "byte")
        return part.select(columns).filter(pa.array(keep)).append_column(to, pa.ListArray.from_arrays(offsets, values))

    idx = F.col("idx")
    cut = df.withColumn("_s", F.explode(F.sequence(F.floor((idx - ahead) / size), F.floor((idx + back) / size))))
    schema = StructType([df.schema[n] for n in columns]).add(to, _parse_datatype_string(f"array<{kind}>"))
    return cut.groupBy("symbol", "_s").applyInArrow(run, schema)


def grid_values(bars: DataFrame, indicator: str, points: Sequence[Mapping], to: str = "values") -> DataFrame:
    """`bars` with an array of the indicator's values at all points, in their order; one pass over the bars."""
    checked = [registry()[indicator].parameters(p) for p in points]
    kernel = KERNELS[canonical(indicator)]
    return _pass(bars, [(indicator, checked, {})], to, "double", lambda s, g, k: kernel.values(s, checked[k]))


def grid_signals(bars: DataFrame, grids: Sequence[tuple[str, Sequence[Mapping], Mapping]], to: str) -> DataFrame:
    """`bars` with signals of all points of (indicator, points, signal parameters), added to the array column `to`."""
    checked = []
    for name, points, params in grids:
        params = own_names(params)
        check_parameters(rule_of(name), params)
        checked.append((name, [registry()[name].parameters(p) for p in points], params))
    kernels, rules = [KERNELS[canonical(n)] for n, _, _ in checked], [RULES[rule_of(n)] for n, _, _ in checked]

    def made(s: Lengths, g: int, k: int) -> np.ndarray:
        _, points, params = checked[g]
        with np.errstate(invalid="ignore"):
            return rules[g](kernels[g].values(s, points[k]), s.series, points[k], params)

    return _pass(bars, checked, to, "byte", made)
