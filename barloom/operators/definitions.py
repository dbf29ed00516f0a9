"""The indicator library: each definition adds a column `value` to a dense bar table.

A window of w bars has a value only if all its w inputs are there; recursive ones start anew after a missing input;
a division by zero is missing. Of definitions with several outputs, `value` is the primary one.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from barloom.functions.scalars import div, sqrt_floor
from barloom.operators.indicators import Indicator, Registry
from barloom.operators.scan import Rolling, ewma, rolled, running_sums, stretched_scan

O, H, L, C, V = (F.col(x) for x in ("open", "high", "low", "close", "volume"))
#: Price series by name.
SOURCES: dict[str, Column] = {"open": O, "high": H, "low": L, "close": C, "hl2": (H + L) / 2, "hlc3": (H + L + C) / 3, "ohlc4": (O + H + L + C) / 4}
SOURCE_AXIS = ("close", "hl2", "hlc3", "ohlc4", "low", "high", "open")

REGISTRY: dict[str, Indicator] = Registry()
#: Values of several points of parameters in one pass, as columns of these names.
Many = Callable[[DataFrame, list[dict], list[str]], DataFrame]


def _define(id_: str, outputs: tuple[str, ...] = ("value",), primary: str | None = None, **defaults: object) -> Callable:
    def add(f: Callable[[DataFrame, dict], DataFrame], many: Many | None = None) -> Callable:
        family = id_.split(".")[0] if "." in id_ else "structure"
        series = SOURCE_AXIS if "source" in defaults else ("open", "high", "low", "close", "volume")
        REGISTRY[id_] = Indicator(id_, family, defaults, f, outputs, primary or outputs[0], series, many)
        return f

    return add


def _src(df: DataFrame, p: dict) -> DataFrame:
    return df.withColumn("x", SOURCES[p.get("source", "close")])


def _windowed(id_: str, value: Callable[[Rolling, dict], Column], back: Callable[[dict], int] = lambda p: p["window"], ahead: Callable[[dict], int] = lambda p: 0, **kw: object) -> None:
    """An indicator of one window stage over x or the bar's own columns."""

    def compute(df: DataFrame, p: dict) -> DataFrame:
        return rolled(_src(df, p), back(p), lambda d, r: d.withColumn("value", value(r, p)), ahead(p))

    def many(df: DataFrame, points: list[dict], names: list[str]) -> DataFrame:
        for source in dict.fromkeys(p.get("source", "close") for p in points):  # their windows share stretches and their sort
            some = {n: p for n, p in zip(names, points, strict=True) if p.get("source", "close") == source}
            stages = lambda d, r, some=some: d.withColumns({n: value(r, p) for n, p in some.items()})
            df = rolled(_src(df, {"source": source}), max(map(back, some.values())), stages, max(map(ahead, some.values())))
        return df

    _define(id_, **kw)(compute, many)


X = F.col("x")
TP = SOURCES["hlc3"]


def _true_range(r: Rolling) -> Column:
    """greatest() skips NULLs: without a previous close it's high - low."""
    before = r.lag(C)
    return F.when(H.isNotNull() & L.isNotNull(), F.greatest(H - L, F.abs(H - before), F.abs(L - before)))


def _with_tr(df: DataFrame) -> DataFrame:
    return rolled(df, 1, lambda d, r: d.withColumn("tr", _true_range(r)))


def _with_atr(df: DataFrame, w: int) -> DataFrame:
    return ewma(_with_tr(df), ("tr", "atr", 1 / w))


# Moving averages
_windowed("ma.sma", lambda r, p: r.mean(X, p["window"]), source="close", window=5)
_windowed("ma.wma", lambda r, p: r.wma(X, p["window"]), source="close", window=5)
_windowed("ma.lwma", lambda r, p: r.wma(X, p["window"]), source="close", window=5)
_windowed("ma.vwma", lambda r, p: div(r.sum(C * V, p["window"]), r.sum(F.when(C.isNotNull(), V), p["window"])), window=5)


def _ema_like(id_: str, alpha: Callable[[int], float]) -> None:
    def many(df: DataFrame, points: list[dict], names: list[str]) -> DataFrame:
        inputs = {f"x_{p['source']}": SOURCES[p["source"]] for p in points}
        return ewma(df.withColumns(inputs), *((f"x_{p['source']}", n, alpha(p["window"])) for n, p in zip(names, points, strict=True)))

    _define(id_, source="close", window=5)(lambda df, p: ewma(_src(df, p), ("x", "value", alpha(p["window"]))), many)


EMA, RMA = (lambda w: 2 / (w + 1)), (lambda w: 1 / w)
_ema_like("ma.ema", EMA)
_ema_like("ma.rma", RMA)
_ema_like("ma.smma", RMA)


def _chained(df: DataFrame, p: dict, n: int) -> DataFrame:
    return ewma(_src(df, p), *(("x" if k == 1 else f"e{k - 1}", f"e{k}", EMA(p["window"])) for k in range(1, n + 1)))


_define("ma.dema", source="close", window=5)(lambda df, p: _chained(df, p, 2).withColumn("value", 2 * F.col("e1") - F.col("e2")))
_define("ma.tema", source="close", window=5)(lambda df, p: _chained(df, p, 3).withColumn("value", 3 * F.col("e1") - 3 * F.col("e2") + F.col("e3")))


@_define("ma.zlema", source="close", window=5)
def _zlema(df: DataFrame, p: dict) -> DataFrame:
    n = (p["window"] - 1) // 2
    ahead = rolled(_src(df, p), n, lambda d, r: d.withColumn("y", X + (X - r.lag(X, n)) if n else X))
    return ewma(ahead, ("y", "value", EMA(p["window"])))


@_define("ma.hma", source="close", window=9)
def _hma(df: DataFrame, p: dict) -> DataFrame:
    w, root = p["window"], sqrt_floor(p["window"])
    stages = lambda d, r: d.withColumn("y", 2 * r.wma(X, max(1, w // 2)) - r.wma(X, w)).withColumn("value", r.wma(F.col("y"), root))
    return rolled(_src(df, p), w + root, stages)


# Momentum
def _with_moves(df: DataFrame, p: dict) -> DataFrame:
    moved = rolled(_src(df, p), 1, lambda d, r: d.withColumn("d", X - r.lag(X)))
    d = F.col("d")
    return moved.withColumn("up", F.when(d.isNotNull(), F.greatest(d, F.lit(0.0)))).withColumn("down", F.when(d.isNotNull(), F.greatest(-d, F.lit(0.0))))


def _with_rsi(df: DataFrame, p: dict, name: str) -> DataFrame:
    a = 1 / p["window"]
    s = ewma(_with_moves(df, p), ("up", "gain", a), ("down", "loss", a))
    gain, loss = F.col("gain"), F.col("loss")
    return s.withColumn(name, F.when((loss == 0) & (gain > 0), 100.0).when(loss > 0, 100 - 100 / (1 + div(gain, loss))))


_define("momentum.rsi", source="close", window=5)(lambda df, p: _with_rsi(df, p, "value"))


@_define("momentum.stoch_rsi", ("k", "d"), "k", source="close", window=5, k_window=4, smoothing=2, d_window=3)
def _stoch_rsi(df: DataFrame, p: dict) -> DataFrame:
    k, s, x = p["k_window"], p["smoothing"], F.col("rsi")

    def stages(d: DataFrame, r: Rolling) -> DataFrame:
        return d.withColumn("raw", 100 * div(x - r.min(x, k), r.max(x, k) - r.min(x, k))).withColumn("value", r.mean(F.col("raw"), s))

    return rolled(_with_rsi(df, p, "rsi"), k + s, stages)


_windowed("momentum.roc", lambda r, p: 100 * (div(X, r.lag(X, p["window"])) - 1), source="close", window=5)


@_define("momentum.cci", source="hlc3", window=5)
def _cci_stages(df: DataFrame, p: dict) -> DataFrame:
    w, m = p["window"], F.col("m")

    def stages(d: DataFrame, r: Rolling) -> DataFrame:
        d = d.withColumn("m", r.mean(X, w)).withColumn("values", F.collect_list(X).over(r.frame(w)))
        return d.withColumn("value", div(X - m, 0.015 * F.aggregate("values", F.lit(0.0), lambda a, v: a + F.abs(v - m)) / w))

    return rolled(_src(df, p), w, stages)


_windowed("momentum.williams_r", lambda r, p: -100 * div(r.max(H, p["window"]) - C, r.max(H, p["window"]) - r.min(L, p["window"])), window=5)


@_define("momentum.fisher", ("fisher", "signal"), "fisher", window=5)
def _fisher(df: DataFrame, p: dict) -> DataFrame:
    w, n, mid = p["window"], F.col("n"), F.col("mid")

    def stages(d: DataFrame, r: Rolling) -> DataFrame:
        low, high = r.min(L, w), r.max(H, w)
        return d.withColumn("n", 2 * div(mid - low, high - low) - 1)

    limited = F.when(n.isNotNull(), F.greatest(F.lit(-0.999), F.least(F.lit(0.999), n)))
    out = rolled(df.withColumn("mid", SOURCES["hl2"]), w, stages).withColumn("n", limited)
    return out.withColumn("value", 0.5 * F.ln((1 + n) / (1 - n)))


@_define("momentum.stoch", ("k", "d"), "k", k_window=5, smoothing=3, d_window=3)
def _stoch(df: DataFrame, p: dict) -> DataFrame:
    k, s = p["k_window"], p["smoothing"]

    def stages(d: DataFrame, r: Rolling) -> DataFrame:
        low, high = r.min(L, k), r.max(H, k)
        return d.withColumn("raw", 100 * div(C - low, high - low)).withColumn("value", r.mean(F.col("raw"), s))

    return rolled(df, k + s, stages)


@_define("momentum.trix", ("trix", "signal"), "trix", source="close", window=5, signal_window=3)
def _trix(df: DataFrame, p: dict) -> DataFrame:
    e = F.col("e3")
    return rolled(_chained(df, p, 3), 1, lambda d, r: d.withColumn("value", 100 * (div(e, r.lag(e)) - 1)))


def _fast_slow(df: DataFrame, p: dict) -> DataFrame:
    return ewma(_src(df, p), ("x", "f", EMA(p["fast"])), ("x", "s", EMA(p["slow"])))


_define("momentum.macd", ("macd", "signal", "hist"), "macd", source="close", fast=3, slow=6, signal_window=3)(lambda df, p: _fast_slow(df, p).withColumn("value", F.col("f") - F.col("s")))
_define("momentum.ppo", ("ppo", "signal", "hist"), "ppo", source="close", fast=3, slow=6, signal_window=3)(lambda df, p: _fast_slow(df, p).withColumn("value", 100 * div(F.col("f") - F.col("s"), F.col("s"))))


# Trend
@_define("trend.adx", ("plus_di", "minus_di", "adx"), "adx", window=5, smoothing=5)
def _adx(df: DataFrame, p: dict) -> DataFrame:
    def moves(d: DataFrame, r: Rolling) -> DataFrame:
        up, down = H - r.lag(H), r.lag(L) - L
        here = H.isNotNull() & L.isNotNull()
        one = lambda a, b: F.when(here, F.when((a > b) & (a > 0), a).otherwise(F.lit(0.0)))
        return d.withColumn("tr", _true_range(r)).withColumn("up", one(up, down)).withColumn("down", one(down, up))

    a = 1 / p["window"]
    s = ewma(rolled(df, 1, moves), ("tr", "atr", a), ("up", "pu", a), ("down", "pd", a))
    plus, minus = 100 * div(F.col("pu"), F.col("atr")), 100 * div(F.col("pd"), F.col("atr"))
    return ewma(s.withColumn("dx", 100 * div(F.abs(plus - minus), plus + minus)), ("dx", "value", 1 / p["smoothing"]))


@_define("trend.aroon", ("up", "down", "osc"), "osc", window=5)
def _aroon(df: DataFrame, p: dict) -> DataFrame:
    w = p["window"]

    def stages(d: DataFrame, r: Rolling) -> DataFrame:
        f = r.frame(w)
        top = F.max_by(r.place, F.struct(H, r.place)).over(f)
        bottom = F.min_by(r.place, F.struct(L, -r.place)).over(f)
        leg = lambda at: (w - (r.place - at)) / w * 100
        return d.withColumn("value", r.full(H, w, r.full(L, w, leg(top) - leg(bottom))))

    return rolled(df, w, stages)


@_define("trend.chandelier_exit", ("long", "short"), "long", window=5, mult=3.0)
def _chandelier(df: DataFrame, p: dict) -> DataFrame:
    return rolled(_with_atr(df, p["window"]), p["window"], lambda d, r: d.withColumn("value", r.max(H, p["window"]) - p["mult"] * F.col("atr")))


_windowed("trend.donchian", lambda r, p: (r.max(H, p["window"]) + r.min(L, p["window"])) / 2, window=5)


@_define("trend.ichimoku", ("span_a", "span_b", "conversion", "base"), "span_a", conversion_window=3, base_window=5, span_b_window=9, displacement=2)
def _ichimoku(df: DataFrame, p: dict) -> DataFrame:
    """Span A is moved back by the displacement, so a bar's value looks ahead by as many bars."""
    a, b, n = p["conversion_window"], p["base_window"], p["displacement"]

    def stages(d: DataFrame, r: Rolling) -> DataFrame:
        mid = lambda w: (r.max(H, w) + r.min(L, w)) * 0.5
        return d.withColumn("raw", (mid(a) + mid(b)) * 0.5).withColumn("value", r.lead(F.col("raw"), n))

    return rolled(df, max(a, b), stages, n)


_define("trend.keltner", ("middle", "upper", "lower"), "middle", window=5, mult=2.0)(lambda df, p: ewma(df.withColumn("x", TP), ("x", "value", EMA(p["window"]))))
_windowed("trend.linreg_slope", lambda r, p: r.full(X, p["window"], F.regr_slope(X, r.place.cast("double")).over(r.frame(p["window"]))), source="close", window=5)


@_define("trend.psar", accel_start=0.02, accel_step=0.02, accel_max=0.2)
def _psar(df: DataFrame, p: dict) -> DataFrame:
    """Parabolic stop and reverse: long from the first bar's low, clamped to one bar before."""
    first, more, most = p["accel_start"], p["accel_step"], p["accel_max"]

    def step(s: dict, row: tuple) -> list[tuple]:
        high, low, *rest = row
        if high is None or low is None:
            s.clear()
            return [(*rest, None)]
        if not s:
            s.update(long=True, stop=low, best=high, speed=first)
        else:
            stop = s["stop"] + s["speed"] * (s["best"] - s["stop"])
            toward, against, edge = (high, low, s["low"]) if s["long"] else (low, high, s["high"])
            sign = 1 if s["long"] else -1
            if sign * (stop - edge) > 0:
                stop = edge
            if sign * (against - stop) < 0:
                s.update(long=not s["long"], stop=s["best"], best=against, speed=first)
            else:
                s["stop"] = stop
                if sign * (toward - s["best"]) > 0:
                    s.update(best=toward, speed=min(most, s["speed"] + more))
        s.update(high=high, low=low)
        return [(*rest, s["stop"])]

    return stretched_scan(df, ["symbol"], ["high", "low", *df.columns], lambda k: {}, step, StructType([*df.schema.fields]).add("value", "double"))


@_define("trend.supertrend", window=5, mult=3.0)
def _supertrend(df: DataFrame, p: dict) -> DataFrame:
    """Bands around hl2 that only tighten until the close leaves them, and the side that the close is on."""
    mult = p["mult"]

    def step(s: dict, row: tuple) -> list[tuple]:
        high, low, close, atr, *rest = row
        if None in (high, low, close, atr):
            s.clear()
            return [(*rest, None)]
        mid = (high + low) * 0.5
        upper, lower = mid + mult * atr, mid - mult * atr
        if not s:
            s.update(up=close >= mid, upper=upper, lower=lower)
        else:
            if upper < s["upper"] or s["close"] > s["upper"]:
                s["upper"] = upper
            if lower > s["lower"] or s["close"] < s["lower"]:
                s["lower"] = lower
            s["up"] = close >= s["lower"] if s["up"] else close > s["upper"]
        s["close"] = close
        return [(*rest, s["lower"] if s["up"] else s["upper"])]

    return stretched_scan(_with_atr(df, p["window"]), ["symbol"], ["high", "low", "close", "atr", *df.columns], lambda k: {}, step, StructType([*df.schema.fields]).add("value", "double"))


@_define("trend.vortex", ("plus", "minus"), "plus", window=5)
def _vortex(df: DataFrame, p: dict) -> DataFrame:
    w = p["window"]

    def stages(d: DataFrame, r: Rolling) -> DataFrame:
        d = d.withColumn("tr", _true_range(r)).withColumn("vm", F.abs(H - r.lag(L)))
        return d.withColumn("value", div(r.sum(F.col("vm"), w), r.sum(F.col("tr"), w)))

    return rolled(df, w + 1, stages)


# Volatility
_define("volatility.tr")(lambda df, p: _with_tr(df).withColumn("value", F.col("tr")))
_define("volatility.atr", window=5)(lambda df, p: ewma(_with_tr(df), ("tr", "value", 1 / p["window"])))
_windowed("volatility.variance", lambda r, p: r.var(X, p["window"]), source="close", window=5)
_windowed("volatility.stddev", lambda r, p: r.std(X, p["window"]), source="close", window=5)


@_define("volatility.hv", source="close", window=5, annualization=365)
def _hv(df: DataFrame, p: dict) -> DataFrame:
    def stages(d: DataFrame, r: Rolling) -> DataFrame:
        before = r.lag(X)
        d = d.withColumn("ret", F.when((X > 0) & (before > 0), F.ln(X / before)))
        return d.withColumn("value", r.std(F.col("ret"), p["window"]) * math.sqrt(p["annualization"]) * 100)

    return rolled(_src(df, p), p["window"] + 1, stages)


_windowed("volatility.bbands", lambda r, p: r.mean(X, p["window"]), source="close", window=5, mult=2.0, outputs=("basis", "upper", "lower"))
_windowed("volatility.bbands_bandwidth", lambda r, p: div(2 * p["mult"] * r.std(X, p["window"]), r.mean(X, p["window"])), source="close", window=5, mult=2.0)


def _percent_b(r: Rolling, p: dict) -> Column:
    mean, half = r.mean(X, p["window"]), p["mult"] * r.std(X, p["window"])
    return div(X - (mean - half), 2 * half)


_windowed("volatility.bbands_percent_b", _percent_b, source="close", window=5, mult=2.0)


# Volume
def _with_ad_line(df: DataFrame) -> DataFrame:
    flow = div((C - L) - (H - C), H - L) * V
    return running_sums(df.withColumn("flow", flow), [("flow", "ad")])


_define("volume.ad_line")(lambda df, p: _with_ad_line(df).withColumn("value", F.col("ad")))


@_define("volume.obv")
def _obv(df: DataFrame, p: dict) -> DataFrame:
    signed = rolled(df, 1, lambda d, r: d.withColumn("sv", F.signum(C - r.lag(C)) * V))
    return running_sums(signed, [("sv", "value")])


@_define("volume.cmf", window=5)
def _cmf(df: DataFrame, p: dict) -> DataFrame:
    """Of the A/D line's differences, so that the first bar of a run has none."""
    w, ad = p["window"], F.col("ad")

    def stages(d: DataFrame, r: Rolling) -> DataFrame:
        return d.withColumn("m", ad - r.lag(ad)).withColumn("value", div(r.sum(F.col("m"), w), r.sum(V, w)))

    return rolled(_with_ad_line(df), w + 1, stages)


@_define("volume.mfi", window=5)
def _mfi(df: DataFrame, p: dict) -> DataFrame:
    w = p["window"]

    def stages(d: DataFrame, r: Rolling) -> DataFrame:
        before = r.lag(TP)
        there = TP.isNotNull() & before.isNotNull() & V.isNotNull()
        d = d.withColumn("up", F.when(there, F.when(TP > before, TP * V).otherwise(0.0))).withColumn("down", F.when(there, F.when(TP < before, TP * V).otherwise(0.0)))
        up, down = r.sum(F.col("up"), w), r.sum(F.col("down"), w)
        return d.withColumn("pu", up).withColumn("pd", down)

    out = rolled(df, w + 1, stages)
    return out.withColumn("value", F.when(F.col("pd") == 0, F.lit(100.0)).otherwise(100 - 100 / (1 + div(F.col("pu"), F.col("pd")))))


_windowed("volume.volume_sma", lambda r, p: r.mean(V, p["window"]), window=5)


def _vwap(r: Rolling, w: int) -> Column:
    return div(r.sum(TP * V, w), r.sum(V, w))


_windowed("volume.vwap", lambda r, p: _vwap(r, p["window"]), window=5)


@_define("volume.vwap_deviation", ("upper", "lower", "stdev"), "upper", window=5, mult=2.0)
def _vwap_deviation(df: DataFrame, p: dict) -> DataFrame:
    w, vwap = p["window"], F.col("vwap")

    def stages(d: DataFrame, r: Rolling) -> DataFrame:
        d = d.withColumn("vwap", _vwap(r, w)).withColumn("off", TP - vwap)
        return d.withColumn("value", vwap + p["mult"] * r.std(F.col("off"), w))

    return rolled(df, 2 * w, stages)


# Structure
_CANDLE: dict[str, Column] = {"body": F.abs(C - O), "range": H - L, "upper_wick": H - F.greatest(O, C), "lower_wick": F.least(O, C) - L}
_WHOLE = O.isNotNull() & H.isNotNull() & L.isNotNull() & C.isNotNull()


def _candle(part: str, over: str | None) -> Callable[[DataFrame, dict], DataFrame]:
    raw = F.when(_WHOLE, _CANDLE[part])
    if over is None:
        return lambda df, p: df.withColumn("value", raw)
    if over == "range":
        return lambda df, p: df.withColumn("value", div(raw, H - L))
    # the average range is stored with single precision
    return lambda df, p: _with_atr(df, p["window"]).withColumn("value", div(raw, F.col("atr").cast("float").cast("double")))


for _part in _CANDLE:
    _define(f"candle_{_part}")(_candle(_part, None))
    _define(f"candle_{_part}_atr", window=5)(_candle(_part, "atr"))
    if _part != "range":
        _define(f"candle_{_part}_pct")(_candle(_part, "range"))
_PARTS = ("body_pct", "body", "range", "upper_wick", "lower_wick", "upper_wick_pct", "lower_wick_pct")
_define("candle_stats", _PARTS)(_candle("body", "range"))
_define("candle_stats_atr_norm", ("body_atr", "range_atr", "upper_wick_atr", "lower_wick_atr"), window=5)(_candle("body", "atr"))
_windowed("zscore", lambda r, p: div(X - r.mean(X, p["window"]), r.std(X, p["window"])), source="close", window=5)


@_define("percent_rank", source="close", window=5)
def _percent_rank(df: DataFrame, p: dict) -> DataFrame:
    w = p["window"]

    def stages(d: DataFrame, r: Rolling) -> DataFrame:
        d = d.withColumn("values", F.collect_list(X).over(r.frame(w)))
        return d.withColumn("value", F.when(F.size("values") == w, F.size(F.filter("values", lambda v: v <= X)) / w * 100))

    return rolled(_src(df, p), w, stages)


def _pivot(series: Column, top: bool) -> Callable[[DataFrame, dict], DataFrame]:
    """An extreme of left + 1 + right bars, given when the right ones are known."""

    def compute(df: DataFrame, p: dict) -> DataFrame:
        left, right = p["left"], p["right"]

        def stages(d: DataFrame, r: Rolling) -> DataFrame:
            x = series if top else -series
            around = F.count(x).over(r.order.rowsBetween(-(left + right), 0)) == left + right + 1
            before, after = (F.max(x).over(r.order.rowsBetween(a, b)) for a, b in ((-(left + right), -(right + 1)), (-(right - 1), 0)))
            c = r.lag(x, right)
            return d.withColumn("value", F.when(around & (before < c) & (after < c), r.lag(series, right)))

        return rolled(df, left + right, stages)

    return compute


_define("pivots", ("pivot_high", "pivot_low"), left=2, right=2)(_pivot(H, True))
_define("pivot_high", left=2, right=2)(_pivot(H, True))
_define("pivot_low", left=2, right=2)(_pivot(L, False))


@_define("distance_to_ma_norm", source="close", window=5)
def _distance(df: DataFrame, p: dict) -> DataFrame:
    both = ewma(_with_tr(_src(df, p)), ("tr", "atr", 1 / p["window"]), ("x", "e", EMA(p["window"])))
    return both.withColumn("value", div(X - F.col("e"), F.col("atr").cast("float").cast("double")))
