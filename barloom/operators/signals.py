"""Signal rules over indicator values, and their conjunction. A signal is 1 (long), -1 (short) or 0 (neutral).

Missing values are NULL, so a comparison with one is not true and the signal is neutral; so is a bar on which both
sides hold.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.operators.indicators import canonical
from barloom.operators.scan import rolled

LONG, NEUTRAL, SHORT = 1, 0, -1
#: Rule of each indicator (fixed values).
RULES: dict[str, tuple[str, ...]] = {
    "compare_price_to_output": (
        "ma.sma", "ma.ema", "ma.rma", "ma.smma", "ma.wma", "ma.lwma", "ma.vwma", "ma.dema", "ma.tema", "ma.zlema", "ma.hma",
        "trend.chandelier_exit", "trend.donchian", "trend.ichimoku", "trend.keltner", "trend.psar", "trend.supertrend", "volatility.bbands", "volume.vwap", "volume.vwap_deviation",
    ),
    "threshold_band": (
        "momentum.cci", "momentum.rsi", "momentum.stoch", "momentum.stoch_rsi", "momentum.williams_r", "percent_rank", "zscore", "distance_to_ma_norm",
        "trend.aroon", "volatility.bbands_percent_b", "volume.cmf", "volume.mfi",
    ),
    "sign": ("momentum.fisher", "momentum.macd", "momentum.ppo", "momentum.roc", "momentum.trix", "trend.linreg_slope"),
    "delta_sign": (
        "trend.adx", "volatility.atr", "volatility.bbands_bandwidth", "volatility.hv", "volatility.stddev", "volatility.tr", "volatility.variance", "volume.ad_line", "volume.obv",
    ),
    "compare_volume_to_output": ("volume.volume_sma",),
    "candle_body_direction": ("candle_stats", "candle_stats_atr_norm"),
    "pivot_events": ("pivots",),
    "threshold_centered": ("trend.vortex",),
}
#: Rules of users' indicators.
OWN_RULES: dict[str, str] = {}
#: Parameters that a rule can't do without.
REQUIRED = {"threshold_band": ("long_threshold", "short_threshold"), "delta_sign": ("long_periods", "short_periods"), "candle_body_direction": ("threshold",), "threshold_centered": ("threshold",)}
#: Other names of a rule's threshold in requests (fixed values).
OTHER_NAMES = {"min_body_pct": "threshold", "min_body_atr": "threshold", "abs_threshold": "threshold"}
#: Indicators that a rule reads besides its own.
DEPENDS = {"pivots": ("pivot_low", "pivot_high")}


def rule_of(indicator: str) -> str:
    if canonical(indicator) in OWN_RULES:
        return OWN_RULES[canonical(indicator)]
    for rule, ids in RULES.items():
        if canonical(indicator) in ids:
            return rule
    raise ValueError(f"{indicator} has no signal rule")


def own_names(params: Mapping) -> dict:
    """A request's signal parameters by this library's names."""
    return {OTHER_NAMES.get(k, k): v for k, v in params.items()}


def check_parameters(rule: str, params: dict) -> None:
    missing = [p for p in REQUIRED.get(rule, ()) if params.get(p) is None]
    if missing:
        raise ValueError(f"{rule} needs {', '.join(missing)}")


def _signal(long: Column, short: Column) -> Column:
    up, down = F.coalesce(long, F.lit(False)), F.coalesce(short, F.lit(False))
    return (F.when(up & ~down, F.lit(LONG)).when(down & ~up, F.lit(SHORT)).otherwise(F.lit(NEUTRAL))).cast("byte")


def compare_price_to_output(price: Column, out: Column, inverted: bool = False) -> Column:
    return _signal(price < out, price > out) if inverted else _signal(price > out, price < out)


def threshold_band(out: Column, long_threshold: float, short_threshold: float) -> Column:
    """Low is long where the long threshold is the lower one (reversion); else high is long (trend)."""
    if long_threshold <= short_threshold:
        return _signal(out <= long_threshold, out >= short_threshold)
    return _signal(out >= long_threshold, out <= short_threshold)


def sign(out: Column) -> Column:
    return _signal(out > 0, out < 0)


def delta_sign(out: Column, long_before: Column, short_before: Column) -> Column:
    """Of the change over |periods| bars, which may differ by side."""
    return _signal(out - long_before > 0, out - short_before < 0)


def compare_volume_to_output(volume: Column, out: Column) -> Column:
    return _signal(volume > out, volume < out)


def candle_body_direction(out: Column, open_: Column, close: Column, threshold: float) -> Column:
    return _signal((out >= threshold) & (close > open_), (out >= threshold) & (close < open_))


def pivot_events(pivot_low: Column, pivot_high: Column) -> Column:
    return _signal(pivot_low.isNotNull(), pivot_high.isNotNull())


def threshold_centered(out: Column, threshold: float) -> Column:
    return _signal(out > 1 + abs(threshold), out < 1 - abs(threshold))


def evaluate(bars: DataFrame, indicator: str, indicator_params: dict | None = None, **params: object) -> DataFrame:
    """`bars` with `signal`, by the rule of the indicator."""
    from barloom.operators.indicators import registry

    defs, rule, ip, params = registry(), rule_of(indicator), indicator_params or {}, own_names(params)
    check_parameters(rule, params)
    columns = bars.columns
    out = defs[indicator](bars, **ip)
    v = F.col("value")
    if rule == "compare_price_to_output":
        from barloom.operators.definitions import SOURCES

        s = compare_price_to_output(SOURCES[str(ip.get("source", "close"))], v, indicator == "volume.vwap_deviation")
    elif rule == "threshold_band":
        s = threshold_band(v, params["long_threshold"], params["short_threshold"])
    elif rule == "sign":
        s = sign(v)
    elif rule == "delta_sign":
        a, b = abs(int(params["long_periods"])), abs(int(params["short_periods"]))
        out = rolled(out, max(a, b), lambda d, r: d.withColumn("la", r.lag(v, a)).withColumn("lb", r.lag(v, b)))
        s = delta_sign(v, F.col("la"), F.col("lb"))
    elif rule == "compare_volume_to_output":
        s = compare_volume_to_output(F.col("volume"), v)
    elif rule == "candle_body_direction":
        s = candle_body_direction(v, F.col("open"), F.col("close"), params["threshold"])
    elif rule == "pivot_events":
        highs = out.withColumnRenamed("value", "high_pivot")
        lows = defs["pivot_low"](bars, **ip).select("symbol", "idx", F.col("value").alias("low_pivot"))
        out, s = highs.join(lows, ["symbol", "idx"]), pivot_events(F.col("low_pivot"), F.col("high_pivot"))
    else:
        s = threshold_centered(v, params["threshold"])
    return out.withColumn("signal", s).select(*columns, "signal")


def column_signals(bars: DataFrame, indicator: str, points: Sequence[dict], **params: object) -> tuple[DataFrame, list[Column]] | None:
    """`bars` with a column of each point's values, and a signal column of each; None for rules that read more than those."""
    from barloom.operators.definitions import SOURCES
    from barloom.operators.indicators import registry

    rule, params = rule_of(indicator), own_names(params)
    check_parameters(rule, params)
    names = [f"_v{k}" for k in range(len(points))]
    rules: dict[str, Callable[[Column, dict], Column]] = {
        "compare_price_to_output": lambda v, p: compare_price_to_output(SOURCES[str(p.get("source", "close"))], v, indicator == "volume.vwap_deviation"),
        "threshold_band": lambda v, p: threshold_band(v, params["long_threshold"], params["short_threshold"]),
        "sign": lambda v, p: sign(v),
        "compare_volume_to_output": lambda v, p: compare_volume_to_output(F.col("volume"), v),
        "threshold_centered": lambda v, p: threshold_centered(v, params["threshold"]),
    }
    if rule not in rules:
        return None
    return registry()[indicator].values(bars, points, names), [rules[rule](F.col(n), p) for n, p in zip(names, points, strict=True)]


def conjunction(signals: DataFrame, keys: Sequence[str] = ("symbol", "idx")) -> DataFrame:
    """Long where all signals of a key are long, short where all are short. `signals` is long: a row a signal."""
    low, high = F.min("signal"), F.max("signal")
    return signals.groupBy(*keys).agg(F.when(low == LONG, LONG).when(high == SHORT, SHORT).otherwise(NEUTRAL).cast("byte").alias("signal"))


def conjunction_of(columns: Sequence[Column]) -> Column:
    """The same over columns of one row. Without any signal every bar is neutral."""
    if not columns:
        return F.lit(NEUTRAL).cast("byte")
    all_long, all_short = F.lit(True), F.lit(True)
    for c in columns:
        all_long, all_short = all_long & (c == LONG), all_short & (c == SHORT)
    return _signal(all_long, all_short)


def expand_dependencies(ids: Sequence[str]) -> list[str]:
    """The indicators to compute for `ids`, each once, with those that their rules read."""
    return list(dict.fromkeys(d for i in ids for d in (i, *DEPENDS.get(canonical(i), ()))))
