"""Performance figures of simulated accounts, from trades and equity curves of any number of (symbol, variant)s."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.scalars import div
from barloom.operators.scan import running_max
from barloom.sources.scratch import materialize

KEYS = ("symbol", "variant")
DAY_MS, YEAR_DAYS, ZERO = 86_400_000, 365, 1e-12


def drawdowns(equity: DataFrame, tf_ms: int) -> DataFrame:
    """Deepest and average drawdown in percent (over all bars), and its episodes' longest and average time in ms.

    An episode is known by the last bar before it that was no drawdown; it ends at the next such bar. Running maxima go by
    stretches, so that a history is many tasks.
    """
    keys = list(KEYS)
    d = running_max(equity, keys, F.col("equity"), "peak", True)
    d = d.withColumn("dd", 1 - div(F.col("equity"), F.col("peak"))).withColumn("down", F.coalesce(F.col("dd") > ZERO, F.lit(False)))
    d = running_max(d.select(*keys, "idx", "dd", "down"), keys, F.when(~F.col("down"), F.col("idx")), "episode", False)
    down, idx = F.col("down"), F.col("idx")
    ends = d.groupBy(*keys, "episode").agg(F.min(F.when(down, idx)).alias("first"), F.max(F.when(down, idx)).alias("last"), F.min(F.when(~down, idx)).alias("over"))
    ms = (F.coalesce(F.col("over"), F.col("last")) - F.col("first")) * tf_ms
    times = ends.where("first is not null").groupBy(*keys).agg(F.max(ms).alias("max_drawdown_ms"), F.floor(F.sum(ms) / F.count("*")).alias("avg_drawdown_ms"))
    depth = d.groupBy(*keys).agg((100 * F.max("dd")).alias("max_drawdown_pct"), (100 * F.avg("dd")).alias("avg_drawdown_pct"))
    return depth.join(times, keys, "left")


def trade_stats(trades: DataFrame, tf_ms: int) -> DataFrame:
    pct, ms = 100 * F.col("net_pnl") / F.col("entry_quote"), (F.col("exit_idx") - F.col("entry_idx")) * tf_ms
    return trades.groupBy(*KEYS).agg(
        F.count("*").alias("num_trades"), (100 * F.avg((F.col("net_pnl") > 0).cast("double"))).alias("win_rate_pct"), F.max(pct).alias("best_trade_pct"), F.min(pct).alias("worst_trade_pct"), F.avg(pct).alias("avg_trade_pct"),
        F.max(ms).alias("max_trade_ms"), F.floor(F.sum(ms) / F.count("*")).alias("avg_trade_ms"), F.avg(pct).alias("expectancy"),
        (F.sqrt(F.count("*").cast("double")) * div(F.avg("net_pnl"), F.when(F.count("*") > 1, F.stddev_samp("net_pnl")))).alias("sqn"),
        div(F.sum(F.when(F.col("net_pnl") > 0, F.col("net_pnl")).otherwise(0.0)), -F.sum(F.when(F.col("net_pnl") < 0, F.col("net_pnl")).otherwise(0.0))).alias("profit_factor"),
    )


def daily_equity(equity: DataFrame, tf_ms: int) -> DataFrame:
    """Last value of each UTC day, by the bars' closing times."""
    day = F.floor((F.col("idx") + 1) * tf_ms / DAY_MS)
    return equity.groupBy(*KEYS, day.alias("day")).agg(F.max_by("equity", "idx").alias("equity"))


def ratios(equity: DataFrame, tf_ms: int) -> DataFrame:
    """Yearly return of daily values, and Sharpe and Sortino ratios; NULL with under two daily returns or a loss of everything."""
    order = Window.partitionBy(*KEYS).orderBy("day")
    r = daily_equity(equity, tf_ms).withColumn("r", div(F.col("equity"), F.lag("equity").over(order)) - 1).where("r is not null")
    whole = (F.count("*") >= 2) & (F.min("r") > -1)
    year = F.when(whole, F.exp(F.avg(F.when(F.col("r") > -1, F.ln(1 + F.col("r")))) * YEAR_DAYS) - 1)
    down = F.sqrt(F.avg(F.pow(F.least(F.col("r"), F.lit(0.0)), 2)))
    root = math.sqrt(YEAR_DAYS)
    return r.groupBy(*KEYS).agg(year.alias("annual_return"), div(year, F.when(F.count("*") > 1, F.stddev_samp("r")) * root).alias("sharpe"), div(year, down * root).alias("sortino"))


def benchmark(signals: DataFrame) -> DataFrame:
    """Percent from a range's first close to its last, without costs."""
    b = signals.where("close is not null")
    keys = [k for k in KEYS if k in b.columns]
    first = F.min_by("close", "idx")
    return b.groupBy(*keys).agg((100 * (div(F.max_by("close", "idx"), F.when(first > 0, first)) - 1)).alias("benchmark_pct"))


def report(signals: DataFrame, trades: DataFrame, equity: DataFrame, cash: float, tf_ms: int) -> DataFrame:
    """One row of figures a (symbol, variant); those that need trades are NULL without any.

    Trades and equity are written first: several aggregates read them, and their state machine is to run once.
    """
    keys = list(KEYS)
    trades, equity = materialize(trades, "trades"), materialize(equity, "equity")
    totals = equity.groupBy(*keys).agg(
        F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"), F.max_by("equity", "idx").alias("final_equity"),
        (100 * F.avg(F.col("in_position").cast("double"))).alias("coverage_pct"), F.avg("exposure").alias("gross_exposure"),
    )
    profit = F.col("final_equity") - cash
    out = totals.withColumn("total_profit", profit).withColumn("total_return_pct", 100 * profit / cash)
    if "variant" not in signals.columns:
        signals = signals.withColumn("variant", F.lit(0).cast("long"))
    for part in (benchmark(signals), drawdowns(equity, tf_ms), trade_stats(trades, tf_ms), ratios(equity, tf_ms)):
        out = out.join(part, keys, "left")
    out = out.withColumn("calmar", div(F.col("annual_return"), F.col("max_drawdown_pct") / 100))
    return out.withColumn("return_over_max_drawdown", div(F.col("total_return_pct"), F.col("max_drawdown_pct"))).fillna({"num_trades": 0})


#: Lines of a report table: title, column of `report`, decimals (None: a time in ms) (fixed values).
LINES = (
    ("Total Profit", "total_profit", 2), ("Total Return [%]", "total_return_pct", 4), ("Benchmark Return [%]", "benchmark_pct", 4), ("Position Coverage [%]", "coverage_pct", 4),
    ("Max. Drawdown [%]", "max_drawdown_pct", 4), ("Avg. Drawdown [%]", "avg_drawdown_pct", 4), ("Max. Drawdown Duration", "max_drawdown_ms", None), ("Avg. Drawdown Duration", "avg_drawdown_ms", None),
    ("Num. Trades", "num_trades", 0), ("Win Rate [%]", "win_rate_pct", 4), ("Best Trade [%]", "best_trade_pct", 4), ("Worst Trade [%]", "worst_trade_pct", 4), ("Avg. Trade [%]", "avg_trade_pct", 4),
    ("Max. Trade Duration", "max_trade_ms", None), ("Avg. Trade Duration", "avg_trade_ms", None), ("Expectancy", "expectancy", 4), ("SQN", "sqn", 5), ("Gross Exposure", "gross_exposure", 4),
    ("Sharpe Ratio", "sharpe", 5), ("Sortino Ratio", "sortino", 5), ("Calmar Ratio", "calmar", 5),
)


def format_value(value: object, decimals: int | None) -> str:
    from datetime import timedelta

    if value is None or (isinstance(value, float) and not math.isfinite(value)):
        return "N/A"
    if decimals is None:
        return str(timedelta(milliseconds=int(value)))
    text = f"{float(value):.{decimals}f}"
    text = text.rstrip("0").rstrip(".") if "." in text else text
    return "0" if text == "-0" else text


def format_report(row: Mapping[str, object], start: str, end: str, duration: str, cash: float) -> str:
    """A Markdown table of one row of `report`, which a ranking has made few."""
    lines = [("Start", start), ("End", end), ("Duration", duration), ("Init. Cash", format_value(cash, 2))]
    lines += [(title, format_value(row[c], d)) for title, c, d in LINES]
    return "\n".join(["|Metric|Value|", "|---|---|", *(f"|{a}|{b}|" for a, b in lines)]) + "\n"
