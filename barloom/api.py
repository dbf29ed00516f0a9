"""What a service asks of the library: listings, estimates, computations and searches, as plain functions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators import execution, lengths, metrics, reference_data, search
from barloom.operators.indicators import registry, registry_rows
from barloom.operators.signals import evaluate
from barloom.sources.scratch import materialize

RUNTIME_DEFAULTS = {"warmup_bars": 200, "top_k": 300, "preselect": 20_000, "max_variants": search.MOST_VARIANTS, "max_bytes": search.MOST_BYTES}


def list_indicators(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(registry_rows(), "id string, family string, parameters string, outputs string, main string")


def estimate(parts: Sequence[search.Part], bars: int, stop_losses: Sequence = (None,), take_profits: Sequence = (None,)) -> dict[str, int]:
    return search.estimate(parts, bars, len(search.risk_variants(stop_losses, take_profits)))


def compute(bars: DataFrame, indicator: str, axes: Mapping[str, Sequence] | None = None, most_variants: int = search.MOST_VARIANTS, most_bytes: int = search.MOST_BYTES) -> DataFrame:
    """(symbol, idx, variant, value float) of every grid point; guarded, by the number of bars too, before any of them is computed."""
    part = search.Part(indicator, axes or {})
    search.enforce_guards(search.estimate([part], 0), most_variants, most_bytes)
    search.enforce_guards(search.estimate([part], bars.count()), most_variants, most_bytes)
    points, columns = part.points(), bars.columns
    if lengths.canonical(indicator) in lengths.KERNELS:  # all points in one pass
        values = F.transform("_values", lambda v: v.cast("float"))
        return lengths.grid_values(bars, indicator, points, "_values").select("symbol", "idx", F.posexplode(values).alias("variant", "value")).withColumn("variant", F.col("variant").cast("long"))
    out = bars.withColumn("_values", F.array().cast("array<float>"))
    definition = registry()[indicator]
    step = search.SHARED if definition.many else 1
    for at in range(0, len(points), step):
        names = [f"_v{k}" for k in range(len(points[at : at + step]))]
        out = definition.values(out, points[at : at + step], names).select(*columns, F.concat("_values", F.array(*(F.col(n).cast("float") for n in names))).alias("_values"))
        if (at // step + 1) % search.STAGES == 0:
            out = materialize(out, "values")
    return out.select("symbol", "idx", F.posexplode("_values").alias("variant", "value")).withColumn("variant", F.col("variant").cast("long"))


def backtest(bars: DataFrame, parts: Sequence[search.Part], how: execution.Execution, tf_ms: int, stop_losses: Sequence = (None,), take_profits: Sequence = (None,), preselect: int = 20_000, top_k: int = 300, rank_by: str = "total_return_pct") -> DataFrame:
    """The best variants of a grid with the best stops; guarded, by the number of bars too."""
    risks = search.risk_variants(stop_losses, take_profits)
    search.enforce_guards(search.estimate(parts, 0, len(risks)))
    search.enforce_guards(search.estimate(parts, bars.count(), len(risks)))
    best, signals = search.stage_a(bars, parts, how, tf_ms, preselect, rank_by)
    return search.stage_b(best, signals, risks, how, tf_ms, top_k, rank_by)


def variant_report(bars: DataFrame, indicators: Sequence[tuple[str, Mapping, Mapping]], how: execution.Execution, tf_ms: int) -> DataFrame:
    """Figures of one variant: (indicator, parameters, signal parameters) each, joined by AND."""
    from barloom.operators.signals import conjunction

    each = [evaluate(bars, i, dict(p), **s).select("symbol", "idx", "signal") for i, p, s in indicators]
    signals = bars.select("symbol", "idx", "close").join(conjunction(reduce(DataFrame.unionByName, each)), ["symbol", "idx"])
    run = execution.Simulation(signals, how)
    return metrics.report(signals, run.trades(), run.equity_curve(), how.cash, tf_ms)


def markets(table: DataFrame) -> DataFrame:
    """Enabled markets, by id."""
    return reference_data.enabled_markets(table).select("market_id", "exchange_name", "market_type", "market_code")


def instruments(table: DataFrame, market_id: int, prefix: str = "", limit: int = 50) -> DataFrame:
    """Enabled tradable instruments of a market whose symbol begins so, by symbol."""
    return reference_data.search_instruments(table, market_id, prefix, limit).select("market_id", "symbol")
