"""Extension points: indicators of a user's own, and grids as a table function of SQL."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from math import prod

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf

from barloom.operators import signals
from barloom.operators.indicators import Indicator, canonical, registry
from barloom.operators.search import Part


def register_indicator(id_: str, compute: Callable[[DataFrame, dict], DataFrame], rule: str, defaults: dict | None = None, outputs: tuple[str, ...] = ("value",), primary: str | None = None) -> Indicator:
    """Add an indicator to the registry: `compute` gets bars and checked parameters and gives the bars with a column `value`.

    `rule` is the family of its signals. A grid's axes are its parameters, as with the library's own; the library's can't be replaced.
    """
    if rule not in signals.RULES:
        raise ValueError(f"{rule} is no rule; one of {', '.join(signals.RULES)}")
    if canonical(id_) in registry():
        raise ValueError(f"{id_} is there already")
    indicator = Indicator(canonical(id_), id_.split(".")[0], defaults or {}, compute, outputs, primary or outputs[0])
    registry()[canonical(id_)] = indicator
    signals.OWN_RULES[canonical(id_)] = rule
    return indicator


def remove_indicator(id_: str) -> None:
    """Take a user's indicator out again."""
    if signals.OWN_RULES.pop(canonical(id_), None) is None:
        raise ValueError(f"{id_} is not a user's indicator")
    del registry()[canonical(id_)]


@udtf(returnType="variant long, part int, indicator string, point string")
class GridVariants:
    """Rows of variants [first, last) of a grid: a row a part, with the part's point as JSON. Variants count with the last axis fastest."""

    def eval(self, spec: str, first: int, last: int) -> Iterator[tuple]:
        parts = [Part(p["indicator"], p.get("axes") or {}) for p in json.loads(spec)]
        sizes = [p.size for p in parts]
        for variant in range(max(first, 0), min(last, prod(sizes))):
            left = variant
            for k in reversed(range(len(parts))):
                left, at = divmod(left, sizes[k])
                yield variant, k, parts[k].indicator, json.dumps(parts[k].points()[at])


def register_functions(spark: SparkSession) -> None:
    """grid_variants(spec, first, last) in SQL: joined laterally with a table of ranges, a grid is as many tasks as that has."""
    spark.udtf.register("grid_variants", GridVariants)
