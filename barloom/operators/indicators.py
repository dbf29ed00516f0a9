"""The indicator library's surface: definitions, their parameters, and how they are applied to bars."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: What ids of the structure family may be written with, and other names of parameters in requests and files (fixed values).
PREFIX = "structure."
_FAST_SLOW = {"fast_window": "fast", "slow_window": "slow"}
OTHER_PARAMETERS = {"momentum.macd": _FAST_SLOW, "momentum.ppo": _FAST_SLOW, "momentum.stoch_rsi": {"rsi_window": "window"}}


def canonical(id_: str) -> str:
    """An indicator's id in this library."""
    return id_.removeprefix(PREFIX)


class Registry(dict):
    """Definitions by id, however their family is written."""

    def __missing__(self, id_: str) -> Indicator:
        if canonical(id_) == id_:
            raise KeyError(id_)
        return self[canonical(id_)]


@dataclass(frozen=True)
class Indicator:
    """A definition: its family, default parameters, whether it has a source axis, outputs, and the computation."""

    id: str
    family: str
    defaults: dict
    compute: Callable[[DataFrame, dict], DataFrame]
    outputs: tuple[str, ...] = ("value",)
    primary: str = "value"
    series: tuple[str, ...] = field(default=("close",))
    many: Callable[[DataFrame, list[dict], list[str]], DataFrame] | None = None

    def parameters(self, params: Mapping) -> dict:
        """`params` over the defaults, checked; their other names are understood."""
        names = OTHER_PARAMETERS.get(self.id, {"atr_window": "window"} if self.id.startswith("candle_") else {})
        given = [names.get(k, k) for k in params]
        if len(set(given)) < len(given):
            raise ValueError(f"{self.id}: a parameter is given under two names")
        params = dict(zip(given, params.values(), strict=True))
        unknown = set(params) - set(self.defaults)
        if unknown:
            raise ValueError(f"{self.id} has no parameter {', '.join(sorted(unknown))}")
        p = self.defaults | params
        for name, v in p.items():
            if name.endswith("window") or name in ("left", "right", "smoothing", "fast", "slow"):
                if int(v) != v or not 1 <= v <= 2000:
                    raise ValueError(f"{self.id}: {name} must be a whole number from 1 to 2000, not {v}")
        return p

    def __call__(self, bars: DataFrame, **params: object) -> DataFrame:
        columns = bars.columns
        return self.compute(bars, self.parameters(params)).select(*columns, "value")

    def values(self, bars: DataFrame, points: Sequence[Mapping], names: list[str]) -> DataFrame:
        """`bars` with a column of each point's values; in one pass where the definition can."""
        columns, checked = bars.columns, [self.parameters(p) for p in points]
        if self.many:
            return self.many(bars, checked, names).select(*columns, *names)
        for p, name in zip(checked, names, strict=True):
            bars = self.compute(bars, p).select(*bars.columns, F.col("value").alias(name))
        return bars


def registry() -> dict[str, Indicator]:
    """All definitions by id. They are made of columns, so a session must be there on the first call."""
    from barloom.operators.definitions import REGISTRY

    return REGISTRY


def registry_rows() -> list[tuple[str, str, str, str, str]]:
    """id, family, parameters with defaults, outputs and primary output of every definition."""
    return [(i.id, i.family, ",".join(f"{k}={v}" for k, v in sorted(i.defaults.items())), ",".join(i.outputs), i.primary) for i in sorted(registry().values(), key=lambda i: i.id)]
