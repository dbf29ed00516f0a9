"""Default grids of indicators from a YAML or JSON file: axes as explicit values or as inclusive ranges."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from itertools import product

from barloom.functions.scalars import float_range
from barloom.operators.search import Part, merge_defaults


def axis_values(spec: object) -> list:
    """Values of {mode: explicit, values}, of {mode: range, start, stop_incl, step} (whole steps give whole numbers), or one value as it is."""
    if not isinstance(spec, Mapping):
        return [*spec] if isinstance(spec, (list, tuple)) else [spec]
    mode = spec.get("mode")
    if mode == "explicit":
        return list(spec["values"])
    if mode != "range":
        raise ValueError(f"an axis is explicit or a range, not {mode!r}")
    bounds = [spec[k] for k in ("start", "stop_incl", "step")]
    values = float_range(*map(str, bounds))
    return [int(v) for v in values] if all(isinstance(x, int) for x in bounds) else values


def _entries(path: str) -> dict[str, Mapping]:
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith(".json"):
        spec = json.loads(text)
    else:
        import yaml  # only YAML files need it

        spec = yaml.safe_load(text)
    return {name: d or {} for name, d in (spec.get("defaults") or {}).items()}


def read_defaults(path: str) -> dict[str, dict[str, list]]:
    """Axes by indicator: the file's `defaults`, each with `inputs` and `params`."""
    return {name: {axis: axis_values(s) for kind in ("inputs", "params") for axis, s in (d.get(kind) or {}).items()} for name, d in _entries(path).items()}


def read_signal_defaults(path: str) -> dict[str, dict[str, list]]:
    """Values of signal parameters by indicator, from the same file's `signals`, `v1`, `params`."""
    found = {name: ((d.get("signals") or {}).get("v1") or {}).get("params") or {} for name, d in _entries(path).items()}
    return {name: {k.strip().lower(): axis_values(v) for k, v in params.items()} for name, params in found.items() if params}


def requested(indicator: str, defaults: Mapping[str, Mapping[str, Sequence]], axes: Mapping[str, Sequence] | None = None, signal: Mapping[str, object] | None = None) -> Part:
    """A part of a search: an indicator's default axes, and a request's in place of them."""
    return Part(indicator, merge_defaults(axes or {}, dict(defaults.get(indicator, {}))), signal or {})


def requested_each(indicator: str, defaults: Mapping[str, Mapping[str, Sequence]], signal_defaults: Mapping[str, Mapping[str, Sequence]], axes: Mapping[str, Sequence] | None = None, signal: Mapping[str, Sequence] | None = None) -> list[Part]:
    """The same for every combination of signal parameters, those of a request in place of the defaults; the last one by name fastest."""
    values = merge_defaults(signal or {}, dict(signal_defaults.get(indicator, {})))
    names = sorted(values)
    return [requested(indicator, defaults, axes, dict(zip(names, some, strict=True))) for some in product(*(values[n] for n in names))]
