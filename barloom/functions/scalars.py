"""Scalar expressions that bars, indicators and planners share. Missing values are NULL inside, never NaN."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

MINUTE_MS = 60_000
#: Timeframes in minutes (fixed values).
TIMEFRAMES = {"1m": 1, "5m": 5, "15m": 15, "1h": 60, "4h": 240, "1d": 1440}


def timeframe_ms(name: str) -> int:
    if name not in TIMEFRAMES:
        raise ValueError(f"unknown timeframe {name!r}; one of {', '.join(TIMEFRAMES)}")
    return TIMEFRAMES[name] * MINUTE_MS


def epoch_ms(ts: str | Column) -> Column:
    """Milliseconds since 1970 of a timestamp; one without a zone counts as UTC, whatever the session's zone is."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_diff("MILLISECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def bucket_open(ms: Column, tf_ms: int) -> Column:
    return ms - F.pmod(ms, F.lit(tf_ms))


def bucket_close(ms: Column, tf_ms: int) -> Column:
    return bucket_open(ms, tf_ms) + tf_ms


def minute_floor(ms: Column) -> Column:
    return bucket_open(ms, MINUTE_MS)


def minute_ceil(ms: Column) -> Column:
    return -bucket_open(-ms, MINUTE_MS)


def on_minute(ms: Column) -> Column:
    """Whether a time is a whole minute."""
    return F.pmod(ms, F.lit(MINUTE_MS)) == 0


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Whether two ranges [start, end) have a part in common; empty ones have none."""
    return (a_start < a_end) & (b_start < b_end) & (a_start < b_end) & (b_start < a_end)


def intersection(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """(start, end) of what two ranges have in common; NULL if nothing."""
    both = F.struct(F.greatest(a_start, b_start).alias("start"), F.least(a_end, b_end).alias("end"))
    return F.when(overlaps(a_start, a_end, b_start, b_end), both)


def div(a: Column, b: Column) -> Column:
    """a / b, NULL where b is 0."""
    return a / F.nullif(b, F.lit(0.0))


def rounded(x: str | Column, places: int) -> Column:
    """x to so many places as SQL engines on doubles do it: scaled, rounded half away from zero and scaled back.

    F.round goes by a double's shortest decimal, which differs where the scaled value is a half.
    """
    x, scale = F.col(x) if isinstance(x, str) else x, F.lit(float(10**places))
    scaled = F.round(x * scale) / scale
    return F.when(F.isnan(scaled) | (F.abs(scaled) == F.lit(float("inf"))), x).otherwise(scaled)


def finite(x: Column) -> Column:
    """x, NULL where it's NaN or infinite."""
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def nan_to_zero(x: Column) -> Column:
    return F.when(x.isNull() | F.isnan(x), F.lit(0.0)).otherwise(x)


def zero_to_null(x: Column) -> Column:
    return F.nullif(x, F.lit(0.0))


def instrument_key(exchange: Column, market_type: Column, symbol: Column) -> Column:
    return F.concat_ws(":", F.lower(F.trim(exchange)), F.lower(F.trim(market_type)), F.upper(F.trim(symbol)))


def encode_radix(coordinates: Sequence[int], sizes: Sequence[int]) -> int:
    """Number of a grid point; the last axis runs fastest."""
    out = 0
    for c, n in zip(coordinates, sizes, strict=True):
        if not 0 <= c < n:
            raise ValueError(f"coordinate {c} is outside of an axis of {n}")
        out = out * n + c
    return out


def decode_radix(number: Column, sizes: Sequence[int]) -> list[Column]:
    """Coordinates of a grid point, as columns."""
    out, below = [], 1
    for n in reversed(sizes):
        out.append(F.pmod((number / below).cast("long") if below > 1 else number, F.lit(n)))
        below *= n
    return out[::-1]


def canonical_json(value: Mapping, ascii_only: bool) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=ascii_only)


def variant_key(value: Mapping, ascii_only: bool = True) -> str:
    """SHA-256 of a variant's canonical JSON."""
    return hashlib.sha256(canonical_json(value, ascii_only).encode()).hexdigest()


def float_range(start: str, stop: str, step: str, most: int = 1_000_000) -> list[float]:
    """Inclusive decimal range; at most `most` values."""
    from decimal import Decimal

    a, b, s = Decimal(start), Decimal(stop), Decimal(step)
    if s <= 0 or b < a:
        raise ValueError("a range needs a positive step and an end at or after its start")
    n = int((b - a) / s) + 1
    if n > most:
        raise ValueError(f"a range has over {most} values")
    return [float(a + k * s) for k in range(n)]


def sqrt_floor(n: int) -> int:
    return max(1, math.isqrt(n))
