"""Windows of many lengths in one pass against the windows of one point at a time."""

import random
import time

import pytest
from barloom.operators import lengths, scan, search
from barloom.operators.indicators import registry
from barloom.operators.signals import RULES, evaluate
from pyspark.sql import functions as F

SCHEMA = "symbol string, idx long, open double, high double, low double, close double, volume double"


def bars(n, seed=1, symbols=("a", "b")):
    deal, rows = random.Random(seed), []
    for s in symbols:
        close = 100.0
        for idx in range(n):
            close = max(1.0, close * (1 + deal.uniform(-0.02, 0.02)))
            flat = 60 <= idx < 80  # values that don't change
            o = c = h = low = 50.0 if flat else close
            if not flat:
                h, low, o = close + deal.random(), close - deal.random(), close + deal.uniform(-0.5, 0.5)
            hole = deal.random() < 0.02
            rows.append((s, idx, *[None] * 5) if hole else (s, idx, o, h, low, c, 0.0 if 90 <= idx < 100 else deal.random() * 9))
    return rows


def points_of(id_):
    i = registry()[id_]
    out = []
    for w in (2, 3, 7, 16, 33):
        p = {k: w if k.endswith("window") else v for k, v in i.defaults.items()}
        if id_ == "trend.ichimoku":
            p |= {"conversion_window": w, "base_window": w + 3, "displacement": w // 2}
        if id_ == "momentum.stoch":
            p |= {"smoothing": 1 + w // 3}
        if "source" in p:
            p["source"] = ("close", "hl2", "high", "ohlc4", "open")[w % 5]
        out.append(p)
    return out


def same(a, b):
    return (a is None and b is None) or (a is not None and b is not None and a == pytest.approx(b, rel=1e-8, abs=1e-8))


@pytest.mark.parametrize("id_", sorted(lengths.KERNELS))
def test_values_are_those_of_one_point_at_a_time(spark, monkeypatch, id_):
    monkeypatch.setattr(scan, "SIZE", 64)
    df = spark.createDataFrame(bars(150), SCHEMA).repartition(3)
    points = points_of(id_)
    got = {(r["symbol"], r["idx"]): r["values"] for r in lengths.grid_values(df, id_, points).collect()}
    assert len(got) == 300
    names = [f"v{k}" for k in range(len(points))]
    for r in registry()[id_].values(df, points, names).collect():
        assert all(map(same, got[r["symbol"], r["idx"]], [r[n] for n in names])), (r["symbol"], r["idx"], got[r["symbol"], r["idx"]], [r[n] for n in names])


def test_signals_of_several_grids(spark, monkeypatch):
    """Parts with kernels share passes, others stand between them; each bar's signals are in the order of parts and points."""
    monkeypatch.setattr(scan, "SIZE", 64)
    df = spark.createDataFrame(bars(120, 2), SCHEMA).repartition(2)
    parts = [
        search.Part("ma.sma", {"window": [2, 5], "source": ["close", "low"]}), search.Part("structure.zscore", {"window": [4, 9]}, {"long_threshold": -1, "short_threshold": 1}), search.Part("ma.ema", {"window": [3, 4]}),
        search.Part("momentum.williams_r", {"window": [3]}, {"long_threshold": -20, "short_threshold": -80}), search.Part("momentum.roc", {"window": [1, 6]}), search.Part("volume.volume_sma", {"window": [3]}),
    ]
    got = {(r["symbol"], r["idx"]): r["signals"] for r in search.point_signals(df, parts).collect()}
    at = 0
    for p in parts:
        for point in p.points():
            for r in evaluate(df, p.indicator, point, **p.signal).select("symbol", "idx", "signal").collect():
                assert got[r["symbol"], r["idx"]][at] == r["signal"], (p, point, r)
            at += 1
    assert {len(x) for x in got.values()} == {at}


def test_kernels_have_rules_of_their_definitions():
    rules = {i: rule for rule, ids in RULES.items() for i in ids}
    assert all(rules[i] in lengths.RULES or i == "volume.vwap_deviation" for i in lengths.KERNELS)
    assert lengths.has_kernel("structure.zscore") and not lengths.has_kernel("trend.psar")


def test_a_grid_of_1176_points(spark):
    """Six sources by 196 lengths over 3,600 bars take seconds."""
    df = spark.createDataFrame(bars(1800, 3), SCHEMA)
    part = search.Part("ma.sma", {"source": ["close", "hlc3", "ohlc4", "low", "high", "open"], "window": [*range(5, 201)]})
    began = time.time()
    sizes = search.point_signals(df, [part]).select(F.size("signals").alias("n")).distinct().collect()
    assert [r["n"] for r in sizes] == [1176] and time.time() - began < 30  # the machine may be three times slower than usual


def test_empty_tables_and_too_many_points(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert lengths.grid_values(df, "ma.sma", [{"window": 3}]).count() == 0
    with pytest.raises(ValueError, match="points"):
        lengths.grid_values(df, "ma.sma", [{"window": 3}] * 40_000)


def test_the_api_computes_a_grid_in_one_pass(spark):
    from barloom import api

    df = spark.createDataFrame(bars(30, 5), SCHEMA)
    got = {(r["symbol"], r["idx"], r["variant"]): r["value"] for r in api.compute(df, "ma.sma", {"source": ["close", "low"], "window": [2, 5]}).collect()}
    assert len(got) == 240
    for variant, (source, w) in enumerate((s, w) for s in ("close", "low") for w in (2, 5)):
        for r in registry()["ma.sma"](df, source=source, window=w).collect():
            a, b = got[r["symbol"], r["idx"], variant], r["value"]
            assert (a is None) == (b is None) and (a is None or a == pytest.approx(b, rel=1e-6))
    i = spark.sql("select 1 market_id, 'BTC' symbol, 'ENABLED' status, 1 is_tradable, 1 updated_at")
    assert [tuple(r) for r in api.instruments(i, 1, "b").collect()] == [(1, "BTC")]
