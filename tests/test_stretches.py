"""State machines over stretches: what one task after the rows' order gives, whatever stretches and guesses are."""

import random

import pytest
from barloom.operators import execution, scan
from barloom.operators.indicators import registry

BARS = "symbol string, idx long, open double, high double, low double, close double, volume double"


@pytest.fixture
def small(monkeypatch):
    """Stretches of 16 rows, guessed from 5."""
    monkeypatch.setattr(scan, "SIZE", 16)
    monkeypatch.setattr(scan, "WARM", 5)


def walk(deal, n, holes=0.03, start=100.0):
    rows, close = [], start
    for idx in range(n):
        close = max(1.0, close * (1 + deal.uniform(-0.03, 0.03)))
        high, low = close * (1 + deal.uniform(0, 0.02)), close * (1 - deal.uniform(0, 0.02))
        rows.append((idx, None, None, None, None, None) if deal.random() < holes else (idx, close, high, low, close, 1.0))
    return rows


@pytest.mark.parametrize("id_", ["trend.psar", "trend.supertrend"])
def test_path_dependent_indicators(spark, monkeypatch, id_):
    deal = random.Random(1)
    bars = [(s, *r) for s, n in (("a", 300), ("b", 40), ("c", 1), ("d", 90)) for r in walk(deal, n)]
    if id_ == "trend.psar":  # stretches without rows; exponential averages need dense ones
        bars = [b for b in bars if not (b[0] == "a" and 100 <= b[1] < 180)]
    df = spark.createDataFrame(bars, BARS).repartition(3)
    whole = {(r["symbol"], r["idx"]): r["value"] for r in registry()[id_](df).collect()}
    monkeypatch.setattr(scan, "SIZE", 16)
    monkeypatch.setattr(scan, "WARM", 5)
    # supertrend's averages come from stretches, too, so its values may differ in the last places
    cut = {(r["symbol"], r["idx"]): r["value"] for r in registry()[id_](df).collect()}
    assert whole.keys() == cut.keys() and len(whole) > 300
    assert all((whole[k] is None) == (cut[k] is None) and (whole[k] is None or whole[k] == pytest.approx(cut[k], rel=1e-12)) for k in whole)


def signal_rows(deal, n, stay=0.7):
    rows, signal = [], 0
    for idx, *_, close, _ in walk(deal, n):
        signal = signal if deal.random() < stay else deal.choice((-1, 0, 1))
        rows.append((idx, close, signal))
    return rows


def one_after_another(rows, e, stop_loss, take_profit):
    """Trades and equity by one account over all rows."""
    account, trades, equity = execution.Account(e, stop_loss, take_profit), [], []
    rows = [r for r in sorted(rows) if r[1] is not None]
    for k, (idx, close, signal) in enumerate(rows):
        done = account.bar(idx, close, signal)
        quote = account.open[5] if account.open else done[-1][7] if done else 0.0
        trades += done
        if k + 1 == len(rows) and account.open:
            trades.append(account.leave(idx, close, "forced_close"))
        equity.append((idx, account.value(close), quote > 0))
    return trades, equity


def near(a, b):
    return all(x == pytest.approx(y, rel=1e-9, abs=1e-9) if isinstance(y, float) else x == y for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize(
    "how",
    [
        dict(sizing="all_in", fee=0.001, slippage=0.0005),
        dict(sizing="strategy_compound", fee=0.001, direction="long-only"),
        dict(sizing="strategy_compound_profit_lock", fee=0.001, safe_percent=30.0, stop_loss=0.02, take_profit=0.03),
        dict(sizing="all_in", direction="short-only", stop_loss=0.05),
        dict(sizing="fixed_quote", fixed_quote=300.0, fee=0.002),
        dict(sizing="all_in", fee=0.45),  # nothing is left soon
    ],
)
def test_execution(spark, small, how):
    e, deal = execution.Execution(**how), random.Random(str(how))
    runs = {("a", 0, None, None): signal_rows(deal, 260), ("a", 1, 0.01, None): signal_rows(deal, 100, 0.97), ("b", 0, None, 0.02): signal_rows(deal, 15), ("b", 7, None, None): signal_rows(deal, 200, 0.995)}
    rows = [(*k, *r) for k, rs in runs.items() for r in rs if not (k[1] == 1 and 30 <= r[0] < 70)]
    df = spark.createDataFrame(rows, "symbol string, variant long, stop_loss double, take_profit double, idx long, close double, signal int").repartition(3)
    run = execution.Simulation(df, e)
    trades, equity = run.trades().collect(), run.equity_curve().collect()
    for (symbol, variant, sl, tp), _ in runs.items():
        mine = [r[4:] for r in rows if r[:2] == (symbol, variant)]
        want, curve = one_after_another(mine, e, e.stop_loss if sl is None else sl, e.take_profit if tp is None else tp)
        got = sorted((tuple(r)[2:] for r in trades if (r["symbol"], r["variant"]) == (symbol, variant)), key=lambda t: t[0])
        assert len(got) == len(want) and all(map(near, got, want))
        points = sorted(tuple(r)[2:5] for r in equity if (r["symbol"], r["variant"]) == (symbol, variant))
        assert len(points) == len(curve) and all(map(near, points, curve))


def test_a_bankrupt_short(spark, small):
    """A price that more than doubles takes all of a short's money, in another stretch than the one it was opened in; nothing is entered afterwards."""
    rows = [("a", k, 100.0 if k < 20 else 300.0, -1 if k < 40 else (1, 0)[k % 2]) for k in range(80)]
    df = spark.createDataFrame(rows, "symbol string, idx long, close double, signal int")
    run = execution.Simulation(df, execution.Execution())
    assert [(r["entry_idx"], r["exit_idx"]) for r in run.trades().collect()] == [(0, 40)]
    assert {round(r["equity"]) for r in run.equity_curve().where("idx >= 40").collect()} == {-1000}


def test_empty_and_null_keys(spark, small):
    schema = "symbol string, idx long, close double, signal int"
    run = execution.Simulation(spark.createDataFrame([], schema), execution.Execution())
    assert run.trades().count() == run.equity_curve().count() == 0
    run = execution.Simulation(spark.createDataFrame([(None, k, 10.0 + k, k // 20 % 2) for k in range(50)] + [("x", 0, None, 1)], schema), execution.Execution())
    assert [tuple(r)[3:6] for r in run.trades().collect()] == [("long", 20, 40)] and run.equity_curve().count() == 50


def test_machines_that_never_forget(spark, small):
    """A counter's guesses are all wrong; rounds mend stretch after stretch. `end` is called once a key."""

    def step(s, row):
        s["n"] += row[0]
        return [(row[1], s["n"])]

    df = spark.createDataFrame([(k, i, 1) for k in ("a", "b") for i in range(70)], "k string, idx long, x long").repartition(2)
    got = scan.stretched_scan(df, ["k"], ["x", "idx"], lambda key: {"n": 0}, step, "idx long, n long", lambda s: [(-1, s["n"])]).collect()
    assert sorted(tuple(r) for r in got) == sorted([(i, i + 1) for i in range(70)] * 2 + [(-1, 70)] * 2)


def test_one_symbol_is_many_tasks(spark, monkeypatch):
    """A long history settles in a round or two, and rows come from several tasks."""
    monkeypatch.setattr(scan, "SIZE", 4096)
    monkeypatch.setattr(scan, "WARM", 512)
    n, rounds, real = 100_000, [], scan.materialize
    monkeypatch.setattr(scan, "materialize", lambda df, name: rounds.append(name) or real(df, name))
    df = spark.range(n).selectExpr("'one' AS symbol", "id AS idx", "100 + 10 * sin(id / 37) + (hash(id) % 100) / 50 AS close").selectExpr("*", "close + 1 AS high", "close - 1 AS low", "1 AS volume", "close AS open")
    was = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = scan.stretched_scan(df, ["symbol"], ["idx", "close"], lambda k: {"up": 0}, lambda s, r: s.update(up=1 if r[1] > 108 else 0 if r[1] < 92 else s["up"]) or [(r[0], s["up"])], "idx long, up int")
        from pyspark.sql import functions as F

        parts = out.groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", was)
    assert sum(r["count"] for r in parts) == n and len(parts) > 1
    assert rounds.count("settled") <= 2
