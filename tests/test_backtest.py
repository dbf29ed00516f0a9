import json
import math

import pytest
from pyspark.sql import functions as F

from barloom.operators import execution as E
from barloom.operators import metrics, search, signals

DAY = 86_400_000


def frame(spark, closes, sig, start=0):
    return spark.createDataFrame([("s", start + i, float(c), int(x)) for i, (c, x) in enumerate(zip(closes, sig, strict=True))], "symbol string, idx long, close double, signal byte")


def run(spark, closes, sig, **kw):
    f, e = frame(spark, closes, sig), E.Execution(**kw)
    return sorted(E.trades(f, e).collect(), key=lambda r: r["trade_id"]), sorted(E.equity_curve(f, e).collect(), key=lambda r: r["idx"])


def test_stop_loss_and_no_entry_without_a_new_signal(spark):
    t, _ = run(spark, [100, 100, 98, 110, 115], [1] * 5, stop_loss=0.01)
    assert [(x["reason"], x["exit_idx"]) for x in t] == [("sl", 2)]
    assert math.isclose(t[0]["net_pnl"], -20)


@pytest.mark.parametrize(("direction", "sig"), [("long-only", [1, -1, -1]), ("short-only", [-1, 1, 1])])
def test_a_disallowed_side_still_exits(spark, direction, sig):
    t, _ = run(spark, [100, 105, 90], sig, direction=direction)
    assert [x["reason"] for x in t] == ["signal_exit"]


def test_costs(spark):
    _, e = run(spark, [100, 100], [1, 0], fee=0.01, slippage=0.01)
    assert math.isclose(e[-1]["equity"], 960.3960396039604)


def test_loss_before_gain_and_forced_close(spark):
    t, _ = run(spark, [100, 100], [1, 1], stop_loss=0.0, take_profit=0.0)
    assert t[0]["reason"] == "sl"
    t, _ = run(spark, [100, 105], [1, 1])
    assert (t[0]["reason"], t[0]["exit_idx"]) == ("forced_close", 1)


def test_profit_lock_and_short(spark):
    t, e = run(spark, [100, 110, 100, 110], [1, 0, 1, 0], sizing="strategy_compound_profit_lock", safe_percent=50)
    assert math.isclose(t[1]["entry_quote"], 1050) and math.isclose(sum(x["locked"] for x in t), 102.5) and math.isclose(e[-1]["equity"], 1205)
    t, e = run(spark, [100, 90], [-1, 0])
    assert math.isclose(t[0]["gross_pnl"], 100) and math.isclose(e[-1]["equity"], 1100)


def test_a_reversal_on_the_last_bar_is_two_trades(spark):
    t, e = run(spark, [100, 110], [1, -1])
    assert [(x["direction"], x["entry_idx"], x["exit_idx"], x["reason"]) for x in t] == [("long", 0, 1, "signal_exit"), ("short", 1, 1, "forced_close")]
    assert math.isclose(e[-1]["equity"], 1100)


def report(spark, closes, sig, cash=1000.0):
    f, e = frame(spark, closes, sig, 20454), E.Execution(cash=cash)
    return metrics.report(f, E.trades(f, e), E.equity_curve(f, e), cash, DAY).first().asDict()


def test_report_table(spark):
    got = metrics.format_report(report(spark, [100, 110, 120, 130, 90, 80], [1, 0, -1, 0, 1, 0]), "a", "b", "c", 1000)
    want = {
        "Total Profit": "-103.7", "Total Return [%]": "-10.3704", "Benchmark Return [%]": "-20", "Position Coverage [%]": "100", "Max. Drawdown [%]": "18.5185", "Avg. Drawdown [%]": "5.8642",
        "Max. Drawdown Duration": "2 days, 0:00:00", "Avg. Drawdown Duration": "2 days, 0:00:00", "Num. Trades": "3", "Win Rate [%]": "33.3333", "Best Trade [%]": "10", "Worst Trade [%]": "-11.1111",
        "Avg. Trade [%]": "-3.1481", "Max. Trade Duration": "1 day, 0:00:00", "Expectancy": "-3.1481", "SQN": "-0.51181", "Gross Exposure": "1.0208", "Sharpe Ratio": "-0.63099", "Sortino Ratio": "-0.84241", "Calmar Ratio": "-5.39817",
    }
    lines = dict(x.strip("|").split("|") for x in got.strip().split("\n"))
    assert {k: lines[k] for k in want} == want


def test_report_without_trades(spark):
    r = report(spark, [100, 110, 120], [0, 0, 0])
    assert r["num_trades"] == 0 and r["win_rate_pct"] is None and r["total_return_pct"] == 0
    assert metrics.format_value(r["sqn"], 5) == "N/A"


def test_drawdown_episodes(spark):
    e = spark.createDataFrame([("s", 0, i, float(x)) for i, x in enumerate([100, 120, 110, 120, 90])], "symbol string, variant long, idx long, equity double")
    d = metrics.drawdowns(e, DAY).first()
    assert math.isclose(d["max_drawdown_pct"], 25) and d["max_drawdown_ms"] == DAY and d["avg_drawdown_ms"] == DAY // 2


def simulate(closes, sig, e):
    """The rules once more, as plain arithmetic."""
    cash, pos, prev, out = e.cash, None, 0, []
    for i, (c, s) in enumerate(zip(closes, sig, strict=True)):
        def close(reason):
            nonlocal cash, pos
            side, fill, qty, q, fee = pos
            got = qty * c * (1 - side * e.slippage)
            cash += q + side * (got - q) - got * e.fee
            out.append((i, reason, round(side * (got - q) - fee - got * e.fee, 9)))
            pos = None
        if pos:
            side, fill = pos[0], pos[1]
            if side * (c - fill * (1 - side * e.stop_loss)) <= 0:
                close("sl")
            elif side * (c - fill * (1 + side * e.take_profit)) >= 0:
                close("tp")
        if pos and s != pos[0]:
            close("signal_exit")
        if not pos and s and s != prev and cash > 0:
            fill = c * (1 + s * e.slippage)
            pos = (s, fill, cash / fill, cash, cash * e.fee)
            cash -= cash * (1 + e.fee)
        prev = s
        if pos and i == len(closes) - 1:
            close("forced_close")
    return out


def test_trades_against_plain_arithmetic(spark):
    import random

    r = random.Random(3)
    closes, sig = [100.0], [0]
    for _ in range(300):
        closes.append(closes[-1] * (1 + r.gauss(0, 0.02)))
        sig.append(r.choice([sig[-1], sig[-1], 1, 0, -1]))
    e = E.Execution(fee=0.001, slippage=0.0005, stop_loss=0.05, take_profit=0.08)
    got = sorted(E.trades(frame(spark, closes, sig), e).collect(), key=lambda x: x["trade_id"])
    assert [(x["exit_idx"], x["reason"], round(x["net_pnl"], 9)) for x in got] == simulate(closes, sig, e)


def test_signal_rules(spark):
    one = lambda c: spark.range(1).select(c.alias("s")).first()["s"]
    v = lambda x: F.lit(x).cast("double")
    assert [one(signals.sign(v(x))) for x in (1, -1, 0, None)] == [1, -1, 0, 0]
    assert [one(signals.threshold_band(v(x), 30, 70)) for x in (20, 80, 50)] == [1, -1, 0]
    assert [one(signals.threshold_band(v(x), 70, 30)) for x in (20, 80, 50)] == [-1, 1, 0]
    assert one(signals.compare_price_to_output(v(2), v(1), inverted=True)) == -1
    assert one(signals.delta_sign(v(2), v(1), v(3))) == 0
    assert one(signals.conjunction_of([])) == 0
    assert one(signals.conjunction_of([F.lit(1), F.lit(1)])) == 1 and one(signals.conjunction_of([F.lit(1), F.lit(-1)])) == 0
    with pytest.raises(ValueError):
        signals.check_parameters("threshold_band", {"long_threshold": 1})
    assert signals.expand_dependencies(["pivots", "ma.sma"]) == ["pivots", "pivot_low", "pivot_high", "ma.sma"]
    assert sum(map(len, signals.RULES.values())) == 52


def test_search_against_single_runs(spark, tmp_path):
    import random

    r = random.Random(4)
    closes = [100.0]
    for _ in range(80):
        closes.append(closes[-1] * (1 + r.gauss(0, 0.03)))
    b = spark.createDataFrame([("s", i, c, c, c, c, 1.0) for i, c in enumerate(closes)], "symbol string, idx long, open double, high double, low double, close double, volume double")
    parts = [search.Part("ma.sma", {"window": [2, 5]}), search.Part("momentum.roc", {"window": [3]})]
    how = E.Execution(fee=0.001)
    best, sig = search.stage_a(b, parts, how, DAY, preselect=5)
    got = {r["variant"]: r["total_return_pct"] for r in best.collect()}
    for v, w in enumerate((2, 5)):
        a = signals.evaluate(b, "ma.sma", {"window": w}).select("symbol", "idx", "signal")
        z = signals.evaluate(b, "momentum.roc", {"window": 3}).select("symbol", "idx", "signal")
        s = b.select("symbol", "idx", "close").join(signals.conjunction(a.unionByName(z)), ["symbol", "idx"])
        last = E.equity_curve(s, how).orderBy(F.desc("idx")).first()["equity"]
        assert math.isclose(got[v], 100 * (last / 1000 - 1), abs_tol=1e-9)
    order = [r["total_return_pct"] for r in best.collect()]
    assert order == sorted(order, reverse=True)
    top = search.stage_b(best, sig, search.risk_variants((None, 0.02), (0.05,)), how, DAY, top_k=3).collect()
    assert len(top) == 3 and {r["risk"] for r in top} <= {0, 1}
    written = search.snapshots(best, sig, search.risk_variants((None, 0.02), (0.05,)), how, DAY, str(tmp_path), block=1, every=1, top_k=3).collect()
    assert [(r["variant"], r["risk"]) for r in written] == [(r["variant"], r["risk"]) for r in top] and list(tmp_path.iterdir())
    assert search.merge_top(best, best.limit(0), 1, "total_return_pct").count() == 1


def test_guards():
    parts = [search.Part("ma.sma", {"window": list(range(2, 1002))}), search.Part("ma.ema", {"window": list(range(2, 1002))})]
    with pytest.raises(ValueError):
        search.enforce_guards(search.estimate(parts, 1000))
    with pytest.raises(ValueError):
        search.Part("ma.sma", {"window": [2, 2]}).points()
    with pytest.raises(ValueError):
        search.ranking("sharpe")


def test_side_by_side_accounts_are_single_ones(spark):
    """Every direction, sizing and pair of stops, over random signals: figures of one pass against trades and equity."""
    import random

    r = random.Random(11)
    closes = [100.0]
    for _ in range(120):
        closes.append(closes[-1] * (1 + r.gauss(0, 0.03)))
    sig = [[r.choice([1, 0, -1]) for _ in range(3)] for _ in closes]
    signals_ = spark.createDataFrame([("s", i, c, s) for i, (c, s) in enumerate(zip(closes, sig, strict=True))] + [("s", 500, None, [1, 1, 1])], "symbol string, idx long, close double, signals array<byte>")
    plans = [([0], None, None), ([1], 0.04, None), ([0, 2], None, 0.05), ([2], 0.03, 0.03)]
    variants = spark.createDataFrame([("s", k % 2, k, p, a, b) for k, (p, a, b) in enumerate(plans)], "symbol string, block long, variant long, points array<int>, stop_loss double, take_profit double")
    for how in (E.Execution(fee=0.001, slippage=0.0005), E.Execution(direction="long-only", sizing="fixed_quote", fixed_quote=300.0, fee=0.002), E.Execution(direction="short-only", sizing="strategy_compound_profit_lock", safe_percent=30.0)):
        got = {x["variant"]: x for x in E.figures(variants, signals_, how).collect()}
        assert len(got) == len(plans)
        for k, (points, a, b) in enumerate(plans):
            joint = [1 if min(s[p] for p in points) == 1 else -1 if max(s[p] for p in points) == -1 else 0 for s in sig]
            one = E.Execution(**{**how.__dict__, "stop_loss": a, "take_profit": b})
            t, e = E.trades(frame(spark, closes, joint), one), E.equity_curve(frame(spark, closes, joint), one)
            net = [x["net_pnl"] for x in t.collect()]
            d = metrics.drawdowns(e, DAY).first()
            last = e.orderBy(F.desc("idx")).first()["equity"]
            want = (last, d["max_drawdown_pct"] / 100, sum(x for x in net if x > 0), -sum(x for x in net if x < 0))
            assert got[k]["num_trades"] == len(net) and all(math.isclose(got[k][c], w, rel_tol=1e-9, abs_tol=1e-9) for c, w in zip(("final", "max_drawdown", "won", "lost"), want, strict=True))


def test_grids_are_numbers(spark):
    big = search.Part("trend.ichimoku", {"conversion_window": range(2, 50), "base_window": range(2, 50), "span_b_window": range(2, 52)})
    assert big.size == 115_200
    parts = [search.Part("ma.sma", {"window": [3, 5]}, {}), search.Part("momentum.rsi", {"window": [4, 6, 8]}, {"long_threshold": 30, "short_threshold": 70})]
    rows = sorted(search.grid(spark, parts).collect())
    from barloom.functions.scalars import encode_radix, variant_key

    assert [tuple(x) for x in rows] == [
        (encode_radix((i, j), (2, 3)), variant_key({"0:ma.sma": {"window": a}, "1:momentum.rsi": {"window": b, "long_threshold": 30, "short_threshold": 70}}), [i, j])
        for i, a in enumerate((3, 5)) for j, b in enumerate((4, 6, 8))
    ]


def test_requests_use_either_name_and_meet_the_guard(spark):
    from barloom import api

    bars = spark.createDataFrame([("s", i, 1.0 + i % 3, 3.0, 1.0, 2.0 - i % 2, 1.0) for i in range(20)], "symbol string, idx long, open double, high double, low double, close double, volume double")
    same = [signals.evaluate(bars, "candle_stats", **{n: 0.2}).select("idx", "signal").collect() for n in ("threshold", "min_body_pct")]
    assert sorted(same[0]) == sorted(same[1])
    got = api.compute(bars, "ma.sma", {"window": [2, 3]})
    assert got.count() == 40 and {r["variant"] for r in got.collect()} == {0, 1}
    with pytest.raises(ValueError):
        api.compute(bars, "ma.sma", {"window": [2, 3]}, most_bytes=(64 << 20) + 28 * 20 + 4 * 20 * 2 - 1)


def test_bars_move_as_often_as_there_are_tasks(spark):
    """However many variants a symbol has, its bars are copied for tasks, not for blocks of variants; signals are two bits each."""
    assert [E.tasks_of(n, 1, 4) for n in (1, 2048, 4097, 600_000, 10**9)] == [1, 1, 3, 8, 7630] and E.tasks_of(600_000, 500, 1000) == 5 and E.tasks_of(0, 0, 4) == 1
    rows = [("s", i, 1.0, [(i * k) % 3 - 1 for k in range(11)]) for i in range(7)]
    df = spark.createDataFrame(rows, "symbol string, idx long, close double, signals array<byte>").coalesce(1)
    got = E.packed(df).orderBy("idx").collect()
    assert {len(bytes(r["signals"])) for r in got} == {4}
    import pyarrow as pa

    back = E._unpacked(pa.array([bytes(r["signals"]) for r in got], pa.binary()))
    assert back[:, :11].tolist() == [r[3] for r in rows] and not back[:, 11:].any()


def test_a_killed_search_goes_on_after_its_last_snapshot(spark, tmp_path, monkeypatch):
    closes = [100.0 + (k * 37) % 23 for k in range(40)]
    b = spark.createDataFrame([("s", i, c, c, c, c, 1.0) for i, c in enumerate(closes)], "symbol string, idx long, open double, high double, low double, close double, volume double")
    how, risks = E.Execution(), search.risk_variants((None, 0.02))
    best, sig = search.stage_a(b, [search.Part("ma.sma", {"window": [2, 3, 4, 5]}), search.Part("momentum.roc", {"window": [1, 2]})], how, DAY, preselect=8)
    whole = search.stage_b(best, sig, risks, how, DAY, top_k=5).select("variant", "total_return_pct").collect()
    ran, real = [], search.stage_b

    def counted(some, *rest, stop_after=None):
        if stop_after is not None and len(ran) >= stop_after:
            raise KeyboardInterrupt
        ran.append({r["variant"] for r in some.collect()})
        return real(some, *rest)

    monkeypatch.setattr(search, "stage_b", lambda *a: counted(*a, stop_after=3))
    with pytest.raises(KeyboardInterrupt):
        search.snapshots(best, sig, risks, how, DAY, str(tmp_path / "log"), block=2, every=2, top_k=5)
    assert len(ran) == 3 and {x.name for x in (tmp_path / "log").iterdir()} == {"blocks=2-of-4"}
    monkeypatch.setattr(search, "stage_b", counted)
    kept, ran[:] = ran[:2], []
    got = search.snapshots(best, sig, risks, how, DAY, str(tmp_path / "log"), block=2, every=99, top_k=5, seconds=0.0)
    assert len(ran) == 2 and not set().union(*kept) & set().union(*ran)
    assert [(r["variant"], r["total_return_pct"]) for r in got.orderBy(*search.ranking("total_return_pct"), "risk").collect()] == [tuple(r) for r in whole]
    assert {x.name for x in (tmp_path / "log").iterdir()} == {"blocks=2-of-4", "blocks=3-of-4", "blocks=4-of-4"}
    with pytest.raises(ValueError, match="another"):
        search.snapshots(best, sig, risks, how, DAY, str(tmp_path / "log"), block=1, top_k=5)
    with pytest.raises(ValueError, match="variants"):
        search.stage_a(b, [search.Part("ma.sma", {"window": [*range(2, 1002)]}), search.Part("momentum.roc", {"window": [*range(2, 1002)]})], how, DAY)


def test_an_indicator_of_ones_own_is_searched_over(spark):
    from barloom.operators import extensions
    from barloom.operators.scan import rolled

    def momentum(df, p):
        return rolled(df, p["window"], lambda d, r: d.withColumn("value", p["scale"] * (F.col("close") - r.lag(F.col("close"), p["window"]))))

    closes = [100.0 + (k * 37) % 23 for k in range(40)]
    b = spark.createDataFrame([("s", i, c, c, c, c, 1.0) for i, c in enumerate(closes)], "symbol string, idx long, open double, high double, low double, close double, volume double")
    extensions.register_indicator("custom.momentum", momentum, "sign", {"window": 2, "scale": 1.0})
    try:
        parts = [search.Part("custom.momentum", {"window": [1, 3], "scale": [1.0, -1.0]}), search.Part("ma.sma", {"window": [2, 3]})]
        best, _ = search.stage_a(b, parts, E.Execution(), DAY, preselect=20)
        assert best.count() == 8
        own = {r["idx"]: r["signal"] for r in signals.evaluate(b, "custom.momentum", {"window": 3, "scale": -1.0}).collect()}
        assert own == {i: 0 if i < 3 else -1 if c > closes[i - 3] else 1 if c < closes[i - 3] else 0 for i, c in enumerate(closes)}
        with pytest.raises(ValueError, match="already"):
            extensions.register_indicator("custom.momentum", momentum, "sign")
    finally:
        extensions.remove_indicator("custom.momentum")
    for wrong in (("ma.sma", "sign"), ("custom.other", "no rule")):
        with pytest.raises(ValueError):
            extensions.register_indicator(wrong[0], momentum, wrong[1])
    with pytest.raises(ValueError, match="user"):
        extensions.remove_indicator("ma.sma")
    extensions.register_functions(spark)
    spec = json.dumps([{"indicator": p.indicator, "axes": p.axes} for p in parts])
    spark.createDataFrame([(0, 3), (3, 6), (6, 99)], "a int, b int").createOrReplaceTempView("ranges")
    got = spark.sql(f"SELECT g.* FROM ranges, LATERAL grid_variants('{spec}', a, b) g").collect()
    want = {(v, k, parts[k].indicator, json.dumps(parts[k].points()[at])) for v in range(8) for k, at in enumerate(divmod(v, 2))}
    assert {tuple(r) for r in got} == want and len(got) == 16
