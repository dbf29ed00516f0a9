"""DuckDB SQL that says, apart from the Spark code, what each query must return."""

from __future__ import annotations

EVENT_BARS = """r AS (
  SELECT event_type AS symbol, epoch_ms(ts) // 3600000 AS idx, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low,
         last(value ORDER BY ts, event_id) AS close, count(*)::DOUBLE AS volume
  FROM events WHERE event_type IS NOT NULL AND ts IS NOT NULL AND value IS NOT NULL AND isfinite(value) GROUP BY ALL),
b AS (
  SELECT s.symbol, s.idx, r.open, r.high, r.low, r.close, r.volume
  FROM (SELECT symbol, unnest(generate_series(min(idx), max(idx))) AS idx FROM r GROUP BY symbol) s LEFT JOIN r USING (symbol, idx))"""

BY = "PARTITION BY symbol ORDER BY idx"
TP = "((high + low + close) / 3)"


def w(n: int) -> str:
    return f"({BY} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def full(x: str, n: int, e: str) -> str:
    return f"CASE WHEN count({x}) OVER {w(n)} = {n} THEN {e} END"


def agg(f: str, x: str, n: int) -> str:
    return full(x, n, f"{f}({x}) OVER {w(n)}")


def lag(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) OVER ({BY})"


def div(a: str, b: str) -> str:
    return f"({a}) / nullif({b}, 0)"


def wma(x: str, n: int) -> str:
    """From the values themselves, each with its weight."""
    return full(x, n, "(" + " + ".join(f"{n - k} * {lag(x, k) if k else x}" for k in range(n)) + f") / {n * (n + 1) / 2}")


class Steps:
    """Common table expressions, each adding columns to the one before."""

    def __init__(self, first: str = EVENT_BARS, name: str = "b") -> None:
        self.parts, self.name, self.n = [first], name, 0

    def add(self, **columns: str) -> Steps:
        self.n += 1
        self.parts.append(f"t{self.n} AS (SELECT *, {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM {self.name})")
        self.name = f"t{self.n}"
        return self

    def scan(self, x: str, y: str, decay: float, gain: float) -> Steps:
        """The recurrence as a sum over all earlier values of a run, each with its weight."""
        n = self.n = self.n + 1
        self.parts.append(f"g{n} AS (SELECT *, sum(CASE WHEN {x} IS NULL THEN 1 ELSE 0 END) OVER ({BY}) AS run FROM {self.name})")
        self.parts.append(f"f{n} AS (SELECT symbol, idx, run, {x} AS x, min(idx) OVER (PARTITION BY symbol, run) AS head FROM g{n} WHERE {x} IS NOT NULL)")
        self.parts.append(
            f"s{n} AS (SELECT t.symbol, t.idx, sum(i.x * pow({decay!r}, t.idx - i.idx) * CASE WHEN i.idx = i.head THEN 1 ELSE {gain!r} END) AS {y} "
            f"FROM f{n} t JOIN f{n} i ON i.symbol = t.symbol AND i.run = t.run AND i.idx <= t.idx GROUP BY ALL)"
        )
        self.parts.append(f"t{n} AS (SELECT g{n}.* EXCLUDE (run), s{n}.{y} FROM g{n} LEFT JOIN s{n} USING (symbol, idx))")
        self.name = f"t{n}"
        return self

    def ema(self, x: str, y: str, n: int) -> Steps:
        return self.scan(x, y, 1 - 2 / (n + 1), 2 / (n + 1))

    def rma(self, x: str, y: str, n: int) -> Steps:
        return self.scan(x, y, 1 - 1 / n, 1 / n)

    def rename_value(self, e: str) -> Steps:
        self.n += 1
        self.parts.append(f"t{self.n} AS (SELECT * EXCLUDE (value), {e} AS value FROM {self.name})")
        self.name = f"t{self.n}"
        return self

    def copy(self) -> Steps:
        out = Steps(self.parts[0], self.name)
        out.parts, out.n = [*self.parts], self.n
        return out

    def select(self, what: str) -> str:
        return f"WITH {', '.join(self.parts)} SELECT {what} FROM {self.name}"

    def value(self) -> str:
        return self.select("symbol, idx, round(value, 6) AS value")


def tr(s: Steps) -> Steps:
    """greatest() passes over NULLs, so a bar without a previous close has high - low."""
    return s.add(pc=lag("close")).add(tr="CASE WHEN high IS NOT NULL AND low IS NOT NULL THEN greatest(high - low, abs(high - pc), abs(low - pc)) END")


def atr(s: Steps, n: int) -> Steps:
    return tr(s).rma("tr", "atr", n)


def one(**columns: str) -> Steps:
    return Steps().add(**columns)


def indicator_steps(n: int = 5) -> dict[str, Steps]:
    """The queries' parameters: windows of 5 and the definitions' other defaults."""
    hh, ll = agg("max", "high", n), agg("min", "low", n)
    mean, std = agg("avg", "close", n), agg("stddev_pop", "close", n)
    tpv = f"{TP} * volume"
    out: dict[str, Steps] = {}
    out["ma.sma"] = one(value=mean)
    out["ma.wma"] = one(value=wma("close", n))
    out["ma.lwma"] = one(value=wma("close", n))
    out["ma.vwma"] = one(pv="close * volume", pvv="CASE WHEN close IS NOT NULL THEN volume END").add(value=div(agg("sum", "pv", n), agg("sum", "pvv", n)))
    out["ma.ema"] = Steps().ema("close", "value", n)
    out["ma.rma"] = Steps().rma("close", "value", n)
    out["ma.smma"] = Steps().rma("close", "value", n)
    out["ma.dema"] = Steps().ema("close", "e1", n).ema("e1", "e2", n).add(value="2 * e1 - e2")
    out["ma.tema"] = Steps().ema("close", "e1", n).ema("e1", "e2", n).ema("e2", "e3", n).add(value="3 * e1 - 3 * e2 + e3")
    out["ma.zlema"] = one(y=f"2 * close - {lag('close', (n - 1) // 2)}").ema("y", "value", n)
    out["ma.hma"] = one(a=wma("close", 4), z=wma("close", 9)).add(y="2 * a - z").add(value=wma("y", 3))
    moves = one(d=f"close - {lag('close')}").add(up="CASE WHEN d IS NOT NULL THEN greatest(d, 0) END", down="CASE WHEN d IS NOT NULL THEN greatest(-d, 0) END").rma("up", "gain", n).rma("down", "loss", n)
    moves.add(rsi="CASE WHEN loss = 0 AND gain > 0 THEN 100 WHEN loss > 0 THEN 100 - 100 / (1 + gain / loss) END")
    out["momentum.stoch_rsi"] = moves.copy().add(lo=agg("min", "rsi", 4), hi=agg("max", "rsi", 4)).add(raw="100 * (rsi - lo) / nullif(hi - lo, 0)").add(value=agg("avg", "raw", 2))
    out["momentum.rsi"] = moves.add(value="rsi")
    out["momentum.roc"] = one(value=f"100 * ({div('close', lag('close', n))} - 1)")
    deviations = " + ".join(f"abs({lag('x', k) if k else 'x'} - m)" for k in range(n))
    out["momentum.cci"] = one(x=TP).add(m=agg("avg", "x", n)).add(value=div("x - m", f"0.015 * (({deviations}) / {n})"))
    out["momentum.williams_r"] = one(hh=hh, ll=ll).add(value=f"-100 * {div('hh - close', 'hh - ll')}")
    out["momentum.fisher"] = one(hh=hh, ll=ll).add(n0="2 * ((high + low) / 2 - ll) / nullif(hh - ll, 0) - 1").add(n1="CASE WHEN n0 IS NOT NULL THEN greatest(-0.999, least(0.999, n0)) END").add(value="0.5 * ln((1 + n1) / (1 - n1))")
    out["momentum.stoch"] = one(hh=hh, ll=ll).add(raw="100 * (close - ll) / nullif(hh - ll, 0)").add(value=agg("avg", "raw", 3))
    out["momentum.trix"] = Steps().ema("close", "e1", n).ema("e1", "e2", n).ema("e2", "e3", n).add(value=f"100 * ({div('e3', lag('e3'))} - 1)")
    out["momentum.macd"] = Steps().ema("close", "f", 3).ema("close", "s", 6).add(value="f - s")
    out["momentum.ppo"] = Steps().ema("close", "f", 3).ema("close", "s", 6).add(value="100 * (f - s) / nullif(s, 0)")
    dm = lambda a, z: f"CASE WHEN high IS NOT NULL AND low IS NOT NULL THEN CASE WHEN {a} > {z} AND {a} > 0 THEN {a} ELSE 0 END END"
    adx = tr(one(mu=f"high - {lag('high')}", md=f"{lag('low')} - low").add(up=dm("mu", "md"), down=dm("md", "mu"))).rma("tr", "a", n).rma("up", "pu", n).rma("down", "pd", n)
    out["trend.adx"] = adx.add(di="100 * pu / nullif(a, 0)", dj="100 * pd / nullif(a, 0)").add(dx="100 * abs(di - dj) / nullif(di + dj, 0)").rma("dx", "value", n)
    # the latest of equal extremes: the nearest of the window's bars that has it
    nearest = lambda x, e: "CASE " + " ".join(f"WHEN {lag(x, k) if k else x} = {e} THEN {k}" for k in range(n)) + " END"
    out["trend.aroon"] = one(hh=hh, ll=ll).add(value=f"CASE WHEN hh IS NOT NULL AND ll IS NOT NULL THEN ({n} - ({nearest('high', 'hh')})) / {n} * 100 - ({n} - ({nearest('low', 'll')})) / {n} * 100 END")
    out["trend.chandelier_exit"] = atr(Steps(), n).add(value=f"{hh} - 3.0 * atr")
    out["trend.donchian"] = one(value=f"({hh} + {ll}) / 2")
    mid = lambda k: f"({agg('max', 'high', k)} + {agg('min', 'low', k)}) * 0.5"
    out["trend.ichimoku"] = one(c3=mid(3), c5=mid(5)).add(raw="(c3 + c5) * 0.5").add(value=f"lead(raw, 2) OVER ({BY})")
    out["trend.keltner"] = one(x=TP).ema("x", "value", n)
    slope = " + ".join(f"({n - 1 - k - (n - 1) / 2}) * {lag('close', k) if k else 'close'}" for k in range(n))
    out["trend.linreg_slope"] = one(value=full("close", n, f"({slope}) / {n * (n * n - 1) / 12}"))
    out["trend.vortex"] = tr(one(vm=f"abs(high - {lag('low')})")).add(value=div(agg("sum", "vm", n), agg("sum", "tr", n)))
    out["volatility.tr"] = tr(Steps()).add(value="tr")
    out["volatility.atr"] = atr(Steps(), n).add(value="atr")
    out["volatility.variance"] = one(value=agg("var_pop", "close", n))
    out["volatility.stddev"] = one(value=std)
    out["volatility.hv"] = one(pc=lag("close")).add(ret="CASE WHEN close > 0 AND pc > 0 THEN ln(close / pc) END").add(value=f"{agg('stddev_pop', 'ret', n)} * sqrt(365) * 100")
    out["volatility.bbands"] = one(value=mean)
    out["volatility.bbands_bandwidth"] = one(value=div(f"2 * 2.0 * {std}", mean))
    out["volatility.bbands_percent_b"] = one(m=mean, h=f"2.0 * {std}").add(value=div("close - (m - h)", "2 * h"))
    ad = one(flow="((close - low) - (high - close)) / nullif(high - low, 0) * volume").scan("flow", "ad", 1.0, 1.0)
    out["volume.cmf"] = ad.copy().add(m=f"ad - {lag('ad')}").add(value=div(agg("sum", "m", n), agg("sum", "volume", n)))
    out["volume.ad_line"] = ad.add(value="ad")
    out["volume.obv"] = one(sv=f"sign(close - {lag('close')}) * volume").scan("sv", "value", 1.0, 1.0)
    flow = lambda op: f"CASE WHEN x IS NOT NULL AND px IS NOT NULL AND volume IS NOT NULL THEN CASE WHEN x {op} px THEN x * volume ELSE 0 END END"
    out["volume.mfi"] = one(x=TP).add(px=lag("x")).add(up=flow(">"), down=flow("<")).add(pu=agg("sum", "up", n), pd=agg("sum", "down", n)).add(value="CASE WHEN pd = 0 THEN 100 ELSE 100 - 100 / (1 + pu / pd) END")
    out["volume.volume_sma"] = one(value=agg("avg", "volume", n))
    vwap = one(x=tpv).add(value=div(agg("sum", "x", n), agg("sum", "volume", n)))
    out["volume.vwap_deviation"] = vwap.copy().add(off=f"{TP} - value").add(sd=agg("stddev_pop", "off", n)).rename_value("value + 2.0 * sd")
    out["volume.vwap"] = vwap
    parts = {"body": "abs(close - open)", "range": "high - low", "upper_wick": "high - greatest(open, close)", "lower_wick": "least(open, close) - low"}
    for k, e in parts.items():
        raw = f"CASE WHEN open IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL AND close IS NOT NULL THEN {e} END"
        normal = f"({raw}) / nullif(atr::FLOAT::DOUBLE, 0)"
        out[f"candle_{k}"] = one(value=raw)
        out[f"candle_{k}_atr"] = atr(Steps(), n).add(value=normal)
        if k != "range":
            out[f"candle_{k}_pct"] = one(value=f"({raw}) / nullif(high - low, 0)")
        if k == "body":
            out["candle_stats"] = one(value=f"({raw}) / nullif(high - low, 0)")
            out["candle_stats_atr_norm"] = atr(Steps(), n).add(value=normal)
    out["zscore"] = one(value=div(f"close - {mean}", std))
    ranks = " + ".join(f"CASE WHEN {lag('close', k) if k else 'close'} <= close THEN 1 ELSE 0 END" for k in range(n))
    out["percent_rank"] = one(value=full("close", n, f"({ranks}) / {n} * 100"))
    pivot = lambda x, op: f"CASE WHEN {' AND '.join(f'{lag(x, 2)} {op} {lag(x, k) if k else x}' for k in (0, 1, 3, 4))} THEN {lag(x, 2)} END"
    out["pivots"] = one(value=pivot("high", ">"))
    out["pivot_high"] = one(value=pivot("high", ">"))
    out["pivot_low"] = one(value=pivot("low", "<"))
    out["distance_to_ma_norm"] = atr(Steps(), n).ema("close", "e", n).add(value="(close - e) / nullif(atr::FLOAT::DOUBLE, 0)")
    return out


def signal(long: str, short: str) -> str:
    a, z = f"coalesce({long}, false)", f"coalesce({short}, false)"
    return f"CASE WHEN {a} AND NOT {z} THEN 1 WHEN {z} AND NOT {a} THEN -1 ELSE 0 END"


def signal_sql() -> dict[str, str]:
    s = indicator_steps()
    rules = {
        "compare_price_to_output": ("ma.sma", "close > value", "close < value"),
        "threshold_band": ("momentum.rsi", "value <= 30", "value >= 70"),
        "sign": ("momentum.macd", "value > 0", "value < 0"),
        "delta_sign": ("volatility.atr", f"value - {lag('value', 2)} > 0", f"value - {lag('value', 3)} < 0"),
        "compare_volume_to_output": ("volume.volume_sma", "volume > value", "volume < value"),
        "candle_body_direction": ("candle_stats", "value >= 0.5 AND close > open", "value >= 0.5 AND close < open"),
        "threshold_centered": ("trend.vortex", "value > 1.1", "value < 0.9"),
    }
    out = {f"sig_{k}": s[i].select(f"symbol, idx, CAST({signal(a, z)} AS TINYINT) AS signal") for k, (i, a, z) in rules.items()}
    pivots = Steps().add(h=f"CASE WHEN {' AND '.join(f'{lag("high", 2)} > {lag("high", k) if k else "high"}' for k in (0, 1, 3, 4))} THEN 1 END", l=f"CASE WHEN {' AND '.join(f'{lag("low", 2)} < {lag("low", k) if k else "low"}' for k in (0, 1, 3, 4))} THEN 1 END")
    out["sig_pivot_events"] = pivots.select(f"symbol, idx, CAST({signal('l IS NOT NULL', 'h IS NOT NULL')} AS TINYINT) AS signal")
    both = Steps().add(a=agg("avg", "close", 3), z=agg("avg", "close", 6))
    out["sig_and_aggregate"] = both.select(f"symbol, idx, CAST({signal('close > a AND close > z', 'close < a AND close < z')} AS TINYINT) AS signal")
    out["flagship"] = (
        f"WITH {', '.join(both.parts)}, s AS (SELECT symbol, {signal('close > a AND close > z', 'close < a AND close < z')} AS signal FROM {both.name}) "
        "SELECT symbol, count(*) FILTER (signal = 1) AS n_long, count(*) FILTER (signal = -1) AS n_short, count(*) FILTER (signal = 0) AS n_neutral FROM s GROUP BY symbol"
    )
    return out


def bars_sql() -> dict[str, str]:
    ohlc = "round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, round(volume, 6) AS volume"
    minute = EVENT_BARS.replace("3600000", "60000")
    cut = minute[: minute.index("\nb AS")].rstrip(",")
    rolled = "SELECT symbol, idx // {n} AS idx, first(open ORDER BY idx) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY idx) AS close, sum(volume) AS volume{more} FROM r GROUP BY symbol, idx // {n}"
    out = {
        "bars_event_hours": f"WITH {EVENT_BARS} SELECT symbol, idx, {ohlc} FROM r",
        "bars_dense_spine": f"WITH {EVENT_BARS} SELECT symbol, idx, {ohlc} FROM b",
        "bars_rollup_best_effort": f"WITH {cut}, q AS ({rolled.format(n=60, more='')}) SELECT symbol, idx, {ohlc} FROM q",
        "bars_rollup_carry_forward": f"WITH {EVENT_BARS}, c AS (SELECT *, last_value(close IGNORE NULLS) OVER ({BY}) AS pc FROM b) SELECT symbol, idx, " + ", ".join(f"round(coalesce({x}, pc), 6) AS {x}" for x in ("open", "high", "low", "close")) + ", round(coalesce(volume, 0), 6) AS volume FROM c",
        "bars_rollup_strict": f"WITH {EVENT_BARS}, q AS ({rolled.format(n=4, more=', count(*) AS n')}) SELECT symbol, idx, {ohlc} FROM q WHERE n = 4",
        "bars_gap_ranges": f"WITH {EVENT_BARS}, n AS (SELECT symbol, idx, lead(idx) OVER ({BY}) AS nxt FROM r) SELECT symbol, idx + 1 AS start_idx, nxt AS end_idx FROM n WHERE nxt > idx + 1",
        "bars_bounds": f"WITH {EVENT_BARS} SELECT symbol, min(idx) AS min_idx, max(idx) AS max_idx FROM r GROUP BY symbol",
        "bars_daily_counts": "SELECT event_type AS symbol, epoch_ms(ts) // 86400000 AS day, count(DISTINCT epoch_ms(ts) // 60000) AS minutes FROM events GROUP BY ALL",
        "bars_target_slice": f"WITH {EVENT_BARS} SELECT symbol, idx, {ohlc} FROM r WHERE (idx + 1) * 3600000 >= 1704326400000 AND (idx + 1) * 3600000 < 1704672000000",
        "bars_latest_per_key": "SELECT user_id, event_type, event_id, round(value, 6) AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1",
        "bars_market_days": """WITH t AS (SELECT l_returnflag AS symbol, epoch_ms(l_shipdate) // 86400000 AS idx, l_extendedprice / l_quantity AS p, l_quantity AS v, l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem)
SELECT symbol, idx, round(first(p ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice), 8) AS open, round(max(p), 8) AS high, round(min(p), 8) AS low,
       round(last(p ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice), 8) AS close, round(sum(v), 8) AS volume FROM t GROUP BY ALL""",
        "bars_order_days": """SELECT o_orderpriority AS symbol, epoch_ms(o_orderdate) // 86400000 AS idx, round(first(o_totalprice ORDER BY o_orderdate, o_orderkey), 6) AS open, round(max(o_totalprice), 6) AS high,
       round(min(o_totalprice), 6) AS low, round(last(o_totalprice ORDER BY o_orderdate, o_orderkey), 6) AS close, count(*)::DOUBLE AS volume FROM orders GROUP BY ALL""",
        "bars_gap_days": """WITH c AS (SELECT event_type AS symbol, epoch_ms(ts) // 86400000 AS day, count(DISTINCT epoch_ms(ts) // 60000) AS minutes FROM events GROUP BY ALL),
d AS (SELECT symbol, unnest(generate_series(19723, 19752)) AS day FROM c GROUP BY symbol)
SELECT symbol, day, coalesce(minutes, 0) AS minutes, CAST(CASE day WHEN 19723 THEN 1380 WHEN 19752 THEN 720 ELSE 1440 END AS BIGINT) AS expected FROM d LEFT JOIN c USING (symbol, day) WHERE coalesce(minutes, 0) < expected""",
        "bars_new_rows": "SELECT user_id, event_type, event_id, round(value, 6) AS value FROM events e WHERE event_id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM events x WHERE x.event_id % 2 = 0 AND x.user_id = e.user_id AND x.event_type = e.event_type) QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1",
    }
    return out


def metrics_sql() -> dict[str, str]:
    """Figures that don't need a simulation: of buying and holding each symbol's bars."""
    held = f"{EVENT_BARS}, h AS (SELECT symbol, idx, close FROM r), p AS (SELECT *, max(close) OVER ({BY}) AS peak, lead(idx) OVER ({BY}) AS nxt FROM h), d AS (SELECT *, 1 - close / peak AS dd FROM p)"
    episodes = (
        f"e AS (SELECT *, dd > 1e-12 AS down, coalesce(lag(dd) OVER ({BY}), 0) > 1e-12 AS was FROM d), g AS (SELECT *, sum(CASE WHEN down AND NOT was THEN 1 ELSE 0 END) OVER ({BY}) AS episode FROM e), "
        "m AS (SELECT symbol, episode, (max(coalesce(nxt, idx)) - min(idx)) * 3600000 AS ms FROM g WHERE down GROUP BY ALL)"
    )
    days = f"{EVENT_BARS}, y AS (SELECT symbol, (idx + 1) * 3600000 // 86400000 AS day, last(close ORDER BY idx) AS close FROM r GROUP BY ALL), q AS (SELECT symbol, close / lag(close) OVER (PARTITION BY symbol ORDER BY day) - 1 AS r FROM y)"
    return {
        "metrics_benchmark": f"WITH {EVENT_BARS} SELECT symbol, round(100 * (last(close ORDER BY idx) / first(close ORDER BY idx) - 1), 4) AS benchmark_pct FROM r GROUP BY symbol",
        "metrics_drawdown": f"WITH {held}, {episodes} SELECT symbol, round(100 * max(dd), 4) AS max_drawdown_pct, round(100 * avg(dd), 4) AS avg_drawdown_pct, (SELECT max(ms) FROM m WHERE m.symbol = d.symbol)::BIGINT AS max_drawdown_ms, (SELECT sum(ms) // count(*) FROM m WHERE m.symbol = d.symbol)::BIGINT AS avg_drawdown_ms FROM d GROUP BY symbol",
        "metrics_ratios": f"WITH {days}, a AS (SELECT symbol, exp(avg(ln(1 + r)) * 365) - 1 AS year, stddev_samp(r) AS sd, sqrt(avg(least(r, 0) * least(r, 0))) AS down FROM q WHERE r IS NOT NULL GROUP BY symbol) SELECT symbol, round(year, 4) AS annual_return, round(year / (sd * sqrt(365)), 4) AS sharpe, round(year / (down * sqrt(365)), 4) AS sortino FROM a",
    }


def recursive_supertrend(n: int = 5, mult: float = 3.0) -> str:
    """Row by row over each symbol's bars."""
    s = atr(Steps(), n).add(mid="(high + low) * 0.5").add(ok="mid IS NOT NULL AND close IS NOT NULL AND atr IS NOT NULL", u=f"mid + {mult} * atr", l=f"mid - {mult} * atr")
    start = "close >= mid AS up, u AS upper, l AS lower"
    follow = """CASE WHEN NOT n.ok THEN NULL WHEN NOT p.ok THEN n.close >= n.mid WHEN p.up THEN n.close >= CASE WHEN n.l > p.lower OR p.close < p.lower THEN n.l ELSE p.lower END
      ELSE n.close > CASE WHEN n.u < p.upper OR p.close > p.upper THEN n.u ELSE p.upper END END AS up,
    CASE WHEN NOT n.ok OR NOT p.ok OR n.u < p.upper OR p.close > p.upper THEN n.u ELSE p.upper END AS upper,
    CASE WHEN NOT n.ok OR NOT p.ok OR n.l > p.lower OR p.close < p.lower THEN n.l ELSE p.lower END AS lower"""
    walk = f"walk AS (SELECT symbol, idx, ok, close, {start} FROM {s.name} WHERE idx = (SELECT min(idx) FROM r WHERE r.symbol = {s.name}.symbol) UNION ALL SELECT n.symbol, n.idx, n.ok, n.close, {follow} FROM walk p JOIN {s.name} n ON n.symbol = p.symbol AND n.idx = p.idx + 1)"
    return f"WITH RECURSIVE {', '.join(p.replace(f'{s.name} AS (', f'{s.name} AS MATERIALIZED (') if p.startswith(f'{s.name} AS') else p for p in s.parts)}, {walk} SELECT symbol, idx, round(CASE WHEN ok THEN CASE WHEN up THEN lower ELSE upper END END, 6) AS value FROM walk"


CARRIED = EVENT_BARS + f""",
c AS (SELECT symbol, idx, last_value(close IGNORE NULLS) OVER ({BY}) AS close FROM b)"""
#: How the registered queries fill orders: cash, fee, slippage.
CASH, FEE, SLIP = "1000.0", "0.00075", "0.0001"


def walk(s: str) -> str:
    """Accounts bar by bar: `s` is a table of symbol, variant, idx, close, signal, sl, tp; gives tables w, trades and equity."""
    d = lambda e, name: f"({e})::DOUBLE AS {name}"
    held, sold = "x_why IS NOT NULL", "qty * (c * (1 - side * {slip}))".format(slip=SLIP)
    names = "symbol, variant, rn, i, c, fin, free, side, fill, qty, quote, fee, eidx, prev, cnt, why, o_cnt, o_side, o_eidx, o_fill, o_exit, o_qty, o_quote, o_got, o_fee, o_xfee, o_gross"
    start = (
        f"SELECT DISTINCT symbol, variant, 0::BIGINT AS rn, 0::BIGINT AS i, 0::DOUBLE AS c, false AS fin, {d(CASH, 'free')}, 0 AS side, {', '.join(d('0', x) for x in ('fill', 'qty', 'quote', 'fee'))}, 0::BIGINT AS eidx, 0 AS prev, 0 AS cnt, "
        f"NULL::VARCHAR AS why, 0 AS o_cnt, 0 AS o_side, 0::BIGINT AS o_eidx, {', '.join(d('0', x) for x in ('o_fill', 'o_exit', 'o_qty', 'o_quote', 'o_got', 'o_fee', 'o_xfee', 'o_gross'))} FROM n"
    )
    one = """SELECT p.symbol, p.variant, n.rn, n.idx AS x_i, n.close AS c2, n.fin AS x_fin, n.signal AS g, p.free, p.side, p.fill, p.qty, p.quote, p.fee, p.eidx, p.prev, p.cnt,
    CASE WHEN p.side <> 0 AND p.side * (n.close - p.fill * (1 - p.side * n.sl)) <= 0 THEN 'sl' WHEN p.side <> 0 AND p.side * (n.close - p.fill * (1 + p.side * n.tp)) >= 0 THEN 'tp'
         WHEN p.side <> 0 AND n.signal <> p.side THEN 'signal_exit' END AS x_why FROM w p JOIN n ON n.symbol = p.symbol AND n.variant = p.variant AND n.rn = p.rn + 1"""
    two = f"SELECT *, {sold.replace('(c *', '(c2 *')} AS x_got FROM ({one})"
    three = f"SELECT *, side * (x_got - quote) AS x_gross, x_got * {FEE} AS x_fee FROM ({two})"
    four = f"SELECT *, CASE WHEN {held} THEN free + (quote + x_gross - x_fee) ELSE free END AS x_free FROM ({three})"
    five = f"SELECT *, (side = 0 OR {held}) AND g <> prev AND g <> 0 AND x_free > 0 AS x_in FROM ({four})"
    follow = (
        f"SELECT symbol, variant, rn, x_i, c2, x_fin, CASE WHEN x_in THEN x_free - (x_free + x_free * {FEE}) ELSE x_free END, CASE WHEN x_in THEN g WHEN {held} THEN 0 ELSE side END, CASE WHEN x_in THEN c2 * (1 + g * {SLIP}) ELSE fill END, "
        f"CASE WHEN x_in THEN x_free / (c2 * (1 + g * {SLIP})) ELSE qty END, CASE WHEN x_in THEN x_free ELSE quote END, CASE WHEN x_in THEN x_free * {FEE} ELSE fee END, CASE WHEN x_in THEN x_i ELSE eidx END, g, cnt + x_in::INT, "
        f"x_why, cnt, side, eidx, fill, c2 * (1 - side * {SLIP}), qty, quote, x_got, fee, x_fee, x_gross FROM ({five})"
    )
    record = "symbol, variant, {cnt} AS trade_id, CASE WHEN {side} > 0 THEN 'long' ELSE 'short' END AS direction, {eidx} AS entry_idx, i AS exit_idx, {fill} AS entry_fill, {exit} AS exit_fill, {qty} AS qty, {quote} AS entry_quote, {got} AS exit_quote, {fee} AS entry_fee, {xfee} AS exit_fee, {gross} AS gross_pnl, {gross} - {fee} - {xfee} AS net_pnl, 0.0::DOUBLE AS locked, {why} AS reason"
    done = record.format(**{x: f"o_{x}" for x in ("cnt", "side", "eidx", "fill", "exit", "qty", "quote", "got", "fee", "xfee", "gross")}, why="why")
    forced = record.format(**{x: x for x in ("cnt", "side", "eidx", "fill", "qty", "quote", "fee")}, exit=f"c * (1 - side * {SLIP})", got=sold, xfee=f"({sold}) * {FEE}", gross=f"side * ({sold} - quote)", why="'forced_close'")
    value = f"CASE WHEN side = 0 THEN free WHEN fin THEN free + (quote + side * ({sold} - quote) - ({sold}) * {FEE}) ELSE free + quote + side * (qty * c - quote) END"
    return f"""n AS MATERIALIZED (SELECT symbol, variant, idx, close, signal, sl, tp, row_number() OVER h AS rn, lead(idx) OVER h IS NULL AS fin FROM {s} WINDOW h AS (PARTITION BY symbol, variant ORDER BY idx)),
w({names}) AS ({start} UNION ALL {follow}),
trades AS (SELECT {done} FROM w WHERE why IS NOT NULL UNION ALL SELECT {forced} FROM w WHERE fin AND side <> 0),
e AS (SELECT symbol, variant, i AS idx, {value} AS equity, CASE WHEN side <> 0 THEN quote WHEN why IS NOT NULL THEN o_quote ELSE 0 END AS used FROM w WHERE rn > 0),
equity AS (SELECT symbol, variant, idx, equity, used > 0 AS in_position, CASE WHEN equity = 0 THEN 0 ELSE used / equity END AS exposure FROM e)"""


def simulation_sql() -> dict[str, str]:
    """Trades, equity and figures of the conjunction of two moving averages, with stops."""
    means = f"m AS (SELECT *, {agg('avg', 'close', 3)} AS a, {agg('avg', 'close', 6)} AS z FROM c)"
    crossing = f"s AS (SELECT symbol, 0::BIGINT AS variant, idx, close, {signal('close > a AND close > z', 'close < a AND close < z')} AS signal, 0.2 AS sl, 0.5 AS tp FROM m)"
    base = f"WITH RECURSIVE {CARRIED}, {means}, {crossing}, {walk('s')}"
    by = "PARTITION BY symbol, variant ORDER BY idx"
    r = lambda names, n: ", ".join(f"round({x}, {n}) AS {x}" for x in names)
    doubles = ("entry_fill", "exit_fill", "qty", "entry_quote", "exit_quote", "entry_fee", "exit_fee", "gross_pnl", "net_pnl", "locked")
    pct, ms = "100 * net_pnl / entry_quote", "(exit_idx - entry_idx) * 3600000"
    stats = (
        f"SELECT symbol, variant, count(*) AS num_trades, 100 * avg((net_pnl > 0)::DOUBLE) AS win_rate_pct, max({pct}) AS best_trade_pct, min({pct}) AS worst_trade_pct, avg({pct}) AS avg_trade_pct, max({ms})::BIGINT AS max_trade_ms, (sum({ms}) // count(*))::BIGINT AS avg_trade_ms, "
        f"avg({pct}) AS expectancy, sqrt(count(*)) * avg(net_pnl) / nullif(stddev_samp(net_pnl), 0) AS sqn, sum(greatest(net_pnl, 0)) / nullif(-sum(least(net_pnl, 0)), 0) AS profit_factor FROM trades GROUP BY symbol, variant"
    )
    stat_doubles = ("win_rate_pct", "best_trade_pct", "worst_trade_pct", "avg_trade_pct", "expectancy", "sqn", "profit_factor")
    report = f"""{base}, st AS ({stats}), p AS (SELECT *, max(equity) OVER ({by}) AS peak, coalesce(lead(idx) OVER ({by}), idx) AS nxt FROM equity), d AS (SELECT *, 1 - equity / nullif(peak, 0) AS dd FROM p),
q AS (SELECT *, dd > 1e-12 AS down, coalesce(lag(dd) OVER ({by}), 0) > 1e-12 AS was FROM d), g AS (SELECT *, sum((down AND NOT was)::INT) OVER ({by}) AS episode FROM q),
ep AS (SELECT symbol, variant, episode, (max(nxt) - min(idx)) * 3600000 AS ms FROM g WHERE down GROUP BY ALL), et AS (SELECT symbol, variant, max(ms)::BIGINT AS max_drawdown_ms, (sum(ms) // count(*))::BIGINT AS avg_drawdown_ms FROM ep GROUP BY ALL),
dep AS (SELECT symbol, variant, min(idx) AS first_idx, max(idx) AS last_idx, last(equity ORDER BY idx) AS final_equity, 100 * avg(in_position::DOUBLE) AS coverage_pct, avg(exposure) AS gross_exposure, 100 * max(dd) AS max_drawdown_pct, 100 * avg(dd) AS avg_drawdown_pct FROM d GROUP BY ALL),
y AS (SELECT symbol, variant, (idx + 1) * 3600000 // 86400000 AS day, last(equity ORDER BY idx) AS equity FROM equity GROUP BY ALL), yr AS (SELECT symbol, variant, equity / nullif(lag(equity) OVER (PARTITION BY symbol, variant ORDER BY day), 0) - 1 AS r FROM y),
ra AS (SELECT symbol, variant, CASE WHEN count(*) >= 2 AND min(r) > -1 THEN exp(avg(ln(1 + r)) * 365) - 1 END AS annual_return, stddev_samp(r) AS sd, sqrt(avg(least(r, 0) * least(r, 0))) AS lo FROM yr WHERE r IS NOT NULL GROUP BY ALL),
bm AS (SELECT symbol, variant, 100 * (last(close ORDER BY idx) / first(close ORDER BY idx) - 1) AS benchmark_pct FROM s WHERE close IS NOT NULL GROUP BY ALL),
al AS (SELECT *, final_equity - {CASH} AS total_profit, 100 * (final_equity - {CASH}) / {CASH} AS total_return_pct, annual_return / nullif(sd * sqrt(365), 0) AS sharpe, annual_return / nullif(lo * sqrt(365), 0) AS sortino, annual_return / nullif(max_drawdown_pct / 100, 0) AS calmar
  FROM dep LEFT JOIN bm USING (symbol, variant) LEFT JOIN et USING (symbol, variant) LEFT JOIN st USING (symbol, variant) LEFT JOIN ra USING (symbol, variant))
SELECT symbol, variant, first_idx, last_idx, coalesce(num_trades, 0) AS num_trades, max_trade_ms, avg_trade_ms, max_drawdown_ms, avg_drawdown_ms, round(total_return_pct / nullif(max_drawdown_pct, 0), 4) AS return_over_max_drawdown, """
    report += r(("final_equity", "coverage_pct", "gross_exposure", "total_profit", "total_return_pct", "benchmark_pct", "max_drawdown_pct", "avg_drawdown_pct", "annual_return", "sharpe", "sortino", "calmar", *stat_doubles), 4) + " FROM al"

    keys = "SELECT i * 2 + j AS variant, a, z, sha256('{{\"0:ma.sma\":{{\"window\":' || a || '}},\"1:momentum.roc\":{{\"window\":' || z || '}}}}') AS key, i, j FROM (VALUES (0, 3), (1, 5), (2, 8)) x(i, a), (VALUES (0, 2), (1, 4)) y(j, z)".replace("{{", "{").replace("}}", "}")
    roc = lambda n: f"close / nullif({lag('close', n)}, 0) - 1"
    values = f"m AS (SELECT *, {', '.join(f'{agg("avg", "close", n)} AS a{n}' for n in (3, 5, 8))}, {', '.join(f'{roc(n)} AS z{n}' for n in (2, 4))} FROM c), k AS ({keys}), "
    values += "v AS (SELECT symbol, idx, close, variant, CASE a WHEN 3 THEN a3 WHEN 5 THEN a5 ELSE a8 END AS a, CASE z WHEN 2 THEN z2 ELSE z4 END AS z FROM m, k)"
    plain = f"s AS (SELECT symbol, variant::BIGINT AS variant, idx, close, {signal('close > a AND z > 0', 'close < a AND z < 0')} AS signal, NULL::DOUBLE AS sl, NULL::DOUBLE AS tp FROM v)"
    total = f"f AS (SELECT symbol, variant, 100 * (last(equity ORDER BY idx) / {CASH} - 1) AS total_return_pct FROM equity GROUP BY ALL)"
    stage_a = f"{CARRIED}, {values}, {plain}, {walk('s')}, {total}, top AS (SELECT symbol, f.variant, key, total_return_pct FROM f JOIN k USING (variant) ORDER BY total_return_pct DESC NULLS LAST, key, symbol LIMIT 10)"
    best = f"WITH RECURSIVE {stage_a}"
    return {
        "exec_trades": f"{base} SELECT symbol, variant, trade_id::BIGINT AS trade_id, direction, entry_idx, exit_idx, {r(doubles, 6)}, reason FROM trades",
        "exec_equity": f"{base} SELECT symbol, variant, idx, round(equity, 6) AS equity, in_position, round(exposure, 6) AS exposure FROM equity",
        "metrics_trades": f"{base}, st AS ({stats}) SELECT symbol, variant, num_trades, max_trade_ms, avg_trade_ms, {r(stat_doubles, 4)} FROM st",
        "metrics_report": report,
        "search_grid": f"WITH k AS ({keys}) SELECT variant::BIGINT AS variant, key, 0 AS part, i AS point FROM k UNION ALL SELECT variant::BIGINT, key, 1, j FROM k",
        "search_stage_a_topk": f"{best} SELECT symbol, variant, key, round(total_return_pct, 4) AS total_return_pct FROM top",
        "search_stage_b_topk": risky_sql(values, plain, total),
    }


def risky_sql(values: str, plain: str, total: str) -> str:
    """Stage B: the five best of stage A, each with four pairs of stops. The walk comes twice, so the second one's tables are renamed."""
    import re

    first = f"{plain}, {walk('s')}, {total}, top AS (SELECT symbol, variant, key FROM f JOIN k USING (variant) ORDER BY total_return_pct DESC NULLS LAST, key, symbol LIMIT 5)"
    second = "s2 AS (SELECT s.symbol, s.variant * 4 + risk AS variant, idx, close, signal, x.sl, x.tp FROM s JOIN top USING (symbol, variant), (VALUES (0, NULL, NULL), (1, NULL, 0.3), (2, 0.1, NULL), (3, 0.1, 0.3)) x(risk, sl, tp))"
    again = re.sub(r"\b(n|w|trades|e|equity) AS\b(?= (?:MATERIALIZED )?\()", r"\g<1>2 AS", walk("s2")).replace("w(symbol", "w2(symbol")
    again = re.sub(r"\bFROM (n|w|e)\b", r"FROM \g<1>2", again).replace("JOIN n ON", "JOIN n2 n ON").replace("FROM w2 p", "FROM w2 p")
    last = total.replace("f AS", "f2 AS").replace("FROM equity", "FROM equity2")
    return f"WITH RECURSIVE {CARRIED}, {values}, {first}, {second}, {again}, {last} SELECT f2.symbol, f2.variant, key, (f2.variant % 4)::INT AS risk, round(total_return_pct, 4) AS total_return_pct FROM f2 JOIN top ON top.symbol = f2.symbol AND top.variant = f2.variant // 4 ORDER BY f2.total_return_pct DESC NULLS LAST, key, f2.symbol, risk LIMIT 8"


def recursive_psar() -> str:
    """Row by row over each symbol's bars: the stop, the extreme so far, and its speed."""
    start = "CASE WHEN ok THEN true END AS up, CASE WHEN ok THEN low END AS stop, CASE WHEN ok THEN high END AS best, 0.02::DOUBLE AS speed"
    one = "SELECT p.symbol, n.idx, n.ok, n.high, n.low, p.up, p.best, p.speed, p.ok AS was, CASE WHEN p.up THEN least(p.stop + p.speed * (p.best - p.stop), p.low) ELSE greatest(p.stop + p.speed * (p.best - p.stop), p.high) END AS x FROM walk p JOIN d n ON n.symbol = p.symbol AND n.idx = p.idx + 1"
    two = f"SELECT *, CASE WHEN up THEN low < x ELSE high > x END AS turn, CASE WHEN up THEN high > best ELSE low < best END AS more FROM ({one})"
    follow = (
        "SELECT symbol, idx, ok, high, low, CASE WHEN ok AND was THEN up <> turn WHEN ok THEN true END, CASE WHEN NOT ok THEN NULL WHEN NOT was THEN low WHEN turn THEN best ELSE x END, "
        "CASE WHEN NOT ok THEN NULL WHEN NOT was THEN high WHEN turn THEN CASE WHEN up THEN low ELSE high END WHEN more THEN CASE WHEN up THEN high ELSE low END ELSE best END, "
        f"CASE WHEN NOT was OR turn OR NOT ok THEN 0.02 WHEN more THEN least(0.2, speed + 0.02) ELSE speed END::DOUBLE FROM ({two})"
    )
    d = "d AS MATERIALIZED (SELECT symbol, idx, high, low, high IS NOT NULL AND low IS NOT NULL AS ok FROM b)"
    walk_ = f"walk AS (SELECT symbol, idx, ok, high, low, {start} FROM d WHERE idx = (SELECT min(idx) FROM r WHERE r.symbol = d.symbol) UNION ALL {follow})"
    return f"WITH RECURSIVE {EVENT_BARS}, {d}, {walk_} SELECT symbol, idx, round(stop, 6) AS value FROM walk"


def service_sql() -> dict[str, str]:
    from barloom.plans.queries import FIRST_MINUTE, NOW_MINUTE, RUN_MINUTES, RUN_WARMUP

    minutes = EVENT_BARS.replace("3600000", "60000")
    minutes = minutes[: minutes.index("\nb AS")].rstrip(",")
    return {
        "ref_upsert_changed": "SELECT CAST(c_custkey % 4 + 1 AS INTEGER) AS market_id, c_name AS symbol, 'DISABLED' AS status, CAST(c_mktsegment = 'BUILDING' AS INTEGER) AS is_tradable FROM customer WHERE c_acctbal < 0 UNION ALL SELECT CAST(s_suppkey % 4 + 1 AS INTEGER), s_name, 'ENABLED', 1 FROM supplier",
        "plan_backfill_tasks": f"""WITH b AS (SELECT event_type AS symbol, min(epoch_ms(ts) // 60000) AS lo FROM events WHERE event_type IS NOT NULL GROUP BY ALL)
SELECT * FROM (SELECT 1 AS market_id, symbol, 'historical_backfill' AS reason, {FIRST_MINUTE}::BIGINT AS start_minute, lo AS end_minute FROM b
UNION ALL SELECT 1, symbol, 'scheduler_tail', {NOW_MINUTE - 180}, {NOW_MINUTE} FROM b UNION ALL SELECT 2, n_name, 'bootstrap', {FIRST_MINUTE + 60}, {NOW_MINUTE} FROM nation) WHERE start_minute < end_minute""",
        "stream_gap_tracker": """WITH m AS (SELECT event_type AS symbol, epoch_ms(ts) // 60000 AS minute, event_id FROM events WHERE event_type IS NOT NULL AND ts IS NOT NULL),
p AS (SELECT *, max(minute) OVER (PARTITION BY symbol ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM m),
k AS (SELECT *, CASE WHEN last IS NULL OR minute = last + 1 THEN 'accepted' WHEN minute = last THEN 'duplicate' WHEN minute < last THEN 'out_of_order' ELSE 'gap' END AS kind FROM p)
SELECT symbol, kind, minute, CASE WHEN kind = 'gap' THEN last + 1 END AS start_minute, CASE WHEN kind = 'gap' THEN minute END AS end_minute FROM k""",
        "stream_raw_to_canonical": """SELECT event_type AS symbol, epoch_ms(ts) // 60000 AS minute, round(value, 6) AS close, event_id AS version FROM events WHERE event_type IS NOT NULL AND ts IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY event_type, epoch_ms(ts) // 60000 ORDER BY event_id DESC) = 1""",
        "join_asof": """WITH k AS (SELECT event_type, ts, max_by(value, event_id) AS known_value, max(event_id) AS known_id FROM events WHERE event_id % 7 = 0 AND event_type IS NOT NULL AND ts IS NOT NULL GROUP BY ALL)
SELECT event_id, e.event_type, round(known_value, 6) AS known_value, known_id FROM (SELECT * FROM events WHERE ts IS NOT NULL) e ASOF LEFT JOIN k ON e.event_type = k.event_type AND e.ts >= k.ts""",
        # live minutes are canonical ones, too, so a run goes on until the first day without any line
        "stream_live_runs": f"""WITH l AS (SELECT l_returnflag || '-' || (l_orderkey % 3) AS run_id, epoch_ms(l_shipdate) // 86400000 AS minute, l_linenumber = 1 AS live FROM lineitem WHERE l_shipdate IS NOT NULL AND l_returnflag IS NOT NULL AND l_orderkey IS NOT NULL),
a AS (SELECT run_id, min(minute) AS first FROM l WHERE live GROUP BY run_id),
g AS (SELECT run_id, first, minute, minute - row_number() OVER (PARTITION BY run_id ORDER BY minute) AS g FROM (SELECT DISTINCT run_id, minute FROM l) JOIN a USING (run_id) WHERE minute >= first),
h AS (SELECT run_id, first, max(minute) AS until FROM g WHERE g = first - 1 GROUP BY ALL),
n AS (SELECT run_id, first, until, minute, row_number() OVER (PARTITION BY run_id, minute) AS k FROM l JOIN h USING (run_id) WHERE live),
c AS (SELECT run_id, minute, lag(minute) OVER o AS before, greatest(0, (minute + 1) // {RUN_MINUTES} - (first + {RUN_MINUTES - 1}) // {RUN_MINUTES}) AS bars FROM n WHERE k = 1 AND minute <= until WINDOW o AS (PARTITION BY run_id ORDER BY minute)),
s AS (SELECT *, coalesce(lag(bars) OVER (PARTITION BY run_id ORDER BY minute), 0) AS bars_before FROM c),
e AS (SELECT run_id, max(minute) AS last FROM c GROUP BY run_id),
u AS (SELECT run_id, 'accepted' AS kind, minute, NULL::BIGINT AS start_minute, NULL::BIGINT AS end_minute, NULL::BIGINT AS attempt, NULL::BIGINT AS bars, NULL AS state FROM c
UNION ALL SELECT run_id, 'dropped', minute, NULL, NULL, NULL, NULL, NULL FROM n WHERE k > 1 AND minute <= until
UNION ALL SELECT run_id, 'repaired', minute, before + 1, minute, 1, NULL, NULL FROM c WHERE before < minute - 1
UNION ALL SELECT run_id, 'gave_up', minute, last + 1, minute, 2, NULL, NULL FROM n JOIN e USING (run_id) WHERE minute > until
UNION ALL SELECT run_id, 'bar', minute, NULL, NULL, NULL, bars, NULL FROM s WHERE bars > bars_before
UNION ALL SELECT run_id, 'state', NULL, NULL, NULL, NULL, NULL, 'warming_up' FROM a
UNION ALL SELECT run_id, 'state', min(minute), NULL, NULL, NULL, NULL, 'running' FROM s WHERE bars >= {RUN_WARMUP} GROUP BY run_id)
SELECT run_id, kind, minute, start_minute, end_minute, attempt, CAST(bars AS BIGINT) AS bars, state FROM u""",
        "stream_rollup": f"WITH {minutes} SELECT symbol, idx // 2 AS idx, round(first(open ORDER BY idx), 6) AS open, round(max(high), 6) AS high, round(min(low), 6) AS low, round(last(close ORDER BY idx), 6) AS close, round(sum(volume), 6) AS volume FROM r GROUP BY symbol, idx // 2 HAVING count(*) = 2",
    }


def oracle_sql() -> dict[str, str]:
    out = {f"ind_{i.replace('.', '_')}": s.value() for i, s in indicator_steps().items()}
    out["ind_trend_supertrend"], out["ind_trend_psar"] = recursive_supertrend(), recursive_psar()
    return out | signal_sql() | bars_sql() | metrics_sql() | simulation_sql() | service_sql()
