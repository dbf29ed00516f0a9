import pytest
from pyspark.sql import functions as F

from barloom.functions import scalars as S
from barloom.operators import bars

BAR = "symbol string, idx long, open double, high double, low double, close double, volume double"


def make(spark, closes, start=0, symbol="s"):
    return spark.createDataFrame([(symbol, start + i, c, c, c, c, 1.0) for i, c in enumerate(closes) if c is not None], BAR).select("symbol", "idx", "open", "high", "low", "close", "volume")


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_rollup_of_a_missing_minute(spark):
    closes = [100, 101, None, 103, 104, *range(200, 205), *range(300, 305), 999]
    out = bars.rollup_best_effort(make(spark, [None if c is None else float(c) for c in closes]), 5)
    out = bars.in_range(out, 0, 16 * 60_000, 5 * 60_000)
    assert rows(out, "idx", "open", "high", "low", "close", "volume") == [(0, 100, 104, 100, 104, 4), (1, 200, 204, 200, 204, 5), (2, 300, 304, 300, 304, 5)]


def test_range_end_excludes_a_bucket_that_closes_there(spark):
    out = bars.in_range(bars.rollup_best_effort(make(spark, [1.0] * 15), 5), 0, 15 * 60_000, 5 * 60_000)
    assert rows(out, "idx") == [(0,), (1,)]


def test_carry_forward(spark):
    closes = [*range(10, 15), *[None] * 5, *range(30, 35)]
    rolled = bars.rollup_best_effort(make(spark, [None if c is None else float(c) for c in closes]), 5)
    got = rows(bars.carry_forward(rolled), "idx", "open", "high", "low", "close", "volume")
    assert got == [(0, 10, 14, 10, 14, 5), (1, 14, 14, 14, 14, 0), (2, 30, 34, 30, 34, 5)]


def test_carry_forward_over_many_stretches(spark):
    b = make(spark, [1.0, None, None, None, None, None, None, None, None, 2.0, None, 3.0])
    assert rows(bars.carry_forward(b, size=2), "idx", "close") == rows(bars.carry_forward(b), "idx", "close")


def test_strict_rollup_needs_every_bar(spark):
    assert rows(bars.rollup_strict(make(spark, [1.0, 2.0, None, 4.0, 5.0, 6.0]), 3), "idx", "open", "close") == [(1, 4, 6)]


def test_rollup_skips_what_isn_t_finite(spark):
    t = spark.createDataFrame([("a", 1, float("nan")), ("a", 2, 5.0), ("a", 3, float("inf")), (None, 4, 1.0)], "s string, t long, p double")
    out = bars.rollup(t, F.floor(F.col("t") / 10), F.col("p"), F.lit(1.0), ["t"], F.col("s"))
    assert rows(out, "symbol", "open", "close", "volume") == [("a", 5, 5, 1)]


def test_dense_gaps_and_bounds(spark):
    b = make(spark, [1.0, None, None, 4.0, None, 6.0])
    assert rows(bars.dense(b), "idx") == [(i,) for i in range(6)]
    assert rows(bars.gap_ranges(b), "start_idx", "end_idx") == [(1, 3), (4, 5)]
    assert rows(bars.bounds(b), "min_idx", "max_idx") == [(0, 5)]
    assert rows(bars.bounds(b, 5), "max_idx") == [(3,)]


def test_target_slice_goes_by_closing_time(spark):
    m, b = 60_000, make(spark, [1.0] * 4)
    assert rows(bars.target_slice(b, int(9.5 * m), 17 * m, 5 * m), "idx") == [(1,), (2,)]


def test_load_range():
    h = 3_600_000
    start, end = bars.load_range(10 * h + 2 * 60_000 + 30_123, 10 * h + 33 * 60_000 + 5_001, 5 * 60_000, 2)
    assert (start, end) == (9 * h + 52 * 60_000, 10 * h + 34 * 60_000)


def test_latest_and_new_rows(spark):
    d = spark.createDataFrame([(1, 1, "old"), (1, 2, "new"), (2, 1, "x"), (2, 1, "x")], "k int, v int, t string")
    assert rows(bars.latest_per_key(d, ["k"], ["v", "t"]), "k", "t") == [(1, "new"), (2, "x")]
    assert rows(bars.new_rows(d, d.where("k = 2"), ["k"], ["v"]), "k", "t") == [(1, "new")]


def test_daily_counts_and_gap_days(spark):
    t = spark.createDataFrame([("s", m * 60_000 + 5) for m in range(1440)] + [("s", 1440 * 60_000)], "s string, ms long")
    counts = bars.daily_counts(t, F.col("s"), F.col("ms"))
    assert rows(counts, "day", "minutes") == [(0, 1440), (1, 1)]
    assert rows(bars.gap_days(counts, 0, 1440 + 30), "day", "minutes", "expected") == [(1, 1, 30)]


def test_day_slices():
    day = 86_400_000
    assert bars.day_slices(day // 2, 9 * day) == [(day // 2, 7 * day), (7 * day, 9 * day)]


def test_valid_candles(spark):
    cols = "ts_open int, ts_close int, open double, high double, low double, close double, volume_base double, volume_quote double"
    d = spark.createDataFrame([(0, 1, 1.0, 2.0, 1.0, 2.0, 0.0, None), (1, 1, 1.0, 2.0, 1.0, 2.0, 0.0, None), (0, 1, 1.0, 1.5, 1.0, 2.0, 0.0, None), (0, 1, 1.0, 2.0, 1.0, 2.0, -1.0, None)], cols)
    assert bars.valid_candles(d).count() == 1


def test_scalars(spark):
    d = spark.range(12)
    got = d.select("id", *(c.alias(n) for c, n in zip(S.decode_radix(F.col("id"), [2, 3, 2]), "abc", strict=True))).collect()
    assert all(S.encode_radix((r["a"], r["b"], r["c"]), [2, 3, 2]) == r["id"] for r in got)
    r = spark.range(1).select(S.minute_floor(F.lit(-1)).alias("f"), S.minute_ceil(F.lit(60_001)).alias("c"), S.bucket_close(F.lit(7), 5).alias("b"), S.div(F.lit(1.0), F.lit(0.0)).alias("d"), S.nan_to_zero(F.lit(float("nan"))).alias("z"), S.zero_to_null(F.lit(0.0)).alias("n"), S.instrument_key(F.lit("Binance"), F.lit("spot "), F.lit(" btc")).alias("k")).first()
    assert tuple(r) == (-60_000, 120_000, 10, None, 0.0, None, "binance:spot:BTC")
    assert S.float_range("0.1", "0.3", "0.1") == [0.1, 0.2, 0.3]
    assert S.variant_key({"b": 1, "a": "é"}, False) != S.variant_key({"b": 1, "a": "é"}, True)
    with pytest.raises(ValueError):
        S.float_range("0", "1", "0")
    with pytest.raises(ValueError):
        S.timeframe_ms("2m")


def test_a_target_range_reaches_the_scan(spark, tmp_path):
    """Bars that close in a range are the same from its rows alone, whatever kind of timestamp they have, and bounds on it are pushed down."""
    from barloom.functions.scalars import epoch_ms

    for kind in ("timestamp", "timestamp_ntz"):
        df = spark.range(3000).selectExpr("'a' AS s", "timestamp_millis(id * 1700) AS t0", "id * 1.0D AS v").withColumn("t", F.col("t0").cast(kind)).drop("t0")
        df.write.parquet(f"{tmp_path}/{kind}")
        df = spark.read.parquet(f"{tmp_path}/{kind}")
        rolled = lambda d: bars.rollup(d, F.floor(epoch_ms("t") / 60_000), F.col("v"), F.lit(1.0), ["t"], F.col("s"))
        for start, end in ((600_000, 1_200_000), (600_001, 1_200_001), (599_999, 1_199_999), (0, 60_000)):
            part = bars.rows_of(df, "t", start, end, 60_000)
            assert rows(bars.target_slice(rolled(part), start, end, 60_000), "idx", "open", "volume") == rows(bars.target_slice(rolled(df), start, end, 60_000), "idx", "open", "volume")
            assert rolled(part).count() == bars.target_slice(rolled(df), start, end, 60_000).count()
        assert "GreaterThanOrEqual(t," in part._jdf.queryExecution().executedPlan().toString()


def test_trades_that_the_order_leaves_equal_go_by_their_place_in_the_file(spark, tmp_path):
    t = spark.createDataFrame([("a", 1, 7, 5.0), ("a", 1, 7, 3.0), ("a", 1, 7, 9.0), ("b", 2, 1, 4.0), ("b", 3, 1, 8.0), ("b", 3, 1, 6.0)], "s string, t long, id long, p double")
    t.coalesce(1).write.parquet(f"{tmp_path}/t")
    t = bars.placed(spark.read.parquet(f"{tmp_path}/t"))
    for given in (t, t.repartition(3, "p"), t.orderBy(F.desc("_row")), t.orderBy("_row")):
        out = bars.rollup(given, F.floor(F.col("t") / 10), F.col("p"), F.lit(1.0), ["t", "id"], F.col("s"))
        assert rows(out, "symbol", "open", "high", "low", "close") == [("a", 5, 9, 3, 5), ("b", 4, 8, 4, 8)]


def test_bars_of_events_with_equal_times_and_numbers_match_their_sql(spark, tmp_path):
    import duckdb

    from barloom.plans import oracle, queries

    t = spark.range(600).selectExpr("id div 3 AS event_id", "timestamp_millis(1704067200000 + id div 3 * 600000) AS ts", "id AS user_id", "'a' AS event_type", "id * 7 % 11 + 0.5D AS value")
    t.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute("SET threads = 1")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    for name in ("bars_event_hours", "bars_rollup_best_effort", "ind_candle_body"):
        assert sorted(map(tuple, queries.queries()[name](spark, str(tmp_path)).collect())) == sorted(con.execute(oracle.oracle_sql()[name]).fetchall())


def test_halves_round_as_in_sql(spark):
    import duckdb

    given = [0.6928125, 0.69281249999999999, -0.6928125, 1.0000005, 2.5e-7, 1e300, 0.1 + 0.2, None, *(k / 1600 for k in range(1, 1600, 2)), *(k * 0.0000005 for k in range(1, 2000, 2))]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(given)], "i int, x double").orderBy("i").select(S.rounded("x", 6)).collect()]
    assert got == [duckdb.execute("SELECT round(?::DOUBLE, 6)", [x]).fetchone()[0] for x in given]


def test_asof_values_of_equal_times_and_numbers_match_their_sql(spark, tmp_path):
    import duckdb

    from barloom.plans import oracle, queries

    t = spark.range(200).selectExpr("id div 4 AS event_id", "timestamp_millis(1704067200000 + id div 4 * 60000) AS ts", "'a' AS event_type", "id * 7 % 11 + 0.5D AS value")
    t.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, queries.asof_values(spark, str(tmp_path)).collect()), key=key) == sorted(con.execute(oracle.oracle_sql()["join_asof"]).fetchall(), key=key)


def test_trades_that_the_order_leaves_equal_go_by_their_file_before_their_row(spark, tmp_path):
    import duckdb

    from barloom.plans import oracle, queries

    at = tmp_path / "a table" / "events.parquet"
    at.mkdir(parents=True)
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute("SET threads = 1")
    # the hour's last time and number stand in the last row of one file and the first row of the next
    con.execute("CREATE TABLE t AS SELECT i - i // 6 AS event_id, TIMESTAMP '2024-01-01' + to_seconds(600 * (i - i // 6)) AS ts, i AS user_id, 'a' AS event_type, (i * 7 % 11 + 0.5)::DOUBLE AS value FROM range(12) r(i)")
    for k in range(2):
        con.execute(f"COPY (SELECT * FROM t WHERE user_id // 6 = {k} ORDER BY user_id) TO '{at}/part-{k}.parquet'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{at}/*.parquet'")
    assert con.execute("SELECT count(*) - count(DISTINCT (ts, event_id)) FROM events").fetchone() == (1,)
    for name in ("bars_event_hours", "bars_rollup_best_effort", "flagship", "ind_candle_body"):
        assert sorted(map(tuple, queries.queries()[name](spark, str(at.parent)).collect())) == sorted(con.execute(oracle.oracle_sql()[name]).fetchall()), name
