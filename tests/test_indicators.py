"""Edge rules of the indicators on literal rows."""

import datetime

import pytest

from tidemark.functions import indicators as ind
from tidemark.operators import asof, bars


def make(spark, closes, symbol="A"):
    day = datetime.date(2024, 1, 1)
    rows = [(symbol, day + datetime.timedelta(days=i), c, c, c, c, 100.0 + i) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "symbol string, ts date, open double, high double, low double, close double, volume double")


def column(df, name):
    return [r[name] for r in df.orderBy("ts").collect()]


def test_short_series_is_null(spark):
    b = make(spark, [1.0, 2.0, 3.0])
    for f, name in ((ind.rsi, "rsi"), (ind.atr, "atr"), (lambda d: ind.sma(d, 20), "sma20"), (ind.bollinger, "bb_pct")):
        assert column(f(b), name) == [None] * 3
    assert ind.snapshot(b).count() == 0


def test_constant_price(spark):
    b = make(spark, [5.0] * 40)
    assert set(column(ind.rsi(b), "rsi")) == {None}  # no bar lost
    assert column(ind.bollinger(b), "bb_pct")[-1] is None  # no width
    assert column(ind.candles(b), "candle")[-1] == "FLAT"
    assert column(ind.obv(b), "obv")[-1] == 0


def test_zero_price_has_no_change(spark):
    assert column(ind.pct_change(make(spark, [0.0, 4.0, 5.0]), 1), "pct1") == [None, None, 25.0]


def test_ema_is_seeded_with_the_first_value(spark):
    got = column(ind.macd(make(spark, [float(i * i % 7) for i in range(40)]), need=1), "macd")
    f = s = None
    for g, c in zip(got, [float(i * i % 7) for i in range(40)]):
        f = c if f is None else 2 / 13 * c + 11 / 13 * f
        s = c if s is None else 2 / 27 * c + 25 / 27 * s
        assert g == pytest.approx(f - s)


def test_asof_counts_the_same_day_both_ways(spark):
    b = make(spark, [1.0, 2.0, 3.0])
    e = spark.createDataFrame([("A", datetime.date(2024, 1, 2), 1), ("A", datetime.date(2023, 12, 1), 2), ("A", datetime.date(2024, 2, 1), 3), ("B", datetime.date(2024, 1, 1), 4)], "symbol string, ts date, id int")
    forward = {r.id: (r.price, r.match) for r in asof.asof_forward(e, b).collect()}
    assert forward == {1: (2.0, "exact"), 2: (None, "failed"), 3: (None, "failed"), 4: (None, "failed")}
    assert {r.id: r.price for r in asof.asof_backward(e, b).collect()} == {1: 2.0, 2: None, 3: 3.0, 4: None}


def test_bins_start_at_local_midnight(spark):
    t = spark.createDataFrame([("A", datetime.datetime(2024, 1, 1, 15, 30), 1, 2.0), ("A", datetime.datetime(2024, 1, 1, 14, 30), 2, 3.0)], "symbol string, ts timestamp, id long, price double")
    got = sorted(r.ts for r in bars.resample(t, 4, "Asia/Seoul").collect())
    assert [x.hour for x in got] == [20, 0]


def test_closes_are_those_of_the_bars(spark, tmp_path):
    """Lines of equal keys, days and symbols that are null, and prices that are."""
    from tidemark.plans.tables import daily_bars, daily_closes

    day = [datetime.datetime(2024, 1, d) for d in (1, 2)]
    rows = [(s, t, o, n, p, x, 2.0 if x != 7.0 else 0.0) for s in (1, None) for t in (*day, None) for o in (1, 1, 2) for n in (1, None) for p in (3, 4) for x in (5.0, 6.0, 7.0, None)]
    names = "l_suppkey long, l_shipdate timestamp, l_orderkey long, l_linenumber int, l_partkey long, l_extendedprice double, l_quantity double"
    spark.createDataFrame(rows[: len(rows) // 2 + 40], names).where("l_quantity > 0").write.parquet(f"{tmp_path}/lineitem.parquet")
    key = lambda r: (r.symbol or 0, str(r.ts), r.close)
    got, want = (sorted(map(key, f(spark, str(tmp_path)).collect())) for f in (daily_closes, daily_bars))
    assert got == want and len(got) > 3


def test_lags_come_with_the_bar(spark):
    """A bar without a close counts as a place, one after the last bar doesn't, and events aren't shuffled again for each lag."""
    start = datetime.date(2024, 1, 1)
    at = lambda n: start + datetime.timedelta(days=n)
    bars = spark.createDataFrame([(1, at(k), c) for k, c in enumerate([1.0, 2.0, None, 4.0])], "symbol int, ts date, close double")
    events = spark.createDataFrame([(1, at(0), "a"), (1, at(1), "b"), (1, at(2), "c"), (2, at(0), "d")], "symbol int, ts date, id string")
    d = asof.event_forward(events, bars, [1, 2])
    assert {(r.id, r.lag, r.base, r.forward) for r in d.collect()} == {("a", 1, 1.0, 2.0), ("a", 2, 1.0, None), ("b", 1, 2.0, None), ("b", 2, 2.0, 4.0)}
    assert "Join" not in d._jdf.queryExecution().executedPlan().toString()
    back = asof.asof_backward(events, bars.withColumn("more", bars["close"] + 1), ["more"])
    assert {(r.id, r.price, r.more) for r in back.collect()} == {("a", 1.0, 2.0), ("b", 2.0, 3.0), ("c", 2.0, 3.0), ("d", None, None)}
