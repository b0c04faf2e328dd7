"""Queries over bars: indicators, as-of joins, relations; each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import indicators as ind
from tidemark.operators import asof, relations
from tidemark.operators import bars as bar_ops
from tidemark.plans.tables import daily_bars, daily_closes, neighbours, symbols, ticks, with_tables

BARS = with_tables("daily_bars")
O = "OVER (PARTITION BY symbol ORDER BY ts)"  # noqa: E741


def over(first: int, last: int = 0) -> str:
    stop = "CURRENT ROW" if last == 0 else f"{-last} PRECEDING"
    return f"OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {-first} PRECEDING AND {stop})"


def picked(df: DataFrame, *cols: str) -> DataFrame:
    """symbol, ts and the columns, doubles rounded to six places."""
    kinds = dict(df.dtypes)
    return df.select("symbol", "ts", *[F.round(c, 6).alias(c) if kinds[c] == "double" else F.col(c) for c in cols])


def full(value: str, n: int, of: str = "close") -> str:
    return f"CASE WHEN count({of}) {over(1 - n)} = {n} THEN {value} END"


QUERIES, SQL = {}, {}


def query(sql: str | None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


@query(f"{BARS} SELECT symbol, ts, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume FROM daily_bars")
def ohlcv_daily(spark, d):
    return picked(daily_bars(spark, d), "open", "high", "low", "close", "volume")


@query(f"""{with_tables('ticks')}, b AS (SELECT symbol, date_trunc('day', ts) + to_hours(CAST(floor(hour(ts) / 4) AS BIGINT) * 4) AS bin, ts, id, price FROM ticks),
    r AS (SELECT *, row_number() OVER (PARTITION BY symbol, bin ORDER BY ts, id) AS a, row_number() OVER (PARTITION BY symbol, bin ORDER BY ts DESC, id DESC) AS z FROM b)
    SELECT symbol, bin AS ts, max(CASE WHEN a = 1 THEN price END) AS open, max(price) AS high, min(price) AS low, max(CASE WHEN z = 1 THEN price END) AS close, count(*) AS volume
    FROM r GROUP BY symbol, bin""")
def resample_4h(spark, d):
    return bar_ops.resample(ticks(spark, d), 4)


@query(f"""{BARS}, w AS (SELECT symbol, ts, close, volume, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS n,
    lag(close, 1) {O} AS c1, lag(close, 5) {O} AS c5, lag(close, 20) {O} AS c20, avg(volume) {over(-20, -1)} AS v FROM daily_bars)
    SELECT symbol, ts, round(close, 6) AS close, round((close / c1 - 1) * 100, 6) AS change_1, round((close / c5 - 1) * 100, 6) AS change_5,
    round((close / c20 - 1) * 100, 6) AS change_20, round(volume / v, 6) AS volume_ratio FROM w WHERE n = 1""")
def latest_snapshot(spark, d):
    return picked(bar_ops.latest_snapshot(daily_bars(spark, d)), "close", "change_1", "change_5", "change_20", "volume_ratio")


@query(f"{BARS} SELECT symbol, ts, " + ", ".join(f"round({full(f'avg(close) {over(1 - n)}', n)}, 6) AS sma{n}" for n in (20, 60, 120)) + " FROM daily_bars")
def sma(spark, d):
    b = daily_bars(spark, d)
    for n in (20, 60, 120):
        b = ind.sma(b, n)
    return picked(b, "sma20", "sma60", "sma120")


@query(f"""{BARS}, x AS (SELECT symbol, ts, close - lag(close) {O} AS d FROM daily_bars),
    y AS (SELECT symbol, ts, count(d) {over(-13)} AS n, avg(greatest(d, 0.0)) {over(-13)} AS g, avg(greatest(-d, 0.0)) {over(-13)} AS l FROM
      (SELECT symbol, ts, d FROM x WHERE d IS NOT NULL) q)
    SELECT x.symbol, x.ts, round(CASE WHEN n = 14 AND l > 0 THEN 100 - 100 / (1 + g / l) END, 6) AS rsi FROM x LEFT JOIN y ON x.symbol = y.symbol AND x.ts = y.ts""")
def rsi14(spark, d):
    return picked(ind.rsi(daily_bars(spark, d)), "rsi")


@query(f"""WITH RECURSIVE {BARS[5:]}, s AS (SELECT symbol, ts, close, row_number() {O} AS k FROM daily_bars),
    e AS (SELECT symbol, ts, k, close AS f, close AS w FROM s WHERE k = 1 UNION ALL
      SELECT s.symbol, s.ts, s.k, 2.0 / 13 * s.close + 11.0 / 13 * e.f, 2.0 / 27 * s.close + 25.0 / 27 * e.w FROM e JOIN s ON s.symbol = e.symbol AND s.k = e.k + 1),
    m AS (SELECT symbol, ts, k, f - w AS m FROM e),
    g AS (SELECT symbol, ts, k, m, m AS g FROM m WHERE k = 1 UNION ALL SELECT m.symbol, m.ts, m.k, m.m, 0.2 * m.m + 0.8 * g.g FROM g JOIN m ON m.symbol = g.symbol AND m.k = g.k + 1)
    SELECT symbol, ts, round(CASE WHEN k >= 35 THEN m END, 6) AS macd, round(CASE WHEN k >= 35 THEN g END, 6) AS macd_signal, round(CASE WHEN k >= 35 THEN m - g END, 6) AS macd_hist FROM g""")
def macd(spark, d):
    return picked(ind.macd(daily_bars(spark, d)), "macd", "macd_signal", "macd_hist")


@query(f"""{BARS}, x AS (SELECT symbol, ts, CASE WHEN lag(close) {O} IS NOT NULL THEN greatest(high - low, abs(high - lag(close) {O}), abs(low - lag(close) {O})) END AS t FROM daily_bars)
    SELECT symbol, ts, round({full(f'avg(t) {over(-13)}', 14, 't')}, 6) AS atr FROM x""")
def atr14(spark, d):
    return picked(ind.atr(daily_bars(spark, d)), "atr")


@query(f"{BARS} SELECT symbol, ts, " + ", ".join(f"round((close - lag(close, {n}) {O}) / lag(close, {n}) {O} * 100, 6) AS pct{n}" for n in (1, 5, 20)) + " FROM daily_bars")
def pct_change(spark, d):
    b = daily_bars(spark, d)
    for n in (1, 5, 20):
        b = ind.pct_change(b, n)
    return picked(b, "pct1", "pct5", "pct20")


OBV = f"""{BARS}, s AS (SELECT symbol, ts, coalesce(sign(close - lag(close) {O}), 0) * volume AS s FROM daily_bars),
    o AS (SELECT symbol, ts, sum(s) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS obv FROM s),
    p AS (SELECT symbol, ts, obv, lag(obv, 19) {O} AS a, lag(obv, 4) {O} AS b FROM o)"""


@query(f"""{OBV} SELECT symbol, ts, obv,
    CASE WHEN a IS NULL THEN 'NO_DATA' WHEN a <> 0 AND (obv - a) / abs(a) > 0.05 THEN 'UP' WHEN a <> 0 AND (obv - a) / abs(a) < -0.05 THEN 'DOWN' ELSE 'FLAT' END AS obv_daily,
    CASE WHEN b IS NULL THEN 'NO_DATA' WHEN obv > b * 1.02 THEN 'UP' WHEN obv < b * 0.98 THEN 'DOWN' ELSE 'FLAT' END AS obv_4h,
    CASE WHEN b IS NULL THEN 'NO_DATA' WHEN obv > b THEN 'UP' WHEN obv < b THEN 'DOWN' ELSE 'FLAT' END AS obv_screen FROM p""")
def obv_trend(spark, d):
    return picked(ind.obv_trends(daily_bars(spark, d)), "obv", "obv_daily", "obv_4h", "obv_screen")


def bollinger_sql(dev: str, population: bool) -> str:
    label = """WHEN close > mid + 2 * s THEN 'ABOVE' WHEN close >= mid + 2 * s - 0.4 * s THEN 'NEAR_UPPER' WHEN close < mid - 2 * s THEN 'BELOW'
        WHEN close <= mid - 2 * s + 0.4 * s THEN 'NEAR_LOWER'""" if population else "WHEN close > mid + 2 * s THEN 'ABOVE' WHEN close < mid - 2 * s THEN 'BELOW'"
    return f"""{BARS}, x AS (SELECT symbol, ts, close, {full(f'avg(close) {over(-19)}', 20)} AS mid, {full(f'{dev}(close) {over(-19)}', 20)} AS s FROM daily_bars)
        SELECT symbol, ts, round(mid, 6) AS bb_mid, round(mid + 2 * s, 6) AS bb_up, round(mid - 2 * s, 6) AS bb_low,
        round(CASE WHEN s > 0 THEN (close - (mid - 2 * s)) / (4 * s) END, 6) AS bb_pct,
        CASE WHEN mid IS NULL THEN 'NO_DATA' {label} WHEN close >= mid THEN 'UPPER_HALF' ELSE 'LOWER_HALF' END AS bb_position FROM x"""


@query(bollinger_sql("stddev_pop", True))
def bollinger_pop(spark, d):
    return picked(ind.bollinger(daily_bars(spark, d)), "bb_mid", "bb_up", "bb_low", "bb_pct", "bb_position")


@query(bollinger_sql("stddev_samp", False))
def bollinger_sample(spark, d):
    return picked(ind.bollinger(daily_bars(spark, d), population=False), "bb_mid", "bb_up", "bb_low", "bb_pct", "bb_position")


PAST = "OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@query(f"""{BARS} SELECT symbol, ts, round({full(f'volume / avg(volume) {over(-19)}', 20, 'volume')}, 6) AS vr_20,
    round(CASE WHEN count(volume) {over(-20, -1)} = 20 THEN volume / avg(volume) {over(-20, -1)} END, 6) AS vr_prev20,
    round(CASE WHEN count(volume) {PAST} >= 5 THEN volume / avg(volume) {PAST} END, 6) AS vr_all,
    round(CASE WHEN count(volume) {over(-19)} >= 2 THEN volume / avg(volume) {over(-19)} END, 6) AS vr_upto20,
    round(volume / avg(volume) {over(-5, -1)}, 6) AS vr_prev5 FROM daily_bars""")
def volume_ratio_variants(spark, d):
    return picked(ind.volume_ratios(daily_bars(spark, d)), "vr_20", "vr_prev20", "vr_all", "vr_upto20", "vr_prev5")


@query(f"{BARS} SELECT symbol, ts, " + ", ".join(f"round({full(f'{f}({c}) {over(-19)}', 20)}, 6) AS {n}" for n, f, c in (("support", "min", "close"), ("resistance", "max", "close"), ("support_hl", "min", "low"), ("resistance_hl", "max", "high"))) + " FROM daily_bars")
def support_resistance(spark, d):
    return picked(ind.support_resistance(daily_bars(spark, d)), "support", "resistance", "support_hl", "resistance_hl")


@query(f"""{BARS}, x AS (SELECT symbol, ts, close AS c, {full(f'avg(close) {over(-19)}', 20)} AS a, {full(f'avg(close) {over(-59)}', 60)} AS b FROM daily_bars)
    SELECT symbol, ts, CASE WHEN a IS NULL OR b IS NULL THEN 'NO_DATA' WHEN c > a AND a > b THEN 'UP' WHEN c < a AND a < b THEN 'DOWN' ELSE 'MIXED' END AS trend_daily,
    CASE WHEN a IS NULL THEN 'NO_DATA' WHEN c > a * 1.02 THEN 'UP' WHEN c < a * 0.98 THEN 'DOWN' ELSE 'FLAT' END AS trend_4h FROM x""")
def trend_labels(spark, d):
    return picked(ind.trends(daily_bars(spark, d)), "trend_daily", "trend_4h")


@query(f"""{BARS}, x AS (SELECT symbol, ts, open AS o, close AS c, high - low AS s, abs(close - open) AS b, high - greatest(open, close) AS u, least(open, close) - low AS l FROM daily_bars)
    SELECT symbol, ts, CASE WHEN s <= 0 THEN 'FLAT' WHEN b / s < 0.1 THEN 'DOJI' WHEN b / s > 0.7 THEN CASE WHEN c > o THEN 'LONG_UP' ELSE 'LONG_DOWN' END
    WHEN l > 2 * b AND u < b THEN 'HAMMER' WHEN u > 2 * b AND l < b THEN 'SHOOTING' WHEN c > o THEN 'UP' ELSE 'DOWN' END AS candle FROM x""")
def candle_labels(spark, d):
    return picked(ind.candles(daily_bars(spark, d)), "candle")


@query(f"{BARS} SELECT symbol, ts, round(avg(close * volume) {over(-19)}, 6) AS turnover FROM daily_bars")
def turnover20(spark, d):
    return picked(ind.turnover(daily_bars(spark, d)), "turnover")


@query(f"""{BARS} SELECT symbol, ts, round(CASE WHEN max(high) {over(-251)} > min(low) {over(-251)} THEN
    (close - min(low) {over(-251)}) / (max(high) {over(-251)} - min(low) {over(-251)}) * 100 END, 6) AS pos_52w FROM daily_bars""")
def position_52w(spark, d):
    return picked(ind.position_52w(daily_bars(spark, d)), "pos_52w")


@query(f"""{BARS}, g AS (SELECT symbol, median(gap) AS median_gap FROM (SELECT symbol, date_diff('second', CAST(lag(ts) {O} AS TIMESTAMP), CAST(ts AS TIMESTAMP)) AS gap FROM daily_bars) q GROUP BY symbol),
    x AS (SELECT symbol, ts, close / lag(close, 1) {O} AS a, close / lag(close, 4) {O} AS b, close / lag(close, 24) {O} AS c FROM daily_bars)
    SELECT x.symbol, ts, round(median_gap, 6) AS median_gap, round(CASE WHEN median_gap < 72000 THEN (b - 1) * 100 END, 6) AS return_4h,
    round(CASE WHEN median_gap >= 72000 THEN (a - 1) * 100 ELSE (c - 1) * 100 END, 6) AS return_1d FROM x JOIN g ON x.symbol = g.symbol""")
def returns_snapshot(spark, d):
    return picked(ind.returns_snapshot(daily_bars(spark, d)), "median_gap", "return_4h", "return_1d")


@query(f"""{BARS} SELECT symbol, ts, round(CASE WHEN symbol IN (1, 2, 3) THEN (close - lag(close) {O}) * 100 ELSE (close / lag(close) {O} - 1) * 100 END, 6) AS change FROM daily_bars""")
def macro_change(spark, d):
    return picked(ind.macro_change(daily_bars(spark, d), [1, 2, 3]), "change")


@query(f"""{BARS}, c AS (SELECT *, close - lag(close) {O} AS dd, lag(close) {O} AS pc, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS n FROM daily_bars),
    k AS (SELECT *, CASE WHEN pc IS NOT NULL THEN greatest(high - low, abs(high - pc), abs(low - pc)) END AS t, greatest(dd, 0.0) AS up, greatest(-dd, 0.0) AS dn, coalesce(sign(dd), 0) * volume AS sv FROM c),
    o AS (SELECT *, sum(sv) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS obv FROM k),
    s AS (SELECT symbol, ts, n, close, dd, pc, volume, obv, lag(obv, 4) {O} AS ob,
      CASE WHEN count(dd) {over(-13)} = 14 AND avg(CASE WHEN dd IS NOT NULL THEN dn END) {over(-13)} > 0 THEN 100 - 100 / (1 + avg(CASE WHEN dd IS NOT NULL THEN up END) {over(-13)} / avg(CASE WHEN dd IS NOT NULL THEN dn END) {over(-13)}) END AS rsi,
      {full(f'avg(t) {over(-13)}', 14, 't')} AS atr, {full(f'avg(close) {over(-19)}', 20)} AS mid, {full(f'stddev_samp(close) {over(-19)}', 20)} AS sd,
      CASE WHEN count(volume) {over(-20, -1)} = 20 THEN volume / avg(volume) {over(-20, -1)} END AS vr, avg(close * volume) {over(-19)} AS turnover FROM o)
    SELECT symbol, ts, round(close, 6) AS close, round(rsi, 6) AS rsi, CASE WHEN ob IS NULL THEN 'NO_DATA' WHEN obv > ob THEN 'UP' WHEN obv < ob THEN 'DOWN' ELSE 'FLAT' END AS obv_screen,
      round(CASE WHEN sd > 0 THEN (close - mid + 2 * sd) / (4 * sd) END, 6) AS bb_pct, round(vr, 6) AS volume_ratio, round(dd / pc * 100, 6) AS pct1, round(atr, 6) AS atr, round(turnover, 6) AS turnover
    FROM s WHERE n = 1""")
def screen_snapshot(spark, d):
    return picked(ind.screen(daily_bars(spark, d)), "close", "rsi", "obv_screen", "bb_pct", "volume_ratio", "pct1", "atr", "turnover")


@query(None)
def snapshot_daily(spark, d):
    """Composition of the indicators above, each of which has its own SQL."""
    s = ind.snapshot(daily_bars(spark, d))
    return picked(s, *[c for c in s.columns if c not in ("symbol", "ts")])


MOVERS = f"""{with_tables('symbols', 'daily_bars')}, x AS (SELECT symbol, ts, close, (close - lag(close) {O}) / lag(close) {O} * 100 AS r,
    CASE WHEN count(volume) {over(-20, -1)} = 20 THEN volume / avg(volume) {over(-20, -1)} END AS v, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS n FROM daily_bars),
    movers AS (SELECT x.symbol, name, sector, market, close, r AS return_pct, v AS volume_ratio, CASE WHEN r > 0 THEN 'UP' ELSE 'DOWN' END AS direction
      FROM x JOIN symbols ON x.symbol = symbols.symbol WHERE n = 1 AND abs(r) >= CASE WHEN market = 'KR' THEN 5.0 ELSE 4.0 END)"""


@query(f"{MOVERS} SELECT symbol, name, sector, market, direction, round(close, 6) AS close, round(return_pct, 6) AS return_pct, round(volume_ratio, 6) AS volume_ratio FROM movers")
def movers(spark, d):
    m = relations.movers(daily_bars(spark, d), symbols(spark, d))
    return m.select("symbol", "name", "sector", "market", "direction", *[F.round(c, 6).alias(c) for c in ("close", "return_pct", "volume_ratio")])


EVENTS = "ev AS (SELECT o_orderkey AS id, o_custkey % (SELECT count(*) FROM supplier) AS symbol, CAST(o_orderdate AS DATE) AS ts FROM orders)"


def order_events(spark, d) -> DataFrame:
    from tidemark.plans.tables import signals

    return signals(spark, d).select("id", "symbol", F.col("created_at").alias("ts"))


@query(f"""{BARS}, {EVENTS}, j AS (SELECT ev.id, ev.symbol, ev.ts, min(b.ts) AS price_ts FROM ev LEFT JOIN daily_bars b ON b.symbol = ev.symbol AND b.ts >= ev.ts AND b.ts <= ev.ts + 8 GROUP BY ev.id, ev.symbol, ev.ts)
    SELECT j.id, j.symbol, j.ts, round(b.close, 6) AS price, j.price_ts, CASE WHEN j.price_ts = j.ts THEN 'exact' WHEN j.price_ts IS NOT NULL THEN 'nearest' ELSE 'failed' END AS match
    FROM j LEFT JOIN daily_bars b ON b.symbol = j.symbol AND b.ts = j.price_ts""")
def asof_forward_close(spark, d):
    return asof.asof_forward(order_events(spark, d), daily_bars(spark, d)).withColumn("price", F.round("price", 6))


@query(f"""{BARS}, {EVENTS}, j AS (SELECT ev.id, ev.symbol, ev.ts, max(b.ts) AS price_ts FROM ev LEFT JOIN daily_bars b ON b.symbol = ev.symbol AND b.ts <= ev.ts GROUP BY ev.id, ev.symbol, ev.ts)
    SELECT j.id, j.symbol, j.ts, round(b.close, 6) AS price, j.price_ts FROM j LEFT JOIN daily_bars b ON b.symbol = j.symbol AND b.ts = j.price_ts""")
def asof_backward_close(spark, d):
    return asof.asof_backward(order_events(spark, d), daily_bars(spark, d)).withColumn("price", F.round("price", 6))


CORR = f"""{with_tables('symbols', 'daily_bars', 'neighbours')}, r AS (SELECT symbol, ts, (close - lag(close) {O}) / lag(close) {O} * 100 AS r FROM daily_bars),
    corrs AS (SELECT source, target, corr(a.r, b.r) AS correlation, count(*) AS n FROM neighbours JOIN r a ON a.symbol = source JOIN r b ON b.symbol = target AND b.ts = a.ts
      WHERE a.r IS NOT NULL AND b.r IS NOT NULL GROUP BY source, target)"""


@query(f"{CORR} SELECT source, target, round(correlation, 4) AS correlation, n FROM corrs")
def peer_correlation(spark, d):
    return relations.correlations(daily_closes(spark, d), neighbours(spark, d)).withColumn("correlation", F.round("correlation", 4))


@query(f"""{with_tables('symbols', 'daily_bars', 'neighbours')}, p AS (SELECT symbol, ts, close, row_number() {O} AS pos, (close - lag(close) {O}) / lag(close) {O} * 100 AS r FROM daily_bars),
    rr AS (SELECT p.symbol, p.ts, p.r, market, CASE WHEN market = 'KR' THEN 7.0 ELSE 5.0 END AS e, CASE WHEN market = 'KR' THEN 2.0 ELSE 1.5 END AS h FROM p JOIN symbols ON p.symbol = symbols.symbol WHERE r IS NOT NULL),
    shocks AS (SELECT symbol AS source, ts, CASE WHEN r > 0 THEN 'UP' ELSE 'DOWN' END AS move FROM rr WHERE abs(r) >= e),
    based AS (SELECT s.source, target, move, s.ts, min(b.ts) AS bts FROM shocks s JOIN neighbours g ON g.source = s.source JOIN daily_bars b ON b.symbol = target AND b.ts >= s.ts GROUP BY s.source, target, move, s.ts),
    lags AS (SELECT 1 AS lag UNION ALL SELECT 2 UNION ALL SELECT 3),
    fwd AS (SELECT d.source, d.target, d.move, lag, (q.close / p.close - 1) * 100 AS f FROM based d JOIN p ON p.symbol = target AND p.ts = bts CROSS JOIN lags JOIN p q ON q.symbol = target AND q.pos = p.pos + lag WHERE p.close > 0),
    st AS (SELECT source, target, move, lag, count(*) AS events, avg(CASE WHEN f >= h THEN 1.0 ELSE 0.0 END) AS up, avg(CASE WHEN f <= -h THEN 1.0 ELSE 0.0 END) AS dn, avg(f) AS mean_forward
      FROM fwd JOIN (SELECT symbol, CASE WHEN market = 'KR' THEN 2.0 ELSE 1.5 END AS h FROM symbols) m ON m.symbol = target GROUP BY source, target, move, lag),
    base AS (SELECT symbol, greatest(0.01, avg(CASE WHEN r >= h THEN 1.0 ELSE 0.0 END)) AS bu, greatest(0.01, avg(CASE WHEN r <= -h THEN 1.0 ELSE 0.0 END)) AS bd FROM rr GROUP BY symbol),
    lng AS (SELECT source, target, move, lag, events, mean_forward, 'UP' AS direction, up AS cond_prob, bu AS base_prob FROM st JOIN base ON symbol = target
      UNION ALL SELECT source, target, move, lag, events, mean_forward, 'DOWN', dn, bd FROM st JOIN base ON symbol = target),
    good AS (SELECT *, cond_prob / base_prob AS lift FROM lng WHERE events >= 5 AND cond_prob >= 0.5 AND cond_prob / base_prob >= 1.05),
    best AS (SELECT *, row_number() OVER (PARTITION BY source, target, move ORDER BY lift DESC, cond_prob DESC, events DESC, lag, direction) AS n FROM good)
    SELECT source, target, move || '_LEADS_' || direction AS relation, lag, events, round(cond_prob, 6) AS cond_prob, round(base_prob, 6) AS base_prob, round(lift, 6) AS lift, round(mean_forward, 4) AS mean_forward,
    CASE WHEN events >= 20 AND cond_prob >= 0.6 AND lift >= 1.3 THEN 'high' WHEN events >= 10 AND cond_prob >= 0.55 AND lift >= 1.15 THEN 'medium' ELSE 'low' END AS confidence FROM best WHERE n = 1""")
def leadlag_event_study(spark, d):
    r = relations.leadlag(daily_closes(spark, d), symbols(spark, d), neighbours(spark, d))
    return r.select("source", "target", "relation", "lag", "events", F.round("cond_prob", 6).alias("cond_prob"), F.round("base_prob", 6).alias("base_prob"), F.round("lift", 6).alias("lift"), F.round("mean_forward", 4).alias("mean_forward"), "confidence")


PAIRS = f"""{with_tables('symbols', 'daily_bars', 'neighbours')}, x AS (SELECT symbol, (close - lag(close) {O}) / lag(close) {O} * 100 AS r, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS n FROM daily_bars),
    mv AS (SELECT symbol, r FROM x WHERE n = 1), pr AS (SELECT source, target, a.r AS s, b.r AS t FROM neighbours JOIN mv a ON a.symbol = source JOIN mv b ON b.symbol = target)"""


def latest_moves(spark, d) -> DataFrame:
    return ind.snapshot(daily_bars(spark, d), need=1).select("symbol", F.col("pct1").alias("return_pct"))


@query(f"""{PAIRS} SELECT source, target, round(s, 6) AS source_return, round(t, 6) AS target_return, CASE WHEN s > 0 THEN CASE WHEN t >= 3 THEN 'ALREADY' WHEN t < -1 THEN 'MISMATCH' WHEN t <= 1 THEN 'NOT_YET' ELSE 'PARTIAL' END
    ELSE CASE WHEN t > 1 THEN 'MISMATCH' WHEN t >= -1 THEN 'WEAKNESS_NOT_YET' WHEN t <= -3 THEN 'ALREADY' ELSE 'PARTIAL' END END AS gap_class FROM pr WHERE s IS NOT NULL AND t IS NOT NULL""")
def gap_class(spark, d):
    m = latest_moves(spark, d)
    j = neighbours(spark, d).join(m.select(F.col("symbol").alias("source"), F.col("return_pct").alias("s")), "source").join(m.select(F.col("symbol").alias("target"), F.col("return_pct").alias("t")), "target").where("s is not null and t is not null")
    kind = relations.gap_class(F.when(F.col("s") > 0, "UP_LEADS_UP").otherwise("DOWN_LEADS_DOWN"), F.col("s"), F.col("t"), F.lit(None), F.col("t"))
    return j.select("source", "target", F.round("s", 6).alias("source_return"), F.round("t", 6).alias("target_return"), kind.alias("gap_class"))


@query(f"{PAIRS} SELECT source, target, round(s, 6) AS source_return, round(t, 6) AS target_return, round(abs(s) * 0.6 - abs(t), 6) AS gap FROM pr WHERE abs(s) * 0.6 - abs(t) >= 2.0")
def unpriced_targets(spark, d):
    u = relations.unpriced(latest_moves(spark, d), neighbours(spark, d))
    return u.select("source", "target", *[F.round(c, 6).alias(c) for c in ("source_return", "target_return", "gap")])


BARS_4H = f"""{with_tables('ticks')}, bk AS (SELECT symbol || '-' || (CAST(floor(price) AS BIGINT) % 30) AS symbol, ts, id, price FROM ticks), bb AS (SELECT *, time_bucket(INTERVAL 4 HOURS, ts) AS bin FROM bk),
    h4 AS (SELECT symbol, bin AS ts, arg_min(price, (epoch_us(ts), id)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (epoch_us(ts), id)) AS close, count(*) AS volume FROM bb GROUP BY symbol, bin)"""


@query(f"""{BARS_4H}, x0 AS (SELECT *, close - lag(close) {O} AS dd FROM h4), x1 AS (SELECT *, sum(coalesce(sign(dd), 0) * volume) OVER (PARTITION BY symbol ORDER BY ts) AS obv FROM x0),
    x AS (SELECT *, count(dd) {over(-13)} AS k, avg(CASE WHEN dd IS NOT NULL THEN greatest(dd, 0.0) END) {over(-13)} AS g, avg(CASE WHEN dd IS NOT NULL THEN greatest(-dd, 0.0) END) {over(-13)} AS l, lag(obv, 4) {O} AS near, count(*) {over(-19)} AS c20, avg(close) {over(-19)} AS m, stddev_samp(close) {over(-19)} AS s,
      CASE WHEN count(volume) {over(-20, -1)} = 20 THEN volume / avg(volume) {over(-20, -1)} END AS vr, min(low) {over(-19)} AS lo, max(high) {over(-19)} AS hi, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS n, count(*) OVER (PARTITION BY symbol) AS bars FROM x1)
    SELECT symbol, bars, round(CASE WHEN bars >= 6 THEN close END, 5) AS close, round(CASE WHEN bars >= 6 AND k = 14 AND l > 0 THEN 100 - 100 / (1 + g / l) END, 5) AS rsi, CASE WHEN bars < 6 OR near IS NULL THEN 'NO_DATA' WHEN obv > near * 1.02 THEN 'UP' WHEN obv < near * 0.98 THEN 'DOWN' ELSE 'FLAT' END AS obv,
      CASE WHEN bars < 6 OR c20 < 20 THEN 'NO_DATA' WHEN close > m + 2 * s THEN 'ABOVE' WHEN close < m - 2 * s THEN 'BELOW' WHEN close >= m THEN 'UPPER_HALF' ELSE 'LOWER_HALF' END AS bb_position, round(CASE WHEN bars >= 6 THEN vr END, 5) AS vr_prev20,
      CASE WHEN bars >= 6 THEN CASE WHEN high > low AND abs(close - open) / (high - low) > 0.7 THEN CASE WHEN close > open THEN 'STRONG_UP' ELSE 'STRONG_DOWN' END ELSE 'PLAIN' END END AS candle, round(CASE WHEN c20 = 20 THEN lo END, 5) AS support_hl, round(CASE WHEN c20 = 20 THEN hi END, 5) AS resistance_hl,
      CASE WHEN bars < 6 THEN 'TOO_FEW' WHEN bars < 20 THEN 'PARTIAL' WHEN close > m * 1.02 THEN 'UP' WHEN close < m * 0.98 THEN 'DOWN' ELSE 'FLAT' END AS trend FROM x WHERE n = 1""")
def snapshot_4h(spark, d):
    """Events dealt to several symbols a type, so that bars have gaps."""
    t = ticks(spark, d).withColumn("symbol", F.concat("symbol", F.lit("-"), (F.floor("price") % 30).cast("string")))
    s = ind.snapshot_4h(bar_ops.resample(t, 4))
    return s.select(*[F.round(c, 5).alias(c) if c in ("close", "rsi", "vr_prev20", "support_hl", "resistance_hl") else F.col(c) for c in s.columns])
