"""Queries of candidate scores, pair signals and evidence; each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import indicators as ind
from tidemark.operators import bars as bar_ops
from tidemark.operators import evidence, pairs, ranking, relations, review, scores
from tidemark.plans.market import CORR, O, full, over
from tidemark.plans.signals import HASHED, ITEMS, QUALITY, any_of, quality
from tidemark.plans.signals import BAD, GOOD
from tidemark.plans.tables import daily_bars, daily_closes, fundamentals, neighbours, raw_items, signals, symbols, ticks, with_tables
from tidemark.sources.shared import checkpointed

QUERIES, SQL = {}, {}


def query(sql: str | None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.select(*[F.round(c, 6).alias(c) if kinds[c] == "double" else F.col(c) for c in cols])


def rounded_sql(doubles: str, others: str = "symbol, side") -> str:
    return others + ", " + ", ".join(f"round({c}, 6) AS {c}" for c in doubles.split())


# ---- candidates: every symbol on either side, with a slow and a fast frame ----

def frame(bars: DataFrame, s: str) -> DataFrame:
    names = {"close": "close", "rsi": "rsi", "obv_screen": "obv", "bb_pct": "bb", "volume_ratio": "vr", "atr": "atr", "turnover": "turnover"}
    return ind.screen(ind.last_bars(bars, 60)).select("symbol", *[F.col(a).alias(f"{b}_{s}") for a, b in names.items()])


def frame_sql(table: str, s: str) -> str:
    gain, loss = (f"avg(CASE WHEN dd IS NOT NULL THEN {c} END) {over(-13)}" for c in ("up", "dn"))
    return f"""c{s} AS (SELECT *, close - lag(close) {O} AS dd, lag(close) {O} AS pc, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS n FROM {table}),
    k{s} AS (SELECT *, CASE WHEN pc IS NOT NULL THEN greatest(high - low, abs(high - pc), abs(low - pc)) END AS t, greatest(dd, 0.0) AS up, greatest(-dd, 0.0) AS dn, coalesce(sign(dd), 0) * volume AS sv FROM c{s}),
    o{s} AS (SELECT *, sum(sv) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS obv FROM k{s}),
    s{s} AS (SELECT symbol, n, close, obv, lag(obv, 4) {O} AS ob, CASE WHEN count(dd) {over(-13)} = 14 AND {loss} > 0 THEN 100 - 100 / (1 + {gain} / {loss}) END AS rsi,
      {full(f'avg(t) {over(-13)}', 14, 't')} AS atr, {full(f'avg(close) {over(-19)}', 20)} AS mid, {full(f'stddev_samp(close) {over(-19)}', 20)} AS sd,
      CASE WHEN count(volume) {over(-20, -1)} = 20 THEN volume / avg(volume) {over(-20, -1)} END AS vr, avg(close * volume) {over(-19)} AS turnover FROM o{s}),
    f{s} AS (SELECT symbol, close AS close_{s}, rsi AS rsi_{s}, CASE WHEN ob IS NULL THEN 'NO_DATA' WHEN obv > ob THEN 'UP' WHEN obv < ob THEN 'DOWN' ELSE 'FLAT' END AS obv_{s},
      CASE WHEN sd > 0 THEN (close - mid + 2 * sd) / (4 * sd) END AS bb_{s}, vr AS vr_{s}, atr AS atr_{s}, turnover AS turnover_{s} FROM s{s} WHERE n = 1)"""


def candidates(spark, d) -> DataFrame:
    """symbol, sector, market, side with both frames, valuation, sentiment (the
    share of LONG among its signals) and evidence (signals of the last 30 days)."""
    bars = daily_bars(spark, d)
    base = symbols(spark, d).withColumn("side", F.explode(F.array(F.lit("LONG"), F.lit("SHORT"))))
    value = fundamentals(spark, d).select("symbol", "pe", "pb", (F.col("pb") / F.col("pe") * 100).alias("roe"), (F.col("pb") * 10 - 25).alias("growth"), F.lit(None).cast("double").alias("margin"))
    sig = signals(spark, d)
    last = sig.agg(F.max("created_at").alias("last_day"))
    long, short = F.count_if(F.col("side") == "LONG"), F.count_if(F.col("side") == "SHORT")
    told = sig.join(F.broadcast(last)).groupBy("symbol").agg(
        F.when(long + short > 0, 100.0 * long / (long + short)).alias("sentiment"), F.count_if(F.datediff("last_day", "created_at") < 30).alias("recent"))
    c = base.join(frame(bar_ops.coarsen(bars, 3), "d"), "symbol", "left").join(frame(bars, "h"), "symbol", "left").join(value, "symbol", "left").join(told, "symbol", "left")
    n = F.coalesce("recent", F.lit(0))
    return c.withColumn("sentiment", F.coalesce("sentiment", F.lit(50.0))).withColumn("evidence", F.when(n >= 3, "DIRECT").when(n == 2, "SECTOR").when(n == 1, "WEAK").otherwise("REJECT"))


CAND = f"""{with_tables('symbols', 'daily_bars', 'fundamentals', 'signals')},
    slow_bars AS (SELECT symbol, max(ts) AS ts, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, sum(volume) AS volume FROM daily_bars GROUP BY symbol, date_diff('day', DATE '1970-01-01', ts) // 3),
    {frame_sql('slow_bars', 'd')}, {frame_sql('daily_bars', 'h')},
    told AS (SELECT symbol, CASE WHEN count(*) FILTER (side IN ('LONG', 'SHORT')) > 0 THEN 100.0 * count(*) FILTER (side = 'LONG') / count(*) FILTER (side IN ('LONG', 'SHORT')) END AS sentiment,
      count(*) FILTER ((SELECT max(created_at) FROM signals) - created_at < 30) AS recent FROM signals GROUP BY symbol),
    cand AS (SELECT y.symbol, y.sector, y.market, q.side, fd.* EXCLUDE (symbol), fh.* EXCLUDE (symbol), v.pe, v.pb, v.pb / v.pe * 100 AS roe, v.pb * 10 - 25 AS growth, CAST(NULL AS DOUBLE) AS margin,
      coalesce(told.sentiment, 50.0) AS sentiment, CASE WHEN recent >= 3 THEN 'DIRECT' WHEN recent = 2 THEN 'SECTOR' WHEN recent = 1 THEN 'WEAK' ELSE 'REJECT' END AS evidence
      FROM symbols y CROSS JOIN (SELECT unnest(['LONG', 'SHORT']) AS side) q LEFT JOIN fd ON fd.symbol = y.symbol LEFT JOIN fh ON fh.symbol = y.symbol LEFT JOIN fundamentals v ON v.symbol = y.symbol LEFT JOIN told ON told.symbol = y.symbol)"""


def case(group, otherwise=0) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {p}" for c, p in group) + f" ELSE {otherwise} END"


def rules_sql(rules, base=50, high=100) -> str:
    return f"greatest(0.0, least({high}.0, {base}.0 + " + " + ".join(case(g) for g in rules) + "))"


def sides(long: str, short: str) -> str:
    return f"CASE WHEN side = 'LONG' THEN {long} ELSE {short} END"


COMP = f"""{CAND}, cv AS (SELECT *, coalesce(vr_d, vr_h) AS vr, {sides('sentiment', '100 - sentiment')} AS own FROM cand),
    cs AS (SELECT *, {sides(rules_sql(scores.TECH_LONG_SLOW), rules_sql(scores.TECH_SHORT_SLOW))} AS slow, {sides(rules_sql(scores.TECH_LONG_FAST), rules_sql(scores.TECH_SHORT_FAST))} AS fast,
      {sides(rules_sql(scores.VALUE_LONG), rules_sql(scores.VALUE_SHORT))} AS value, CAST({sides(case(scores.VOLUME_LONG, 50), case(scores.VOLUME_SHORT, 50))} AS DOUBLE) AS volume_score,
      {sides(rules_sql(scores.RISK_LONG, 0, 30), rules_sql(scores.RISK_SHORT, 0, 30))} AS penalty FROM cv),
    comp AS (SELECT *, least(100.0, own * 0.6 + volume_score * 0.4) AS catalyst FROM cs),
    fin AS (SELECT *, greatest(0.0, least(CASE evidence WHEN 'REJECT' THEN 59.0 WHEN 'WEAK' THEN 69.0 WHEN 'SECTOR' THEN 74.0 ELSE 100.0 END, CASE WHEN side = 'LONG'
      THEN own * 0.2 + value * 0.2 + fast * 0.2 + slow * 0.15 + volume_score * 0.1 + catalyst * 0.1 + 2.5
      ELSE own * 0.25 + fast * 0.25 + slow * 0.2 + value * 0.1 + volume_score * 0.1 + catalyst * 0.1 END - penalty)) AS final FROM comp)"""


def scored(spark, d) -> DataFrame:
    return scores.final_score(scores.component_scores(candidates(spark, d)))


@query(f"{COMP} SELECT {rounded_sql('slow fast value volume_score catalyst penalty')} FROM comp")
def component_scores(spark, d):
    return rounded(scores.component_scores(candidates(spark, d)), "symbol", "side", "slow", "fast", "value", "volume_score", "catalyst", "penalty")


@query(f"{COMP} SELECT {rounded_sql('final', 'symbol, side, evidence')} FROM fin")
def candidate_final_score(spark, d):
    return rounded(scored(spark, d), "symbol", "side", "evidence", "final")


@query(f"""{COMP} SELECT symbol, side, CASE WHEN side = 'LONG' THEN CASE WHEN value >= 65 AND (pe < 15 OR pb < 1) THEN CASE WHEN slow >= 55 THEN 'VALUE_REBOUND' ELSE 'TURNAROUND' END
      WHEN fast >= 65 AND volume_score >= 65 AND (rsi_h IS NULL OR rsi_h BETWEEN 45 AND 65) THEN 'BREAKOUT' WHEN catalyst >= 60 THEN 'SECTOR_BENEFIT' ELSE 'VALUE_REBOUND' END
    ELSE CASE WHEN rsi_h > 70 AND fast >= 60 THEN CASE WHEN value >= 60 THEN 'OVERHEAT' ELSE 'DISTRIBUTION' END WHEN catalyst >= 60 THEN 'CATALYST' WHEN slow >= 60 AND fast >= 60 THEN 'BREAKDOWN' ELSE 'OVERHEAT' END END AS style FROM comp""")
def style_labels(spark, d):
    return scores.style(scores.component_scores(candidates(spark, d))).select("symbol", "side", "style")


ZONES = f"""zn AS (SELECT *, nullif(atr_d, 0) AS a FROM fin), zones AS (SELECT * EXCLUDE (a), {sides('close_h * 0.99', 'close_h * 1.005')} AS entry,
    {sides('coalesce(close_h - a, close_h * 0.96)', 'coalesce(close_h + a, close_h * 1.03)')} AS invalidation, {sides('coalesce(close_h + 1.5 * a, close_h * 1.05)', 'coalesce(close_h - 1.5 * a, close_h * 0.95)')} AS target FROM zn)"""


def zoned(spark, d) -> DataFrame:
    return scores.atr_zones(scored(spark, d).withColumn("close", F.col("close_h")).withColumn("atr", F.col("atr_d")))


@query(f"{COMP}, {ZONES} SELECT {rounded_sql('entry invalidation target')} FROM zones")
def atr_zones(spark, d):
    return rounded(zoned(spark, d), "symbol", "side", "entry", "invalidation", "target")


@query(f"""{COMP}, {ZONES}, md AS (SELECT symbol, median(close) AS latest FROM daily_bars GROUP BY symbol),
    bad AS (SELECT z.*, CASE WHEN latest > 0 THEN coalesce(close_h > 0 AND (close_h / latest < 0.5 OR close_h / latest > 1.5), false) OR coalesce(close_d > 0 AND (close_d / latest < 0.5 OR close_d / latest > 1.5), false)
      ELSE coalesce(close_h > 0 AND close_d > 0 AND (close_h / close_d < 0.5 OR close_h / close_d > 2.0), false) END AS scale_warning FROM zones z LEFT JOIN md ON md.symbol = z.symbol)
    SELECT symbol, side, scale_warning, round(CASE WHEN scale_warning THEN least(final, 59.0) ELSE final END, 6) AS final, round(CASE WHEN scale_warning THEN least(fast, 30.0) ELSE fast END, 6) AS fast,
    round(CASE WHEN NOT scale_warning THEN target END, 6) AS target FROM bad""")
def price_scale_guard(spark, d):
    """The median close stands for the latest quoted price."""
    quoted = daily_bars(spark, d).groupBy("symbol").agg(F.median("close").alias("latest"))
    return rounded(scores.price_scale_guard(zoned(spark, d).join(quoted, "symbol", "left")), "symbol", "side", "scale_warning", "final", "fast", "target")


@query(f"""{COMP}, rp AS (SELECT symbol, side, count(*) AS repeats FROM signals WHERE (SELECT max(created_at) FROM signals) - created_at < 30 GROUP BY symbol, side)
    SELECT f.symbol, f.side, round(greatest(0.0, final - CASE WHEN f.side = 'SHORT' AND repeats >= 2 THEN 8.0 * (repeats - 1) ELSE 0 END), 6) AS final FROM fin f LEFT JOIN rp ON rp.symbol = f.symbol AND rp.side = f.side""")
def repeat_short_penalty(spark, d):
    sig = signals(spark, d)
    counts = sig.join(F.broadcast(sig.agg(F.max("created_at").alias("last_day")))).where(F.datediff("last_day", "created_at") < 30).groupBy("symbol", "side").agg(F.count("*").alias("repeats"))
    return rounded(scores.repeat_penalty(scored(spark, d), counts), "symbol", "side", "final")


@query(f"{COMP} SELECT symbol, side, round(final, 6) AS final, final < 70 OR coalesce(turnover_d < CASE WHEN market = 'KR' THEN 2e9 ELSE 5e6 END, false) AS speculative FROM fin")
def speculative_marks(spark, d):
    return rounded(scores.mark_speculative(scored(spark, d).withColumn("turnover", F.col("turnover_d"))), "symbol", "side", "final", "speculative")


@query(f"""{COMP}, p AS (SELECT *, row_number() OVER (PARTITION BY market, side ORDER BY round(CASE WHEN side = 'LONG' THEN (75 - coalesce(nullif(rsi_h, 0), 50)) * 0.5 + CASE WHEN obv_h = 'UP' THEN 5 ELSE 0 END + least(coalesce(nullif(vr_h, 0), 1), 3) * 3 ELSE coalesce(nullif(rsi_h, 0), 50) * 0.5 - CASE WHEN obv_h = 'UP' THEN 5 ELSE 0 END END, 9) DESC, symbol) AS k FROM fin
      WHERE close_h IS NOT NULL AND CASE WHEN side = 'LONG' THEN coalesce(nullif(rsi_h, 0), 100) < 75 ELSE coalesce(nullif(rsi_h, 0), 0) > 40 END QUALIFY k <= 40),
    x AS (SELECT symbol, side, market, final, row_number() OVER (PARTITION BY market, side ORDER BY final DESC, symbol) AS rank FROM p)
    SELECT symbol, side, market, round(final, 6) AS final, rank FROM x WHERE rank <= 30""")
def daily_screen(spark, d):
    """The 30 best of the 40 of each market and side that the staged filter lets through."""
    c = ranking.prefilter(scored(spark, d).where("close_h is not null"), ["market", "side"], 40, "rsi_h", "obv_h", "vr_h")
    return rounded(ranking.top_per(c, ["market", "side"], "final", "symbol", 30), "symbol", "side", "market", "final", "rank")


@query(f"""{COMP} SELECT side, count(*) AS n, count(*) FILTER (final >= 50) AS over_50, count(*) FILTER (final >= 80) AS over_80, round(max(final), 6) AS best, count(*) FILTER (evidence = 'REJECT') AS no_evidence, count(*) FILTER (close_h IS NULL) AS no_price FROM fin GROUP BY side""")
def score_diagnosis(spark, d):
    g = scored(spark, d).groupBy("side").agg(
        F.count("*").alias("n"), F.count_if(F.col("final") >= 50).alias("over_50"), F.count_if(F.col("final") >= 80).alias("over_80"), F.max("final").alias("best"),
        F.count_if(F.col("evidence") == "REJECT").alias("no_evidence"), F.count_if(F.col("close_h").isNull()).alias("no_price"))
    return rounded(g, *g.columns)


THEME = f"""{COMP}, tb AS (SELECT symbol, (close - lag(close) {O}) / lag(close) {O} * 100 AS r, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS n FROM daily_bars),
    near AS (SELECT DISTINCT b.symbol AS symbol FROM symbols a JOIN tb ON tb.symbol = a.symbol AND tb.n = 1 AND tb.r >= 3 JOIN symbols b ON b.symbol > a.symbol AND b.symbol <= a.symbol + 3),
    ct AS (SELECT symbol, count(*) AS mentions, max(score) AS top, count(*) FILTER (score >= 80) AS direct FROM signals GROUP BY symbol),
    th AS (SELECT f.symbol, f.sector, r AS return_pct, vr_h AS volume_ratio, rsi_d AS rsi, near.symbol IS NOT NULL AS lagging, coalesce(ct.mentions, 0) AS mentions, coalesce(top, 0) AS top, coalesce(direct, 0) AS direct, sentiment < 48 AS victim
      FROM fin f JOIN tb ON tb.symbol = f.symbol AND tb.n = 1 LEFT JOIN near ON near.symbol = f.symbol LEFT JOIN ct ON ct.symbol = f.symbol WHERE f.side = 'LONG' AND r IS NOT NULL),
    tr AS (SELECT *, CASE WHEN victim THEN 'VICTIM' WHEN return_pct >= 3 AND (coalesce(rsi >= 72, false) OR coalesce(volume_ratio >= 2.5, false)) THEN 'OVERHEATED' WHEN lagging AND return_pct < 1.5 THEN 'LAGGING'
        WHEN return_pct >= 1.5 AND coalesce(volume_ratio >= 1.3, false) THEN 'LEADER' WHEN lagging THEN 'LAGGING' ELSE 'LEADER' END AS role,
      greatest(0.0, least(100.0, 0.3 * greatest(0.0, least(100.0, 50 + 5 * return_pct)) + 0.2 * least(100.0, 50 * coalesce(volume_ratio, 1)) + 0.25 * top + 0.15 * least(100.0, 20.0 * direct) + 0.1 * least(100.0, 10.0 * mentions))) AS theme_score FROM th)"""


def themed(spark, d) -> DataFrame:
    c = candidates(spark, d).where("side = 'LONG'").drop("side")
    move = ind.snapshot(daily_bars(spark, d), need=1).select("symbol", F.col("pct1").alias("return_pct")).where("return_pct is not null")
    lag = neighbours(spark, d).join(move.where("return_pct >= 3").select(F.col("symbol").alias("source")), "source").select(F.col("target").alias("symbol")).distinct().withColumn("lagging", F.lit(True))
    told = signals(spark, d).groupBy("symbol").agg(F.count("*").alias("mentions"), F.max("score").alias("top"), F.count_if(F.col("score") >= 80).alias("direct"))
    c = c.join(move, "symbol").join(lag, "symbol", "left").join(told, "symbol", "left").fillna({"lagging": False, "mentions": 0, "top": 0.0, "direct": 0})
    c = c.withColumn("volume_ratio", F.col("vr_h")).withColumn("rsi", F.col("rsi_d")).withColumn("victim", F.col("sentiment") < 48).withColumn("side", F.lit(None).cast("string"))
    score = scores.theme_score(F.col("return_pct"), F.coalesce("volume_ratio", F.lit(1.0)), F.col("top"), F.col("direct"), F.col("mentions"))
    return c.withColumn("role", scores.theme_role(c)).withColumn("theme_score", score)


@query(f"{THEME} SELECT symbol, role, round(theme_score, 6) AS theme_score FROM tr")
def theme_roles(spark, d):
    return rounded(themed(spark, d), "symbol", "role", "theme_score")


@query(f"""{THEME}, sx AS (SELECT symbol, sector, theme_score, unnest([CASE WHEN return_pct >= 2 AND volume_ratio >= 1.4 AND role <> 'VICTIM' THEN 'surge' END, CASE WHEN return_pct <= -2 AND volume_ratio >= 1.4 THEN 'crash' END,
      CASE WHEN role = 'VICTIM' THEN 'victim' END, CASE WHEN role = 'LAGGING' THEN 'lagging' END, CASE WHEN role IN ('LAGGING', 'LEADER') THEN 'beneficiary' END, CASE WHEN role = 'OVERHEATED' THEN 'overheated' END,
      CASE WHEN role IN ('LEADER', 'OVERHEATED') THEN 'leader' END]) AS section FROM tr),
    sy AS (SELECT *, row_number() OVER (PARTITION BY section, CASE WHEN section = 'leader' THEN sector ELSE CAST(symbol AS VARCHAR) END ORDER BY theme_score DESC, symbol) AS m FROM sx WHERE section IS NOT NULL),
    sz AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY theme_score DESC, symbol) AS place FROM sy WHERE m = 1) SELECT section, symbol, place FROM sz WHERE place <= 5""")
def theme_sections(spark, d):
    return scores.sections(themed(spark, d)).select("section", "symbol", "place")


@query(f"""{THEME}, g AS (SELECT sector, avg(theme_score) AS t FROM tr GROUP BY sector), sn AS (SELECT sector, avg(sentiment) AS s FROM cand WHERE side = 'LONG' GROUP BY sector),
    r AS (SELECT g.sector, 0.6 * t + 0.4 * s AS strength FROM g JOIN sn ON sn.sector = g.sector), q AS (SELECT *, row_number() OVER (ORDER BY strength DESC, sector) AS n FROM r) SELECT sector, round(strength, 6) AS strength FROM q WHERE n <= 3""")
def top_sectors(spark, d):
    t = themed(spark, d).groupBy("sector").agg(F.avg("theme_score").alias("t"))
    s = candidates(spark, d).where("side = 'LONG'").groupBy("sector").agg(F.avg("sentiment").alias("s"))
    return rounded(ranking.top_k(t.join(s, "sector").withColumn("strength", 0.6 * F.col("t") + 0.4 * F.col("s")), "strength", "sector", 3), "sector", "strength")


# ---- pairs ----

STUDY = f"""{CORR}, long_enough AS (SELECT symbol FROM daily_bars GROUP BY symbol HAVING count(*) >= 10),
    pb AS (SELECT symbol, ts, close AS base, last_value(close) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS fin, lead(close, 3) {O} AS whole FROM daily_bars WHERE symbol IN (FROM long_enough)),
    pe AS (SELECT r.symbol AS source, r.ts, CASE WHEN r.r > 0 THEN 'UP' ELSE 'DOWN' END AS direction FROM r JOIN symbols y ON y.symbol = r.symbol WHERE r.symbol IN (FROM long_enough) AND abs(r.r) >= CASE WHEN y.market = 'KR' THEN 7.0 ELSE 5.0 END),
    pj AS (SELECT e.source, n.target, e.direction, b.base, b.fin FROM pe e JOIN neighbours n ON n.source = e.source ASOF JOIN pb b ON b.symbol = n.target AND b.ts <= e.ts),
    ps AS (SELECT source, target, direction, count(*) AS events, avg(CASE WHEN direction = 'UP' AND fin > base OR direction = 'DOWN' AND fin < base THEN 1.0 ELSE 0.0 END) AS cond_prob FROM pj WHERE base > 0 AND fin IS NOT NULL GROUP BY source, target, direction HAVING count(*) >= 5),
    pr AS (SELECT symbol, avg(CASE WHEN whole > base THEN 1.0 ELSE 0.0 END) AS up, avg(CASE WHEN whole < base THEN 1.0 ELSE 0.0 END) AS dn FROM pb WHERE base > 0 AND whole IS NOT NULL GROUP BY symbol),
    study AS (SELECT source, target, direction, events, cond_prob, CASE WHEN direction = 'UP' THEN up ELSE dn END AS base_prob, cond_prob / nullif(CASE WHEN direction = 'UP' THEN up ELSE dn END, 0) AS lift FROM ps LEFT JOIN pr ON pr.symbol = target)"""


def both_ways(spark, d) -> DataFrame:
    return neighbours(spark, d).withColumn("direction", F.explode(F.array(F.lit("UP"), F.lit("DOWN"))))


@query(f"{STUDY} SELECT source, target, direction, events, round(cond_prob, 6) AS cond_prob, round(base_prob, 6) AS base_prob, round(lift, 6) AS lift FROM study")
def pair_study(spark, d):
    return rounded(pairs.pair_study(daily_closes(spark, d), symbols(spark, d), both_ways(spark, d)), "source", "target", "direction", "events", "cond_prob", "base_prob", "lift")


@query(f"""{STUDY}, lx AS (SELECT symbol, (close - lag(close) {O}) / lag(close) {O} * 100 AS m, CASE WHEN count(volume) {over(-20, -1)} = 20 THEN volume / avg(volume) {over(-20, -1)} END AS v, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS n FROM daily_bars),
    lt AS (SELECT lx.symbol, sector, m, v FROM lx JOIN symbols ON symbols.symbol = lx.symbol WHERE n = 1),
    gp AS (SELECT n.source, n.target, a.m AS sm, b.m AS tm, a.v AS sv, b.v AS tv, a.sector = b.sector AS kin, CASE WHEN a.m > 0 THEN 'UP' ELSE 'DOWN' END AS direction, CASE WHEN abs(a.m) < 3 THEN 'ALREADY' WHEN a.m > 0 THEN CASE WHEN b.m >= 3 THEN 'ALREADY' WHEN b.m < -1 THEN 'MISMATCH' WHEN b.m <= 1 THEN 'NOT_YET' ELSE 'PARTIAL' END
      ELSE CASE WHEN b.m > 1 THEN 'MISMATCH' WHEN b.m >= -1 THEN 'WEAKNESS_NOT_YET' WHEN b.m <= -3 THEN 'ALREADY' ELSE 'PARTIAL' END END AS gap_class
      FROM neighbours n JOIN lt a ON a.symbol = n.source JOIN lt b ON b.symbol = n.target WHERE a.m IS NOT NULL AND b.m IS NOT NULL),
    sg AS (SELECT gp.*, events, CASE WHEN events >= 20 AND s.cond_prob >= 0.6 AND s.lift >= 1.5 AND sv >= 1.2 THEN 'high' WHEN events > 0 OR s.cond_prob > 0 OR s.lift > 1 THEN 'medium' ELSE 'low' END AS confidence, greatest(0.0, least(100.0, least(30.0, 4 * abs(sm)) + CASE WHEN sv >= 1.2 THEN 5 ELSE 0 END + CASE gap_class WHEN 'NOT_YET' THEN 28 WHEN 'WEAKNESS_NOT_YET' THEN 22 WHEN 'PARTIAL' THEN 12 ELSE -15 END
      + coalesce(least(8.0, 12 * s.cond_prob), 0) + CASE WHEN s.lift > 1 THEN least(7.0, 6 * (s.lift - 1)) ELSE 0 END + CASE WHEN c.correlation > 0 THEN least(10.0, 12 * c.correlation) ELSE 0 END + CASE WHEN kin THEN 3 ELSE 0 END + CASE WHEN tv >= 1 THEN 3 ELSE 0 END)) AS score
      FROM gp LEFT JOIN study s ON s.source = gp.source AND s.target = gp.target AND s.direction = gp.direction LEFT JOIN corrs c ON c.source = gp.source AND c.target = gp.target WHERE gap_class <> 'ALREADY'),
    so AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY score DESC, source) AS n FROM sg) SELECT source, target, direction, gap_class, confidence, events, round(score, 5) AS score FROM so WHERE n = 1 ORDER BY so.score DESC, target LIMIT 40""")
def pair_signals(spark, d):
    bars = checkpointed(daily_closes(spark, d))  # read by the study and the correlations
    latest = ind.snapshot(ind.last_bars(daily_bars(spark, d), 22), need=1).select("symbol", F.col("pct1").alias("return_pct"), F.col("vr_prev20").alias("volume_ratio")).join(symbols(spark, d).select("symbol", "sector"), "symbol")
    stats = pairs.pair_study(bars, symbols(spark, d), both_ways(spark, d))
    out = pairs.pair_signals(latest, neighbours(spark, d), stats, relations.correlations(bars, neighbours(spark, d)))
    return out.select("source", "target", "direction", "gap_class", "confidence", "events", F.round("score", 5).alias("score"))


@query(f"""{CORR}, {with_tables('signals')[5:]}, pk AS (SELECT DISTINCT symbol FROM signals WHERE score >= 80 AND (SELECT max(created_at) FROM signals) - created_at < 30), e AS (SELECT source, target, correlation, row_number() OVER (PARTITION BY source ORDER BY correlation DESC, target) AS n FROM corrs WHERE correlation >= 0.0 AND source IN (FROM pk)),
    b AS (SELECT target AS symbol, source AS parent, correlation, row_number() OVER (PARTITION BY target ORDER BY correlation DESC, source) AS m FROM e WHERE n <= 5 AND target NOT IN (FROM pk)) SELECT symbol, parent, round(correlation, 5) AS correlation FROM b WHERE m = 1""")
def expand_peers(spark, d):
    """Peers of the symbols of the last 30 days' strong signals (any positive correlation: these are random walks)."""
    edges = relations.correlations(daily_bars(spark, d), neighbours(spark, d))
    sig = signals(spark, d)
    recent = sig.join(F.broadcast(sig.agg(F.max("created_at").alias("last_day")))).where("score >= 80 and datediff(last_day, created_at) < 30")
    out = pairs.expand_peers(recent, edges, least=0.0)
    return out.select("symbol", "parent", F.round("correlation", 5).alias("correlation"))


@query(f"{with_tables('signals')} SELECT symbol, side, min(created_at) AS first_seen, max(created_at) AS last_seen, count(*) AS total_seen FROM signals GROUP BY symbol, side")
def pair_meta(spark, d):
    return pairs.pair_meta(signals(spark, d), ["symbol", "side"], "created_at")


TICKS = with_tables("ticks")
SESSION = f"""{TICKS}, m5 AS (SELECT symbol, ts, price, id, CAST(ts AS DATE) AS day FROM ticks),
    se AS (SELECT symbol, day, arg_min(price, ts) AS open, arg_max(price, ts) AS close, count(*) AS volume, count(DISTINCT date_trunc('hour', ts)) AS n_bars FROM m5 GROUP BY symbol, day),
    ss AS (SELECT *, (close - open) / nullif(open, 0) * 100 AS change_pct, volume / greatest(lag(volume) OVER (PARTITION BY symbol ORDER BY day), CASE WHEN lag(volume) OVER (PARTITION BY symbol ORDER BY day) IS NULL THEN NULL ELSE 1 END) * 24 / greatest(least(n_bars, 24), 1) AS volume_ratio FROM se)"""


@query(f"{SESSION} SELECT symbol, day, round(open, 6) AS open, round(close, 6) AS close, volume, n_bars, round(change_pct, 6) AS change_pct, round(volume_ratio, 6) AS volume_ratio FROM ss WHERE open > 0")
def session_moves(spark, d):
    s = pairs.session_moves(bar_ops.resample(ticks(spark, d), 1), session_bars=24)
    return rounded(s, "symbol", "day", "open", "close", "volume", "n_bars", "change_pct", "volume_ratio")


SURGE = "sgx AS (SELECT id, symbol, ts, price FROM ticks WHERE price >= 12)"


@query(f"{TICKS}, {SURGE}, l AS (SELECT *, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY symbol ORDER BY ts, id)) AS g FROM sgx) SELECT id, symbol, round(price, 6) AS price FROM l WHERE g IS NULL OR g >= 7200000000")
def surge_quiet_period(spark, d):
    return pairs.quiet(ticks(spark, d).where("price >= 12")).select("id", "symbol", F.round("price", 6).alias("price"))


# ---- evidence ----

@query(r"""WITH p AS (SELECT page_id AS external_id, lower(regexp_replace(split_part(split_part(url, '?', 1), '#', 1), '/+$', '')) AS u, row_number() OVER (PARTITION BY CASE WHEN lower(regexp_replace(split_part(split_part(url, '?', 1), '#', 1), '/+$', '')) <> ''
    THEN lower(regexp_replace(split_part(split_part(url, '?', 1), '#', 1), '/+$', '')) ELSE chr(10) || page_id END ORDER BY page_id DESC) AS n FROM pages) SELECT external_id FROM p WHERE n = 1""")
def url_dedupe(spark, d):
    p = spark.read.parquet(f"{d}/pages.parquet").select(F.col("page_id").alias("external_id"), F.col("page_id").alias("published_at"), "url")
    return evidence.url_dedupe(p).select("external_id")


POL = f"p AS (SELECT *, {any_of(GOOD)} AS g, {any_of(BAD)} AS b, {QUALITY} AS q FROM h), pp AS (SELECT *, CASE WHEN g + b = 0 THEN 'neutral' WHEN g > b THEN 'positive' ELSE 'negative' END AS polarity FROM p)"
CLUSTERS = f"""{HASHED}, {POL}, c AS (SELECT hash, count(*) AS size, count(DISTINCT source_name) AS sources, count(DISTINCT source_name) FILTER (source_name IN ('src1', 'src3')) AS research, count(*) FILTER (polarity = 'positive') AS pos,
    count(*) FILTER (polarity = 'negative') AS neg, count(*) FILTER (polarity = 'neutral') AS neu, max(external_id) AS representative, sum(greatest(0, q)) AS q FROM pp GROUP BY hash),
    clusters AS (SELECT hash, size, sources, representative, CASE WHEN pos = greatest(pos, neg, neu) THEN 'positive' WHEN neg = greatest(pos, neg, neu) THEN 'negative' ELSE 'neutral' END AS polarity, q + 1.5 * sources + 2.0 * research AS score FROM c)"""


def clustered(spark, d) -> DataFrame:
    return evidence.clusters(raw_items(spark, d), GOOD, BAD, quality(), ["src1", "src3"])


@query(f"{CLUSTERS} SELECT hash, size, sources, representative, polarity, round(score, 6) AS score FROM clusters")
def evidence_clusters(spark, d):
    return rounded(clustered(spark, d), "hash", "size", "sources", "representative", "polarity", "score")


@query(f"""{HASHED}, w AS (SELECT hash, external_id, regexp_extract_all(text, '[A-Z][a-z]{{7,}}') AS tickers, list_filter([CASE WHEN contains(text, 'und') THEN 'land' END, CASE WHEN contains(text, 'the') THEN 'sea' END, CASE WHEN contains(text, 'que') THEN 'sky' END], lambda x: x IS NOT NULL) AS themes FROM h),
    t AS (SELECT hash, v, min(-external_id * 100000 + i) AS o FROM (SELECT hash, external_id, unnest(tickers) AS v, generate_subscripts(tickers, 1) AS i FROM w) q GROUP BY hash, v),
    m AS (SELECT hash, v, min(-external_id * 100000 + i) AS o FROM (SELECT hash, external_id, unnest(themes) AS v, generate_subscripts(themes, 1) AS i FROM w) q GROUP BY hash, v)
    SELECT c.hash, coalesce(array_to_string(a.l[1:8], ','), '') AS tickers, coalesce(array_to_string(b.l[1:8], ','), '') AS themes FROM (SELECT DISTINCT hash FROM h) c
    LEFT JOIN (SELECT hash, list(v ORDER BY o) AS l FROM t GROUP BY hash) a ON a.hash = c.hash LEFT JOIN (SELECT hash, list(v ORDER BY o) AS l FROM m GROUP BY hash) b ON b.hash = c.hash""")
def cluster_tickers_themes(spark, d):
    """Long capitalised words stand for tickers."""
    from tidemark.operators import mentions, text

    t = F.coalesce("text", F.lit(""))
    items = raw_items(spark, d).withColumn("tickers", F.regexp_extract_all("text", F.lit("[A-Z][a-z]{7,}"), 0)).withColumn("themes", mentions.themes(t, {"land": ["und"], "sea": ["the"], "sky": ["que"]}))
    lists = evidence.cluster_lists(items, text.content_hash(F.col("text")), {"tickers": 8, "themes": 8})
    return lists.select("hash", F.array_join("tickers", ",").alias("tickers"), F.array_join("themes", ",").alias("themes"))


@query(f"""{HASHED}, {POL}, g AS (SELECT source_name, count(*) FILTER (polarity = 'positive') AS bull, count(*) FILTER (polarity = 'negative') AS bear FROM pp GROUP BY source_name)
    SELECT source_name, bull, bear, round(100.0 * bull / (bull + bear), 6) AS score, CASE WHEN bull + bear >= 3 THEN 'high' WHEN bull + bear = 2 THEN 'medium' ELSE 'low' END AS confidence,
    CASE WHEN 100.0 * bull / (bull + bear) >= 65 THEN 'STRONG' WHEN 100.0 * bull / (bull + bear) >= 55 THEN 'WARM' WHEN 100.0 * bull / (bull + bear) > 45 THEN 'NEUTRAL' WHEN 100.0 * bull / (bull + bear) > 35 THEN 'COOL' ELSE 'WEAK' END AS mood FROM g WHERE bull + bear > 0""")
def sentiment_by_source(spark, d):
    from tidemark.operators import text

    items = raw_items(spark, d).withColumn("polarity", text.item_polarity(F.col("text"), GOOD, BAD))
    s = evidence.sentiment_by(items, "source_name")
    return rounded(s.withColumn("mood", evidence.mood(F.col("score"))), "source_name", "bull", "bear", "score", "confidence", "mood")


@query(rf"""{ITEMS}, a AS (SELECT external_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS ws FROM raw_items WHERE published_at >= TIMESTAMP '2024-01-01 01:00:00'),
    t AS (SELECT external_id, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS p FROM a), bw AS (SELECT item_id, list_filter(string_split_regex(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS ws FROM benchmark),
    tm AS (SELECT DISTINCT unnest(ws) AS term FROM bw UNION SELECT DISTINCT ws[1] || ' ' || ws[2] FROM bw WHERE len(ws) > 1),
    tw AS (SELECT term, len(string_split(term, ' ')) AS k, unnest(string_split(term, ' ')) AS w, generate_subscripts(string_split(term, ' '), 1) - 1 AS i FROM tm),
    h AS (SELECT external_id, term, p - i AS at0, k FROM t JOIN tw ON t.w = tw.w GROUP BY external_id, term, p - i, k HAVING count(*) = k)
    SELECT term, external_id, count(*) AS n FROM h GROUP BY term, external_id""")
def items_for_terms(spark, d):
    """Terms are all words of the benchmark's passages and the first two of each as a name, since an hour in."""
    b = spark.read.parquet(f"{d}/benchmark.parquet").select(evidence.tokens(F.col("text")).alias("ws"))
    names = b.where("size(ws) > 1").select(F.concat_ws(" ", F.slice("ws", 1, 2)).alias("term"))
    terms = b.select(F.explode("ws").alias("term")).unionByName(names).distinct()
    return evidence.items_for_terms(raw_items(spark, d), terms, since=F.lit("2024-01-01 01:00:00").cast("timestamp"))


@query(f"""{with_tables('symbols', 'daily_bars')}, l AS (SELECT symbol, max(ts) AS m FROM daily_bars GROUP BY symbol), g AS (SELECT max(ts) AS t FROM daily_bars)
    SELECT s.symbol, CAST(coalesce(t - m, 999) AS BIGINT) AS days, coalesce(t - m, 999) > 4 AS stale FROM symbols s CROSS JOIN g LEFT JOIN l ON l.symbol = s.symbol""")
def bar_staleness(spark, d):
    bars = daily_bars(spark, d)
    asof = bars.agg(F.max("ts").alias("asof"))
    dims = symbols(spark, d)
    last = bars.groupBy("symbol").agg(F.max("ts").alias("ts"))
    return evidence.staleness(last, dims, F.lit(asof.first()[0])).withColumn("days", F.col("days").cast("long"))


@query(f"""{with_tables('signals', 'symbols')}, e AS (SELECT DISTINCT a.symbol AS source, a.symbol + 1 AS target FROM signals a)
    SELECT 'unknown_source' AS finding, source, target FROM e WHERE source NOT IN (SELECT symbol FROM symbols) UNION ALL SELECT 'unknown_target', source, target FROM e WHERE target NOT IN (SELECT symbol FROM symbols)""")
def referential_audit(spark, d):
    e = signals(spark, d).select(F.col("symbol").alias("source"), (F.col("symbol") + 1).alias("target")).distinct()
    return evidence.referential_audit(e, symbols(spark, d))


@query(f"""{with_tables('symbols')}, dm AS (SELECT CASE WHEN symbol % 10 = 0 THEN CAST(symbol AS VARCHAR) ELSE lpad(CAST(symbol AS VARCHAR), 6, '0') END AS symbol, CASE WHEN symbol % 8 = 0 THEN '' ELSE name END AS name, CASE symbol % 9 WHEN 0 THEN NULL WHEN 1 THEN 'TBD' ELSE sector END AS sector, market, symbol AS n FROM symbols),
    rl AS (SELECT 'r' || CASE WHEN n % 13 = 0 THEN 0 ELSE n END AS rule, symbol AS source, CASE n % 6 WHEN 0 THEN symbol WHEN 1 THEN 'GONE' || n WHEN 2 THEN 'JPM' ELSE '000001' END AS target, CASE WHEN n % 7 = 0 THEN '' ELSE 'UP' END AS direction, CASE n % 5 WHEN 0 THEN NULL WHEN 1 THEN -1.0 ELSE 2.0 END AS least_move FROM dm),
    k AS (SELECT DISTINCT symbol FROM dm),
    f AS (SELECT symbol AS subject, 'missing_name' AS finding, 'HIGH' AS severity FROM dm WHERE coalesce(name, '') = '' UNION ALL SELECT symbol, 'missing_sector', 'MEDIUM' FROM dm WHERE coalesce(sector, '') = '' UNION ALL SELECT symbol, 'bad_code', 'HIGH' FROM dm WHERE market = 'KR' AND NOT regexp_full_match(symbol, '\\d{{6}}')
      UNION ALL SELECT symbol, 'placeholder', 'HIGH' FROM dm WHERE regexp_matches(concat_ws(' ', name, sector), '(?i)\\b(TBD|TODO|N/A|dummy)\\b') UNION ALL SELECT symbol, 'short_ticker', 'LOW' FROM dm WHERE length(symbol) <= 1
      UNION ALL SELECT rule, 'self_loop', 'HIGH' FROM rl WHERE source = target UNION ALL SELECT DISTINCT rule, 'duplicate_id', 'HIGH' FROM rl WHERE rule IN (SELECT rule FROM rl GROUP BY rule HAVING count(*) > 1)
      UNION ALL SELECT max(rule), 'duplicate_edge', 'MEDIUM' FROM rl GROUP BY source, target, direction HAVING count(*) > 1 UNION ALL SELECT rule, 'missing_threshold', 'MEDIUM' FROM rl WHERE least_move IS NULL UNION ALL SELECT rule, 'bad_threshold', 'HIGH' FROM rl WHERE least_move <= 0
      UNION ALL SELECT rule, 'missing_field', 'HIGH' FROM rl WHERE direction = '' UNION ALL SELECT rule, 'unknown_source', 'HIGH' FROM rl WHERE source NOT IN (SELECT symbol FROM k) UNION ALL SELECT rule, 'unknown_target', 'MEDIUM' FROM rl WHERE target NOT IN (SELECT symbol FROM k) UNION ALL SELECT rule, 'broker_target', 'LOW' FROM rl WHERE target = 'JPM')
    SELECT severity, finding, subject, count(*) AS n FROM f GROUP BY severity, finding, subject""")
def universe_audit(spark, d):
    """Symbols and rules with planted faults."""
    k = F.col("symbol")
    code = F.when(k % 10 == 0, k.cast("string")).otherwise(F.lpad(k.cast("string"), 6, "0"))
    base = symbols(spark, d).withColumn("n", k)
    dim = base.select(code.alias("symbol"), F.when(k % 8 == 0, "").otherwise(F.col("name")).alias("name"), F.when(k % 9 == 0, None).when(k % 9 == 1, "TBD").otherwise(F.col("sector")).alias("sector"), "market", "n")
    n, s = F.col("n"), F.col("symbol")
    rules = dim.select(
        F.concat(F.lit("r"), F.when(n % 13 == 0, 0).otherwise(n)).alias("rule"), s.alias("source"), F.when(n % 6 == 0, s).when(n % 6 == 1, F.concat(F.lit("GONE"), n)).when(n % 6 == 2, "JPM").otherwise("000001").alias("target"),
        F.when(n % 7 == 0, "").otherwise("UP").alias("direction"), F.when(n % 5 == 0, None).when(n % 5 == 1, -1.0).otherwise(2.0).alias("least_move"))
    return evidence.audit_universe(dim, rules, ["JPM"]).groupBy("severity", "finding", "subject").agg(F.count("*").alias("n"))


@query(f"""{with_tables('signals')}, x AS (SELECT symbol, count(*) AS n, count(*) FILTER (side = 'WATCH') AS watch, bool_or(score >= 80) AS crossed FROM signals GROUP BY symbol) SELECT count(*) AS symbols, CAST(sum(n) AS BIGINT) AS signals, CAST(sum(watch) AS BIGINT) AS unevaluable, count(*) FILTER (NOT crossed) AS never_crossed FROM x""")
def signal_coverage(spark, d):
    return review.signal_coverage(signals(spark, d))


# ---- setups, sides and levels ----

LATEST = f"""dl AS (SELECT symbol, ts, close, (close - lag(close) {O}) / lag(close) {O} * 100 AS r, {full(f'avg(close) {over(-19)}', 20)} AS m20, {full(f'avg(close) {over(-59)}', 60)} AS m60, {full(f'stddev_pop(close) {over(-19)}', 20)} AS sp,
    {full(f'min(close) {over(-19)}', 20)} AS support, {full(f'max(close) {over(-19)}', 20)} AS resistance, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS n FROM daily_bars),
    lv AS (SELECT *, CASE WHEN m20 IS NULL OR m60 IS NULL THEN 'NO_DATA' WHEN close > m20 AND m20 > m60 THEN 'UP' WHEN close < m20 AND m20 < m60 THEN 'DOWN' ELSE 'MIXED' END AS trend FROM dl WHERE n = 1)"""


def with_latest(spark, d, c: DataFrame) -> DataFrame:
    last = ind.snapshot(daily_bars(spark, d), need=1)
    return c.join(last.select("symbol", "close", "support", "resistance", "atr", "bb_mid", "bb_up", "bb_low", F.col("pct1").alias("return_pct"), F.col("trend_daily").alias("trend")), "symbol")


@query(f"""{CAND}, {LATEST}, su AS (SELECT c.*, r AS return_pct, sentiment > 52 AS strong_reason, sentiment < 48 AS weak_reason FROM cand c JOIN lv ON lv.symbol = c.symbol WHERE side = 'LONG')
    SELECT symbol, round({rules_sql(scores.SURGE_SETUP, 0)}, 6) AS surge, round(CASE WHEN rsi_h < 30 THEN 0 ELSE {rules_sql(scores.CRASH_SETUP, 0)} END, 6) AS crash FROM su""")
def setup_scores(spark, d):
    c = with_latest(spark, d, candidates(spark, d).where("side = 'LONG'")).withColumn("strong_reason", F.col("sentiment") > 52).withColumn("weak_reason", F.col("sentiment") < 48)
    return rounded(scores.setup_scores(c), "symbol", "surge", "crash")


@query(f"""{COMP}, {LATEST}, dec AS (SELECT f.symbol, final, rsi_h AS rsi, obv_h AS obv, trend, sentiment AS up, 100 - sentiment AS dn, CASE WHEN sentiment > 52 THEN 'positive' WHEN sentiment < 48 THEN 'negative' ELSE 'mixed' END AS mood, evidence = 'DIRECT' AS direct
      FROM fin f JOIN lv ON lv.symbol = f.symbol WHERE side = 'LONG')
    SELECT symbol, mood, CASE WHEN NOT direct THEN 'WATCH' WHEN mood = 'positive' THEN CASE WHEN final < 45 OR coalesce(rsi >= 85, false) THEN 'WATCH' ELSE 'LONG' END
      WHEN mood = 'negative' THEN CASE WHEN trend = 'UP' AND obv = 'UP' THEN 'WATCH' WHEN final >= 45 AND trend <> 'UP' THEN 'SHORT' WHEN trend = 'DOWN' AND obv = 'DOWN' THEN 'SHORT' ELSE 'WATCH' END
      WHEN final < 45 OR coalesce(rsi >= 85, false) THEN 'WATCH' WHEN up > dn THEN 'LONG' WHEN dn > up AND trend = 'DOWN' THEN 'SHORT' ELSE 'WATCH' END AS decision FROM dec""")
def side_decision(spark, d):
    c = with_latest(spark, d, scored(spark, d).where("side = 'LONG'"))
    s = F.col("sentiment")
    c = c.withColumn("mood", F.when(s > 52, "positive").when(s < 48, "negative").otherwise("mixed")).withColumn("direct", (F.col("evidence") == "DIRECT").cast("int"))
    c = c.withColumn("score", F.col("final")).withColumn("rsi", F.col("rsi_h")).withColumn("obv", F.col("obv_h")).withColumn("catalysts", s).withColumn("risks", 100 - s)
    return c.withColumn("decision", scores.decide_side(c)).select("symbol", "mood", "decision")


@query(f"""{CAND}, {LATEST} SELECT l.symbol, round(CASE WHEN m20 IS NOT NULL THEN (m20 - 2 * sp) * 1.005 ELSE coalesce(support, close * 0.95) * 0.99 END, 6) AS entry_low, round(CASE WHEN m20 IS NOT NULL THEN m20 ELSE least(close * 1.01, coalesce(resistance, close * 1.1) * 0.97) END, 6) AS entry_high,
    round(CASE WHEN m20 IS NOT NULL THEN (m20 - 2 * sp) * 0.985 ELSE coalesce(support, close * 0.95) - coalesce(nullif(atr_h, 0), close * 0.02) END, 6) AS stop, round(CASE WHEN m20 IS NOT NULL THEN m20 + 2 * sp ELSE coalesce(resistance, close * 1.1) END, 6) AS target FROM lv l JOIN fh ON fh.symbol = l.symbol JOIN symbols y ON y.symbol = l.symbol""")
def price_levels(spark, d):
    return rounded(scores.price_levels(with_latest(spark, d, symbols(spark, d))), "symbol", "entry_low", "entry_high", "stop", "target")


@query(f"{CAND} SELECT symbol, sector, round(rsi_h, 6) AS rsi FROM cand WHERE side = 'LONG' AND rsi_h >= 70")
def overheated(spark, d):
    """Symbols whose RSI is 70 or more (the report's own bound is 85)."""
    c = symbols(spark, d).join(ind.screen(daily_bars(spark, d)).select("symbol", "rsi"), "symbol")
    return rounded(c.where("rsi >= 70"), "symbol", "sector", "rsi")


@query(f"""{with_tables('symbols', 'daily_bars', 'neighbours')}, {LATEST}, ed AS (SELECT a.sector AS rule, n.source, n.target, CASE WHEN a.market = b.market THEN 'BENEFICIARY' ELSE 'VICTIM' END AS relation FROM neighbours n JOIN symbols a ON a.symbol = n.source JOIN symbols b ON b.symbol = n.target),
    sp AS (SELECT rule, target, source, relation, r AS source_return, row_number() OVER (PARTITION BY rule, target ORDER BY abs(r) DESC, source) AS k FROM ed JOIN lv ON lv.symbol = ed.source AND relation = CASE WHEN r > 0 THEN 'BENEFICIARY' ELSE 'VICTIM' END WHERE r IS NOT NULL)
    SELECT rule, target, source, relation, round(source_return, 6) AS source_return FROM sp WHERE k = 1""")
def spillover_targets(spark, d):
    """Edges within a market stand for beneficiaries, those across for victims; a rule is the source's sector."""
    y = symbols(spark, d)
    e = neighbours(spark, d).join(y.select(F.col("symbol").alias("source"), F.col("sector").alias("rule"), F.col("market").alias("_a")), "source").join(y.select(F.col("symbol").alias("target"), F.col("market").alias("_b")), "target")
    e = e.select("rule", "source", "target", F.when(F.col("_a") == F.col("_b"), "BENEFICIARY").otherwise("VICTIM").alias("relation"))
    move = ind.snapshot(daily_bars(spark, d), need=1).select("symbol", F.col("pct1").alias("return_pct")).where("return_pct is not null")
    return pairs.spillover_targets(move, e).withColumn("source_return", F.round("source_return", 6))
