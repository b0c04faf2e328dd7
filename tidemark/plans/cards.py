"""Queries of scorecards, spillovers, scenarios and ordered lists; each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import cards, ranking
from tidemark.plans.scoring import case, rules_sql, sides
from tidemark.plans.tables import fundamentals, neighbours, read, signals, symbols, with_tables

QUERIES, SQL = {}, {}


def query(sql: str | None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


#: Columns of stand-in figures out of a customer's keys, as SQL that both engines read.
FIGURES = {
    "side": "CASE WHEN k % 2 = 0 THEN 'LONG' ELSE 'SHORT' END", "rsi": "CASE WHEN k % 13 <> 0 THEN CAST(k * 7 % 101 AS DOUBLE) END", "bb": "CASE WHEN k % 11 <> 0 THEN CAST(k * 3 % 101 AS DOUBLE) END", "vr": "CASE WHEN k % 7 <> 0 THEN k * 5 % 40 / 10.0 END",
    "obv": "CASE k % 3 WHEN 0 THEN 'UP' WHEN 1 THEN 'DOWN' ELSE 'FLAT' END", "roe": "CASE WHEN k % 5 <> 0 THEN (k * 3 % 60 - 10) / 100.0 END", "pe": "CASE WHEN k % 9 <> 0 THEN CAST(k * 11 % 100 - 5 AS DOUBLE) END", "growth": "CASE WHEN k % 6 <> 0 THEN (k * 7 % 50 - 15) / 100.0 END",
    "margin": "CASE WHEN k % 8 <> 0 THEN k % 30 / 100.0 END", "debt": "CASE WHEN k % 10 <> 0 THEN k % 50 / 10.0 END", "volume_ratio": "CASE WHEN k % 12 <> 0 THEN k % 35 / 10.0 END", "sentiment": "CASE k % 4 WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' WHEN 2 THEN 'mixed' ELSE 'neutral' END",
    "n_catalysts": "k % 4", "n_risks": "k % 5", "mentions": "k % 7 + 1", "narratives": "k % 5", "close": "CASE WHEN k % 17 <> 0 THEN 100.0 END", "close_h": "CASE WHEN k % 6 <> 1 THEN 100.0 END", "trend": "CASE k % 3 WHEN 0 THEN 'UP' WHEN 1 THEN 'DOWN' ELSE 'MIXED' END",
    "trend_h": "CASE k % 4 WHEN 0 THEN 'UP' WHEN 1 THEN 'DOWN' ELSE 'MIXED' END", "macd": "CASE WHEN k % 14 <> 0 THEN CAST(k % 9 AS DOUBLE) END", "macd_signal": "CAST(k % 7 AS DOUBLE)", "obv_h": "CASE k % 5 WHEN 0 THEN 'UP' WHEN 1 THEN 'DOWN' ELSE 'FLAT' END", "vr_h": "CASE WHEN k % 8 <> 3 THEN k % 30 / 10.0 END",
    "bb_position": "CASE k % 5 WHEN 0 THEN 'LOWER' WHEN 1 THEN 'UPPER' WHEN 2 THEN 'ABOVE' ELSE 'MIDDLE' END", "candle": "CASE k % 4 WHEN 0 THEN 'HAMMER' WHEN 1 THEN 'LONG_BLACK' WHEN 2 THEN 'LONG_WHITE' ELSE 'NONE' END", "alpha": "CASE WHEN k % 3 = 0 THEN 0.0 ELSE CAST(k * 13 % 101 AS DOUBLE) END", "evidence": "k % 4",
}
FIG = "fg AS (SELECT k AS id, " + ", ".join(f"{e} AS {n}" for n, e in FIGURES.items()) + " FROM (SELECT c_custkey * 31 + c_nationkey AS k FROM customer) q)"


def figures(spark, d) -> DataFrame:
    c = read(spark, d, "customer").select((F.col("c_custkey") * 31 + F.col("c_nationkey")).alias("k"))
    return c.select(F.col("k").alias("id"), *[F.expr(e).cast("double").alias(n) if "/" in e else F.expr(e).alias(n) for n, e in FIGURES.items()])


@query(f"WITH {FIG} SELECT id, CAST(least(40.0, {sides(' + '.join(case(g) for g in cards.QUICK_LONG), ' + '.join(case(g) for g in cards.QUICK_SHORT))}) AS DOUBLE) AS score, CAST(greatest(-10.0, least(10.0, {' + '.join(case(g) for g in cards.VERIFY)})) AS DOUBLE) AS adjust FROM fg")
def quick_looks(spark, d):
    f = figures(spark, d)
    return f.select("id", cards.quick_score(f).alias("score"), cards.verify_adjust(f).alias("adjust"))


CARD = f"""WITH {FIG}, p AS (SELECT *, greatest(0.0, least(30.0, 12.0 + CASE sentiment WHEN 'positive' THEN 8 WHEN 'negative' THEN -10 WHEN 'mixed' THEN 2 ELSE 0 END + least(n_catalysts * 3.5, 8.0) - least(n_risks * 3.5, 10.0) + least((mentions - 1) * 1.5, 6.0) + CASE WHEN narratives >= 1 THEN least(narratives * 3.0, 9.0) ELSE 0 END)) AS evidence_score,
      CASE WHEN close IS NULL THEN 8.0 ELSE {rules_sql(cards.CARD_TREND, 14, 30)} END AS technical_score, {rules_sql(cards.CARD_VALUE, 10, 20)} AS valuation_score, greatest(0.0, least(10.0, 10.0 - least(n_risks * 2.0, 8.0) - CASE WHEN sentiment = 'negative' THEN 2 ELSE 0 END)) AS risk_score,
      CASE WHEN close IS NULL THEN 5.0 ELSE {rules_sql(cards.CARD_TIMING, 5, 10)} END AS timing_score, CASE WHEN close_h IS NULL THEN 14.0 ELSE {rules_sql(cards.CARD_FAST, 14, 30)} END AS fast FROM fg),
    t AS (SELECT *, least(greatest(0.0, least(100.0, CASE WHEN alpha > 0 AND evidence > 0 THEN alpha * 0.35 + fast / 30 * 25 + technical_score / 30 * 15 + valuation_score / 20 * 10 + risk_score + timing_score / 10 * 5 ELSE evidence_score + technical_score + valuation_score + risk_score + timing_score END)),
      CASE WHEN close IS NOT NULL AND (rsi > 90 OR rsi > 80 AND bb_position IN ('UPPER', 'ABOVE')) THEN 74.0 ELSE 100.0 END, CASE WHEN evidence = 0 THEN 62.0 ELSE 100.0 END) AS total FROM p)
    SELECT id, round(evidence_score, 5) AS evidence_score, round(technical_score, 5) AS technical_score, round(valuation_score, 5) AS valuation_score, round(risk_score, 5) AS risk_score, round(timing_score, 5) AS timing_score, round(total, 5) AS total, CASE WHEN total >= 75 THEN 'STRONG' WHEN total >= 60 THEN 'INTEREST' WHEN total >= 45 THEN 'WATCH' ELSE 'EXCLUDE' END AS grade FROM t"""


@query(CARD)
def scorecard(spark, d):
    s = cards.scorecard(figures(spark, d))
    return s.select("id", *[F.round(c, 5).alias(c) for c in ("evidence_score", "technical_score", "valuation_score", "risk_score", "timing_score", "total")], "grade")


FUND = """fd AS (SELECT symbol, sector, pe, pb, CASE WHEN symbol % 5 <> 0 THEN CAST(symbol % 40 - 8 AS DOUBLE) END AS roe, CAST(symbol % 50 - 20 AS DOUBLE) AS eps_growth, CAST(symbol % 30 - 12 AS DOUBLE) AS growth, CASE WHEN symbol % 7 <> 0 THEN CAST(symbol % 25 AS DOUBLE) END AS margin, CAST(symbol % 300 AS DOUBLE) AS debt, CAST(symbol * 3 % 101 AS DOUBLE) AS w52, symbol % 6 = 0 AS blind_spot, s.side FROM fundamentals CROSS JOIN (SELECT unnest(['LONG', 'SHORT']) AS side) s),
    md AS (SELECT sector, median(pe) AS m FROM fundamentals WHERE pe > 0 GROUP BY sector), fp AS (SELECT fd.*, CASE WHEN pe > 0 THEN (m - pe) / m * 100 END AS pe_discount FROM fd LEFT JOIN md ON md.sector = fd.sector)"""


@query(f"{with_tables('fundamentals')}, {FUND} SELECT symbol, side, round({sides(rules_sql(cards.FUND_LONG), rules_sql(cards.FUND_SHORT))}, 5) AS score, round(pe_discount, 4) AS pe_discount FROM fp")
def fundamental_scores(spark, d):
    k = F.col("symbol")
    f = fundamentals(spark, d).select("symbol", "sector", "pe", "pb", F.when(k % 5 != 0, (k % 40 - 8).cast("double")).alias("roe"), (k % 50 - 20).cast("double").alias("eps_growth"), (k % 30 - 12).cast("double").alias("growth"), F.when(k % 7 != 0, (k % 25).cast("double")).alias("margin"), (k % 300).cast("double").alias("debt"), (k * 3 % 101).cast("double").alias("w52"), (k % 6 == 0).alias("blind_spot"))
    f = cards.with_peers(f).withColumn("side", F.explode(F.array(F.lit("LONG"), F.lit("SHORT"))))
    return f.select("symbol", "side", F.round(cards.fundamental_score(f), 5).alias("score"), F.round("pe_discount", 4).alias("pe_discount"))


KINDS = ["earnings_beat", "guidance_down", "sector_cycle", "unknown_price_only", "ai_capex", "rumour"]
LINKS = ["SUPPLY_CHAIN_COST", "BENEFICIARY", "LAGGING_BENEFICIARY", "PEER_MOMENTUM", "OTHER"]
SPILL = f"""{with_tables('symbols', 'neighbours')}, sp AS (SELECT target AS symbol, source, CASE WHEN (source + target) % 2 = 0 THEN 'LONG' ELSE 'SHORT' END AS side, (source * 7 % 41 - 20) / 2.0 AS mv, market, {KINDS}[source % 6 + 1] AS reason, ['HIGH', 'MEDIUM', 'LOW'][target % 3 + 1] AS confidence, {LINKS}[target % 5 + 1] AS relation,
      source % 101 AS sentiment, target * 3 % 101 AS value, source * 5 % 101 AS fast, target * 7 % 101 AS slow, source % 90 AS vol, target % 20 AS penalty, CASE WHEN target % 4 = 0 THEN 15.0 ELSE 0.0 END AS backlog FROM neighbours JOIN symbols y ON y.symbol = source),
    sq AS (SELECT *, CASE reason WHEN 'earnings_beat' THEN 90.0 WHEN 'guidance_down' THEN 85.0 WHEN 'sector_cycle' THEN 70.0 WHEN 'ai_capex' THEN 85.0 ELSE 50.0 END AS rb, CASE relation WHEN 'SUPPLY_CHAIN_COST' THEN 85.0 WHEN 'BENEFICIARY' THEN 80.0 WHEN 'LAGGING_BENEFICIARY' THEN 65.0 ELSE 70.0 END AS rel FROM sp WHERE reason <> 'unknown_price_only'),
    ss AS (SELECT symbol, side, source, greatest(0.0, least(100.0, least(100.0, 40 + abs(mv) * CASE WHEN market = 'KR' THEN 3 ELSE 4 END) * 0.15 + CASE confidence WHEN 'HIGH' THEN least(100.0, rb + 5) WHEN 'LOW' THEN greatest(0.0, rb - 15) ELSE rb END * 0.15 + rel * 0.15
      + CASE WHEN side = 'LONG' THEN sentiment ELSE 100 - sentiment END * 0.10 + value * 0.15 + fast * 0.15 + slow * 0.10 + vol * 0.05 - penalty + backlog * CASE WHEN side = 'LONG' THEN 0.05 ELSE 0.03 END)) AS score FROM sq)"""


@query(f"{SPILL} SELECT symbol, side, source, round(score, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY symbol, side ORDER BY round(score, 9) DESC, source) AS n FROM ss WHERE round(score, 9) >= 45) q WHERE n = 1")
def spillover_scores(spark, d):
    s, t = F.col("source"), F.col("target")
    of = lambda names, k: F.element_at(F.array(*map(F.lit, names)), (k + 1).cast("int"))
    e = neighbours(spark, d).join(symbols(spark, d).select(F.col("symbol").alias("source"), "market"), "source")
    x = e.select(t.alias("symbol"), "source", F.when((s + t) % 2 == 0, "LONG").otherwise("SHORT").alias("side"), ((s * 7 % 41 - 20) / 2.0).alias("source_return"), "market", of(KINDS, s % 6).alias("reason"), of(("HIGH", "MEDIUM", "LOW"), t % 3).alias("confidence"), of(LINKS, t % 5).alias("relation"),
                 (s % 101).alias("sentiment"), (t * 3 % 101).alias("value"), (s * 5 % 101).alias("fast"), (t * 7 % 101).alias("slow"), (s % 90).alias("volume_score"), (t % 20).alias("penalty"), F.when(t % 4 == 0, 15.0).otherwise(0.0).alias("backlog"))
    return cards.spillover_score(x, 45.0).select("symbol", "side", "source", F.round("score", 5).alias("score"))


@query("""WITH c AS (SELECT c_custkey * 31 + c_nationkey AS k FROM customer), p AS (SELECT k AS id, CASE WHEN k % 2 = 0 THEN 'LONG' ELSE 'SHORT' END AS side, CASE WHEN k % 3 <> 0 THEN k END AS source, ['LAGGING_BENEFICIARY', 'VICTIM', 'BENEFICIARY', 'OTHER'][k % 4 + 1] AS relation, ['policy_benefit', 'earnings_beat', 'earnings_miss', 'rumour', NULL][k % 5 + 1] AS reason, CASE WHEN k % 7 = 0 THEN 'Breakout' ELSE 'x' END AS style, k % 12 AS evidence FROM c)
    SELECT id, CASE WHEN side = 'LONG' THEN CASE WHEN source IS NOT NULL AND relation = 'LAGGING_BENEFICIARY' THEN 'LAGGING_BENEFICIARY' WHEN source IS NOT NULL AND relation IN ('VICTIM', 'BENEFICIARY') THEN 'SUPPLY_CHAIN' WHEN reason = 'policy_benefit' THEN 'POLICY_MOMENTUM' WHEN reason = 'earnings_beat' THEN 'EARNINGS_TURNAROUND' WHEN style = 'Breakout' THEN 'VOLUME_BREAKOUT' ELSE 'UNDERVALUED_REBOUND' END
      ELSE CASE WHEN source IS NOT NULL AND relation = 'VICTIM' THEN 'SHORT_SLOWDOWN' WHEN reason = 'earnings_miss' THEN 'SHORT_CATALYST' ELSE 'SHORT_OVERHEAT' END END AS scenario,
      CASE reason WHEN 'policy_benefit' THEN 70.0 WHEN 'earnings_beat' THEN 100.0 WHEN 'earnings_miss' THEN 100.0 WHEN 'rumour' THEN 50.0 ELSE least(100.0, 50.0 + evidence * 5) END AS quality FROM p""")
def scenarios(spark, d):
    k = F.col("k")
    of = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (n + 1).cast("int"))
    c = read(spark, d, "customer").select((F.col("c_custkey") * 31 + F.col("c_nationkey")).alias("k"))
    p = c.select(k.alias("id"), F.when(k % 2 == 0, "LONG").otherwise("SHORT").alias("side"), F.when(k % 3 != 0, k).alias("source"), of(("LAGGING_BENEFICIARY", "VICTIM", "BENEFICIARY", "OTHER"), k % 4).alias("relation"), of(("policy_benefit", "earnings_beat", "earnings_miss", "rumour", None), k % 5).alias("reason"), F.when(k % 7 == 0, "Breakout").otherwise("x").alias("style"), (k % 12).alias("evidence"))
    return p.select("id", cards.scenario_type(*map(F.col, ("side", "source", "relation", "reason", "style"))).alias("scenario"), cards.scenario_quality(F.col("reason"), F.lit(None), F.col("evidence")).alias("quality"))


RANKED = """rk AS (SELECT source, target, CASE WHEN source % 3 = 0 THEN 'medium' ELSE 'low' END AS confidence, (source * 7 + target) % 10 / 4.0 AS lift, target % 9 / 10.0 AS cond_prob, source % 30 AS events FROM neighbours)"""


def ranked_pairs(spark, d) -> DataFrame:
    s, t = F.col("source"), F.col("target")
    return neighbours(spark, d).select("source", "target", F.when(s % 3 == 0, "medium").otherwise("low").alias("confidence"), ((s * 7 + t) % 10 / 4.0).alias("lift"), (t % 9 / 10.0).alias("cond_prob"), (s % 30).alias("events"))


@query(f"{with_tables('symbols', 'neighbours')}, {RANKED} SELECT source, target, row_number() OVER (ORDER BY CASE confidence WHEN 'medium' THEN 0 ELSE 1 END, lift DESC, cond_prob DESC, events DESC, source, target) AS rank FROM rk QUALIFY rank <= 40")
def rank_pairs(spark, d):
    return ranking.rank_pairs(ranked_pairs(spark, d), 40).select("source", "target", "rank")


@query(f"""WITH RECURSIVE {with_tables('symbols', 'neighbours')[5:]}, o AS (SELECT source, target, row_number() OVER (ORDER BY (source * 37 + target * 11) % 97 DESC, source, target) AS i FROM neighbours),
    g(i, src, tgt, taken) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST([] AS BIGINT[]), 0 UNION ALL SELECT o.i, CASE WHEN ok THEN list_append(src, o.source) ELSE src END, CASE WHEN ok THEN list_append(tgt, o.target) ELSE tgt END, taken + CAST(ok AS INT)
      FROM (SELECT g.*, o2.i AS j, taken < 8 AND len(list_filter(src, lambda x: x = o2.source)) < 2 AND len(list_filter(tgt, lambda x: x = o2.target)) < 2 AS ok FROM g JOIN o o2 ON o2.i = g.i + 1 WHERE taken < 8) g JOIN o ON o.i = g.j)
    SELECT unnest(src) AS source, unnest(tgt) AS target FROM (SELECT * FROM g ORDER BY i DESC LIMIT 1) q""")
def two_sided_quota(spark, d):
    e = neighbours(spark, d).withColumn("score", (F.col("source") * 37 + F.col("target") * 11) % 97)
    return ranking.two_sided_quota(e, "score").select("source", "target")


@query(f"""{with_tables('signals')}, o AS (SELECT id, side, row_number() OVER (PARTITION BY side ORDER BY score + CASE WHEN side = 'LONG' AND symbol % 5 = 0 THEN 5 ELSE 0 END DESC, id) AS place FROM signals) SELECT * FROM o WHERE place <= CASE side WHEN 'LONG' THEN 30 WHEN 'SHORT' THEN 20 ELSE 10 END""")
def order_scenarios(spark, d):
    s = signals(spark, d).withColumn("watched", F.col("symbol") % 5 == 0)
    return ranking.order_scenarios(s, {"LONG": 30, "SHORT": 20, "WATCH": 10}).select("id", "side", "place")


@query("SELECT id FROM (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice END AS amount, o_orderdate AS date FROM orders ORDER BY amount DESC NULLS LAST, date DESC, id LIMIT 200) q")
def order_amount(spark, d):
    """The backlog, where some amounts aren't known."""
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice")).alias("amount"), F.col("o_orderdate").alias("date"))
    return ranking.order_amount(o, 200).select("id")


@query(f"""{with_tables('symbols', 'signals')}, g AS (SELECT sector, count(*) FILTER (side = 'LONG' AND score >= 95) AS l, count(*) FILTER (side = 'SHORT' AND score >= 97) AS s FROM signals JOIN symbols ON symbols.symbol = signals.symbol GROUP BY sector)
    SELECT sector, CASE WHEN l > 0 AND s > 0 THEN 'mixed' WHEN l > 0 THEN 'strong' ELSE 'weak' END AS standing FROM g WHERE l > 0 OR s > 0""")
def sector_overlap(spark, d):
    s = signals(spark, d).join(symbols(spark, d).select("symbol", "sector"), "symbol")
    return ranking.sector_overlap(s.where("side = 'LONG' and score >= 95"), s.where("side = 'SHORT' and score >= 97"))


@query(f"""{with_tables('signals')}, p AS (SELECT id, symbol, score FROM signals) SELECT id, symbol FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY score DESC, id) AS n FROM p) q WHERE n = 1""")
def dedupe_picks(spark, d):
    p = signals(spark, d).withColumn("source", F.when(F.col("id") % 2 == 0, F.col("id") % 100)).withColumn("relation", F.when(F.col("id") % 3 == 0, "PEER"))
    return ranking.dedupe_picks(p).select("id", "symbol")
