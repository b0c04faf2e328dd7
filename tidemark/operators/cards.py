"""Scorecards and the scores that reports show: fundamentals, spillovers, scenarios, verification, quick looks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ranking import places
from tidemark.operators.scores import by_side, clamp, first_of, rule_score
from tidemark.sources.shared import checkpointed

# Conditions and points of the fundamentals scores, base 50.
FUND_LONG = [
    [("pe <= 0", 0), ("pe < 8", 20), ("pe < 15", 12), ("pe < 25", 5), ("pe > 50", -10)], [("pb <= 0", 0), ("pb < 0.8", 18), ("pb < 1.5", 8), ("pb > 6", -8)],
    [("roe >= 20", 15), ("roe >= 12", 8), ("roe < 0", -12)], [("eps_growth > 15", 10)], [("growth > 5", 6)], [("margin > 12", 6)], [("debt > 200", -8)],
    [("w52 < 30", 8), ("w52 > 85", -5)], [("pe_discount > 15", 5)], [("blind_spot", 5)],
]
FUND_SHORT = [
    [("pe <= 0", 0), ("pe > 80", 25), ("pe > 50", 15), ("pe < 10", -15)], [("pb > 8", 12), ("pb < 1", -10)], [("growth < -5", 15)], [("eps_growth < -10", 10)], [("roe < 0", 10)], [("w52 > 90", 8)],
]
# The quick look of up to 40 points.
QUICK_LONG = [[("rsi < 40", 15), ("rsi < 55", 10), ("rsi < 70", 5), ("rsi >= 70", -5)], [("bb < 20", 10), ("bb < 50", 5)], [("vr >= 1.5", 8), ("vr >= 1.2", 4)], [("obv = 'UP'", 7)]]
QUICK_SHORT = [[("rsi > 70", 15), ("rsi > 55", 8)], [("bb > 80", 10), ("bb > 60", 5)], [("vr >= 1.5", 8)], [("obv = 'DOWN'", 7)]]
# Points of a verification, between -10 and 10.
VERIFY = [[("volume_ratio > 2.0", 3), ("volume_ratio < 0.3", -2)], [("pe > 60", -3)], [("roe > 0.20", 2)], [("growth > 0.15", 2)]]
# Quality of a reason, as a spillover's source and as a scenario's.
REASONS = {
    "clinical_success": 95.0, "clinical_failure": 95.0, "earnings_beat": 90.0, "earnings_miss": 90.0, "guidance_up": 85.0, "guidance_down": 85.0, "ai_capex": 85.0, "order_contract": 85.0, "policy_benefit": 80.0,
    "policy_risk": 80.0, "litigation_regulation": 80.0, "product_launch": 75.0, "rate_fx_macro": 75.0, "sector_cycle": 70.0, "commodity_price": 70.0, "unknown_price_only": 30.0,
}
SCENARIO_REASONS = {
    "earnings_beat": 100.0, "earnings_miss": 100.0, "clinical_success": 100.0, "clinical_failure": 100.0, "order_contract": 100.0, "guidance_up": 70.0, "guidance_down": 70.0, "ai_capex": 70.0, "policy_benefit": 70.0,
    "policy_risk": 70.0, "product_launch": 70.0, "litigation_regulation": 70.0, "sector_cycle": 50.0, "rate_fx_macro": 50.0, "commodity_price": 50.0, "unknown_price_only": 20.0,
}
RELEVANCE = {"SUPPLY_CHAIN_COST": 85.0, "BENEFICIARY": 80.0, "DEMAND_SLOWDOWN": 80.0, "VICTIM": 80.0, "PEER_MOMENTUM": 70.0, "LAGGING_BENEFICIARY": 65.0}
# Parts of the scorecard.
CARD_TREND = [[("trend = 'UP'", 8), ("trend = 'DOWN'", -8)], [("macd > macd_signal", 4), ("macd is not null and macd_signal is not null", -2)], [("obv = 'UP'", 2), ("obv = 'DOWN'", -2)], [("vr > 1.5", 2), ("vr < 0.5", -2)]]
CARD_FAST = [[("trend_h = 'UP'", 8), ("trend_h = 'DOWN'", -8)], [("obv_h = 'UP'", 2), ("obv_h = 'DOWN'", -2)], [("coalesce(vr_h, 0) > 1.5", 2), ("coalesce(vr_h, 0) < 0.5", -2)]]
CARD_VALUE = [[("roe > 0.15", 5), ("roe < 0", -5)], [("pe between 5 and 25", 4), ("pe > 40", -4)], [("margin > 0.15", 2)], [("growth > 0.10", 2)], [("debt > 2", -2)]]
CARD_TIMING = [
    [("rsi between 45 and 70", 3), ("rsi > 90", -6), ("rsi > 85", -4), ("rsi > 80", -2), ("rsi > 70", 1), ("rsi < 30", -1)], [("obv = 'UP' and coalesce(rsi, 0) < 70", 1.5), ("obv = 'DOWN'", -1.5)],
    [("bb_position = 'LOWER' and candle = 'HAMMER'", 2.5), ("bb_position = 'LOWER'", 1), ("bb_position = 'ABOVE' and coalesce(vr, 0) > 1.5", -2)], [("candle = 'LONG_BLACK' and coalesce(vr, 0) > 1.5", -3), ("candle = 'LONG_WHITE' and coalesce(vr, 0) >= 2", 1)],
    [("coalesce(vr, 0) > 1.5 and rsi between 45 and 70", 1), ("coalesce(vr, 0) < 0.5", -1)],
]


def looked_up(key: Column, table: dict[str, float], otherwise: float) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key), F.lit(otherwise))


def group_medians(df: DataFrame, group: str, value: str) -> DataFrame:
    """group and median (the mean of the middle two of an even number) of the values that aren't null.

    Places in the group tell the middle ones: rows are dealt by ranges of (group, value), so
    that no task or buffer holds a group, and only the ranges' sizes are summed."""
    d = places(df.where(F.col(value).isNotNull()).select(group, F.col(value).cast("double").alias("_v")), group, [F.col("_v")])
    middle = d.where((F.col("place") == F.floor((F.col("size") + 1) / 2)) | (F.col("place") == F.floor((F.col("size") + 2) / 2)))
    return middle.groupBy(group).agg(F.avg("_v").alias("median"))


def with_peers(df: DataFrame) -> DataFrame:
    """``df`` with pe_discount, in percent of the sector's median P/E of those above 0."""
    med = group_medians(df.where("pe > 0"), "sector", "pe").select(F.col("sector").alias("_sector"), F.col("median").alias("_m"))
    # written, so that the join reads two plain shuffles and AQE may split a sector of many rows
    d = df.join(checkpointed(med), F.col("sector").eqNullSafe(F.col("_sector")), "left")
    return d.withColumn("pe_discount", F.when(F.col("pe") > 0, (F.col("_m") - F.col("pe")) / F.col("_m") * 100)).drop("_m", "_sector")


def fundamental_score(df: DataFrame) -> Column:
    return by_side(rule_score(FUND_LONG), rule_score(FUND_SHORT))


def quick_score(df: DataFrame) -> Column:
    """Up to 40 points from four figures of the last bars; what is unknown gives none, a ratio of 1."""
    total = lambda rules: sum((first_of(g) for g in rules), F.lit(0.0))
    return F.least(F.lit(40.0), by_side(total(QUICK_LONG), total(QUICK_SHORT)))


def verify_adjust(df: DataFrame) -> Column:
    return clamp(sum((first_of(g) for g in VERIFY), F.lit(0.0)), -10.0, 10.0)


def source_move_score(move: Column, market: Column) -> Column:
    return F.least(F.lit(100.0), 40.0 + F.abs(move) * F.when(market == "KR", 3.0).otherwise(4.0))


def source_reason_quality(reason: Column, confidence: Column) -> Column:
    base = looked_up(reason, REASONS, 50.0)
    return F.when(confidence == "HIGH", F.least(F.lit(100.0), base + 5)).when(confidence == "LOW", F.greatest(F.lit(0.0), base - 15)).otherwise(base)


def spillover_score(targets: DataFrame, least: float = 55.0, most: int | None = None) -> DataFrame:
    """``targets`` with their score, those of unknown reasons and below ``least`` without.

    Columns: side, source_return, market, reason, confidence, relation, sentiment, value, fast, slow,
    volume_score, penalty, backlog (0 where none).  The best source of a symbol and side stays.
    Scores are compared at nine places, so that equal sums of parts are equal whatever their last bits."""
    d = targets.where("reason <> 'unknown_price_only'")
    s = F.when(F.col("side") == "LONG", F.col("sentiment")).otherwise(100 - F.col("sentiment"))
    total = (source_move_score(F.col("source_return"), F.col("market")) * 0.15 + source_reason_quality(F.col("reason"), F.col("confidence")) * 0.15 + looked_up(F.col("relation"), RELEVANCE, 70.0) * 0.15
             + s * 0.10 + F.col("value") * 0.15 + F.col("fast") * 0.15 + F.col("slow") * 0.10 + F.col("volume_score") * 0.05 - F.col("penalty") + F.col("backlog") * F.when(F.col("side") == "LONG", 0.05).otherwise(0.03))
    d = d.withColumn("score", clamp(total)).withColumn("_at", F.round("score", 9)).where(F.col("_at") >= least)
    first = Window.partitionBy("symbol", "side").orderBy(F.desc("_at"), "source")
    d = d.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return (d.orderBy(F.desc("_at"), "symbol").limit(most) if most else d).drop("_at")


def scenario_type(side: Column, source: Column, relation: Column, reason: Column, style: Column) -> Column:
    led = source.isNotNull()
    long = (
        F.when(led & (relation == "LAGGING_BENEFICIARY"), "LAGGING_BENEFICIARY").when(led & relation.isin("BENEFICIARY", "SUPPLY_CHAIN_COST", "DEMAND_SLOWDOWN", "VICTIM", "PEER_MOMENTUM"), "SUPPLY_CHAIN")
        .when(reason.isin("policy_benefit", "ai_capex"), "POLICY_MOMENTUM").when(reason.isin("earnings_beat", "order_contract", "clinical_success", "guidance_up"), "EARNINGS_TURNAROUND")
        .when(F.lower(F.coalesce(style, F.lit(""))).contains("breakout"), "VOLUME_BREAKOUT").otherwise("UNDERVALUED_REBOUND")
    )
    short = F.when(led & relation.isin("VICTIM", "DEMAND_SLOWDOWN"), "SHORT_SLOWDOWN").when(reason.isin("earnings_miss", "guidance_down", "clinical_failure", "litigation_regulation", "policy_risk"), "SHORT_CATALYST").otherwise("SHORT_OVERHEAT")
    return F.when(side == "LONG", long).otherwise(short)


def scenario_quality(reason: Column, source_return: Column, evidence: Column) -> Column:
    """Quality of a pick's reason; an unknown one counts 20 where the source moved beyond 7 %; without a reason 50 and 5 a piece of evidence."""
    base = looked_up(reason, SCENARIO_REASONS, 50.0)
    return F.when(reason.isNull() | (reason == ""), F.least(F.lit(100.0), 50.0 + 5.0 * F.coalesce(evidence, F.lit(0)))).otherwise(base)


def scorecard(df: DataFrame) -> DataFrame:
    """Evidence 30, technical 30, valuation 20, risk 10 and timing 10 points, the total and its grade.

    Where there is a sentiment alpha and direct evidence the total weighs them with the parts instead.
    An RSI above 90, or above 80 at the upper band, caps it at 74; no direct evidence at 62.
    A null ``close`` stands for a missing chart, a null ``close_h`` for a missing fast one."""
    mood = first_of([("sentiment = 'positive'", 8), ("sentiment = 'negative'", -10), ("sentiment = 'mixed'", 2)])
    cap = lambda v, high: F.least(v, F.lit(float(high)))
    said = 12.0 + mood + cap(F.col("n_catalysts") * 3.5, 8) - cap(F.col("n_risks") * 3.5, 10) + cap((F.col("mentions") - 1) * 1.5, 6) + F.when(F.col("narratives") >= 1, cap(F.col("narratives") * 3.0, 9)).otherwise(0.0)
    has = F.col("close").isNotNull()
    d = df.withColumn("evidence_score", clamp(said, high=30.0))
    d = d.withColumn("technical_score", F.when(has, rule_score(CARD_TREND, 14, 30)).otherwise(8.0)).withColumn("valuation_score", rule_score(CARD_VALUE, 10, 20))
    d = d.withColumn("risk_score", clamp(10.0 - cap(F.col("n_risks") * 2.0, 8) - F.when(F.col("sentiment") == "negative", 2.0).otherwise(0.0), high=10.0))
    d = d.withColumn("timing_score", F.when(has, rule_score(CARD_TIMING, 5, 10)).otherwise(5.0))
    fast = F.when(F.col("close_h").isNotNull(), rule_score(CARD_FAST, 14, 30)).otherwise(14.0)
    weighed = F.col("alpha") * 0.35 + fast / 30 * 25 + F.col("technical_score") / 30 * 15 + F.col("valuation_score") / 20 * 10 + F.col("risk_score") / 10 * 10 + F.col("timing_score") / 10 * 5
    plain = F.col("evidence_score") + F.col("technical_score") + F.col("valuation_score") + F.col("risk_score") + F.col("timing_score")
    total = clamp(F.when((F.col("alpha") > 0) & (F.col("evidence") > 0), weighed).otherwise(plain))
    hot = F.coalesce((F.col("rsi") > 90) | ((F.col("rsi") > 80) & F.col("bb_position").isin("UPPER", "ABOVE")), F.lit(False))
    total = F.least(total, F.when(hot & has, 74.0).otherwise(100.0), F.when(F.col("evidence") == 0, 62.0).otherwise(100.0))
    d = d.withColumn("total", total)
    return d.withColumn("grade", F.when(F.col("total") >= 75, "STRONG").when(F.col("total") >= 60, "INTEREST").when(F.col("total") >= 45, "WATCH").otherwise("EXCLUDE"))
