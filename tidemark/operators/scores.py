"""Scores of long and short candidates as sums of rules.

A score is a base plus the points of its rule groups, between 0 and 100.  Within
a group the first condition that holds counts; a null input holds in none.
Conditions are SQL expressions over the columns of the candidate table: slow
(``*_d``) and fast (``*_h``) indicator frames, valuation, and price.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Rules = list[list[tuple[str, float]]]

# Conditions and points of the technical scores.
TECH_LONG_SLOW: Rules = [
    [("rsi_d between 40 and 60", 15), ("rsi_d < 35", 10), ("rsi_d > 75", -15)],
    [("obv_d = 'UP'", 15), ("obv_d = 'DOWN'", -10)],
    [("bb_d between 0.2 and 0.6", 10), ("bb_d > 0.8", -5)],
    [("vr_d >= 1.5", 10)],
]
TECH_LONG_FAST: Rules = [
    [("rsi_h between 45 and 65", 20), ("rsi_h < 40", 12), ("rsi_h > 80", -20), ("rsi_h > 70", -5)],
    [("obv_h = 'UP'", 20), ("obv_h = 'DOWN'", -15)],
    [("bb_h between 0.4 and 0.7", 15), ("bb_h > 0.9", 10), ("bb_h < 0.1", -5)],
    [("vr_h >= 1.5", 15)],
]
TECH_SHORT_SLOW: Rules = [
    [("rsi_d > 70", 20), ("rsi_d > 60", 10), ("rsi_d < 35", -20)],
    [("obv_d = 'DOWN'", 20), ("obv_d = 'UP'", -15)],
    [("bb_d > 0.85", 15), ("bb_d < 0.2", -10)],
]
TECH_SHORT_FAST: Rules = [
    [("rsi_h > 80", 30), ("rsi_h > 70", 20), ("rsi_h < 35", -20)],
    [("obv_h = 'DOWN'", 25), ("obv_h = 'UP'", -15)],
    [("bb_h < 0.35", 20), ("bb_h > 0.85", 15)],
    [("vr_h >= 1.3", 10)],
]
# Conditions and points of the valuation scores.
VALUE_LONG: Rules = [
    [("pe <= 0", 0), ("pe < 8", 20), ("pe < 15", 12), ("pe < 25", 5), ("pe > 50", -10)],
    [("pb <= 0", 0), ("pb < 0.8", 20), ("pb < 1.5", 10), ("pb > 5", -8)],
    [("roe >= 15", 12), ("roe >= 8", 6), ("roe < 0", -10)],
    [("growth > 5", 8)],
    [("margin > 10", 5)],
]
VALUE_SHORT: Rules = [
    [("pe <= 0", 0), ("pe > 80", 25), ("pe > 50", 15), ("pe > 30", 5), ("pe < 10", -15)],
    [("pb > 8", 15), ("pb > 5", 8), ("pb < 1", -10)],
    [("growth < -5", 15)],
    [("roe < 0", 10)],
]
# Volume scores, risk points, and the weights of the final score.
VOLUME_LONG = [("vr >= 2.0", 85), ("vr >= 1.5", 72), ("vr >= 1.0", 55), ("vr < 1.0", 35)]
VOLUME_SHORT = [("vr >= 1.5", 70), ("vr >= 0.5 and vr < 1.0", 60)]
RISK_LONG: Rules = [[("rsi_h > 80", 15)], [("vr < 0.3", 10)]]
RISK_SHORT: Rules = [[("rsi_h < 30", 20)], [("vr < 0.3", 10)]]
WEIGHTS_LONG = {"sentiment": 0.20, "value": 0.20, "fast": 0.20, "slow": 0.15, "volume": 0.10, "catalyst": 0.10}
WEIGHTS_SHORT = {"sentiment": 0.25, "fast": 0.25, "slow": 0.20, "value": 0.10, "volume": 0.10, "catalyst": 0.10}
PAIR_SHARE = 2.5  # a neutral 50 at the weight 0.05, LONG only
EVIDENCE_CAPS = {"REJECT": 59.0, "WEAK": 69.0, "SECTOR": 74.0}


def first_of(group: list[tuple[str, float]], otherwise: float = 0.0) -> Column:
    out = F.when(F.expr(group[0][0]), float(group[0][1]))
    for condition, points in group[1:]:
        out = out.when(F.expr(condition), float(points))
    return out.otherwise(float(otherwise))


def clamp(value: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def rule_score(rules: Rules, base: float = 50.0, high: float = 100.0) -> Column:
    """Base plus the points of every group, between 0 and ``high``."""
    return clamp(sum((first_of(g) for g in rules), F.lit(float(base))), high=high)


def by_side(long: Column, short: Column) -> Column:
    return F.when(F.col("side") == "LONG", long).otherwise(short)


def component_scores(df: DataFrame) -> DataFrame:
    """slow, fast, value, volume, catalyst and penalty of each (symbol, side).

    Volume is 50 where its ratio isn't known; the catalyst mixes the sentiment
    in the side's direction with volume."""
    d = df.withColumn("vr", F.coalesce("vr_d", "vr_h"))
    d = d.withColumn("slow", by_side(rule_score(TECH_LONG_SLOW), rule_score(TECH_SHORT_SLOW))).withColumn("fast", by_side(rule_score(TECH_LONG_FAST), rule_score(TECH_SHORT_FAST)))
    d = d.withColumn("value", by_side(rule_score(VALUE_LONG), rule_score(VALUE_SHORT))).withColumn("volume_score", by_side(first_of(VOLUME_LONG, 50), first_of(VOLUME_SHORT, 50)))
    d = d.withColumn("_s", by_side(F.col("sentiment"), 100 - F.col("sentiment")))
    d = d.withColumn("catalyst", F.least(F.lit(100.0), F.col("_s") * 0.6 + F.col("volume_score") * 0.4))
    return d.withColumn("penalty", by_side(rule_score(RISK_LONG, 0, 30), rule_score(RISK_SHORT, 0, 30))).drop("_s")


def final_score(components: DataFrame) -> DataFrame:
    """The weighted sum less the penalty, capped by the quality of the evidence
    (``evidence``: REJECT, WEAK, SECTOR or anything else), between 0 and 100."""

    def weighted(weights: dict[str, float], sentiment: Column) -> Column:
        parts = {"sentiment": sentiment, "volume": F.col("volume_score")}
        return sum(parts.get(k, F.col(k)) * w for k, w in weights.items())

    raw = by_side(weighted(WEIGHTS_LONG, F.col("sentiment")) + PAIR_SHARE, weighted(WEIGHTS_SHORT, 100 - F.col("sentiment"))) - F.col("penalty")
    cap = F.lit(100.0)
    for label, most in EVIDENCE_CAPS.items():
        cap = F.when(F.col("evidence") == label, most).otherwise(cap)
    return components.withColumn("final", clamp(F.least(raw, cap)))


def style(df: DataFrame) -> DataFrame:
    """What kind of trade the components describe."""
    rsi = F.col("rsi_h")
    cheap = (F.col("value") >= 65) & F.coalesce((F.col("pe") < 15) | (F.col("pb") < 1.0), F.lit(False))
    breakout = (F.col("fast") >= 65) & (F.col("volume_score") >= 65) & (rsi.isNull() | rsi.between(45, 65))
    long = F.when(cheap, F.when(F.col("slow") >= 55, "VALUE_REBOUND").otherwise("TURNAROUND")).when(breakout, "BREAKOUT").when(F.col("catalyst") >= 60, "SECTOR_BENEFIT").otherwise("VALUE_REBOUND")
    hot = (rsi > 70) & (F.col("fast") >= 60)
    short = F.when(hot, F.when(F.col("value") >= 60, "OVERHEAT").otherwise("DISTRIBUTION")).when(F.col("catalyst") >= 60, "CATALYST")
    short = short.when((F.col("slow") >= 60) & (F.col("fast") >= 60), "BREAKDOWN").otherwise("OVERHEAT")
    return df.withColumn("style", by_side(long, short))


def atr_zones(df: DataFrame) -> DataFrame:
    """entry, invalidation and target: 1 and 1.5 ATR from the close, else percents
    (4 and 5 for LONG, 3 and 5 for SHORT).  An ATR of zero counts as missing."""
    c, a = F.col("close"), F.when(F.col("atr") != 0, F.col("atr"))
    d = df.withColumn("entry", by_side(c * 0.99, c * 1.005))
    d = d.withColumn("invalidation", by_side(F.coalesce(c - a, c * 0.96), F.coalesce(c + a, c * 1.03)))
    return d.withColumn("target", by_side(F.coalesce(c + 1.5 * a, c * 1.05), F.coalesce(c - 1.5 * a, c * 0.95)))


def price_scale_guard(df: DataFrame) -> DataFrame:
    """Bars that contradict the latest price (outside 0.5 to 1.5 of it; where
    there is none, fast and slow closes outside 0.5 to 2.0 of each other) cap the
    technical scores at 30 and the final one at 59, and clear the zones."""
    off = lambda a, b, low, high: F.coalesce(F.when((a > 0) & (b > 0), (a / b < low) | (a / b > high)), F.lit(False))
    latest, slow, fast = F.col("latest"), F.col("close_d"), F.col("close_h")
    bad = F.when(latest > 0, off(fast, latest, 0.5, 1.5) | off(slow, latest, 0.5, 1.5)).otherwise(off(fast, slow, 0.5, 2.0))
    d = df.withColumn("scale_warning", bad)
    for name, most in (("slow", 30.0), ("fast", 30.0), ("final", 59.0)):
        d = d.withColumn(name, F.when(F.col("scale_warning"), F.least(F.col(name), F.lit(most))).otherwise(F.col(name)))
    for name in ("entry", "invalidation", "target"):
        d = d.withColumn(name, F.when(~F.col("scale_warning"), F.col(name)))
    return d


def repeat_penalty(picks: DataFrame, counts: DataFrame, step: float = 8.0) -> DataFrame:
    """SHORT picks lose ``step`` points for every repeat after the first."""
    d = picks.join(counts, ["symbol", "side"], "left")
    lost = F.when((F.col("side") == "SHORT") & (F.col("repeats") >= 2), step * (F.col("repeats") - 1)).otherwise(0.0)
    return d.withColumn("final", F.greatest(F.lit(0.0), F.col("final") - lost))


def mark_speculative(picks: DataFrame, main: float = 70.0, floor_us: float = 5e6, floor_kr: float = 2e9) -> DataFrame:
    """Speculative: below the main threshold, or a known turnover under the market's floor."""
    thin = F.col("turnover") < F.when(F.col("market") == "KR", floor_kr).otherwise(floor_us)
    return picks.withColumn("speculative", (F.col("final") < main) | F.coalesce(thin, F.lit(False)))


def pair_score(df: DataFrame) -> Column:
    """0 to 100 from the source's move, the target's lag behind it, history,
    correlation, kinship and volume; unknown parts give nothing."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    gap = first_of([("gap_class = 'NOT_YET'", 28), ("gap_class = 'WEAKNESS_NOT_YET'", 22), ("gap_class = 'PARTIAL'", 12), ("gap_class = 'ALREADY'", -20), ("gap_class in ('CURRENT_MISMATCH', 'MISMATCH')", -15)])
    parts = [
        F.least(F.lit(30.0), 4 * F.abs("source_return")), first_of([("source_volume >= 1.2", 5)]), gap,
        F.least(F.lit(8.0), 12 * F.col("cond_prob")), F.when(F.col("lift") > 1, F.least(F.lit(7.0), 6 * (F.col("lift") - 1))),
        F.when(F.col("correlation") > 0, F.least(F.lit(10.0), 12 * F.col("correlation"))),
        first_of([("source_sector = target_sector", 3)]), first_of([("target_volume >= 1.0", 3)]),
    ]
    return clamp(sum((zero(p) for p in parts), F.lit(0.0)))


def theme_role(df: DataFrame) -> Column:
    """VICTIM, OVERHEATED, LAGGING or LEADER, in that order."""
    surge = (F.col("return_pct") >= 3) & (F.coalesce(F.col("rsi") >= 72, F.lit(False)) | F.coalesce(F.col("volume_ratio") >= 2.5, F.lit(False)))
    moved = (F.col("return_pct") >= 1.5) & F.coalesce(F.col("volume_ratio") >= 1.3, F.lit(False))
    return (
        F.when(F.col("victim") | (F.coalesce("side", F.lit("")) == "SHORT"), "VICTIM").when(surge, "OVERHEATED")
        .when(F.col("lagging") & ((F.col("return_pct") < 1.5) | ~moved), "LAGGING").otherwise("LEADER")
    )


def theme_score(price: Column, volume: Column, scenario: Column, evidence: Column, mentions: Column) -> Column:
    p, v = clamp(50 + 5 * price), F.least(F.lit(100.0), 50 * volume)
    raw = 0.30 * p + 0.20 * v + 0.25 * scenario + 0.15 * F.least(F.lit(100.0), 20 * evidence) + 0.10 * F.least(F.lit(100.0), 10 * mentions)
    return clamp(raw)


def sections(cands: DataFrame, k: int = 5) -> DataFrame:
    """section, symbol, place: each candidate in every section that it belongs
    to, the top k of each; one leader a sector."""
    role, hot = F.col("role"), F.col("volume_ratio") >= 1.4
    names = F.array_compact(F.array(
        F.when((F.col("return_pct") >= 2) & hot & (role != "VICTIM"), "surge"), F.when((F.col("return_pct") <= -2) & hot, "crash"), F.when(role == "VICTIM", "victim"),
        F.when(role == "LAGGING", "lagging"), F.when(role.isin("LAGGING", "LEADER"), "beneficiary"), F.when(role == "OVERHEATED", "overheated"), F.when(role.isin("LEADER", "OVERHEATED"), "leader"),
    ))
    best = Window.partitionBy("section", F.when(F.col("section") == "leader", F.col("sector")).otherwise(F.col("symbol").cast("string"))).orderBy(F.desc("theme_score"), "symbol")
    d = cands.withColumn("section", F.explode(names)).withColumn("_n", F.row_number().over(best)).where("_n = 1")
    # a partial top k first, so that no section is sorted whole in one task
    local = Window.partitionBy("section", F.pmod(F.xxhash64("symbol"), F.lit(64))).orderBy(F.desc("theme_score"), "symbol")
    d = d.withColumn("_n", F.row_number().over(local)).where(F.col("_n") <= k)
    place = F.row_number().over(Window.partitionBy("section").orderBy(F.desc("theme_score"), "symbol"))
    return d.withColumn("place", place).where(F.col("place") <= k).drop("_n")


# Conditions and points of the setup scores (before a surge, before a crash).
SURGE_SETUP: Rules = [
    [("rsi_h between 45 and 65", 20), ("rsi_h < 40", 10), ("rsi_h > 80", -20)],
    [("obv_h = 'UP'", 25), ("obv_h = 'DOWN'", -10)],
    [("bb_h between 0.4 and 0.65", 20), ("bb_h > 0.85", 5), ("bb_h < 0.15", 5)],
    [("vr_h >= 2.0", 20), ("vr_h >= 1.5", 15)],
    [("strong_reason", 15)],
    [("return_pct > 15", -10)],
]
CRASH_SETUP: Rules = [
    [("rsi_h > 80", 25), ("rsi_h > 70", 20)],
    [("obv_h = 'DOWN'", 25), ("obv_h = 'UP'", -15)],
    [("bb_h > 0.85", 20), ("bb_h < 0.35", 15)],
    [("vr_h >= 1.3", 10)],
    [("weak_reason", 15)],
]


def setup_scores(df: DataFrame) -> DataFrame:
    """surge and crash: how ready a symbol is for either; an oversold one can't crash."""
    crash = F.when(F.col("rsi_h") < 30, 0.0).otherwise(rule_score(CRASH_SETUP, 0))
    return df.withColumn("surge", rule_score(SURGE_SETUP, 0)).withColumn("crash", crash)


def decide_side(df: DataFrame, least: float = 45.0, hot: float = 85.0) -> Column:
    """LONG, SHORT or WATCH of a candidate: mood, score, direct (evidence count),
    rsi, trend, obv, catalysts and risks (counts).

    Without direct evidence nothing is traded; an overheated symbol isn't
    bought; what rises on rising volume isn't sold."""
    enough = F.col("score") >= least
    cool = F.coalesce(F.col("rsi") < hot, F.lit(True))
    trend, obv = F.coalesce("trend", F.lit("")), F.coalesce("obv", F.lit(""))
    buy = (F.col("mood") == "positive") & enough & cool
    sell = (F.col("mood") == "negative") & ((enough & (trend != "UP")) | ((trend == "DOWN") & (obv == "DOWN")))
    torn = (F.col("mood") == "mixed") & enough & cool
    long = F.when(F.col("direct") <= 0, "WATCH").when(buy | (torn & (F.col("catalysts") > F.col("risks"))), "LONG")
    return long.when(sell | (torn & (F.col("risks") > F.col("catalysts")) & (trend == "DOWN")), "SHORT").otherwise("WATCH")


def price_levels(df: DataFrame) -> DataFrame:
    """entry_low, entry_high, stop and target from the bands where they are
    known, else from support, resistance and ATR (5, 10 and 2 % of the close
    where those are missing)."""
    c = F.col("close")
    part = lambda name, share: F.coalesce(F.nullif(F.col(name), F.lit(0.0)), c * share)
    support, resistance, atr = part("support", 0.95), part("resistance", 1.10), part("atr", 0.02)
    bands = F.col("bb_mid").isNotNull() & F.col("bb_up").isNotNull() & F.col("bb_low").isNotNull()
    return (
        df.withColumn("entry_low", F.when(bands, F.col("bb_low") * 1.005).otherwise(support * 0.99))
        .withColumn("entry_high", F.when(bands, F.col("bb_mid")).otherwise(F.least(c * 1.01, resistance * 0.97)))
        .withColumn("stop", F.when(bands, F.col("bb_low") * 0.985).otherwise(support - atr))
        .withColumn("target", F.when(bands, F.col("bb_up")).otherwise(resistance))
    )
