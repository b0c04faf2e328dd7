"""Macro guard and regime, surges, market hours, and what is asked of symbols and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.scores import first_of

# Conditions on the macro columns and their points for LONG and defensive picks.
GUARD_LONG = [
    [("fear_greed >= 75", -5), ("fear_greed <= 30", 3)], [("us10y >= 4.5", -8), ("us10y <= 3.8", 5)], [("vix >= 25", -5)],
    [("dollar >= 103", -3)], [("oil >= 85", -2)], [("hot_sectors >= 2", -3)],
]
GUARD_DEFENSIVE = [[("fear_greed >= 75", 0), ("fear_greed <= 30", 3)], [("us10y >= 4.5", 5)]]
# Signals of fear and of greed; rates change in basis points, the rest in percent.
FEAR = [[("vix > 25", 2)], [("us10y_chg > 15", 2)], [("dxy_chg > 0.8", 1)], [("sp500_chg < -1.0", 1)], [("wti_chg > 3.0", 1)], [("gold_chg > 1.5", 1)]]
GREED = [[("vix < 18", 1)], [("us10y_chg < -15", 1)], [("dxy_chg < -0.8", 1)], [("sp500_chg > 0.5", 1)]]
# Codes of what the macro figures say, in order; of a group the first that holds.
READINGS = [
    [("vix > 30", "VIX_FEAR"), ("vix > 25", "VIX_ALERT"), ("vix < 14", "VIX_CALM")],
    [("us10y is not null and us10y_chg > 15", "RATE_SPIKE"), ("us10y is not null and us10y_chg < -15", "RATE_DROP")],
    [("usd_krw is not null and usd_krw_chg > 1.0", "WON_WEAK"), ("usd_krw is not null and usd_krw_chg < -1.0", "WON_STRONG")],
    [("dxy_chg > 0.8", "DOLLAR_STRONG"), ("dxy_chg < -0.8", "DOLLAR_WEAK")],
    [("wti is not null and wti_chg > 3.0", "OIL_SPIKE"), ("wti is not null and wti_chg < -3.0", "OIL_DROP")],
    [("gold_chg > 1.5", "GOLD_UP"), ("gold_chg < -1.5", "GOLD_DOWN")],
    [("coalesce(sp500_chg, 0) < -1.5 and coalesce(kospi_chg, 0) < -1.5", "BOTH_DOWN"), ("coalesce(sp500_chg, 0) > 1.0 and coalesce(kospi_chg, 0) > 0.5", "BOTH_UP"), ("kospi_chg < -3.0", "KOSPI_DROP"), ("sp500_chg < -2.0", "SP500_DROP")],
]
# Scores of unpriced targets by relation.
UNPRICED = {"BENEFICIARY": 75.0, "SUPPLY_CHAIN_COST": 75.0, "VICTIM": 75.0, "LAGGING_BENEFICIARY": 65.0}


def points(rules: list) -> Column:
    return sum((first_of(g) for g in rules), F.lit(0.0))


def macro_guard(macro: DataFrame) -> DataFrame:
    """``macro`` with long_adj, defensive_adj and the risk level that follows from the first."""
    d = macro.withColumn("long_adj", points(GUARD_LONG)).withColumn("defensive_adj", points(GUARD_DEFENSIVE))
    return d.withColumn("risk_level", F.when(F.col("long_adj") <= -12, "HIGH").when(F.col("long_adj") <= -5, "MEDIUM").otherwise("LOW"))


def macro_regime(macro: DataFrame) -> DataFrame:
    """``macro`` with fear, greed, the regime and the first five readings."""
    d = macro.withColumn("fear", points(FEAR)).withColumn("greed", points(GREED))
    regime = F.when(F.col("fear") >= 3, "RISK_OFF").when((F.col("greed") >= 2) & (F.col("fear") == 0), "RISK_ON").otherwise("NEUTRAL")
    codes = [F.coalesce(*(F.when(F.expr(cond), code) for cond, code in group)) for group in READINGS]
    return d.withColumn("regime", regime).withColumn("readings", F.array_join(F.slice(F.array_compact(F.array(*codes)), 1, 5), ","))


def market_mood(candidates: DataFrame, mean_sentiment: Column) -> DataFrame:
    """up, down, mood over all candidates (return_1d, role): victims don't count as up."""
    g = candidates.agg(F.count("*").alias("n"), F.count_if((F.col("return_1d") >= 1.0) & (F.col("role") != "VICTIM")).alias("up"), F.count_if(F.col("return_1d") <= -1.0).alias("down"), F.coalesce(F.avg(mean_sentiment), F.lit(50.0)).alias("sentiment"))
    mood = F.when(F.col("n") == 0, "MIXED").when((F.col("up") > F.col("down") * 2) & (F.col("sentiment") > 60), "RISK_ON").when((F.col("down") > F.col("up") * 2) | (F.col("sentiment") < 40), "DEFENSIVE").otherwise("MIXED")
    return g.select("up", "down", "sentiment", mood.alias("mood"))


def range_summary(df: DataFrame, value: str, at: str, *keys: str) -> DataFrame:
    """latest, low, high, n of a figure over a period; nulls don't count."""
    d = df.where(F.col(value).isNotNull())
    return d.groupBy(*keys).agg(F.max_by(value, at).alias("latest"), F.min(value).alias("low"), F.max(value).alias("high"), F.count("*").alias("n"))


def classify_catalyst(text: Column, volume_ratio: Column, keywords: list[tuple[str, list[str], float]]) -> tuple[Column, Column]:
    """The catalyst of the highest confidence whose keyword the text holds, the first of equals,
    and the confidence; without any, volume alone and what its ratio is worth."""
    low = F.lower(F.coalesce(text, F.lit("")))
    found = [F.when(F.greatest(*(F.instr(low, w.lower()) for w in words), F.lit(0)) > 0, F.struct(F.lit(conf).alias("c"), F.lit(-k).alias("o"), F.lit(kind).alias("k"))) for k, (kind, words, conf) in enumerate(keywords)]
    best = F.array_max(F.array_compact(F.array(*found)))
    alone = F.when(volume_ratio >= 3.0, 0.35).when(volume_ratio >= 2.0, 0.25).otherwise(0.15)
    return F.coalesce(best["k"], F.lit("volume_surge_only")), F.coalesce(best["c"], alone)


def unpriced_score(relation: Column, gap: Column, confidence: Column, catalyst: Column) -> Column:
    base = F.coalesce(*(F.when(relation == k, v) for k, v in UNPRICED.items()), F.lit(60.0))
    return base + F.least(gap * 1.5, F.lit(15.0)) + confidence * 10 - F.when(catalyst == "volume_surge_only", 10.0).otherwise(0.0)


def surge_scan(moves: DataFrame, texts: DataFrame, edges: DataFrame, keywords: list[tuple[str, list[str], float]], threshold: float = 5.0, sensitivity: float = 0.6, least_gap: float = 2.0) -> DataFrame:
    """source, direction, catalyst, confidence and, for each target that has not followed yet, its gap and score.

    ``moves`` has symbol, return_pct and volume_ratio, ``texts`` what was said of a symbol,
    ``edges`` source, target and relation.  Surges without such a target stay with a null one."""
    kind, conf = classify_catalyst(F.col("text"), F.col("volume_ratio"), keywords)
    hot = moves.where(F.abs("return_pct") >= threshold).join(texts, "symbol", "left")
    hot = hot.select(F.col("symbol").alias("source"), "return_pct", F.when(F.col("return_pct") > 0, "BULLISH").otherwise("BEARISH").alias("direction"), kind.alias("catalyst"), conf.alias("confidence"))
    t = moves.select(F.col("symbol").alias("target"), F.col("return_pct").alias("target_return"))
    gap = F.abs("return_pct") * sensitivity - F.abs("target_return")
    led = hot.join(edges, "source").join(t, "target").withColumn("gap", gap).where(F.col("gap") >= least_gap)
    led = led.select("source", "target", "gap", unpriced_score(F.col("relation"), F.col("gap"), F.col("confidence"), F.col("catalyst")).alias("score"))
    return hot.join(led, "source", "left")


def is_open(ts: Column, market: Column) -> Column:
    """Whether the market is open at ``ts`` in UTC, Monday to Friday: KR 00:00-06:30, US 13:30-20:30,
    any other name: either."""
    hour = F.hour(ts) + F.minute(ts) / 60.0
    kr, us = hour < 6.5, (hour >= 13.5) & (hour < 20.5)
    return F.dayofweek(ts).between(2, 6) & F.when(market == "KR", kr).when(market == "US", us).otherwise(kr | us)


def market_of(symbol: Column) -> Column:
    return F.when(symbol.endswith(".KS") | symbol.endswith(".KQ"), "KR").otherwise("US")


def canonical_symbol(c: Column) -> Column:
    """Upper case without a $ mark; six digits get .KS, a .US suffix goes, shorter digits are padded to six."""
    c = F.upper(F.trim(F.regexp_replace(c, r"^\$", "")))
    c = F.regexp_replace(c, r"\.US$", "")
    return F.when(c.rlike(r"^\d{1,6}$"), F.concat(F.lpad(c, 6, "0"), F.lit(".KS"))).otherwise(c)


def resolve_symbol(asked: DataFrame, dim: DataFrame) -> DataFrame:
    """query, symbol: by code, else exact name, else the shortest name that begins with the query; null without any.

    Names meet queries in equi joins over their beginnings, so long lists of either are fine."""
    q = asked.select("query", F.lower(F.trim("query")).alias("q"))
    s = dim.select("symbol", F.col("symbol").cast("string").alias("code"), F.lower("name").alias("n"))
    by_code = q.join(s, q.q == F.lower("code")).select("query", F.lit(0).alias("o"), F.lit(0).alias("len"), "symbol")
    by_name = q.join(s, q.q == s.n).select("query", F.lit(1).alias("o"), F.lit(0).alias("len"), "symbol")
    heads = s.where("length(n) > 0").select("symbol", "n", F.explode(F.expr("transform(sequence(1, length(n)), k -> substring(n, 1, k))")).alias("h"))
    by_part = q.join(heads, q.q == heads.h).select("query", F.lit(2).alias("o"), F.length("n").alias("len"), "symbol")
    best = by_code.unionByName(by_name).unionByName(by_part).groupBy("query").agg(F.min(F.struct("o", "len", "symbol"))["symbol"].alias("symbol"))
    return asked.select("query").distinct().join(best, "query", "left")


def tag_watchlist(df: DataFrame, watchlist: DataFrame) -> DataFrame:
    """``df`` without avoided symbols, with the group of watched ones."""
    avoid = watchlist.where("avoid").select("symbol").distinct()
    group = watchlist.where("not avoid").groupBy("symbol").agg(F.min("group").alias("watch_group"))
    return df.join(avoid, "symbol", "left_anti").join(group, "symbol", "left")


def upcoming(events: DataFrame, asof: Column, back: int = 0, ahead: int = 14, importance: str = "high") -> DataFrame:
    """Events from ``back`` days before to ``ahead`` days after ``asof``, with days_away; ``high`` leaves medium ones out."""
    d = events.withColumn("days_away", F.datediff("date", asof)).where(F.col("days_away").between(-back, ahead))
    return d.where("importance <> 'medium'") if importance == "high" else d


def data_quality(market: Column, source: Column, has_fundamentals: Column) -> Column:
    s = F.lower(F.coalesce(source, F.lit("")))
    kr = (market == "KR") & (s.contains("pykrx") | s.contains("fdr") | s.contains("financedatareader"))
    return F.when(kr, "high").when(s.contains("yfinance"), F.when(has_fundamentals, "high").otherwise("medium")).otherwise("low")


def backlog_boost(events: DataFrame, asof: Column, days: int = 60) -> DataFrame:
    """symbol, tier, boost of the best tier within ``days``."""
    rank = F.when(F.col("tier") == "HIGH", 3).when(F.col("tier") == "MEDIUM", 2).otherwise(1)
    g = events.where(F.datediff(asof, "date").between(0, days)).groupBy("symbol").agg(F.max(rank).alias("r"))
    pick = lambda *v: F.element_at(F.array(*map(F.lit, v)), F.col("r"))
    return g.select("symbol", pick("LOW", "MEDIUM", "HIGH").alias("tier"), pick(3.0, 8.0, 15.0).alias("boost"))


def audit_backlog(events: DataFrame, asof: Column) -> DataFrame:
    """finding, n: stored amounts shown as new, a share of low confidence above 70 % among the rest, and amounts beyond reason."""
    e = events.withColumn("age", F.datediff(asof, "date")).where("age between 0 and 30")
    g = e.agg(F.count_if((F.col("age") <= 1) & (F.col("source") == "STATIC")).alias("fresh"), F.count_if(F.col("source") != "STATIC").alias("rest"),
              F.count_if((F.col("source") != "STATIC") & (F.coalesce("confidence", F.lit("LOW")) == "LOW")).alias("low"), F.count_if(F.col("amount") > 50_000_000).alias("far"))
    out = g.select(F.expr("stack(3, 'static_as_new', fresh, 'low_confidence_ratio', if(rest > 0 and low / rest > 0.7, low, 0), 'amount_outlier', far) as (finding, n)"))
    return out.where("n > 0")


def position_summary(positions: DataFrame, asof: Column, days: int = 30, most: int = 50) -> DataFrame:
    """closed, wins, win_rate, mean_return of each book's latest closed positions."""
    d = positions.where((F.col("status") != "open") & (F.datediff(asof, "exit_at") < days))
    d = d.withColumn("_n", F.row_number().over(Window.partitionBy("book").orderBy(F.desc("exit_at"), "id"))).where(F.col("_n") <= most)
    r = F.coalesce("return_pct", F.lit(0.0))
    return d.groupBy("book").agg(F.count("*").alias("closed"), F.count_if(r > 0).alias("wins"), (F.count_if(r > 0) / F.count("*") * 100).alias("win_rate"), F.avg(r).alias("mean_return"))
