"""Lead-lag relations between securities, movers and live pair signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import indicators as ind
from tidemark.operators.asof import event_forward
from tidemark.sources.shared import checkpointed


def movers(bars: DataFrame, symbols: DataFrame, us: float = 4.0, kr: float = 5.0) -> DataFrame:
    """Latest bars whose 1-bar return passes the market's threshold."""
    d = ind.volume_ratios(ind.pct_change(bars, 1))
    d = d.withColumn("_n", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts")))).where("_n = 1")
    d = d.join(symbols, "symbol").where(F.abs("pct1") >= F.when(F.col("market") == "KR", kr).otherwise(us))
    return d.select("symbol", "name", "sector", "market", "close", F.col("pct1").alias("return_pct"), F.col("vr_prev20").alias("volume_ratio"), F.when(F.col("pct1") > 0, "UP").otherwise("DOWN").alias("direction"))


def correlations(bars: DataFrame, edges: DataFrame) -> DataFrame:
    """Correlation of 1-bar returns over common days of each edge (source, target)."""
    r = ind.pct_change(bars, 1).where("pct1 is not null").select("symbol", "ts", "pct1")
    a = r.select(F.col("symbol").alias("source"), "ts", F.col("pct1").alias("x"))
    b = r.select(F.col("symbol").alias("target"), "ts", F.col("pct1").alias("y"))
    return edges.join(a, "source").join(b, ["target", "ts"]).groupBy("source", "target").agg(F.corr("x", "y").alias("correlation"), F.count("*").alias("n"))


def confidence(n: Column, prob: Column, lift: Column) -> Column:
    return F.when((n >= 20) & (prob >= 0.6) & (lift >= 1.3), "high").when((n >= 10) & (prob >= 0.55) & (lift >= 1.15), "medium").otherwise("low")


def pair_confidence(events: Column, prob: Column, lift: Column, volume_ratio: Column) -> Column:
    """Confidence of a live pair: its history, and for high also the source's volume; without any history low."""
    e, p, l_, v = (F.coalesce(c, F.lit(0.0)) for c in (events.cast("double"), prob, lift, volume_ratio))
    return F.when((e >= 20) & (p >= 0.6) & (l_ >= 1.5) & (v >= 1.2), "high").when((e > 0) | (p > 0) | (l_ > 1.0), "medium").otherwise("low")


def relation_type(move: Column, direction: Column) -> Column:
    return F.concat(move, F.lit("_LEADS_"), direction)


def leadlag(
    bars: DataFrame, symbols: DataFrame, edges: DataFrame, lags: tuple[int, ...] = (1, 2, 3), event: tuple[float, float] = (5.0, 7.0),
    hit: tuple[float, float] = (1.5, 2.0), least_events: int = 5, least_prob: float = 0.5, least_lift: float = 1.05,
) -> DataFrame:
    """Event study over all edges at once; thresholds are (US, KR).

    An event is a source day beyond the event threshold.  A target hits when its
    close ``lag`` bars later stands beyond the hit threshold, up or down.
    cond_prob is the share of events that hit, base_prob the share of all the
    target's 1-bar returns that would (0.01 at least), lift their ratio.  The best lag
    and direction of each (source, target, move) stays."""
    by_market = lambda pair: F.when(F.col("market") == "KR", pair[1]).otherwise(pair[0])
    m, bars = symbols.select("symbol", "market"), checkpointed(bars.select("symbol", "ts", "close"))  # read by returns, bases and ends
    r = ind.pct_change(bars, 1).where("pct1 is not null").select("symbol", "ts", "pct1").join(m, "symbol")
    shocks = r.where(F.abs("pct1") >= by_market(event)).select(F.col("symbol").alias("source"), "ts", F.when(F.col("pct1") > 0, "UP").otherwise("DOWN").alias("move"))
    asked = shocks.join(edges.select("source", F.col("target").alias("symbol")), "source")
    moved = event_forward(asked, bars, list(lags)).withColumn("fwd", (F.col("forward") / F.col("base") - 1) * 100).join(m, "symbol")
    up, down = F.col("fwd") >= by_market(hit), F.col("fwd") <= -by_market(hit)
    stats = moved.groupBy("source", F.col("symbol").alias("target"), "move", "lag").agg(
        F.count("*").alias("events"), F.avg(up.cast("double")).alias("UP"), F.avg(down.cast("double")).alias("DOWN"), F.avg("fwd").alias("mean_forward"))
    base = r.groupBy(F.col("symbol").alias("target")).agg(
        F.greatest(F.lit(0.01), F.avg((F.col("pct1") >= by_market(hit)).cast("double"))).alias("base_up"),
        F.greatest(F.lit(0.01), F.avg((F.col("pct1") <= -by_market(hit)).cast("double"))).alias("base_down"))
    long = stats.select("*", F.expr("stack(2, 'UP', `UP`, 'DOWN', `DOWN`) as (direction, cond_prob)")).join(base, "target")
    long = long.withColumn("base_prob", F.when(F.col("direction") == "UP", F.col("base_up")).otherwise(F.col("base_down"))).withColumn("lift", F.col("cond_prob") / F.col("base_prob"))
    good = long.where((F.col("events") >= least_events) & (F.col("cond_prob") >= least_prob) & (F.col("lift") >= least_lift))
    best = Window.partitionBy("source", "target", "move").orderBy(F.desc("lift"), F.desc("cond_prob"), F.desc("events"), "lag", "direction")
    good = good.withColumn("_n", F.row_number().over(best)).where("_n = 1")
    return good.select("source", "target", relation_type(F.col("move"), F.col("direction")).alias("relation"), "lag", "events", "cond_prob", "base_prob", "lift", "mean_forward", confidence(F.col("events"), F.col("cond_prob"), F.col("lift")).alias("confidence"))


def primary_return(r4: Column, r1: Column) -> Column:
    """The return over four hours, else over a day, else 0."""
    return F.coalesce(r4, r1, F.lit(0.0))


def gap_class(direction: Column, source: Column, target: Column, target_4h: Column, target_1d: Column) -> Column:
    """How a target has answered its source's move, seen from the rule's direction.

    A rising source lets a target rise unless the rule is UP_LEADS_DOWN; a falling one
    lets it fall.  Returns are in percent; a null ``target_4h`` or ``target_1d`` isn't below zero."""
    rises = (source > 0) & ~direction.contains("UP_LEADS_DOWN")
    both_down = F.coalesce((target_4h < 0) & (target_1d < 0), F.lit(False))
    up = F.when(target >= 3.0, "ALREADY").when(both_down, "CURRENT_MISMATCH").when(target < -1.0, "MISMATCH").when(target <= 1.0, "NOT_YET").otherwise("PARTIAL")
    down = F.when(target > 1.0, "MISMATCH").when(target >= -1.0, "WEAKNESS_NOT_YET").when(target <= -3.0, "ALREADY").otherwise("PARTIAL")
    return F.when(rises, up).otherwise(down)


def unpriced(moves: DataFrame, edges: DataFrame, sensitivity: float = 0.6, least_gap: float = 2.0) -> DataFrame:
    """Targets of moving sources whose own move leaves a gap of at least ``least_gap``."""
    s = moves.select(F.col("symbol").alias("source"), F.col("return_pct").alias("source_return"))
    t = moves.select(F.col("symbol").alias("target"), F.col("return_pct").alias("target_return"))
    d = edges.join(s, "source").join(t, "target").withColumn("gap", F.abs("source_return") * sensitivity - F.abs("target_return"))
    return d.where(F.col("gap") >= least_gap).select("source", "target", "source_return", "target_return", "gap")
