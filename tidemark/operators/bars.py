"""Bars out of trades, and snapshots of bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.indicators import by_time, rows


def resample(trades: DataFrame, hours: int, zone: str = "UTC") -> DataFrame:
    """Trades (symbol, ts, id, price) as bars of ``hours``, in bins that start at
    midnight of ``zone``; bins without trades don't exist."""
    local = F.from_utc_timestamp("ts", zone)
    start = F.date_trunc("day", local) + F.make_dt_interval(hours=(F.floor(F.hour(local) / hours) * hours).cast("int"))
    at = F.struct("ts", "id", "price")
    return trades.groupBy("symbol", start.alias("bin")).agg(
        F.min(at)["price"].alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max(at)["price"].alias("close"), F.count("*").alias("volume")
    ).withColumnRenamed("bin", "ts")


def latest_snapshot(bars: DataFrame) -> DataFrame:
    change = lambda n: (F.col("close") / F.lag("close", n).over(by_time()) - 1) * 100
    d = bars.select("symbol", "ts", "close", *[change(n).alias(f"change_{n}") for n in (1, 5, 20)], (F.col("volume") / F.avg("volume").over(rows(-20, -1))).alias("volume_ratio"))
    return d.withColumn("_n", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts")))).where("_n = 1").drop("_n")


def coarsen(bars: DataFrame, days: int) -> DataFrame:
    """Daily bars as bars of ``days`` calendar days, counted from 1970-01-01;
    each has the time of its last day."""
    slot = F.floor(F.datediff("ts", F.lit("1970-01-01").cast("date")) / days).alias("_slot")
    return bars.groupBy("symbol", slot).agg(
        F.max("ts").alias("ts"), F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume")
    ).drop("_slot")


def latest_quotes(bars: DataFrame) -> DataFrame:
    """symbol, close, return_1d, return_4h (of the last bar itself), rsi (14 changes, simple
    means), volume_ratio (to the 20 bars before) and obv (the sign of the last 4 flows).

    Bars beyond the last 21 of a symbol are cut before anything is computed."""
    w = Window.partitionBy("symbol").orderBy(F.desc("ts"))
    d = bars.withColumn("n", F.row_number().over(w)).where("n <= 22").withColumn("prev", F.lead("close").over(w)).where("n <= 21")
    at = lambda cond, v: F.when(F.expr(cond), v)
    change = F.col("close") - F.col("prev")
    g = d.groupBy("symbol").agg(
        F.max(at("n = 1", F.col("close"))).alias("close"), F.max(at("n = 1 and prev <> 0", (F.col("close") / F.col("prev") - 1) * 100)).alias("return_1d"),
        F.max(at("n = 1 and open <> 0", (F.col("close") / F.col("open") - 1) * 100)).alias("return_4h"),
        F.avg(at("n <= 14 and prev is not null", F.greatest(change, F.lit(0.0)))).alias("gain"), F.avg(at("n <= 14 and prev is not null", F.greatest(-change, F.lit(0.0)))).alias("loss"), F.count(at("n <= 14", F.col("prev"))).alias("known"),
        F.try_divide(F.max(at("n = 1", F.col("volume"))), F.avg(at("n between 2 and 21", F.col("volume")))).alias("volume_ratio"), F.sum(at("n <= 4", F.col("volume") * F.signum(change))).alias("flow"))
    rsi = F.when((F.col("known") == 14) & (F.col("loss") > 0), 100 - 100 / (1 + F.col("gain") / F.col("loss")))
    return g.select("symbol", "close", "return_1d", "return_4h", rsi.alias("rsi"), "volume_ratio", F.when(F.col("flow") > 0, "UP").when(F.col("flow") < 0, "DOWN").otherwise("FLAT").alias("obv"))
