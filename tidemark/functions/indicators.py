"""Technical indicators over bars (symbol, ts, open, high, low, close, volume).

Every function adds columns for every bar; "latest" is a filter of the result.
All of them share one window by symbol, so Spark sorts the bars once however
many are chained.  A value is null until its window is full ("need n").
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def by_time():
    return Window.partitionBy("symbol").orderBy("ts")


def rows(first: int, last: int = 0):
    return by_time().rowsBetween(first, last)


def full(value: Column, n: int, of: str = "close") -> Column:
    """``value`` where the last n bars have ``of``."""
    return F.when(F.count(of).over(rows(1 - n)) == n, value)


def sma(bars: DataFrame, n: int) -> DataFrame:
    return bars.withColumn(f"sma{n}", full(F.avg("close").over(rows(1 - n)), n))


def rsi(bars: DataFrame, n: int = 14) -> DataFrame:
    """Simple-mean form; null until n changes are known or where no bar lost."""
    d = bars.withColumn("_d", F.col("close") - F.lag("close").over(by_time()))
    gain = F.avg(F.greatest("_d", F.lit(0.0))).over(rows(1 - n))
    loss = F.avg(F.greatest(-F.col("_d"), F.lit(0.0))).over(rows(1 - n))
    d = d.withColumn("_g", full(gain, n, "_d")).withColumn("_l", F.when(full(loss, n, "_d") > 0, loss))
    return d.withColumn("rsi", 100 - 100 / (1 + F.col("_g") / F.col("_l"))).drop("_d", "_g", "_l")


def macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, need: int = 35) -> DataFrame:
    """symbol, ts, macd, macd_signal, macd_hist.  A recursion along each symbol's bars, seeded
    with the first close: one pass over a symbol's series, in an Arrow group of its own."""
    source = bars.select("symbol", "ts", "close")
    out = T.StructType([source.schema["symbol"], source.schema["ts"], *(T.StructField(c, T.DoubleType()) for c in ("macd", "macd_signal", "macd_hist"))])

    def run(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("ts", ignore_index=True)
        ema = lambda x, span: x.ewm(span=span, adjust=False).mean()
        line = ema(own["close"], fast) - ema(own["close"], slow)
        own["macd"], own["macd_signal"] = line, ema(line, signal)
        own["macd_hist"] = own["macd"] - own["macd_signal"]
        own.loc[: need - 2, ["macd", "macd_signal", "macd_hist"]] = None
        return own.drop(columns="close")

    return source.groupBy("symbol").applyInPandas(run, out)


def last_bars(bars: DataFrame, n: int) -> DataFrame:
    """The last n bars of each symbol: what looks at the latest one need not sort all of history."""
    return bars.withColumn("_n", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts")))).where(F.col("_n") <= n).drop("_n")


def atr(bars: DataFrame, n: int = 14) -> DataFrame:
    prev = F.lag("close").over(by_time())
    d = bars.withColumn("_t", F.when(prev.isNotNull(), F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev))))
    return d.withColumn("atr", full(F.avg("_t").over(rows(1 - n)), n, "_t")).drop("_t")


def pct_change(bars: DataFrame, n: int) -> DataFrame:
    prev = F.lag("close", n).over(by_time())
    return bars.withColumn(f"pct{n}", F.when(prev != 0, (F.col("close") - prev) / prev * 100))


def obv(bars: DataFrame) -> DataFrame:
    d = bars.withColumn("_s", F.coalesce(F.signum(F.col("close") - F.lag("close").over(by_time())), F.lit(0.0)) * F.col("volume"))
    return d.withColumn("obv", F.sum("_s").over(by_time().rowsBetween(Window.unboundedPreceding, 0))).drop("_s")


def obv_trends(bars: DataFrame) -> DataFrame:
    """Trend of the running volume by three rules: daily (19 bars back, over 5 %),
    4-hour (4 back, 2 % of the value) and screen (4 back, strict)."""
    d = obv(bars)
    old, near = F.lag("obv", 19).over(by_time()), F.lag("obv", 4).over(by_time())
    change = F.when(old != 0, (F.col("obv") - old) / F.abs(old))
    d = d.withColumn("obv_daily", F.when(old.isNull(), "NO_DATA").when(change > 0.05, "UP").when(change < -0.05, "DOWN").otherwise("FLAT"))
    d = d.withColumn("obv_4h", F.when(near.isNull(), "NO_DATA").when(F.col("obv") > near * 1.02, "UP").when(F.col("obv") < near * 0.98, "DOWN").otherwise("FLAT"))
    return d.withColumn("obv_screen", F.when(near.isNull(), "NO_DATA").when(F.col("obv") > near, "UP").when(F.col("obv") < near, "DOWN").otherwise("FLAT"))


def bollinger(bars: DataFrame, n: int = 20, k: float = 2.0, population: bool = True) -> DataFrame:
    """Bands of k standard deviations, %B (null without width) and the close's position."""
    dev = (F.stddev_pop if population else F.stddev_samp)("close").over(rows(1 - n))
    mid = F.avg("close").over(rows(1 - n))
    d = bars.withColumn("bb_mid", full(mid, n)).withColumn("_s", full(dev, n))
    d = d.withColumn("bb_up", F.col("bb_mid") + k * F.col("_s")).withColumn("bb_low", F.col("bb_mid") - k * F.col("_s"))
    width = F.col("bb_up") - F.col("bb_low")
    d = d.withColumn("bb_pct", F.when(width > 0, (F.col("close") - F.col("bb_low")) / width)).drop("_s")
    c, edge = F.col("close"), 0.1 * width
    if population:
        label = F.when(c > F.col("bb_up"), "ABOVE").when(c >= F.col("bb_up") - edge, "NEAR_UPPER").when(c < F.col("bb_low"), "BELOW").when(c <= F.col("bb_low") + edge, "NEAR_LOWER").when(c >= F.col("bb_mid"), "UPPER_HALF").otherwise("LOWER_HALF")
    else:
        label = F.when(c > F.col("bb_up"), "ABOVE").when(c < F.col("bb_low"), "BELOW").when(c >= F.col("bb_mid"), "UPPER_HALF").otherwise("LOWER_HALF")
    return d.withColumn("bb_position", F.when(F.col("bb_mid").isNotNull(), label).otherwise("NO_DATA"))


def volume_ratios(bars: DataFrame) -> DataFrame:
    """The last volume over five means: of 20 bars with it, of the 20 before it,
    of all before it (5 at least), of up to 20 with it, of up to 5 before it."""
    v = F.col("volume")
    over = lambda mean: F.when(mean > 0, v / mean)
    past = by_time().rowsBetween(Window.unboundedPreceding, -1)
    return (
        bars.withColumn("vr_20", full(over(F.avg("volume").over(rows(-19))), 20, "volume"))
        .withColumn("vr_prev20", F.when(F.count("volume").over(rows(-20, -1)) == 20, over(F.avg("volume").over(rows(-20, -1)))))
        .withColumn("vr_all", F.when(F.count("volume").over(past) >= 5, over(F.avg("volume").over(past))))
        .withColumn("vr_upto20", F.when(F.count("volume").over(rows(-19)) >= 2, over(F.avg("volume").over(rows(-19)))))
        .withColumn("vr_prev5", over(F.avg("volume").over(rows(-5, -1))))
    )


def support_resistance(bars: DataFrame, n: int = 20) -> DataFrame:
    return (
        bars.withColumn("support", full(F.min("close").over(rows(1 - n)), n)).withColumn("resistance", full(F.max("close").over(rows(1 - n)), n))
        .withColumn("support_hl", full(F.min("low").over(rows(1 - n)), n)).withColumn("resistance_hl", full(F.max("high").over(rows(1 - n)), n))
    )


def trends(bars: DataFrame) -> DataFrame:
    d = sma(sma(bars, 20), 60)
    c, a, b = F.col("close"), F.col("sma20"), F.col("sma60")
    d = d.withColumn("trend_daily", F.when(a.isNull() | b.isNull(), "NO_DATA").when((c > a) & (a > b), "UP").when((c < a) & (a < b), "DOWN").otherwise("MIXED"))
    return d.withColumn("trend_4h", F.when(a.isNull(), "NO_DATA").when(c > a * 1.02, "UP").when(c < a * 0.98, "DOWN").otherwise("FLAT"))


def candles(bars: DataFrame, strong: float = 0.7) -> DataFrame:
    o, h, l, c = map(F.col, ("open", "high", "low", "close"))
    span, body = h - l, F.abs(c - o)
    upper, lower = h - F.greatest(o, c), F.least(o, c) - l
    label = F.when(span <= 0, "FLAT").when(body / span < 0.1, "DOJI").when(body / span > strong, F.when(c > o, "LONG_UP").otherwise("LONG_DOWN"))
    label = label.when((lower > 2 * body) & (upper < body), "HAMMER").when((upper > 2 * body) & (lower < body), "SHOOTING").when(c > o, "UP").otherwise("DOWN")
    return bars.withColumn("candle", label)


def turnover(bars: DataFrame, n: int = 20) -> DataFrame:
    return bars.withColumn("turnover", F.avg(F.col("close") * F.col("volume")).over(rows(1 - n)))


def position_52w(bars: DataFrame, n: int = 252) -> DataFrame:
    """The close within the range of n bars.  Ranges are doubled by looking back at those before,
    so a bar takes as many steps as n has binary places, not n of them."""
    d, wide = bars.withColumn("_l", F.col("low")).withColumn("_h", F.col("high")), 1
    while wide < n:
        back = min(wide, n - wide)  # the last step's two ranges overlap
        d = d.withColumns({"_lb": F.lag("_l", back).over(by_time()), "_hb": F.lag("_h", back).over(by_time())})
        d, wide = d.withColumns({"_l": F.least("_l", "_lb"), "_h": F.greatest("_h", "_hb")}), wide + back
    low, high = F.col("_l"), F.col("_h")
    return d.withColumn("pos_52w", F.when(high > low, (F.col("close") - low) / (high - low) * 100)).drop("_l", "_h", "_lb", "_hb")


def returns_snapshot(bars: DataFrame) -> DataFrame:
    """Returns by bar spacing: where the median gap is 20 hours or more a bar is
    a day (no 4-hour return, 1 bar is a day); else 4 hours are 4 bars and a day 24."""
    gap = F.unix_timestamp(F.col("ts").cast("timestamp")) - F.unix_timestamp(F.lag("ts").over(by_time()).cast("timestamp"))
    g = bars.select("symbol", gap.alias("gap")).groupBy("symbol").agg(F.median("gap").alias("median_gap"))
    back = lambda n: F.when(F.lag("close", n).over(by_time()) != 0, (F.col("close") / F.lag("close", n).over(by_time()) - 1) * 100)
    d = bars.withColumn("_1", back(1)).withColumn("_4", back(4)).withColumn("_24", back(24)).join(g, "symbol")
    daily = F.col("median_gap") >= 20 * 3600
    return d.withColumn("return_4h", F.when(~daily, F.col("_4"))).withColumn("return_1d", F.when(daily, F.col("_1")).otherwise(F.col("_24"))).drop("_1", "_4", "_24")


def macro_change(bars: DataFrame, rates: list) -> DataFrame:
    """Change on the bar before: in basis points for the symbols of ``rates``, else in percent."""
    prev = F.lag("close").over(by_time())
    return bars.withColumn("change", F.when(F.col("symbol").isin(rates), (F.col("close") - prev) * 100).when(prev != 0, (F.col("close") / prev - 1) * 100))


def latest(bars: DataFrame, need: int = 1) -> DataFrame:
    """The latest bar of each symbol and ``bars``, how many it has, where there are ``need``: told in
    the order that the indicators stand in, so that their wide rows aren't sorted again."""
    d = bars.withColumn("bars", F.row_number().over(by_time())).withColumn("_more", F.lead(F.lit(1)).over(by_time()))
    return d.where(F.col("_more").isNull() & (F.col("bars") >= need)).drop("_more")


def snapshot(bars: DataFrame, need: int = 5) -> DataFrame:
    """The latest bar of each symbol that has ``need`` bars, with all daily indicators."""
    d = trends(candles(support_resistance(volume_ratios(bollinger(obv_trends(pct_change(pct_change(pct_change(atr(rsi(bars)), 1), 5), 20)))))))
    return latest(d, need).drop("bars")


def screen(bars: DataFrame) -> DataFrame:
    d = turnover(bollinger(volume_ratios(obv_trends(pct_change(atr(rsi(bars)), 1))), population=False))
    return latest(d).select("symbol", "ts", "close", "rsi", "obv_screen", "bb_pct", F.col("vr_prev20").alias("volume_ratio"), "pct1", "atr", "turnover")


def snapshot_4h(bars: DataFrame) -> DataFrame:
    """The latest 4-hour bar of each symbol with its indicators; with under 6 bars only the count's
    label, with under 20 what can be told, and a label that says so."""
    d = latest(trends(candles(support_resistance(volume_ratios(bollinger(obv_trends(rsi(bars)), population=False))))))
    d = d.withColumn("bars", F.col("bars").cast("long"))
    enough = F.col("bars") >= 6
    known = lambda c: F.when(enough, F.col(c)).alias(c)
    body = F.try_divide(F.abs(F.col("close") - F.col("open")), F.col("high") - F.col("low"))
    candle = F.when(body > 0.7, F.when(F.col("close") > F.col("open"), "STRONG_UP").otherwise("STRONG_DOWN")).otherwise("PLAIN")
    label = F.when(~enough, "TOO_FEW").when(F.col("bars") < 20, "PARTIAL").otherwise(F.col("trend_4h"))
    return d.select("symbol", "bars", known("close"), known("rsi"), F.when(enough, F.col("obv_4h")).otherwise("NO_DATA").alias("obv"), F.when(enough, F.col("bb_position")).otherwise("NO_DATA").alias("bb_position"),
                    known("vr_prev20"), F.when(enough, candle).alias("candle"), known("support_hl"), known("resistance_hl"), label.alias("trend"))
