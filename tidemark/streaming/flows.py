"""Structured Streaming twins of the batch operators.

A watermark bounds the state of each flow: the look-back of the feed it reads.
``land`` runs what has arrived, writes each micro-batch to a folder of its own
(a repeated batch overwrites itself) and ``latest`` reads the newest row a key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.indicators import by_time, rsi

#: How late items and bars may come (the look-backs of their feeds).
ITEM_DELAY, BAR_DELAY = "4 hours", "15 minutes"


def ingest(items: DataFrame, keys: list[str], at: str = "published_at", delay: str = ITEM_DELAY) -> DataFrame:
    """Items whose key hasn't come within the delay."""
    return items.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


def bars(trades: DataFrame, length: str = "4 hours", delay: str = BAR_DELAY) -> DataFrame:
    """Tumbling bars of trades (symbol, ts, id, price)."""
    at = F.struct("ts", "id", "price")
    g = trades.withWatermark("ts", delay).groupBy("symbol", F.window("ts", length).alias("w")).agg(
        F.min(at)["price"].alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max(at)["price"].alias("close"), F.count("*").alias("volume"))
    return g.select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def counts(events: DataFrame, key: str, length: str = "24 hours", slide: str = "4 hours", delay: str = ITEM_DELAY) -> DataFrame:
    """Sliding look-back counts by key."""
    g = events.withWatermark("ts", delay).groupBy(key, F.window("ts", length, slide).alias("w")).agg(F.count("*").alias("n"))
    return g.select(key, F.col("w.start").alias("ts"), "n")


def upsert(signals: DataFrame, keys: list[str], delay: str = "1 day") -> DataFrame:
    """Seen count, first and last time and best score a key and day."""
    g = signals.withWatermark("ts", delay).groupBy(*keys, F.window("ts", "1 day").alias("w")).agg(
        F.count("*").alias("seen_count"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.max("score").alias("max_score"))
    return g.select(*keys, F.col("w.start").alias("day"), "seen_count", "first_seen", "last_seen", "max_score")


def latest_quiet(events: DataFrame, path: str, hours: float = 2.0) -> DataFrame:
    """Events (symbol, ts, id) that none of the same symbol precedes within the
    quiet period, over all that has arrived; events without a time are left out.

    In a time bucket of the period's length only the first event can be one, so a
    bucket's first event and last time are all that is needed: an aggregation, however
    many events a symbol has.  The last time a symbol is kept under ``path`` for the next
    micro-batch; it is that of the batch before, so that a repeated batch does the same again."""
    span = int(hours * 3_600_000_000)
    source = events.select("symbol", "ts", "id")
    micros = F.unix_micros("ts")

    def work(batch: DataFrame, number: int) -> DataFrame:
        spark = batch.sparkSession
        last = spark.read.parquet(f"{path}/last/batch={number - 1}") if number else batch.select("symbol", "ts").limit(0)
        last = last.select(F.col("symbol").alias("_symbol"), F.unix_micros("ts").alias("_last"))
        each = batch.where("ts is not null").groupBy("symbol", F.floor(micros / span).alias("bucket")).agg(F.min(F.struct("ts", "id")).alias("first"), F.max("ts").alias("ts"))
        each = each.join(last, F.col("symbol").eqNullSafe(F.col("_symbol")), "left")
        known = last.select(F.col("_symbol").alias("symbol"), F.timestamp_micros("_last").alias("ts"))
        each.select("symbol", "ts").unionByName(known).groupBy("symbol").agg(F.max("ts").alias("ts")).write.mode("overwrite").parquet(f"{path}/last/batch={number}")
        # greatest() passes over nulls: no bucket before, no batch before
        before = F.greatest(F.lag(micros).over(Window.partitionBy("symbol").orderBy("bucket")), F.col("_last"))
        kept = each.withColumn("before", before).where(F.col("before").isNull() | (F.unix_micros("first.ts") - F.col("before") >= span))
        return kept.select("symbol", "first.ts", "first.id")

    return latest(source, path, [], "append", work)


def price_alerts(prices: DataFrame, picks: DataFrame) -> DataFrame:
    """Arriving prices (symbol, ts, price) that reach a pick's target or stop."""
    d = prices.join(picks.select("id", "symbol", "side", "stop", "target"), "symbol")
    long, p = F.col("side") == "LONG", F.col("price")
    alert = F.when(F.when(long, p <= F.col("stop")).otherwise(p >= F.col("stop")), "STOP").when(F.when(long, p >= F.col("target")).otherwise(p <= F.col("target")), "TARGET")
    return d.withColumn("alert", alert).where("alert is not null").select("id", "symbol", "ts", "price", "alert")


def alerts_once(prices: DataFrame, picks: DataFrame, path: str) -> DataFrame:
    """price_alerts() that fire once a pick: the first of the micro-batch in which there is one.

    The picks that have fired are kept under ``path``, an id each, for the next micro-batch: it reads
    that table of the batch before and no earlier batch's rows, so a repeated batch does the same again.
    Picks that aren't given any more are forgotten."""
    ids = picks.select("id").distinct()

    def work(batch: DataFrame, number: int) -> DataFrame:
        fired = batch.sparkSession.read.schema(ids.schema).parquet(f"{path}/last/batch={number - 1}") if number else batch.select("id").limit(0)
        first = batch.groupBy("id").agg(F.min(F.struct("ts", "price", "alert", "symbol")).alias("a")).select("id", "a.symbol", "a.ts", "a.price", "a.alert")
        first = first.join(fired, "id", "left_anti")
        fired.join(ids, "id", "left_semi").unionByName(first.select("id")).write.mode("overwrite").parquet(f"{path}/last/batch={number}")
        return first.select(*batch.columns)

    return latest(price_alerts(prices, picks), path, [], "append", work)


def live_indicators(bars: DataFrame, path: str, n: int = 14) -> DataFrame:
    """symbol, ts, rsi and obv of every arriving bar (symbol, ts, close, volume), in order of ts.

    Kept under ``path`` for the next micro-batch: each symbol's last n bars and its running
    volume.  Bars that arrive late, before one that is kept, are left out."""

    def work(batch: DataFrame, number: int) -> DataFrame:
        spark = batch.sparkSession
        empty = batch.limit(0).withColumn("obv", F.lit(None).cast("double"))
        kept = spark.read.schema(empty.schema).parquet(f"{path}/last/batch={number - 1}") if number else empty
        edge = kept.groupBy("symbol").agg(F.max("ts").alias("_edge"))
        new = batch.join(edge, "symbol", "left").where(F.col("_edge").isNull() | (F.col("ts") > F.col("_edge"))).drop("_edge")
        both = kept.withColumn("_old", F.lit(True)).unionByName(new.withColumn("obv", F.lit(None).cast("double")).withColumn("_old", F.lit(False)))
        d = rsi(both, n).withColumnRenamed("obv", "_known")
        step = F.when(F.col("_old"), F.lit(None)).otherwise(F.coalesce(F.signum(F.col("close") - F.lag("close").over(by_time())), F.lit(0.0)) * F.col("volume"))
        past = by_time().rowsBetween(Window.unboundedPreceding, 0)
        d = d.withColumn("_step", step).withColumn("obv", F.coalesce("_known", F.coalesce(F.last("_known", ignorenulls=True).over(past), F.lit(0.0)) + F.sum("_step").over(past)))
        d.withColumn("_k", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts")))).where(F.col("_k") <= n + 1).select(*empty.columns).write.mode("overwrite").parquet(f"{path}/last/batch={number}")
        return d.where("not _old").select("symbol", "ts", "close", "volume", "rsi", "obv")

    source = bars.select("symbol", "ts", F.col("close").cast("double").alias("close"), F.col("volume").cast("double").alias("volume"))
    rows = land(source, path, "append", work)
    return source.sparkSession.read.parquet(rows).select("symbol", "ts", "rsi", "obv")


def land(flow: DataFrame, path: str, mode: str = "update", work: Callable[[DataFrame, int], DataFrame] = lambda batch, number: batch) -> str:
    """Run the flow over all that has arrived; micro-batches, after ``work``, go under ``path``."""

    def write(batch: DataFrame, number: int) -> None:
        work(batch, number).write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    run = flow.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(write).start()
    run.awaitTermination()
    return f"{path}/rows"


def latest(flow: DataFrame, path: str, keys: list[str], mode: str = "update", work: Callable[[DataFrame, int], DataFrame] = lambda batch, number: batch) -> DataFrame:
    """``land``, then the row of the last batch of each key (all rows with no keys)."""
    spark, names = flow.sparkSession, flow.columns
    rows = spark.read.schema(T.StructType([*flow.schema.fields, T.StructField("batch", T.IntegerType())])).parquet(land(flow, path, mode, work))
    if not keys:
        return rows.select(*names)
    rest = [c for c in names if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*")
