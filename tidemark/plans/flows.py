"""Queries over streams and sources; each with the SQL of its batch twin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import text
from tidemark.plans.signals import HASHED
from tidemark.plans.tables import daily_bars, with_tables
from tidemark.sources import readers
from tidemark.sources.shared import shared_path
from tidemark.streaming import flows

QUERIES, SQL = {}, {}
TICKS = with_tables("ticks")


def query(sql: str | None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def arriving(spark, d, name: str) -> DataFrame:
    path = f"{d}/{name}.parquet"
    # a pattern, as a stream's plain path has to be a folder and a table may be one file
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{d}/{name}.parque[t]")


def trades(spark, d) -> DataFrame:
    return arriving(spark, d, "events").select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("id"), F.col("value").alias("price"))


@query(f"""{TICKS}, b AS (SELECT *, time_bucket(INTERVAL 4 HOURS, ts) AS bin, row_number() OVER (PARTITION BY symbol, time_bucket(INTERVAL 4 HOURS, ts) ORDER BY ts, id) AS a, row_number() OVER (PARTITION BY symbol, time_bucket(INTERVAL 4 HOURS, ts) ORDER BY ts DESC, id DESC) AS z FROM ticks)
    SELECT symbol, bin AS ts, max(CASE WHEN a = 1 THEN price END) AS open, max(price) AS high, min(price) AS low, max(CASE WHEN z = 1 THEN price END) AS close, count(*) AS volume FROM b GROUP BY symbol, bin""")
def stream_bars(spark, d):
    return flows.latest(flows.bars(trades(spark, d)), shared_path(spark, "stream-bars"), ["symbol", "ts"])


@query(f"""{TICKS}, b AS (SELECT symbol, time_bucket(INTERVAL 4 HOURS, ts) - to_hours(CAST(k * 4 AS BIGINT)) AS ts FROM ticks, range(6) r(k)) SELECT symbol, ts, count(*) AS n FROM b GROUP BY symbol, ts""")
def stream_counts(spark, d):
    return flows.latest(flows.counts(trades(spark, d), "symbol"), shared_path(spark, "stream-counts"), ["symbol", "ts"])


@query(f"""{TICKS}, l AS (SELECT *, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY symbol ORDER BY ts, id)) AS g FROM ticks WHERE price >= 12) SELECT id, symbol, ts FROM l WHERE g IS NULL OR g >= 7200000000""")
def stream_surge(spark, d):
    return flows.latest_quiet(trades(spark, d).where("price >= 12"), shared_path(spark, "stream-surge")).select("id", "symbol", "ts")


@query(f"{TICKS} SELECT symbol, date_trunc('day', ts) AS day, count(*) AS seen_count, min(ts) AS first_seen, max(ts) AS last_seen, max(price) AS max_score FROM ticks GROUP BY symbol, date_trunc('day', ts)")
def stream_upsert(spark, d):
    flow = flows.upsert(trades(spark, d).withColumnRenamed("price", "score"), ["symbol"])
    return flows.latest(flow, shared_path(spark, "stream-upsert"), ["symbol", "day"])


@query(f"{HASHED} SELECT DISTINCT source_name, hash FROM h")
def stream_ingest(spark, d):
    docs = arriving(spark, d, "documents")
    at = F.expr("timestamp '2024-01-01 00:00:00' + make_dt_interval(0, 0, doc_id)")
    items = docs.select(F.col("source").alias("source_name"), text.content_hash(F.col("text")).alias("hash"), at.alias("published_at"))
    return flows.latest(flows.ingest(items, ["source_name", "hash"]), shared_path(spark, "stream-ingest"), ["source_name", "hash"], "append").select("source_name", "hash")


@query(f"""{TICKS}, p AS (SELECT symbol, avg(price) * 2 AS target, avg(price) / 100 AS stop FROM ticks GROUP BY symbol), a AS (SELECT ticks.symbol, ticks.id, CASE WHEN price <= stop THEN 'STOP' ELSE 'TARGET' END AS alert, row_number() OVER (PARTITION BY ticks.symbol ORDER BY ticks.id) AS n FROM ticks JOIN p ON p.symbol = ticks.symbol WHERE price <= stop OR price >= target)
    SELECT symbol, id, alert FROM a WHERE n = 1""")
def stream_price_alerts(spark, d):
    """One pick a symbol, with its target at twice and its stop at a hundredth of the mean price."""
    events = spark.read.parquet(f"{d}/events.parquet")
    picks = events.groupBy(F.col("event_type").alias("symbol")).agg((F.avg("value") * 2).alias("target"), (F.avg("value") / 100).alias("stop")).select(F.col("symbol").alias("id"), "symbol", F.lit("LONG").alias("side"), "stop", "target")
    prices = trades(spark, d).select("symbol", F.col("id").alias("ts"), "price")
    return flows.alerts_once(prices, picks, shared_path(spark, "stream-alerts")).select("symbol", F.col("ts").alias("id"), "alert")


@query("""WITH b AS (SELECT user_id AS symbol, event_id AS ts, value, value - lag(value) OVER w AS dd FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
    r AS (SELECT symbol, ts, count(dd) OVER n AS k, avg(CASE WHEN dd IS NOT NULL THEN greatest(dd, 0.0) END) OVER n AS g, avg(CASE WHEN dd IS NOT NULL THEN greatest(-dd, 0.0) END) OVER n AS l, sum(coalesce(sign(dd), 0)) OVER (PARTITION BY symbol ORDER BY ts) AS obv FROM b WINDOW n AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 13 PRECEDING AND CURRENT ROW))
    SELECT symbol, ts, round(CASE WHEN k = 14 AND l > 0 THEN 100 - 100 / (1 + g / l) END, 5) AS rsi, obv FROM r""")
def stream_indicators(spark, d):
    """Each user's events as bars, numbered by the event."""
    e = arriving(spark, d, "events").select(F.col("user_id").alias("symbol"), F.col("event_id").alias("ts"), F.col("value").alias("close"), F.lit(1.0).alias("volume"))
    return flows.live_indicators(e, shared_path(spark, "stream-indicators")).withColumn("rsi", F.round("rsi", 5))


@query(r"""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)) AS url FROM pages) SELECT page_id, url, count(*) AS n FROM l GROUP BY page_id, url""")
def page_links(spark, d):
    return readers.page_links(spark.read.parquet(f"{d}/pages.parquet"))


@query(f"{with_tables('daily_bars')} SELECT symbol AS series, max(ts) AS ts, round(arg_max(close, ts), 6) AS value FROM daily_bars WHERE close <> 0 GROUP BY symbol")
def latest_observation(spark, d):
    series = daily_bars(spark, d).select(F.col("symbol").alias("series"), "ts", F.col("close").cast("string").alias("value"))
    return readers.latest_observation(series).withColumn("value", F.round(F.col("value").cast("double"), 6))


@query(f"""{with_tables('symbols', 'daily_bars')}, a AS (SELECT symbol, arg_max(close, ts) AS price FROM daily_bars WHERE volume > 40 GROUP BY symbol), b AS (SELECT symbol, arg_max(close, ts) AS price FROM daily_bars GROUP BY symbol)
    SELECT b.symbol, round(coalesce(a.price, b.price), 6) AS price, CASE WHEN a.price IS NOT NULL THEN 'busy' ELSE 'any' END AS origin FROM b LEFT JOIN a ON a.symbol = b.symbol""")
def coalesce_sources(spark, d):
    """Prices of busy days come before those of any day."""
    bars = daily_bars(spark, d)
    last = lambda df: df.groupBy("symbol").agg(F.max_by("close", "ts").alias("price"))
    return readers.coalesce_sources("symbol", "price", busy=last(bars.where("volume > 40")), any=last(bars)).withColumn("price", F.round("price", 6))
