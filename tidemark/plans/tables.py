"""Inputs of the operators, derived from the stored tables.

Each table has a Spark plan here and the same definition as SQL (``CTES``), so
that the SQL that checks an operator starts from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.bars import latest_quotes


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, name, sector, market: one row a supplier."""
    s, n, r = (read(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    return s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select(
        F.col("s_suppkey").alias("symbol"), F.col("s_name").alias("name"), F.col("n_name").alias("sector"),
        F.when(F.col("r_name") == "ASIA", "KR").otherwise("US").alias("market"),
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as trades, dealt by symbol, so that days are made and windows over a symbol run where they are, already sorted."""
    price = F.col("l_extendedprice") / F.col("l_quantity")
    return read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("symbol"), F.to_date("l_shipdate").alias("ts"), price.alias("price"), "l_quantity", "l_orderkey", "l_linenumber", "l_partkey").repartition("symbol")


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, ts (date), open, high, low, close, volume."""
    ord_ = F.struct("l_orderkey", "l_linenumber", "l_partkey", "price")
    return lines(spark, sf_dir).groupBy("symbol", "ts").agg(
        F.min(ord_)["price"].alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max(ord_)["price"].alias("close"), F.sum("l_quantity").alias("volume")
    )


def daily_closes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, ts, close of daily_bars(): a day's last line is the one that another day's follows."""
    w = Window.partitionBy("symbol").orderBy("ts", "l_orderkey", "l_linenumber", "l_partkey", "price")
    day = F.coalesce(F.datediff("ts", F.lit("1970-01-01").cast("date")), F.lit(-(2**31)).cast("int"))  # so that null is what stands after the last line
    last = lines(spark, sf_dir).withColumn("_day", day).withColumn("_next", F.lead("_day").over(w)).where("_next is null or _next <> _day")
    return last.select("symbol", "ts", F.col("price").alias("close"))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, ts, id, price: events as trades."""
    return read(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), "ts", F.col("event_id").alias("id"), F.col("value").alias("price"))


def raw_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """external_id, source_name, published_at, title, text: documents as items."""
    d = read(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("external_id"), F.col("source").alias("source_name"),
        F.expr("timestamp '2024-01-01 00:00:00' + make_dt_interval(0, 0, doc_id)").alias("published_at"),
        F.substring_index("text", "\n", 1).alias("title"), "text",
    )


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, symbol, side, score, created_at: orders as scored signals."""
    n = read(spark, sf_dir, "supplier").agg(F.count("*").alias("n_symbols"))
    o = read(spark, sf_dir, "orders").join(F.broadcast(n))  # one row
    return o.select(
        F.col("o_orderkey").alias("id"), (F.col("o_custkey") % F.col("n_symbols")).alias("symbol"),
        F.when(F.col("o_orderstatus") == "F", "LONG").when(F.col("o_orderstatus") == "O", "SHORT").otherwise("WATCH").alias("side"),
        F.least(F.lit(100.0), F.col("o_totalprice") / 4000.0).alias("score"), F.to_date("o_orderdate").alias("created_at"),
    )


def fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, sector, pe, pb: parts as valuation rows."""
    return read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("symbol"), F.col("p_brand").alias("sector"), (F.col("p_retailprice") / F.col("p_size")).alias("pe"), (F.col("p_size") / 10.0).alias("pb")
    )


def neighbours(spark: SparkSession, sf_dir: str, reach: int = 3) -> DataFrame:
    """source, target: each symbol and those whose key follows within ``reach``,
    an edge list that grows with the symbols."""
    s = symbols(spark, sf_dir).select("symbol")
    near = s.select(F.col("symbol").alias("source"), F.explode(F.sequence(F.col("symbol") + 1, F.col("symbol") + reach)).alias("target"))
    return near.join(s.withColumnRenamed("symbol", "target"), "target").select("source", "target")


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, name, sector, market and the latest figures of its bars."""
    return symbols(spark, sf_dir).join(latest_quotes(daily_bars(spark, sf_dir)), "symbol", "left")


def cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cycle, stage, place, symbol, sector: each run of eight symbols is a cycle of
    two leaders, first, second and third beneficiaries, and a victim."""
    k = F.col("symbol") % 8
    stage = F.when(k < 2, "LEADER").when(k < 5, "SECOND").when(k < 7, "THIRD").otherwise("VICTIM")
    place = F.when((k < 2) | (k == 7), 0).when(k == 2, 1).when(k < 5, 2).otherwise(3)
    return symbols(spark, sf_dir).select(F.expr("symbol div 8").alias("cycle"), stage.alias("stage"), place.alias("place"), "symbol", "sector", "market")


def pair_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rule, market, source, targets, keywords, direction, least_move: one rule a symbol."""
    s, k = symbols(spark, sf_dir), F.col("symbol")
    direction = F.element_at(F.array(*map(F.lit, DIRECTIONS)), (k % 3 + 1).cast("int"))
    market = F.when(k % 5 == 0, "BOTH").when(k % 5 == 1, "CROSS").otherwise(F.col("market"))
    return s.select(k.alias("rule"), market.alias("market"), k.alias("source"), F.array(k + 1, k + 2, k).alias("targets"), F.array(F.concat(F.lit("#00000"), F.lpad(k.cast("string"), 3, "0"))).alias("keywords"), direction.alias("direction"), (2.0 + k % 3).alias("least_move"))


#: Directions of the derived pair rules, in turn.
DIRECTIONS = ["UP_LEADS_UP", "UP_LEADS_DOWN", "DOWN_LEADS_DOWN"]

CTES = {
    "symbols": """symbols AS (SELECT s_suppkey AS symbol, s_name AS name, n_name AS sector, CASE WHEN r_name = 'ASIA' THEN 'KR' ELSE 'US' END AS market
        FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)""",
    "daily_bars": """lines AS (SELECT l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS ts, l_extendedprice / l_quantity AS price, l_quantity AS q,
          row_number() OVER (PARTITION BY l_suppkey, CAST(l_shipdate AS DATE) ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice / l_quantity) AS a,
          count(*) OVER (PARTITION BY l_suppkey, CAST(l_shipdate AS DATE)) AS n FROM lineitem),
        daily_bars AS (SELECT symbol, ts, max(CASE WHEN a = 1 THEN price END) AS open, max(price) AS high, min(price) AS low,
          max(CASE WHEN a = n THEN price END) AS close, sum(q) AS volume FROM lines GROUP BY symbol, ts)""",
    "ticks": "ticks AS (SELECT event_type AS symbol, ts, event_id AS id, value AS price FROM events)",
    "raw_items": """raw_items AS (SELECT doc_id AS external_id, source AS source_name, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id) AS published_at,
        split_part(text, chr(10), 1) AS title, text FROM documents)""",
    "signals": """signals AS (SELECT o_orderkey AS id, o_custkey % (SELECT count(*) FROM supplier) AS symbol,
        CASE o_orderstatus WHEN 'F' THEN 'LONG' WHEN 'O' THEN 'SHORT' ELSE 'WATCH' END AS side, least(100.0, o_totalprice / 4000.0) AS score,
        CAST(o_orderdate AS DATE) AS created_at FROM orders)""",
    "fundamentals": "fundamentals AS (SELECT p_partkey AS symbol, p_brand AS sector, p_retailprice / p_size AS pe, p_size / 10.0 AS pb FROM part)",
    "neighbours": """neighbours AS (SELECT a.symbol AS source, b.symbol AS target FROM symbols a JOIN symbols b ON b.symbol = a.symbol + 1 OR b.symbol = a.symbol + 2 OR b.symbol = a.symbol + 3)""",
    "quotes": """q0 AS (SELECT symbol, open, close, volume, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS n, lead(close) OVER (PARTITION BY symbol ORDER BY ts DESC) AS prev FROM daily_bars),
        q1 AS (SELECT symbol, max(CASE WHEN n = 1 THEN close END) AS close, max(CASE WHEN n = 1 AND prev <> 0 THEN (close / prev - 1) * 100 END) AS return_1d, max(CASE WHEN n = 1 AND open <> 0 THEN (close / open - 1) * 100 END) AS return_4h,
          avg(CASE WHEN n <= 14 THEN greatest(close - prev, 0.0) END) AS gain, avg(CASE WHEN n <= 14 THEN greatest(prev - close, 0.0) END) AS loss, count(CASE WHEN n <= 14 THEN prev END) AS known,
          max(CASE WHEN n = 1 THEN volume END) / avg(CASE WHEN n BETWEEN 2 AND 21 THEN volume END) AS volume_ratio, sum(CASE WHEN n <= 4 THEN volume * sign(close - prev) END) AS flow FROM q0 WHERE n <= 21 GROUP BY symbol),
        quotes AS (SELECT y.*, close, return_1d, return_4h, CASE WHEN known = 14 AND loss > 0 THEN 100 - 100 / (1 + gain / loss) END AS rsi, volume_ratio, CASE WHEN flow > 0 THEN 'UP' WHEN flow < 0 THEN 'DOWN' ELSE 'FLAT' END AS obv
          FROM symbols y LEFT JOIN q1 ON q1.symbol = y.symbol)""",
    "cycles": """cycles AS (SELECT symbol // 8 AS cycle, CASE WHEN symbol % 8 < 2 THEN 'LEADER' WHEN symbol % 8 < 5 THEN 'SECOND' WHEN symbol % 8 < 7 THEN 'THIRD' ELSE 'VICTIM' END AS stage,
        CASE WHEN symbol % 8 < 2 OR symbol % 8 = 7 THEN 0 WHEN symbol % 8 = 2 THEN 1 WHEN symbol % 8 < 5 THEN 2 ELSE 3 END AS place, symbol, sector, market FROM symbols)""",
    "pair_rules": """pair_rules AS (SELECT symbol AS rule, CASE WHEN symbol % 5 = 0 THEN 'BOTH' WHEN symbol % 5 = 1 THEN 'CROSS' ELSE market END AS market, symbol AS source, [symbol + 1, symbol + 2, symbol] AS targets,
        ['#00000' || lpad(CAST(symbol AS VARCHAR), 3, '0')] AS keywords, ['UP_LEADS_UP', 'UP_LEADS_DOWN', 'DOWN_LEADS_DOWN'][symbol % 3 + 1] AS direction, 2.0 + symbol % 3 AS least_move FROM symbols)""",
}


def with_tables(*names: str) -> str:
    return "WITH " + ",\n".join(CTES[n] for n in names)
