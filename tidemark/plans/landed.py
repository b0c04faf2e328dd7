"""Queries that land tables as files first and read them back, and queries of small parts; each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import evidence, text
from tidemark.plans.tables import daily_bars, neighbours, pair_rules, raw_items, read, signals, symbols, with_tables
from tidemark.sources import readers, store
from tidemark.sources.shared import shared_path

QUERIES, SQL = {}, {}
TICKER = "CASE WHEN market = 'KR' THEN lpad(CAST(symbol AS VARCHAR), 6, '0') ELSE CAST(symbol AS VARCHAR) END"


def query(sql: str | None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


@query(f"{with_tables('symbols', 'daily_bars')} SELECT market, {TICKER} AS ticker, count(*) AS bars, max(ts) AS last, CAST(sum(CAST(volume AS BIGINT)) AS BIGINT) AS volume FROM daily_bars JOIN symbols USING (symbol) GROUP BY market, ticker")
def landed_prices(spark, d):
    """Bars as price files, as the feed lands them: KR tickers have lost their zeros."""
    path = shared_path(spark, "landed-prices")
    rows = daily_bars(spark, d).join(symbols(spark, d).select("symbol", "market"), "symbol")
    readers.write_csv(rows.select("market", F.col("symbol").cast("string").alias("ticker"), F.col("ts").alias("date"), "close", "open", "high", "low", F.col("volume").cast("long").alias("volume")), path)
    return readers.read_prices(spark, path).groupBy("market", "ticker").agg(F.count("*").alias("bars"), F.max("date").alias("last"), F.sum("volume").alias("volume"))


@query(f"{with_tables('symbols', 'neighbours')} SELECT market, {TICKER} AS ticker, CASE WHEN market = 'KR' THEN lpad(CAST(target AS VARCHAR), 6, '0') ELSE CAST(target AS VARCHAR) END AS peer_ticker, (source * 7 + target) % 100 / 100.0 AS correlation, target - source AS rank FROM neighbours JOIN symbols ON symbol = source")
def landed_peers(spark, d):
    path = shared_path(spark, "landed-peers")
    e = neighbours(spark, d).join(symbols(spark, d).select(F.col("symbol").alias("source"), "market"), "source")
    readers.write_csv(e.select("market", F.col("source").cast("string").alias("ticker"), F.col("target").cast("string").alias("peer_ticker"), ((F.col("source") * 7 + F.col("target")) % 100 / 100.0).alias("correlation"), (F.col("target") - F.col("source")).alias("rank")), path)
    return readers.read_peers(spark, path)


@query(f"""{with_tables('symbols', 'neighbours')}, f AS (SELECT source AS source_symbol, target AS target_symbol, 'UP' AS relation, (source * 13 + target) % 97 / 1.0 AS ranking_score, CASE WHEN source % 11 = 0 THEN 'thin' ELSE '' END AS caution, 0 AS file FROM neighbours WHERE source % 2 = 0
    UNION ALL SELECT source, target, 'UP', (source * 5 + target) % 89 / 1.0, '', 1 FROM neighbours) SELECT source_symbol, target_symbol, relation, ranking_score FROM f WHERE caution = '' QUALIFY row_number() OVER (PARTITION BY source_symbol, target_symbol ORDER BY file) = 1 ORDER BY ranking_score DESC, source_symbol, target_symbol LIMIT 200""")
def landed_research(spark, d):
    """Two files of pairs, of which the first wins; the best 200 are the feature."""
    e = neighbours(spark, d).select(F.col("source").alias("source_symbol"), F.col("target").alias("target_symbol"), F.lit("UP").alias("relation"))
    a, b = F.col("source_symbol"), F.col("target_symbol")
    parts = [e.where(a % 2 == 0).select("*", ((a * 13 + b) % 97 / 1.0).alias("ranking_score"), F.when(a % 11 == 0, "thin").otherwise("").alias("caution")), e.select("*", ((a * 5 + b) % 89 / 1.0).alias("ranking_score"), F.lit("").alias("caution"))]
    paths = [shared_path(spark, f"landed-research-{k}") for k in range(2)]
    for part, path in zip(parts, paths):
        readers.write_csv(part, path)
    return readers.read_research_pairs(spark, paths, "source_symbol long, target_symbol long, relation string, ranking_score double, caution string").drop("caution")


@query("SELECT 'research_package_' || strftime(max(CAST(o_orderdate AS DATE)), '%Y%m%d') AS package FROM orders")
def newest_package(spark, d):
    paths = read(spark, d, "orders").select(F.concat(F.lit("/data/research_package_"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("/part.csv")).alias("path"))
    return readers.latest_package(paths)


@query(f"{with_tables('symbols', 'pair_rules')} SELECT rule, source, t AS target, direction FROM (SELECT rule, source, direction, unnest(targets) AS t FROM pair_rules) q WHERE t <> source")
def landed_rules(spark, d):
    path = shared_path(spark, "landed-rules")
    pair_rules(spark, d).select("rule", "source", "targets", "direction").write.json(path)
    return readers.load_rules(spark, path, "rule long, source long, targets array<long>, direction string")


@query("SELECT DISTINCT source AS source_type, substr(sha256(coalesce(text, '')), 1, 8) AS external_id FROM documents EXCEPT SELECT source, substr(sha256(coalesce(text, '')), 1, 8) FROM documents WHERE doc_id % 3 = 0")
def ingested_items(spark, d):
    """Items by the hash of their text: those whose key is in the store, and repeated ones, are passed over."""
    docs = read(spark, d, "documents").select("doc_id", F.col("source").alias("source_type"), F.substring(F.sha2(F.coalesce("text", F.lit("")), 256), 1, 8).alias("external_id"))
    keys = ["source_type", "external_id"]
    return readers.ingest_new(docs, docs.where("doc_id % 3 = 0"), keys).select(*keys)


@query("SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderstatus = 'F' GROUP BY year(o_orderdate)")
def sent_history(spark, d):
    """History in two appends; only what was sent is kept."""
    path = shared_path(spark, "sent-history")
    o = read(spark, d, "orders").select("o_orderkey", "o_totalprice", (F.col("o_orderstatus") == "F").alias("sent"), F.year("o_orderdate").alias("year"))
    for part in (0, 1):
        readers.append_if_sent(o.where(F.col("o_orderkey") % 2 == part), path, "year")
    return spark.read.parquet(path).groupBy("year").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""SELECT 'Customer ' || c_custkey || ' of ' || c_mktsegment AS title, 'some words' AS summary, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE 'https://x.y/' || c_custkey END AS url,
    substr(sha1(CASE WHEN c_custkey % 4 = 0 THEN 'Customer ' || c_custkey || ' of ' || c_mktsegment || ' some words' ELSE 'https://x.y/' || c_custkey END), 1, 16) AS external_id, TIMESTAMP '2024-03-05 10:00:00' AS published_at FROM customer""")
def feed_items(spark, d):
    """A feed a customer, written as a document."""
    k = F.col("c_custkey")
    link = F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("<link>https://x.y/"), k, F.lit("</link>")))
    xml = F.concat(F.lit("<rss><channel><item><title>Customer &lt;b&gt;"), k, F.lit("&lt;/b&gt; of "), "c_mktsegment", F.lit("</title><description>some &lt;i&gt; words</description>"), link, F.lit("<pubDate>Tue, 5 Mar 2024 10:00:00 +0000</pubDate></item></channel></rss>"))
    return readers.parse_feed(read(spark, d, "customer").select(xml.alias("xml")))


@query("SELECT sha1(CAST(o_orderkey AS VARCHAR)) AS external_id, '[' || o_orderstatus || '] ' || o_orderpriority AS title, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS published_at FROM orders")
def filing_items(spark, d):
    o = read(spark, d, "orders")
    return readers.filings_to_items(o.select(F.col("o_orderkey").cast("string").alias("receipt"), F.col("o_orderstatus").alias("company"), F.col("o_orderpriority").alias("report"), F.date_format("o_orderdate", "yyyyMMdd").alias("filed")))


@query("""SELECT c_custkey AS company, form, '2024-0' || i AS date, 'a' || i AS accession, items FROM (SELECT c_custkey, unnest(['8-K', '10-K', CASE WHEN c_custkey % 2 = 0 THEN '8-K/A' ELSE '8-K' END]) AS form, unnest([1, 2, 3]) AS i, unnest([CASE WHEN c_custkey % 3 = 0 THEN '1.01,9.01' ELSE '9.01' END, '1.01', '1.01']) AS items FROM customer) q WHERE form IN ('8-K', '8-K/A') AND contains(items, '1.01')""")
def zipped_filings(spark, d):
    k = F.col("c_custkey")
    lists = {"form": [F.lit("8-K"), F.lit("10-K"), F.when(k % 2 == 0, "8-K/A").otherwise("8-K")], "date": ["2024-01", "2024-02", "2024-03"], "accession": ["a1", "a2", "a3"], "items": [F.when(k % 3 == 0, "1.01,9.01").otherwise("9.01"), F.lit("1.01"), F.lit("1.01")]}
    return readers.zip_filing_arrays(read(spark, d, "customer").select(k.alias("company"), *[F.array(*[c if not isinstance(c, str) else F.lit(c) for c in cs]).alias(n) for n, cs in lists.items()]))


@query("""WITH f AS (SELECT o_custkey AS company, CASE o_orderkey % 3 WHEN 0 THEN 'Revenues' WHEN 1 THEN 'Sales' ELSE 'Other' END AS concept, CASE WHEN o_orderkey % 5 = 0 THEN '8-K' WHEN o_orderkey % 2 = 0 THEN '10-K' ELSE '10-Q' END AS form, o_orderkey AS "end", o_totalprice AS value FROM orders)
    SELECT company, concept, "end", value FROM f WHERE concept <> 'Other' AND form <> '8-K' QUALIFY row_number() OVER (PARTITION BY company ORDER BY concept = 'Sales' DESC, "end" DESC) = 1""")
def newest_facts(spark, d):
    k = F.col("o_orderkey")
    concept = F.when(k % 3 == 0, "Revenues").when(k % 3 == 1, "Sales").otherwise("Other")
    form = F.when(k % 5 == 0, "8-K").when(k % 2 == 0, "10-K").otherwise("10-Q")
    facts = read(spark, d, "orders").select(F.col("o_custkey").alias("company"), concept.alias("concept"), form.alias("form"), k.alias("end"), F.col("o_totalprice").alias("value"))
    return readers.latest_fact(facts, ["Sales", "Revenues"]).select("company", "concept", "end", "value")


@query(rf"""{with_tables('raw_items')} SELECT external_id, md5(CASE WHEN length(text) > 50 THEN substr(text, 1, 49) || '…' ELSE text END) AS short, md5(regexp_replace(text, '(?i)(password|passwd|secret|token|api_?key)([ "'']*[:=][ "'']*)[A-Za-z0-9+/_.=-]+', '\1\2***', 'g')) AS masked FROM raw_items WHERE text IS NOT NULL""")
def short_and_masked(spark, d):
    t = F.col("text")
    return raw_items(spark, d).where("text is not null").select("external_id", F.md5(text.truncate(t, 50)).alias("short"), F.md5(text.mask_secrets(t)).alias("masked"))


@query(f"""{with_tables('raw_items')}, l AS (SELECT external_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS k FROM raw_items WHERE text IS NOT NULL)
    SELECT external_id, k, md5(line) AS line FROM l QUALIFY coalesce(lag(line) OVER (PARTITION BY external_id ORDER BY k) <> line, true)""")
def adjacent_lines(spark, d):
    return text.adjacent_duplicates(raw_items(spark, d)).withColumn("line", F.md5("line"))


@query("""SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def cosines(spark, d):
    e = read(spark, d, "embeddings")
    x, y = e.select(F.col("vec_id").alias("a"), F.col("embedding").alias("u")), e.select(F.col("vec_id").alias("b"), F.col("embedding").alias("v"))
    return x.join(y, F.col("b") == F.col("a") + 1).select("a", "b", F.round(evidence.cosine(F.col("u"), F.col("v")), 6).alias("cosine"))


@query("""WITH s AS (SELECT c_custkey AS id, 'T' || c_custkey // 3 || CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'A' ELSE 'BC' END AS symbol FROM customer), p AS (SELECT a.id AS a, b.id AS b, a.symbol AS x, b.symbol AS y FROM s a JOIN s b ON b.id = a.id + 1 OR b.id = a.id + 2)
    SELECT a, b, x = y OR regexp_replace(x, '[LABCDE]+$', '') = regexp_replace(y, '[LABCDE]+$', '') AND abs(length(x) - length(y)) <= 1 AS same FROM p""")
def share_classes(spark, d):
    k = F.col("c_custkey")
    s = read(spark, d, "customer").select(k.alias("id"), F.concat(F.lit("T"), F.expr("c_custkey div 3"), F.when(k % 3 == 0, "").when(k % 3 == 1, "A").otherwise("BC")).alias("symbol"))
    x = s.select(F.col("id").alias("a"), F.col("symbol").alias("x"), F.explode(F.array(F.col("id") + 1, F.col("id") + 2)).alias("b"))
    y = s.select(F.col("id").alias("b"), F.col("symbol").alias("y"))
    return x.join(y, "b").select("a", "b", evidence.same_product(F.col("x"), F.col("y")).alias("same"))


@query("""WITH t AS (SELECT o_orderkey AS external_id, ['$AB', 'AB', '$CEO', '$ABCDEFG', '$Q.'][o_orderkey % 5 + 1] || ' rose, ' || CASE WHEN o_orderkey % 2 = 0 THEN '$AB again' ELSE 'nothing' END AS text FROM orders), m AS (SELECT external_id, unnest(regexp_extract_all(text, '\\$([A-Z]{1,5})\\b', 1)) AS ticker FROM t) SELECT external_id, ticker, count(*) AS n FROM m WHERE ticker <> 'CEO' GROUP BY external_id, ticker""")
def dollar_marks(spark, d):
    k = F.col("o_orderkey")
    first = F.element_at(F.array(*map(F.lit, ("$AB", "AB", "$CEO", "$ABCDEFG", "$Q."))), (k % 5 + 1).cast("int"))
    items = read(spark, d, "orders").select(k.alias("external_id"), F.concat(first, F.lit(" rose, "), F.when(k % 2 == 0, "$AB again").otherwise("nothing")).alias("text"))
    return evidence.dollar_tickers(items, ["CEO"])


def contracts(spark, d) -> DataFrame:
    """Orders as contract events of the last days, in dollars."""
    k = F.col("o_orderkey")
    amount = F.when(k % 6 != 0, F.round(evidence.usd_to_krw(F.col("o_totalprice") / 100), 4))
    return read(spark, d, "orders").select(
        k.alias("id"), F.col("o_custkey").alias("symbol"), F.to_date("o_orderdate").alias("event_date"), F.element_at(F.array(*map(F.lit, ("DART", "SEC", "STATIC"))), (k % 3 + 1).cast("int")).alias("source"),
        amount.alias("amount"), (k % 10 == 0).alias("is_amendment"), (k % 14 == 0).alias("is_cancellation"), (k % 4).cast("int").alias("chain_tier"))


@query("""WITH e AS (SELECT o_orderkey AS id, o_custkey AS symbol, CAST(o_orderdate AS DATE) AS day, ['DART', 'SEC', 'STATIC'][o_orderkey % 3 + 1] AS source, CASE WHEN o_orderkey % 6 <> 0 THEN round(o_totalprice / 100 * 1e6 * 1370 / 1e8, 4) END AS amount, o_orderkey % 10 = 0 AS am, o_orderkey % 14 = 0 AS ca, o_orderkey % 4 AS chain FROM orders),
    b AS (SELECT 'new' AS bucket, * FROM e WHERE source <> 'STATIC' AND amount IS NOT NULL AND NOT am AND NOT ca UNION ALL SELECT 'unparsed', * FROM e WHERE source = 'DART' AND amount IS NULL AND NOT ca
      UNION ALL SELECT 'high', * FROM (SELECT * FROM e WHERE amount >= 150000 / 10 QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY day DESC, id) = 1) q UNION ALL SELECT 'risk', * FROM e WHERE source <> 'STATIC' AND (am OR ca) UNION ALL SELECT 'second', * FROM e WHERE chain >= 2 AND source <> 'STATIC')
    SELECT bucket, id, row_number() OVER (PARTITION BY bucket ORDER BY day DESC, id) AS place, CASE WHEN amount >= 15000 THEN 'HIGH' WHEN amount >= 3000 THEN 'MEDIUM' ELSE 'LOW' END AS tier FROM b QUALIFY place <= CASE bucket WHEN 'new' THEN 10 WHEN 'high' THEN 10 ELSE 5 END""")
def backlog_report(spark, d):
    """Tiers at a tenth of the operator's thresholds, as orders are small."""
    return evidence.backlog_report(contracts(spark, d), scale=0.1).select("bucket", "id", "place", "tier")


@query(f"{with_tables('signals')} SELECT symbol, side, count(*) AS seen_count, min(created_at) AS first_seen, max(created_at) AS last_seen, round(max(score), 6) AS max_score FROM signals GROUP BY symbol, side")
def upsert_store(spark, d):
    """Signals in three batches, the last of a few symbols, merged into a store of buckets."""
    path = shared_path(spark, "signal-store")
    s = signals(spark, d).select("symbol", "side", F.lit(1).cast("long").alias("seen_count"), F.col("created_at").alias("first_seen"), F.col("created_at").alias("last_seen"), F.col("score").alias("max_score"), "id")
    few = F.col("symbol") % 16 == 0
    for part in (~few & (F.col("id") % 2 == 0), ~few & (F.col("id") % 2 == 1), few):
        store.merge(s.where(part), path, ["symbol", "side"], {"seen_count": "sum", "first_seen": "min", "last_seen": "max", "max_score": "max"}, 16)
    return store.read_store(spark, path).withColumn("max_score", F.round("max_score", 6))
