"""Queries of filters and cleaning; each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import cleaning as cl
from tidemark.operators import evidence
from tidemark.plans.tables import quotes, raw_items, read, signals, symbols, with_tables

QUERIES, SQL = {}, {}
ITEMS = with_tables("raw_items")
SIG = with_tables("signals")


def query(sql: str | None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


@query(f"{SIG} SELECT id, symbol, side, created_at FROM signals WHERE side = 'LONG' AND score >= 50 AND created_at >= DATE '1996-01-01' AND created_at < DATE '1997-06-01' ORDER BY created_at DESC, id LIMIT 500")
def recent_window(spark, d):
    s = signals(spark, d).where("side = 'LONG' and score >= 50")
    return cl.recent(s, "created_at", F.lit("1996-01-01").cast("date"), F.lit("1997-06-01").cast("date"), 500).select("id", "symbol", "side", "created_at")


@query("WITH p AS (SELECT o_orderkey AS id, o_orderkey % 3 = 0 AS s, CASE WHEN o_orderkey % 4 <> 0 THEN o_totalprice * 1.1 END AS target, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice * 0.9 END AS stop FROM orders) SELECT id FROM p WHERE NOT s AND target IS NOT NULL AND stop IS NOT NULL")
def active_picks(spark, d):
    k, price = F.col("o_orderkey"), F.col("o_totalprice")
    p = read(spark, d, "orders").select(k.alias("id"), F.when(k % 3 == 0, 1).otherwise(0).alias("alert_sent"), F.when(k % 4 != 0, price * 1.1).alias("target"), F.when(k % 5 != 0, price * 0.9).alias("stop"))
    return cl.active_picks(p).select("id")


@query(f"{with_tables('symbols', 'daily_bars', 'quotes')} SELECT symbol FROM quotes WHERE close IS NOT NULL AND (market <> 'US' OR close >= 1200)")
def price_floor(spark, d):
    return cl.price_floor(quotes(spark, d), 1200.0).select("symbol")


NAMES = "nm AS (SELECT c_custkey AS id, c_name || CASE c_custkey % 6 WHEN 0 THEN ' 2X Long' WHEN 1 THEN ' ETF' WHEN 2 THEN ' Ultra Daily' WHEN 3 THEN ' Holdings' ELSE '' END AS name, CASE WHEN c_custkey % 10 = 3 THEN 'etf_context' WHEN c_custkey % 10 = 4 THEN NULL ELSE c_mktsegment END AS sector FROM customer)"


@query(f"WITH {NAMES} SELECT id FROM nm WHERE NOT regexp_matches(lower(name), '2x|3x|leverage|leveraged|inverse|t-rex|tradr|direxion|proshares|etf|etn|daily target|ultra|bear|bull') AND upper(coalesce(sector, '')) <> 'ETF_CONTEXT'")
def exclude_products(spark, d):
    k = F.col("c_custkey") % 6
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.concat("c_name", F.when(k == 0, " 2X Long").when(k == 1, " ETF").when(k == 2, " Ultra Daily").when(k == 3, " Holdings").otherwise("")).alias("name"), F.when(F.col("c_custkey") % 10 == 3, "etf_context").when(F.col("c_custkey") % 10 == 4, None).otherwise(F.col("c_mktsegment")).alias("sector"))
    return cl.exclude_products(c, sector="sector").select("id")


@query(f"{ITEMS} SELECT external_id FROM raw_items WHERE NOT contains(coalesce(text, ''), 'eren') AND NOT contains(coalesce(text, ''), 'leau') AND length(trim(coalesce(text, ''))) >= 60 AND lower(source_name) NOT IN ('src3', 'src7')")
def drop_self_generated(spark, d):
    return cl.drop_self_generated(raw_items(spark, d), ["eren", "leau"], ["SRC3", "src7"], 60).select("external_id")


ADS = "click here|buy now|subscribe|leau[a-z]*x"
NOISE = [r"(?i)the\s+of", r"https?://\S+", r"(?i)\bund\s+der\b"]


@query(rf"{ITEMS} SELECT external_id, NOT regexp_matches(text, '{ADS}') AS no_ad, NOT (regexp_matches(text, '(?i)the\s+of') OR regexp_matches(text, 'https?://\S+') OR regexp_matches(text, '(?i)\bund\s+der\b')) AS no_noise FROM raw_items")
def ads_and_noise(spark, d):
    items = raw_items(spark, d).where("text is not null")
    flagged = lambda name, patterns: cl.drop_matching(items, patterns).select("external_id", F.lit(True).alias(name))
    return items.select("external_id").join(flagged("no_ad", [ADS]), "external_id", "left").join(flagged("no_noise", NOISE), "external_id", "left").na.fill(False)


@query(f"""{ITEMS}, c AS (SELECT external_id, CASE external_id % 3 WHEN 0 THEN 'neutral' WHEN 1 THEN 'positive' ELSE 'negative' END AS polarity, contains(text, 'tion') AS is_macro, len(regexp_extract_all(text, '[A-Z][a-z]{{9,}}')) AS n FROM raw_items) SELECT external_id FROM c WHERE NOT (polarity = 'neutral' AND NOT is_macro AND n = 0)""")
def drop_orphans(spark, d):
    kind = F.element_at(F.array(F.lit("neutral"), F.lit("positive"), F.lit("negative")), (F.col("external_id") % 3 + 1).cast("int"))
    c = raw_items(spark, d).where("text is not null").select("external_id", kind.alias("polarity"), F.contains("text", F.lit("tion")).alias("is_macro"), F.regexp_extract_all("text", F.lit("[A-Z][a-z]{9,}"), 0).alias("tickers"))
    return cl.drop_orphans(c).select("external_id")


@query("WITH r AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 0 WHEN o_orderkey % 5 = 1 THEN NULL ELSE o_totalprice END AS sr, CASE o_orderkey % 7 WHEN 0 THEN 'Refill row' WHEN 1 THEN 'deeper-empirical' WHEN 2 THEN NULL ELSE o_orderpriority END AS note FROM orders) SELECT id FROM r WHERE abs(coalesce(sr, 0)) > 0 AND NOT regexp_matches(coalesce(note, ''), '(?i)refill|deeper[-_ ]empirical')")
def valid_chain_rows(spark, d):
    k = F.col("o_orderkey")
    r = read(spark, d, "orders").select(k.alias("id"), F.when(k % 5 == 0, 0.0).when(k % 5 == 1, None).otherwise(F.col("o_totalprice")).alias("source_return"), F.when(k % 7 == 0, "Refill row").when(k % 7 == 1, "deeper-empirical").when(k % 7 == 2, None).otherwise(F.col("o_orderpriority")).alias("note"))
    return cl.valid_chain_rows(r).select("id")


@query(rf"""{ITEMS} SELECT external_id, lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(title, 'https?://\S+', '', 'g'), '\b([A-Z]{{1,6}})\.US\b', '\1', 'g'), '\bThe\b', 'Them', 'g'), '[^\p{{L}}\p{{N}}_\s%.,;:!?()\-]', ' ', 'g'), '\s+', ' ', 'g'))) AS norm,
    trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(title), '^ *(?:\[[^\[\]]*\] *)+', '', 'g'), 'https?://\S+', '', 'g'), '\b([A-Z]{{1,6}})\.US\b', '(\1)', 'g'), '\s{{2,}}', ' ', 'g')) AS header FROM raw_items""")
def title_norms(spark, d):
    t = F.col("title")
    return raw_items(spark, d).select("external_id", cl.normalise_dedupe(t, {"The": "Them"}).alias("norm"), cl.clean_header(t, [cl.LEADING_TAGS, cl.URL]).alias("header"))


GREETING, HEADER_ONLY = "^(?:De|The|Und) ", r"^\S+\s?\S*$"


@query(rf"""{ITEMS}, a AS (SELECT external_id, trim(regexp_replace(trim(split_part(text, chr(10), 2)), '\s{{2,}}', ' ', 'g')) AS x, trim(regexp_replace(trim(title), '\s{{2,}}', ' ', 'g')) AS y FROM raw_items WHERE text IS NOT NULL),
    b AS (SELECT external_id, CASE WHEN regexp_matches(x, '{GREETING}') OR length(x) < 8 THEN y ELSE x END AS s FROM a)
    SELECT external_id, CASE WHEN regexp_matches(s, '{GREETING}') OR length(s) < 8 OR regexp_matches(s, '{HEADER_ONLY}') THEN '' WHEN length(s) > 90 THEN CASE WHEN regexp_replace(substr(s, 1, 90), ' [^ ]*$', '') <> '' THEN regexp_replace(substr(s, 1, 90), ' [^ ]*$', '') ELSE substr(s, 1, 90) END || '...' ELSE s END AS issue FROM b""")
def issue_sentences(spark, d):
    items = raw_items(spark, d).where("text is not null").withColumn("line", F.get(F.split("text", "\n"), F.lit(1)))
    return items.select("external_id", cl.issue_sentence(F.coalesce("line", F.lit("")), F.col("title"), GREETING, HEADER_ONLY, []).alias("issue"))


DROPPED = [r"^(?i)the\b", r"^\S+$"]


@query(r"""WITH l AS (SELECT doc_id AS external_id, list_filter(regexp_split_to_array(coalesce(text, ''), '\r?\n'), lambda x: NOT (regexp_matches(trim(x), '(?i)^the\b') OR regexp_matches(trim(x), '^\S+$'))) AS a FROM documents),
    j AS (SELECT external_id, array_to_string(list_transform(a, lambda x: regexp_replace(regexp_replace(x, '<[^>]+>', '', 'g'), 'https?://\S+', '', 'g')), chr(10)) AS t FROM l)
    SELECT external_id, md5(regexp_replace(regexp_replace(t, '\n(?:[ \t]*\n){2,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS text FROM j""")
def final_clean(spark, d):
    r = cl.final_clean(raw_items(spark, d), DROPPED, ["<[^>]+>", r"https?://\S+"])
    return r.select("external_id", F.md5("text").alias("text"))


@query(None)
def phrase_clean(spark, d):
    """Backward references are beyond the SQL's regular expressions; tests hold it against Python's."""
    return raw_items(spark, d).select("external_id", cl.phrase_clean(F.coalesce("title", F.lit("")), [("the of", "the")]).alias("text"))


@query(r"""WITH l AS (SELECT doc_id, list_filter(list_transform(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, '(?i)\bthe\b')), lambda x: trim(regexp_replace(regexp_replace(x, 'https?://\S+', '', 'g'), '\s+', ' ', 'g'))), lambda x: length(x) >= 5 AND NOT regexp_matches(x, '(?i)\bthe\b')) AS a FROM documents WHERE text IS NOT NULL),
    c AS (SELECT doc_id, list_transform(a, lambda x: CASE WHEN length(x) > 40 THEN CASE WHEN regexp_replace(substr(x, 1, 40), ' [^ ]*$', '') <> '' THEN regexp_replace(substr(x, 1, 40), ' [^ ]*$', '') ELSE substr(x, 1, 40) END || '…' ELSE x END) AS a FROM l),
    f AS (SELECT doc_id, list_filter(a, lambda x, i: list_position(list_transform(a, lambda y: lower(y)), lower(x)) = i) AS a FROM c) SELECT doc_id AS external_id, coalesce(array_to_string(a[1:2], '|'), '') AS snippets FROM f""")
def snippets(spark, d):
    items = raw_items(spark, d).where("text is not null")
    return items.select("external_id", F.array_join(cl.snippets(F.split("text", "\n"), [r"(?i)\bthe\b"], 2, 40), "|").alias("snippets"))


@query(f"{ITEMS}, h AS (SELECT external_id, text, instr(text, 'tion') AS p FROM raw_items) SELECT external_id, p AS place, substr(text, greatest(p - 20, 1), p + 4 + 20 - greatest(p - 20, 1)) AS context FROM h WHERE p > 0")
def hit_context(spark, d):
    h = raw_items(spark, d).withColumn("at", F.instr("text", "tion")).where("at > 0")
    return h.select("external_id", F.col("at").alias("place"), cl.context(F.col("text"), F.col("at"), F.lit(4), 20).alias("context"))


@query("""SELECT o_orderkey AS id, round(CASE o_orderkey % 4 WHEN 0 THEN 10000.0 + o_orderkey % 900 + 1 WHEN 1 THEN (o_orderkey % 5000 + 1) * 1000 / 100.0 WHEN 2 THEN (o_orderkey % 90 + 1) * 1e6 * 1370 / 1e8 END, 5) AS amount, 'Acme' AS client,
    '2024-01-' || lpad(CAST(o_orderkey % 28 + 1 AS VARCHAR), 2, '0') AS contract_start, '2025-03-01' AS contract_end, o_orderkey % 50 + 0.5 AS revenue_share, o_orderkey % 9 = 0 AS is_amendment, o_orderkey % 11 = 0 AS is_cancellation, CASE WHEN o_orderkey % 4 < 3 THEN 'HIGH' ELSE 'MEDIUM' END AS confidence FROM orders""")
def contract_fields(spark, d):
    """Filings written out of the orders; the SQL knows what was written."""
    k = F.col("o_orderkey")
    amount = F.when(k % 4 == 0, F.concat(F.lit("1조 "), k % 900 + 1, F.lit("억원"))).when(k % 4 == 1, F.concat(k % 5000 + 1, F.lit(",000 백만원"))).when(k % 4 == 2, F.concat(F.lit("$"), k % 90 + 1, F.lit(" million"))).otherwise("미정")
    text = F.concat(F.lit("<p>계약금액 "), amount, F.lit("</p> 계약 상대방: Acme "), "o_custkey", F.lit(" 계약기간 2024.01."), F.lpad((k % 28 + 1).cast("string"), 2, "0"), F.lit(" ~ 2025-03-01 매출액 대비 "), k % 50, F.lit(".5 %"), F.when(k % 9 == 0, " 정정").otherwise(""), F.when(k % 11 == 0, " 계약 해지").otherwise(""))
    filings = read(spark, d, "orders").select(k.alias("id"), text.alias("text"))
    return cl.contract_fields(filings).withColumn("amount", F.round("amount", 5)).drop("text")


@query("""SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 2 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS date FROM orders""")
def list_dates(spark, d):
    k, day = F.col("o_orderkey"), F.col("o_orderdate")
    text = F.when(k % 3 == 0, F.concat(F.lit("report of "), F.date_format(day, "yyyy.MM.dd"), F.lit(" (mon)"))).when(k % 3 == 1, F.concat(F.date_format(day, "yyyy-M-d"), F.lit(" x"))).otherwise("no date 12.34")
    return read(spark, d, "orders").select(k.alias("id"), cl.list_date(text).alias("date"))


@query("""SELECT o_orderkey AS id, '  Title of report ' || o_orderkey AS raw, 'Title of report ' || o_orderkey AS title, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE '/view?id=' || o_orderkey END AS url, CASE WHEN o_orderkey % 2 = 0 THEN '/d/' || o_orderkey || '.pdf' ELSE '' END AS pdf_url, CAST(o_orderdate AS DATE) AS date, CASE WHEN o_custkey % 2 = 0 THEN 'Alpha Securities' ELSE 'cust' || o_custkey END AS broker FROM orders""")
def report_rows(spark, d):
    """A list page a row written out of the orders; the SQL knows what was written."""
    k = F.col("o_orderkey")
    title = F.concat(F.lit("Title of report "), k)
    link = F.when(k % 3 == 0, title).otherwise(F.concat(F.lit("<a class='x' href='/view?id="), k, F.lit("'> "), title, F.lit(" </a>")))
    file = F.when(k % 2 == 0, F.concat(F.lit('<a href="/d/'), k, F.lit('.pdf">pdf</a>'))).otherwise("")
    row = F.concat(F.lit("<table><tr><th>head</th></tr><TR><td>"), link, F.lit("</td><td>"), file, F.lit("</td><td>"), F.date_format("o_orderdate", "yyyy.MM.dd"), F.lit("</td><td>"), F.when(F.col("o_custkey") % 2 == 0, "Alpha Securities").otherwise(F.concat(F.lit("cust"), "o_custkey")), F.lit("</td></TR></table>"))
    pages = read(spark, d, "orders").select(k.alias("page_id"), row.alias("html"))
    r = cl.report_rows(pages, ["Alpha Securities", "Beta"])
    return r.select(F.col("page_id").alias("id"), F.concat(F.lit("  "), "title").alias("raw"), "title", "url", "pdf_url", "date", "broker")


@query("""SELECT event_id, CASE event_id % 4 WHEN 3 THEN NULL ELSE date_trunc('second', ts) END AS ts, CASE WHEN hours >= 24 AND hours % 24 > 0 THEN (hours // 24) || 'd ' || (hours % 24) || 'h' WHEN hours >= 24 THEN (hours // 24) || 'd' ELSE hours || 'h' END AS held
    FROM (SELECT *, greatest(0, CAST(floor(epoch(TIMESTAMP '2024-02-03 00:00:00') - epoch(date_trunc('second', ts))) AS BIGINT) // 3600) AS hours FROM events) q""")
def parse_moments(spark, d):
    k, ts = F.col("event_id"), F.date_trunc("second", F.col("ts"))
    text = F.when(k % 4 == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k % 4 == 1, F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss 'GMT'")).when(k % 4 == 2, F.date_format(ts, "yyyy-MM-dd HH:mm:ss")).otherwise("yesterday")
    return read(spark, d, "events").select("event_id", cl.parse_ts(text).alias("ts"), cl.hold_period(ts, F.lit("2024-02-03 00:00:00").cast("timestamp")).alias("held"))


@query("SELECT o_orderkey AS id, round(CASE WHEN o_totalprice - 100000 > 0 THEN (200000 / (o_totalprice - 100000) - 1) * 100 * CASE WHEN o_orderstatus = 'F' THEN 1 ELSE -1 END END, 5) AS r FROM orders")
def signed_returns(spark, d):
    up = F.when(F.col("o_orderstatus") == "F", "UP").otherwise("DOWN")
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.round(cl.signed_return(F.col("o_totalprice") - 100000, F.lit(200000.0), up), 5).alias("r"))


@query("""WITH p AS (SELECT o_custkey AS k, o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN '{bad' ELSE '[{"name": " ' || o_orderpriority || '"}, {"name": ""}, {"name": "N' || o_custkey % 20 || '"}]' END AS j FROM orders)
    SELECT name, count(*) AS n FROM (SELECT lower(trim(unnest([(SELECT o_orderpriority FROM orders o WHERE o.o_orderkey = p.id), 'N' || k % 20]))) AS name FROM p WHERE id % 5 <> 0 AND id % 7 <> 0) q GROUP BY name""")
def narrative_boost(spark, d):
    k = F.col("o_orderkey")
    j = F.when(k % 5 == 0, None).when(k % 7 == 0, "{bad").otherwise(F.concat(F.lit('[{"name": " '), "o_orderpriority", F.lit('"}, {"name": ""}, {"name": "N'), F.col("o_custkey") % 20, F.lit('"}]')))
    return cl.narrative_boost(read(spark, d, "orders").select(j.alias("bullish")))


@query("""SELECT c_custkey, array_to_string(list_filter(list_distinct_ordered, lambda x: x IS NOT NULL)[1:3], ',') AS merged FROM (SELECT c_custkey, CASE WHEN c_nationkey % 3 = 0 THEN [CAST(c_nationkey AS VARCHAR), 'b', 'c', 'd'] WHEN c_nationkey % 3 = 1 THEN [c_mktsegment, CAST(c_nationkey AS VARCHAR), 'b'] ELSE ['b', c_mktsegment, CAST(c_nationkey AS VARCHAR)] END AS list_distinct_ordered FROM customer) q""")
def merged_arrays(spark, d):
    n, m = F.col("c_nationkey").cast("string"), F.col("c_mktsegment")
    k = F.col("c_nationkey") % 3
    a = F.when(k == 0, F.array(n, F.lit("b"))).when(k == 1, F.array(m, n)).otherwise(F.array(F.lit("b"), m))
    b = F.when(k == 0, F.array(F.lit("b"), F.lit("c"), F.lit("d"))).when(k == 1, F.array(n, F.lit("b"))).otherwise(F.array(F.lit("b"), F.lit(None), n))
    return read(spark, d, "customer").select("c_custkey", F.array_join(cl.merge_arrays(a, b, F.lit(None).cast("array<string>"), most=3), ",").alias("merged"))


@query(r"""WITH l AS (SELECT doc_id AS external_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS k FROM documents),
    s AS (SELECT external_id, k, line, last_value(CASE WHEN regexp_matches(line, '^[A-Z][a-z]* [a-z]+\.') THEN line END IGNORE NULLS) OVER (PARTITION BY external_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS section FROM l)
    SELECT external_id, k, md5(line) AS line, md5(section) AS section FROM s""")
def section_state(spark, d):
    r = cl.section_state(raw_items(spark, d), r"^[A-Z][a-z]* [a-z]+\.")
    return r.select("external_id", "k", F.md5("line").alias("line"), F.md5("section").alias("section"))


@query("""SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 20000.0 + o_orderkey % 90 WHEN 1 THEN CAST(o_orderkey % 900 AS DOUBLE) ELSE (o_orderkey % 900) / 100.0 END AS won, CASE o_orderkey % 3 WHEN 0 THEN (o_orderkey % 90 + 1) * 1500.0 WHEN 1 THEN o_orderkey % 900 * 100.0 ELSE o_orderkey % 900 * 1.0 END AS dollars FROM orders""")
def amounts(spark, d):
    k = F.col("o_orderkey")
    won = F.when(k % 3 == 0, F.concat(F.lit("총 2조 "), k % 90, F.lit("억 원"))).when(k % 3 == 1, F.concat(k % 900, F.lit("억원"))).otherwise(F.concat(k % 900, F.lit(" 백만원")))
    usd = F.when(k % 3 == 0, F.concat(F.format_string("%.1f", (k % 90 + 1) * 1.5), F.lit(" Billion and 3 million"))).when(k % 3 == 1, F.concat(k % 900, F.lit("억 달러"))).otherwise(F.concat(F.lit("about "), k % 900, F.lit("M in all")))
    return read(spark, d, "orders").select(k.alias("id"), evidence.krw_amount(won).alias("won"), evidence.usd_amount(usd).alias("dollars"))
