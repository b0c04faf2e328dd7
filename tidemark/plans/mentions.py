"""Queries of mentions, candidates, judgements and fuzzy de-duplication; each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import cleaning, fuzzy, ranking
from tidemark.operators import mentions as mt
from tidemark.operators import text as tx
from tidemark.plans.tables import neighbours, raw_items, read, signals, symbols, with_tables
from tidemark.sources.shared import checkpointed

QUERIES, SQL = {}, {}
ITEMS = with_tables("raw_items")

#: (symbol, alias, needs context) that suit the invented words of the tables; no two of them overlap
#: but "the" within "there".
ALIASES = [("S_THERE", "there", False), ("S_THE", "the", False), ("S_DER", "der", True), ("S_QUE", "que", False), ("S_QUE", "qui", False)]
STOCK = "tion"


def query(sql: str | None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def places(word: str, table: str = "raw_items") -> str:
    """SQL of external_id, i (1-based) and the text after each place of a word that doesn't overlap itself."""
    return f"""(SELECT external_id, CAST(sum(length(part)) OVER w + k * {len(word)} - {len(word)} + 1 AS BIGINT) AS i, lead(part) OVER w AS after FROM (SELECT external_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS k
      FROM (SELECT external_id, string_split(text, '{word}') AS parts FROM {table}) a) b WINDOW w AS (PARTITION BY external_id ORDER BY k) QUALIFY after IS NOT NULL)"""


def hits_sql(items: str, table: str = "raw_items") -> str:
    near = "substr(text, greatest(1, i - 80), i + 83 - greatest(1, i - 80))"
    return f"""{items}, h0 AS (SELECT external_id, i, CASE WHEN starts_with(after, 're') THEN 'there' ELSE 'the' END AS alias FROM {places('the', table)} UNION ALL SELECT external_id, i, 'que' FROM {places('que', table)}
      UNION ALL SELECT external_id, i, 'qui' FROM {places('qui', table)} UNION ALL SELECT external_id, i, 'der' FROM {places('der', table)}),
    hits AS (SELECT h0.external_id, text, i - 1 AS place, alias, CASE alias WHEN 'there' THEN 'S_THERE' WHEN 'the' THEN 'S_THE' WHEN 'der' THEN 'S_DER' ELSE 'S_QUE' END AS symbol FROM h0 JOIN {table} r ON r.external_id = h0.external_id
      WHERE alias <> 'der' OR contains({near}, '{STOCK}') OR contains({near}, '$der') OR contains({near}, '(der)'))"""


HITS = hits_sql(ITEMS)


def hits(spark, d) -> DataFrame:
    return mt.alias_mentions(raw_items(spark, d), ALIASES, [], STOCK)


@query(f"{HITS} SELECT external_id, symbol, count(*) AS mentions FROM hits GROUP BY external_id, symbol")
def alias_mentions(spark, d):
    return mt.mention_table(hits(spark, d)).select("external_id", "symbol", "mentions")


@query(f"{HITS} SELECT symbol, count(DISTINCT external_id) AS items, count(*) AS mentions FROM hits WHERE symbol <> 'S_QUE' GROUP BY symbol ORDER BY mentions DESC, symbol LIMIT 10")
def top_mentions(spark, d):
    return mt.top_mentions(hits(spark, d), ["S_QUE"])


@query(f"{HITS} SELECT external_id, symbol, place FROM hits WHERE NOT (alias = 'the' AND (regexp_matches(substr(text, place + 4, 100), '^(?:\\)| of)') OR NOT regexp_matches(substr(text, place + 4, 100), 'ing')))")
def drop_attribution(spark, d):
    kept = mt.drop_attribution(hits(spark, d), ["the"], r"\)| of", "ing")
    return kept.select("external_id", "symbol", F.col("at").alias("place"))


@query(rf"""{ITEMS}, words AS (SELECT DISTINCT w AS alias, upper(substr(w, 1, 3)) AS symbol FROM (SELECT unnest(regexp_extract_all(title, '[A-Z][a-z]{{5}}')) AS w FROM raw_items WHERE title IS NOT NULL) q),
    found AS (SELECT external_id, unnest(regexp_extract_all(text, '[A-Z][a-z]{{5}}')) AS alias FROM raw_items WHERE text IS NOT NULL)
    SELECT symbol, count(DISTINCT words.alias) AS aliases, count(DISTINCT external_id) AS items, count(*) AS mentions FROM found JOIN words ON words.alias = found.alias GROUP BY symbol""")
def alias_table(spark, d):
    """Aliases out of the titles, thousands of them: a capital and five letters, so that no two overlap."""
    items = raw_items(spark, d)
    words = items.select(F.explode(F.regexp_extract_all("title", F.lit("[A-Z][a-z]{5}"), 0)).alias("alias")).distinct()
    book = words.select(F.upper(F.substring("alias", 1, 3)).alias("symbol"), "alias", F.lit(False).alias("marked"))
    found = mt.alias_mentions(items, book, [], STOCK)
    return found.groupBy("symbol").agg(F.count_distinct("alias").alias("aliases"), F.count_distinct("external_id").alias("items"), F.count("*").alias("mentions"))


#: Items of which some begin with a house's name and some end with a ticker behind a dollar sign.
MARKED = f"""{ITEMS}, marked AS (SELECT external_id, title, CASE WHEN external_id % 4 = 0 THEN 'Citi) ' ELSE '' END || text || CASE WHEN external_id % 5 = 0 THEN ' $De up' ELSE '' END AS text FROM raw_items)"""
EDGE = r"[^\p{L}\p{N}_]"
AROUND = lambda at, n, text="text", w=20: f"substr({text}, greatest({at} - {w}, 0) + 1, {at} + {n} + {w} - greatest({at} - {w}, 0))"
WORD = lambda t: rf"(?s)^(|.*?{EDGE}){t}(?:{EDGE}|$)"
EVIDENCE = rf"""{hits_sql(MARKED, 'marked')}, behind AS (SELECT external_id, regexp_replace(text, '^(?i:Citi)\s*[)\]:]\s*', '') AS text FROM marked WHERE regexp_matches(text, '^(?i:Citi)\s*[)\]:]\s*.{{5}}')),
    names AS (SELECT DISTINCT symbol, alias FROM hits), tickers AS (SELECT * FROM (VALUES ('S_THE', 'De'), ('S_QUE', 'Und')) v(symbol, ticker) WHERE symbol IN (SELECT symbol FROM hits)),
    words AS (SELECT symbol, ticker, external_id, text, length(regexp_extract(text, CASE ticker WHEN 'De' THEN '{WORD("De")}' ELSE '{WORD("Und")}' END, 1)) AS pl FROM marked, tickers WHERE regexp_matches(text, CASE ticker WHEN 'De' THEN '{WORD("De")}' ELSE '{WORD("Und")}' END)),
    cx AS (SELECT symbol, 1 AS stream, -length(alias) AS l, external_id, min(place) AS pl, regexp_replace(arg_min({AROUND('place', 'length(alias)')}, place), '^(?i:Citi)\s*[)\]:]\s*', '') AS context FROM hits GROUP BY symbol, alias, external_id
      UNION ALL SELECT symbol, 2, -length(alias), external_id, instr(text, alias) - 1, {AROUND('(instr(text, alias) - 1)', 'length(alias)', 'text', 15)} FROM behind, names WHERE contains(text, alias)
      UNION ALL SELECT symbol, 3, -length(ticker), external_id, pl, {AROUND('pl', 'length(ticker)')} FROM words
      UNION ALL SELECT symbol, 4, -length(ticker) - 1, external_id, instr(text, '$' || ticker) - 1, {AROUND("(instr(text, '$' || ticker) - 1)", '(length(ticker) + 1)')} FROM marked, tickers WHERE contains(text, '$' || ticker)),
    f AS (SELECT * FROM cx WHERE NOT regexp_matches(context, '\d') QUALIFY row_number() OVER (PARTITION BY symbol, context ORDER BY stream, l, external_id, pl) = 1),
    ev AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY stream, l, external_id, pl, context) AS k FROM f QUALIFY k <= 10)"""


def marked(spark, d) -> DataFrame:
    k = F.col("external_id")
    text = F.concat(F.when(k % 4 == 0, "Citi) ").otherwise(""), "text", F.when(k % 5 == 0, " $De up").otherwise(""))
    return raw_items(spark, d).withColumn("text", text)


def evidence_of(spark, items: DataFrame, found: DataFrame) -> DataFrame:
    tickers = spark.range(1).select(F.inline(F.array(*(F.struct(F.lit(s).alias("symbol"), F.lit(t).alias("ticker")) for s, t in (("S_THE", "De"), ("S_QUE", "Und"), ("S_DER", "12"), ("S_THERE", "x"))))))
    return mt.direct_evidence(mt.evidence_streams(items, found, tickers, ["Citi"], r"\)| of", "ing", 20), r"\d")


@query(f"{EVIDENCE} SELECT symbol, string_agg(context, '|' ORDER BY k) AS contexts, count(*) AS n FROM ev GROUP BY symbol")
def direct_evidence(spark, d):
    items = marked(spark, d)
    found = checkpointed(mt.alias_mentions(items, ALIASES, [], STOCK))
    return evidence_of(spark, items, found).select("symbol", F.array_join("contexts", "|").alias("contexts"), "n")


@query(f"""{EVIDENCE}, g AS (SELECT symbol, count(*) AS evidence, count(*) FILTER (regexp_matches(context, 'and|und')) AS p, count(*) FILTER (regexp_matches(context, 'of|le')) AS m,
      string_agg(substr(context, 1, 60), '|' ORDER BY k) FILTER (k <= 3 AND regexp_matches(context, 'and|und')) AS catalysts, string_agg(substr(context, 1, 60), '|' ORDER BY k) FILTER (k <= 3 AND regexp_matches(context, 'of|le')) AS risks FROM ev GROUP BY symbol),
    said AS (SELECT symbol, external_id FROM hits GROUP BY symbol, external_id QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY external_id) <= 3),
    tt AS (SELECT symbol, string_agg(CASE WHEN length(title) > 60 THEN substr(title, 1, 59) || '…' ELSE title END, '|' ORDER BY said.external_id) AS titles FROM said JOIN (SELECT external_id, coalesce(title, '') AS title FROM marked) m ON m.external_id = said.external_id GROUP BY symbol)
    SELECT h.symbol, h.mentions, CASE WHEN p > 0 AND m > 0 THEN 'mixed' WHEN p > 0 THEN 'positive' WHEN m > 0 THEN 'negative' ELSE 'neutral' END AS sentiment, coalesce(catalysts, '') AS catalysts, coalesce(risks, '') AS risks, titles, coalesce(evidence, 0) AS evidence
    FROM (SELECT symbol, count(*) AS mentions FROM hits GROUP BY symbol) h LEFT JOIN g ON g.symbol = h.symbol JOIN tt ON tt.symbol = h.symbol""")
def candidate_table(spark, d):
    items = marked(spark, d)
    h = checkpointed(mt.alias_mentions(items, ALIASES, [], STOCK))
    c = mt.candidate_table(h, evidence_of(spark, items, h), mt.titles(items, h), "and|und", "of|le")
    lists = {n: F.array_join(n, "|") for n in ("catalysts", "risks", "titles")}
    return c.withColumns(lists)


@query("""WITH c AS (SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'positive' WHEN 1 THEN 'mixed' WHEN 2 THEN 'negative' ELSE 'neutral' END AS s, c_custkey % 6 AS a, c_custkey % 5 AS b, c_nationkey % 5 AS t, c_custkey % 9 * 2.5 AS sp, c_custkey % 11 AS m, c_custkey % 4 AS e, c_custkey % 7 AS x, c_nationkey % 6 AS r FROM customer)
    SELECT id, least(100.0, CASE s WHEN 'positive' THEN 12.0 + least(a * 2.0, 8.0) WHEN 'mixed' THEN CASE WHEN a > b THEN 8.0 ELSE 5.0 END WHEN 'negative' THEN 2.0 ELSE 5.0 END + least(t * 4.0, 15.0) + least(sp, 15.0) + least(greatest(m - 1, 0) * 2.5, 15.0) + CASE WHEN e >= 3 THEN 10.0 WHEN e = 2 THEN 7.0 WHEN e = 1 THEN 4.0 ELSE 0.0 END + least(x * 3.0, 15.0) + least(r * 2.5, 10.0)) AS alpha FROM c""")
def sentiment_alpha(spark, d):
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    s = F.element_at(F.array(*map(F.lit, ("positive", "mixed", "negative", "neutral"))), (k % 4 + 1).cast("int"))
    return read(spark, d, "customer").select(k.alias("id"), mt.sentiment_alpha(s, k % 6, k % 5, n % 5, k % 9 * 2.5, k % 11, k % 4, k % 7, n % 6).alias("alpha"))


THEMES = {"land": ["und", "der"], "sea": ["the"], "sky": ["leau", "que"]}
CATS = [("rates", ["eren", "ENTH"]), ("oil", ["leau"]), ("jobs", ["sch"])]


@query(f"""{ITEMS} SELECT external_id, array_to_string(list_filter([CASE WHEN contains(text, 'und') OR contains(text, 'der') THEN 'land' END, CASE WHEN contains(text, 'the') THEN 'sea' END, CASE WHEN contains(text, 'leau') OR contains(text, 'que') THEN 'sky' END], lambda x: x IS NOT NULL), ',') AS themes,
    CASE WHEN contains(lower(text), 'eren') OR contains(lower(text), 'enth') THEN 'rates' WHEN contains(lower(text), 'leau') THEN 'oil' WHEN contains(lower(text), 'sch') THEN 'jobs' ELSE 'unknown' END AS category FROM raw_items""")
def themes_and_categories(spark, d):
    c = F.coalesce("text", F.lit(""))
    return raw_items(spark, d).select("external_id", F.array_join(mt.themes(c, THEMES), ",").alias("themes"), mt.first_category(c, CATS, "unknown").alias("category"))


GOOD, BAD, OVER, IDLE = ["and", "und", "et "], ["of", "le ", "der"], ["eren", "der"], "^Re"
MANY = lambda ws: "(" + " + ".join(f"CAST(contains(t, '{w}') AS INT)" for w in ws) + ")"


@query(f"""{ITEMS}, x AS (SELECT external_id, coalesce(title, '') AS t FROM raw_items) SELECT external_id, CASE WHEN regexp_matches(t, '{IDLE}') THEN 'neutral' WHEN contains(t, 'eren') OR contains(t, 'der') THEN CASE WHEN {MANY(['of', 'le '])} > {MANY(GOOD)} + 1 THEN 'negative' ELSE 'positive' END
    WHEN {MANY(GOOD)} > {MANY(BAD)} THEN 'positive' WHEN {MANY(BAD)} > {MANY(GOOD)} THEN 'negative' WHEN {MANY(GOOD)} > 0 THEN 'mixed' ELSE 'neutral' END AS refined,
    CASE WHEN {MANY(BAD)} > {MANY(GOOD)} OR {MANY(BAD)} = {MANY(GOOD)} AND {MANY(BAD)} > 0 THEN 'negative' WHEN {MANY(GOOD)} > {MANY(BAD)} THEN 'positive' ELSE 'neutral' END AS event FROM x""")
def refined_polarity(spark, d):
    t = F.coalesce("title", F.lit(""))
    return raw_items(spark, d).select("external_id", mt.refined_polarity(t, GOOD, BAD, OVER, IDLE).alias("refined"), mt.event_polarity(t, GOOD, BAD).alias("event"))


@query(f"""WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents), s AS (SELECT doc_id, a[1:2] AS c, a[3:4] AS r FROM l),
    k AS (SELECT doc_id, unnest(c) AS t, generate_subscripts(c, 1) AS i, 'c' AS o FROM s UNION ALL SELECT doc_id, unnest(r), generate_subscripts(r, 1), 'r' FROM s),
    e AS (SELECT *, CASE WHEN {MANY(BAD)} > {MANY(GOOD)} OR {MANY(BAD)} = {MANY(GOOD)} AND {MANY(BAD)} > 0 THEN 'negative' WHEN {MANY(GOOD)} > {MANY(BAD)} THEN 'positive' ELSE 'neutral' END AS kind FROM k)
    SELECT s.doc_id AS external_id, md5(coalesce((SELECT string_agg(t, '|' ORDER BY o, i) FROM e WHERE e.doc_id = s.doc_id AND (o = 'c' AND kind <> 'negative' OR o = 'r' AND kind = 'positive')), '')) AS catalysts,
      md5(coalesce((SELECT string_agg(t, '|' ORDER BY o DESC, i) FROM e WHERE e.doc_id = s.doc_id AND (o = 'r' AND kind <> 'positive' OR o = 'c' AND kind = 'negative')), '')) AS risks FROM s""")
def reassigned(spark, d):
    a = F.split(F.coalesce("text", F.lit("")), "\n")
    c, r = mt.reassign(F.slice(a, 1, 2), F.slice(a, 3, 2), GOOD, BAD)
    return raw_items(spark, d).select("external_id", F.md5(F.array_join(c, "|")).alias("catalysts"), F.md5(F.array_join(r, "|")).alias("risks"))


SAID = """sd AS (SELECT y.symbol, y.name, y.sector, d.text FROM (SELECT symbol, CASE symbol % 3 WHEN 0 THEN 'the and' WHEN 1 THEN 'leau' ELSE 'un' END AS name, sector FROM symbols) y LEFT JOIN documents d ON d.doc_id % (SELECT count(*) FROM supplier) = y.symbol AND d.doc_id >= 30)"""


def said(spark, d) -> DataFrame:
    """Each symbol with the items whose number stands for it."""
    k = F.col("symbol")
    y = symbols(spark, d).select("symbol", F.when(k % 3 == 0, "the and").when(k % 3 == 1, "leau").otherwise("un").alias("name"), "sector")
    n = F.broadcast(y.agg(F.count("*").alias("n_symbols")))
    t = raw_items(spark, d).where("external_id >= 30").join(n).select((F.col("external_id") % F.col("n_symbols")).alias("symbol"), "text")
    return y.join(t, "symbol", "left")


SECTOR_WORDS = {"france": ["eau", "que"], "germany": ["sch"]}


@query(rf"""{with_tables('symbols')}, {SAID}, w AS (SELECT *, ' ' || regexp_replace(lower(text), '[^\p{{L}}\p{{N}}]+', '  ', 'g') || ' ' AS t FROM sd)
    SELECT symbol, ['REJECT', 'WEAK', 'SECTOR', 'DIRECT'][max(CASE WHEN text IS NULL THEN 0 WHEN contains(t, ' ' || symbol || ' ') OR length(name) >= 3 AND contains(t, ' ' || replace(name, ' ', '  ') || ' ') THEN 3
      WHEN lower(sector) = 'france' AND (contains(lower(text), 'eau') OR contains(lower(text), 'que')) OR lower(sector) = 'germany' AND contains(lower(text), 'sch') THEN 2 ELSE 1 END) + 1] AS quality FROM w GROUP BY symbol""")
def evidence_quality(spark, d):
    return mt.evidence_quality(said(spark, d), SECTOR_WORDS)


@query(f"""{with_tables('symbols')}, {SAID}, c AS (SELECT symbol, count(*) AS n, sum((length(lower(text)) - length(replace(lower(text), 'and', ''))) / 3 + (length(lower(text)) - length(replace(lower(text), 'und', ''))) / 3) AS p, sum((length(lower(text)) - length(replace(lower(text), 'leau', ''))) / 4) AS m FROM sd WHERE text IS NOT NULL GROUP BY symbol)
    SELECT symbol, n, CASE WHEN p + m = 0 THEN 55.0 ELSE round(20 + 60.0 * p / (p + m), 1) END AS score FROM c""")
def news_sentiment(spark, d):
    return mt.news_sentiment(said(spark, d), ["and", "und"], ["leau"])


@query("SELECT c_custkey AS id, CASE WHEN s >= 7 THEN 'high' WHEN s >= 3 THEN 'medium' ELSE 'low' END AS label FROM (SELECT c_custkey, c_custkey % 5 + 2 * (c_nationkey % 3) + CASE WHEN c_acctbal > 0 THEN 2 ELSE 0 END AS s FROM customer) q")
def confidence_labels(spark, d):
    return read(spark, d, "customer").select(F.col("c_custkey").alias("id"), mt.confidence_label(F.col("c_custkey") % 5, F.col("c_nationkey") % 3, F.col("c_acctbal") > 0).alias("label"))


CLUSTERS = """cl AS (SELECT doc_id AS id, source AS source_name, split_part(text, chr(10), 1) AS headline, CASE doc_id % 4 WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' WHEN 2 THEN 'neutral' ELSE 'positive' END AS polarity, doc_id % 3 + 1 AS sources, doc_id % 10 / 2.0 AS score, doc_id % 5 = 0 AS is_macro, doc_id % 2 AS n_tickers FROM documents WHERE text IS NOT NULL)"""


def told_clusters(spark, d) -> DataFrame:
    k = F.col("external_id")
    kind = F.element_at(F.array(*map(F.lit, ("positive", "negative", "neutral", "positive"))), (k % 4 + 1).cast("int"))
    return raw_items(spark, d).where("text is not null").select(k.alias("id"), "source_name", F.col("title").alias("headline"), kind.alias("polarity"), (k % 3 + 1).alias("sources"), (k % 10 / 2.0).alias("score"), (k % 5 == 0).alias("is_macro"), (k % 2).alias("n_tickers"))


RADAR = [("north", ["the", "and"]), ("south", ["que", "le "]), ("none", ["zzzz"])]
RADAR_SQL = """sx AS (SELECT *, unnest(list_filter([CASE WHEN contains(headline, 'the') OR contains(headline, 'and') THEN 'north' END, CASE WHEN contains(headline, 'que') OR contains(headline, 'le ') THEN 'south' END], lambda x: x IS NOT NULL)) AS sector FROM cl),
    sr AS (SELECT {0}, sector, count(*) FILTER (polarity = 'positive') AS bull, count(*) FILTER (polarity = 'negative') AS bear, count(*) FILTER (sources = 1) AS novelty, sum(sources) AS sources FROM sx GROUP BY {0}, sector)"""


@query(f"WITH {CLUSTERS}, {RADAR_SQL.format('1')} SELECT sector, bull, bear, round(bull * 100.0 / (bull + bear), 5) AS score, novelty, sources, CASE WHEN bull + bear >= 3 THEN 'high' WHEN bull + bear = 2 THEN 'medium' ELSE 'low' END AS confidence FROM sr WHERE bull + bear > 0".replace("SELECT 1, sector", "SELECT sector").replace("GROUP BY 1, sector", "GROUP BY sector"))
def sector_radar(spark, d):
    return mt.sector_radar(told_clusters(spark, d), RADAR).withColumn("score", F.round("score", 5))


@query(f"WITH {CLUSTERS}, {RADAR_SQL.format('id % 3 = 0')}, s AS (SELECT *, bull * 100.0 / (bull + bear) AS score FROM sr WHERE bull + bear > 0) SELECT a.sector, round(a.score - b.score, 5) AS delta, CASE WHEN a.score - b.score >= 10 THEN 'rising' WHEN a.score - b.score <= -10 THEN 'cooling' ELSE 'steady' END AS trend FROM s a JOIN s b ON a.sector = b.sector AND a.now AND NOT b.now".replace("SELECT id % 3 = 0, sector", "SELECT id % 3 = 0 AS now, sector"))
def sentiment_delta(spark, d):
    c = told_clusters(spark, d)
    return mt.sentiment_delta(mt.sector_radar(c.where("id % 3 = 0"), RADAR), mt.sector_radar(c.where("id % 3 <> 0"), RADAR)).withColumn("delta", F.round("delta", 5))


COUNTED = lambda ws, each: " + ".join(f"CASE WHEN contains(headline, '{w}') THEN {each} ELSE 0 END" for w in ws)
SCORED = f"""{CLUSTERS}, cs AS (SELECT id, CASE WHEN is_macro THEN 'macro' WHEN polarity = 'negative' THEN 'negative' ELSE 'positive' END AS bucket, score + 0.5 * sources + CASE WHEN regexp_matches(source_name, 'src1') THEN 3 ELSE 0 END + CASE WHEN n_tickers > 0 THEN 2 ELSE 0 END
      + CASE WHEN is_macro THEN {COUNTED(['the'], 2.0)} WHEN polarity = 'negative' THEN {COUNTED(['le ', 'der'], 1.5)} ELSE {COUNTED(['and', 'und'], 1.5)} END AS score FROM cl WHERE NOT regexp_matches(headline, 'xx') AND NOT (polarity = 'neutral' AND NOT is_macro AND n_tickers = 0))"""


def scored_clusters(spark, d) -> DataFrame:
    return mt.cluster_scores(told_clusters(spark, d), ["the"], ["and", "und"], ["le ", "der"], "src1", "xx")


@query(f"WITH {SCORED} SELECT id, bucket, score FROM cs")
def cluster_scores(spark, d):
    return scored_clusters(spark, d)


@query(f"WITH {SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY score DESC, id) AS k FROM cs) SELECT id, bucket, score FROM r WHERE bucket = 'macro' AND k <= 12 OR bucket = 'positive' AND k <= 14 OR bucket = 'negative' AND k <= 14")
def evidence_budget(spark, d):
    """Caps of 12, 30 and 20 and 40 of all: 12 macros stay, and 14 of either other."""
    return mt.within_budget(scored_clusters(spark, d), {"macro": 12, "positive": 30, "negative": 20}, 40)


@query(f"WITH {CLUSTERS}, c AS (SELECT id, headline, CASE WHEN contains(lower(headline), 'eren') OR contains(lower(headline), 'enth') THEN 'rates' WHEN contains(lower(headline), 'leau') THEN 'oil' WHEN contains(lower(headline), 'sch') THEN 'jobs' END AS category FROM cl), o AS (SELECT *, row_number() OVER (PARTITION BY headline ORDER BY id) AS n FROM c WHERE category IS NOT NULL AND headline <> '' QUALIFY n = 1) SELECT category, row_number() OVER (PARTITION BY category ORDER BY id) AS k, id FROM o QUALIFY k <= 2")
def category_headlines(spark, d):
    return mt.category_headlines(told_clusters(spark, d), CATS)


@query(f"""{with_tables('symbols', 'signals', 'neighbours')}, m AS (SELECT symbol, count(*) AS m FROM (SELECT source AS symbol FROM neighbours UNION ALL SELECT target FROM neighbours UNION ALL SELECT source FROM neighbours WHERE source % 2 = 0 UNION ALL SELECT target FROM neighbours WHERE source % 2 = 0) q GROUP BY symbol),
    b AS (SELECT symbol, max(score) AS score, arg_max(side, score * 1000 + CASE side WHEN 'LONG' THEN 1 WHEN 'SHORT' THEN 2 ELSE 3 END * 1e-9) AS side, count(*) AS n FROM signals GROUP BY symbol)
    SELECT coalesce(b.symbol, m.symbol) AS symbol, round(coalesce(score, 0.0), 5) AS score, coalesce(side, '') AS side, coalesce(n, 0) + coalesce(m, 0) AS mentions FROM b FULL JOIN m ON m.symbol = b.symbol""")
def symbol_summary(spark, d):
    e = neighbours(spark, d)
    return mt.symbol_summary(signals(spark, d), e, e.where("source % 2 = 0")).withColumn("score", F.round("score", 5))


@query("""WITH a AS (SELECT c_custkey AS symbol, CASE c_custkey % 6 WHEN 0 THEN 'a' WHEN 1 THEN 'Oil' WHEN 2 THEN 'ab' WHEN 3 THEN 'AB' WHEN 4 THEN 'Group' ELSE c_name || ' and ' || c_mktsegment END AS alias, c_nationkey % 2 = 0 AS marked FROM customer)
    SELECT symbol, alias, 'single_character' AS finding, 'HIGH' AS severity FROM a WHERE alias = 'a' UNION ALL SELECT symbol, alias, 'macro_word', 'HIGH' FROM a WHERE alias = 'Oil' UNION ALL SELECT symbol, alias, 'short_unprotected', 'MEDIUM' FROM a WHERE alias IN ('a', 'ab') AND NOT marked
    UNION ALL SELECT symbol, alias, 'common_word', 'MEDIUM' FROM a WHERE alias = 'Group' UNION ALL SELECT symbol, alias, 'too_long', 'LOW' FROM a WHERE length(alias) > 20""")
def audit_aliases(spark, d):
    k = F.col("c_custkey") % 6
    alias = F.when(k == 0, "a").when(k == 1, "Oil").when(k == 2, "ab").when(k == 3, "AB").when(k == 4, "Group").otherwise(F.concat("c_name", F.lit(" and "), "c_mktsegment"))
    return mt.audit_aliases(read(spark, d, "customer").select(F.col("c_custkey").alias("symbol"), alias.alias("alias"), (F.col("c_nationkey") % 2 == 0).alias("marked")), ["Oil"], ["Group"])


@query(r"""WITH r AS (SELECT doc_id AS id, coalesce(text, '') AS t, CASE WHEN doc_id % 2 = 0 THEN 'SHORT' ELSE 'LONG' END AS side, CAST(doc_id % 100 AS DOUBLE) AS score FROM documents),
    f AS (SELECT id, 'link' AS finding, len(regexp_extract_all(t, 'https?://')) AS n FROM r UNION ALL SELECT id, 'doubled', len(regexp_extract_all(t, '\bthe of\b')) FROM r UNION ALL SELECT id, 'forbidden', len(regexp_extract_all(t, '\b(ing|of)\b')) FROM r UNION ALL SELECT id, 'short_gate', CASE WHEN side = 'SHORT' AND score < 70 THEN 1 ELSE 0 END FROM r)
    SELECT * FROM f WHERE n > 0""")
def lint_reports(spark, d):
    k = F.col("external_id")
    r = raw_items(spark, d).select(k.alias("id"), "text", F.when(k % 2 == 0, "SHORT").otherwise("LONG").alias("side"), (k % 100).cast("double").alias("score"))
    return mt.lint_reports(r, [("link", "https?://"), ("doubled", r"\bthe of\b")], ["ing", "of"])


@query(f"{ITEMS} SELECT a.external_id FROM raw_items a WHERE NOT EXISTS (SELECT 1 FROM raw_items b WHERE b.external_id % 4 = 0 AND coalesce(b.text, '') = coalesce(a.text, ''))")
def not_seen_before(spark, d):
    i = raw_items(spark, d).withColumn("hash", F.sha2(F.coalesce("text", F.lit("")), 256))
    return ranking.not_seen(i, i.where("external_id % 4 = 0").select("hash")).select("external_id")


def normed(spark, d, chars: int | None = None) -> DataFrame:
    """Whole items, or titles with the first ``chars`` characters, as the fuzzy operators compare them."""
    t = tx.normalise(F.col("text")) if chars is None else cleaning.normalise_dedupe(F.concat_ws(" ", "title", F.substring("text", 1, chars)))
    return checkpointed(raw_items(spark, d).select(F.col("external_id").alias("id"), F.col("published_at").alias("at"), F.coalesce(t, F.lit("")).alias("norm")))


@query(None)
def dedupe_fuzzy(spark, d):
    """SQL has no longest common subsequence; tests hold this and the next two against brute force."""
    return fuzzy.dedupe_fuzzy(normed(spark, d)).select(F.col("id").alias("external_id"))


@query(None)
def fuzzy_clusters(spark, d):
    """Title and 300 characters are what the operator compares."""
    return fuzzy.cluster_first(normed(spark, d, 300)).select(F.col("id").alias("external_id"), "cluster")


@query(None)
def dedupe_semantic(spark, d):
    v = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), (-F.col("vec_id")).alias("at"), "embedding")
    return fuzzy.dedupe_semantic(v).select(F.col("id").alias("vec_id"))
