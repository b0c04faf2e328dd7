"""Queries over signals and items; each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import lint, ranking, review, text
from tidemark.plans.tables import daily_bars, daily_closes, fundamentals, raw_items, signals, symbols, with_tables

QUERIES, SQL = {}, {}
SIG = with_tables("signals")
ITEMS = with_tables("raw_items")
SHARED = with_tables("symbols", "daily_bars", "signals")


def query(sql: str | None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


@query(f"""{SIG}, x AS (SELECT *, row_number() OVER (PARTITION BY symbol, side ORDER BY created_at, id) AS n FROM signals WHERE score >= 80)
    SELECT id, symbol, side, round(score, 6) AS score, created_at FROM x WHERE n = 1""")
def first_crossing(spark, d):
    return review.first_crossing(signals(spark, d)).withColumn("score", F.round("score", 6))


@query(f"""{SIG}, a AS (SELECT symbol, id, row_number() OVER (PARTITION BY symbol ORDER BY score DESC, created_at DESC) AS m, score, created_at, count(*) OVER (PARTITION BY symbol) AS c FROM signals),
    f AS (SELECT symbol, id, row_number() OVER (PARTITION BY symbol ORDER BY created_at, id) AS n FROM signals WHERE id % 5 <> 0)
    SELECT a.symbol, max(f.id) AS first_id, round(max(score), 6) AS max_score, max(CASE WHEN m = 1 THEN created_at END) AS max_at, max(c) AS repeats FROM a LEFT JOIN f ON f.symbol = a.symbol AND f.n = 1 GROUP BY a.symbol""")
def signal_rollup(spark, d):
    """Every fifth signal has no price."""
    s = signals(spark, d).withColumn("price", F.when(F.col("id") % 5 != 0, F.col("score") + 1))
    return review.signal_rollup(s).withColumn("max_score", F.round("max_score", 6))


ENTRY = f"""{SHARED}, nx AS (SELECT s.id, s.symbol, s.side, s.score, s.created_at, max(b.ts) AS bts FROM signals s LEFT JOIN daily_bars b ON b.symbol = s.symbol AND b.ts <= s.created_at GROUP BY s.id, s.symbol, s.side, s.score, s.created_at),
    lt AS (SELECT symbol, max(ts) AS ts FROM daily_bars GROUP BY symbol), lp AS (SELECT b.symbol, b.close AS price FROM daily_bars b JOIN lt ON lt.symbol = b.symbol AND lt.ts = b.ts),
    e AS (SELECT nx.id, nx.symbol, nx.side, nx.created_at, b.close AS entry, lp.price, y.sector FROM nx LEFT JOIN daily_bars b ON b.symbol = nx.symbol AND b.ts = nx.bts LEFT JOIN lp ON lp.symbol = nx.symbol LEFT JOIN symbols y ON y.symbol = nx.symbol),
    o AS (SELECT *, CASE WHEN entry > 0 THEN CASE side WHEN 'LONG' THEN 1 WHEN 'SHORT' THEN -1 END * (price / entry - 1) * 100 END AS return_pct FROM e),
    oc AS (SELECT *, CASE WHEN return_pct IS NOT NULL THEN CASE WHEN return_pct > 0 THEN 1 ELSE 0 END END AS hit FROM o)"""


def outcomes(spark, d):
    from tidemark.operators.asof import asof_backward

    bars = daily_bars(spark, d)
    events = signals(spark, d).select("symbol", F.col("created_at").alias("ts"), "id", "side")
    entry = asof_backward(events, bars).withColumnRenamed("price", "entry").drop("price_ts")
    priced = review.attach_price(entry, review.latest_price(bars))
    return review.outcome(priced.join(symbols(spark, d).select("symbol", "sector"), "symbol", "left"))


@query(f"{ENTRY} SELECT id, symbol, side, round(entry, 6) AS entry, round(price, 6) AS price, round(return_pct, 6) AS return_pct, hit FROM oc")
def outcome_by_direction(spark, d):
    return outcomes(spark, d).select("id", "symbol", "side", F.round("entry", 6).alias("entry"), F.round("price", 6).alias("price"), F.round("return_pct", 6).alias("return_pct"), "hit")


@query(f"""{ENTRY} SELECT side, count(*) AS n, count(return_pct) AS evaluable, round(avg(return_pct), 6) AS mean_return, sum(hit) AS wins, round(CAST(sum(hit) AS DOUBLE) / count(hit) * 100, 6) AS win_rate,
    round(max(return_pct), 6) AS best, round(min(return_pct), 6) AS worst FROM oc WHERE side <> 'WATCH' GROUP BY side""")
def performance_by_side(spark, d):
    p = review.performance(outcomes(spark, d).where("side <> 'WATCH'"), "side")
    return p.select("side", "n", "evaluable", F.round("mean_return", 6).alias("mean_return"), "wins", F.round("win_rate", 6).alias("win_rate"), F.round("best", 6).alias("best"), F.round("worst", 6).alias("worst"))


@query(f"""{ENTRY}, od AS (SELECT *, CASE id % 3 WHEN 0 THEN 'value' WHEN 1 THEN 'growth' ELSE 'event' END AS style, CASE WHEN id % 2 = 0 THEN 'spillover' ELSE 'screen' END AS origin FROM oc)
    SELECT side, sector, style, origin, count(*) AS n, count(return_pct) AS evaluable, round(avg(return_pct), 6) AS mean_return, sum(hit) AS wins FROM od GROUP BY GROUPING SETS ((), (side), (sector), (style), (origin))""")
def performance_grouping_sets(spark, d):
    """Style and origin of a signal are told by its number."""
    k = F.col("id")
    o = outcomes(spark, d).withColumn("style", F.when(k % 3 == 0, "value").when(k % 3 == 1, "growth").otherwise("event")).withColumn("origin", F.when(k % 2 == 0, "spillover").otherwise("screen"))
    return review.performance_sets(o, "side", "sector", "style", "origin").withColumn("mean_return", F.round("mean_return", 6))


@query(f"""{ENTRY}, p AS (SELECT sector, count(*) AS n, CAST(sum(hit) AS DOUBLE) / count(hit) * 100 AS w FROM oc WHERE sector IS NOT NULL GROUP BY sector HAVING count(hit) > 0)
    SELECT sector, n, round(w, 6) AS win_rate, CASE WHEN w >= 52 THEN 'good' ELSE 'bad' END AS feedback FROM p WHERE w >= 52 OR w <= 48 AND n >= 2""")
def style_feedback(spark, d):
    return review.style_feedback(outcomes(spark, d).where("sector is not null"), good=52.0, bad=48.0).withColumn("win_rate", F.round("win_rate", 6))


@query(f"""{SIG} SELECT a.id, a.symbol, a.side, count(*) AS repeats FROM signals a JOIN signals b ON a.symbol = b.symbol AND a.side = b.side AND b.created_at <= a.created_at AND b.created_at >= a.created_at - 3
    GROUP BY a.id, a.symbol, a.side""")
def repeat_counts(spark, d):
    return review.repeat_counts(signals(spark, d)).select("id", "symbol", "side", "repeats")


@query(f"""{ENTRY}, z AS (SELECT *, CASE WHEN side = 'LONG' THEN entry * 0.9 ELSE entry * 1.1 END AS stop, CASE WHEN side = 'LONG' THEN entry * 1.15 ELSE entry * 0.85 END AS target FROM oc WHERE side <> 'WATCH')
    SELECT id, symbol, side, CASE WHEN side = 'LONG' AND price <= stop OR side = 'SHORT' AND price >= stop THEN 'STOP' WHEN side = 'LONG' AND price >= target OR side = 'SHORT' AND price <= target THEN 'TARGET'
    WHEN (SELECT max(created_at) FROM signals) - created_at >= 7 THEN 'TIMEOUT' ELSE 'OPEN' END AS exit FROM z""")
def position_exit(spark, d):
    long = F.col("side") == "LONG"
    asof = signals(spark, d).agg(F.max("created_at")).first()[0]
    o = outcomes(spark, d).where("side <> 'WATCH'").withColumn("stop", F.when(long, F.col("entry") * 0.9).otherwise(F.col("entry") * 1.1))
    o = o.withColumn("target", F.when(long, F.col("entry") * 1.15).otherwise(F.col("entry") * 0.85)).withColumn("held_days", F.datediff(F.lit(asof), "ts"))
    return review.position_exit(o).select("id", "symbol", "side", "exit")


@query(f"""{ENTRY}, z AS (SELECT *, CASE WHEN side = 'LONG' THEN entry * 0.9 ELSE entry * 1.1 END AS stop, CASE WHEN side = 'LONG' THEN entry * 1.15 ELSE entry * 0.85 END AS target FROM oc WHERE side <> 'WATCH' AND price IS NOT NULL),
    w AS (SELECT id, symbol, side, CASE WHEN side = 'LONG' AND price <= stop OR side = 'SHORT' AND price >= stop THEN 'STOP' WHEN side = 'LONG' AND price >= target OR side = 'SHORT' AND price <= target THEN 'TARGET' END AS alert FROM z)
    SELECT * FROM w WHERE alert IS NOT NULL""")
def price_alerts(spark, d):
    from tidemark.operators.asof import asof_backward
    from tidemark.sources.shared import checkpointed

    long = F.col("side") == "LONG"
    bars = checkpointed(daily_closes(spark, d))  # read by entries and latest prices
    events = signals(spark, d).where("side <> 'WATCH'").select("symbol", F.col("created_at").alias("ts"), "id", "side")
    o = asof_backward(events, bars).withColumnRenamed("price", "entry").withColumn("stop", F.when(long, F.col("entry") * 0.9).otherwise(F.col("entry") * 1.1))
    o = o.withColumn("target", F.when(long, F.col("entry") * 1.15).otherwise(F.col("entry") * 0.85)).select("id", "symbol", "side", "stop", "target")
    return review.price_alerts(o, review.latest_price(bars)).select("id", "symbol", "side", F.col("exit").alias("alert"))


@query(f"""{with_tables('symbols', 'signals')}, g AS (SELECT signals.*, sector FROM signals JOIN symbols ON symbols.symbol = signals.symbol), op AS (SELECT DISTINCT sector, symbol FROM g WHERE side = 'WATCH' AND score >= 75 AND (SELECT max(created_at) FROM signals) - created_at < 30),
    f AS (SELECT *, row_number() OVER (PARTITION BY sector, symbol ORDER BY score DESC, id) AS k FROM g WHERE side <> 'WATCH' AND score >= CASE WHEN symbol % 4 = 0 THEN 75 ELSE 80 END AND symbol NOT IN (SELECT symbol FROM op)),
    r AS (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY score DESC, id) AS rank FROM f WHERE k = 1), hd AS (SELECT sector, count(*) AS held FROM op GROUP BY sector)
    SELECT id, symbol, r.sector, round(score, 6) AS score, rank FROM r LEFT JOIN hd ON hd.sector = r.sector WHERE rank <= 6 - coalesce(held, 0)""")
def position_admission(spark, d):
    """One book a sector; symbols with a strong WATCH signal in the last 30 days stand for open positions."""
    s = signals(spark, d).join(symbols(spark, d).select("symbol", "sector"), "symbol")
    last = signals(spark, d).agg(F.max("created_at").alias("last_day"))
    held = s.where("side = 'WATCH' and score >= 75").join(F.broadcast(last)).where("datediff(last_day, created_at) < 30").select("sector", "symbol").distinct()
    return review.admit(s.where("side <> 'WATCH'").withColumn("small_cap", F.col("symbol") % 4 == 0), held, "sector").select("id", "symbol", "sector", F.round("score", 6).alias("score"), "rank")


@query(f"""{SIG}, u AS (SELECT *, id % 7 AS source, CASE WHEN id % 3 = 0 THEN 'UP_LEADS_UP' ELSE 'UP_LEADS_DOWN' END AS relation, CASE WHEN id % 4 <> 0 THEN CAST(id AS DOUBLE) END AS price, id % 2 AS sent FROM signals)
    SELECT source, symbol, side, relation, created_at, count(*) AS seen_count, min(id) AS first_id, max(id) AS last_id, round(max(score), 6) AS max_score, min(price) AS first_price, max(sent) AS sent FROM u GROUP BY source, symbol, side, relation, created_at""")
def upsert_signals(spark, d):
    k = F.col("id")
    s = signals(spark, d).withColumn("source", k % 7).withColumn("relation", F.when(k % 3 == 0, "UP_LEADS_UP").otherwise("UP_LEADS_DOWN")).withColumn("price", F.when(k % 4 != 0, k.cast("double"))).withColumn("sent", k % 2)
    return review.upsert_signals(s.where("created_at < '1998-01-01'"), s.where("created_at >= '1998-01-01'")).withColumn("max_score", F.round("max_score", 6))


@query(f"""{SIG} SELECT id, symbol, side, min(id) OVER w AS keep_id, count(*) OVER w AS seen, min(created_at) OVER w AS first_seen, max(created_at) OVER w AS last_seen, id % 4 = 0 AS missing_price, id <> min(id) OVER w AS archived FROM signals WINDOW w AS (PARTITION BY symbol, side)""")
def archive_duplicates(spark, d):
    return review.archive_duplicates(signals(spark, d).withColumn("price", F.when(F.col("id") % 4 != 0, F.col("score"))))


@query(f"""{ENTRY}, lag AS (SELECT *, id % 400 AS lag_days, (SELECT max(created_at) FROM signals) AS day FROM oc) SELECT id, CASE WHEN day - created_at < lag_days THEN 'pending' WHEN entry IS NULL OR price IS NULL THEN 'no_price' ELSE 'evaluable' END AS state,
    round(CASE WHEN day - created_at >= lag_days AND entry IS NOT NULL AND price IS NOT NULL THEN return_pct END, 5) AS return_pct, CASE WHEN day - created_at >= lag_days AND entry IS NOT NULL AND price IS NOT NULL THEN hit END AS hit FROM lag""")
def review_states(spark, d):
    o = outcomes(spark, d).withColumnRenamed("ts", "created_at").withColumn("lag_days", F.col("id") % 400)
    day = F.broadcast(signals(spark, d).agg(F.max("created_at").alias("day")))
    return review.review_state(o.drop("return_pct", "hit").join(day), F.col("day")).select("id", "state", F.round("return_pct", 5).alias("return_pct"), "hit")


@query(f"""{SHARED}, s AS (SELECT id, symbol, created_at, CASE WHEN id % 3 <> 0 THEN score END AS price, id % 2 = 0 AS verified FROM signals),
    c AS (SELECT s.id, min(b.ts) AS ts FROM s JOIN daily_bars b ON b.symbol = s.symbol AND b.ts BETWEEN s.created_at AND s.created_at + 8 WHERE b.close IS NOT NULL AND (s.price IS NULL OR NOT verified) GROUP BY s.id)
    SELECT s.id, round(CASE WHEN price IS NOT NULL AND verified THEN price ELSE coalesce(b.close, price) END, 8) AS price, CASE WHEN price IS NOT NULL AND verified THEN 'kept' WHEN b.ts IS NULL THEN 'failed_no_price' WHEN b.ts = s.created_at THEN 'exact_date_close' ELSE 'nearest_trading_day_close' END AS price_source
    FROM s LEFT JOIN c ON c.id = s.id LEFT JOIN daily_bars b ON b.symbol = s.symbol AND b.ts = c.ts""")
def backfill_prices(spark, d):
    k = F.col("id")
    s = signals(spark, d).select("id", "symbol", "created_at", F.when(k % 3 != 0, F.col("score")).alias("price"), (k % 2 == 0).alias("verified"))
    return review.backfill_prices(s, daily_bars(spark, d)).select("id", F.round("price", 8).alias("price"), "price_source")


@query(f"""{SIG}, l AS (SELECT *, CASE WHEN id % 3 <> 0 THEN score END AS price, CASE WHEN id % 4 = 0 THEN 'unverified' ELSE 'close' END AS price_source FROM signals WHERE id % 9 <> 0), g AS (SELECT symbol, side, count(*) AS n FROM l GROUP BY symbol, side)
    SELECT (SELECT count(*) FROM g WHERE n > 1) AS groups, (SELECT sum(n - 1)::BIGINT FROM g WHERE n > 1) AS to_archive, count(*) FILTER (price IS NULL) AS missing_price, count(*) FILTER (price_source = 'unverified') AS unverified FROM l""")
def duplicate_stats(spark, d):
    """Every ninth signal is archived and doesn't count."""
    k = F.col("id")
    s = signals(spark, d).withColumns({"price": F.when(k % 3 != 0, F.col("score")), "price_source": F.when(k % 4 == 0, "unverified").otherwise("close"), "archived": k % 9 == 0})
    return review.duplicate_stats(s)


@query(f"{SIG} SELECT a.id, a.symbol, a.side FROM signals a WHERE score >= 50 AND NOT EXISTS (SELECT 1 FROM signals b WHERE b.side = 'WATCH' AND b.symbol = a.symbol AND b.created_at = a.created_at)")
def new_picks_anti(spark, d):
    s = signals(spark, d)
    return ranking.except_seen(s.where("score >= 50"), s.where("side = 'WATCH'"), ["symbol", "created_at"]).select("id", "symbol", "side")


@query(f"{SIG} SELECT id, symbol, round(score, 6) AS score FROM (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS n FROM signals) q WHERE n <= 20")
def top_signals(spark, d):
    return ranking.top_k(signals(spark, d), "score", "id", 20).select("id", "symbol", F.round("score", 6).alias("score"))


@query(f"{SIG} SELECT id, symbol, side, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY score DESC, id) AS n FROM signals) q WHERE n = 1")
def best_per_symbol(spark, d):
    return ranking.best_per(signals(spark, d), ["symbol"], "score", "id").select("id", "symbol", "side", F.round("score", 6).alias("score"))


@query(f"""{with_tables('symbols', 'signals')}, x AS (SELECT id, sector, score, row_number() OVER (PARTITION BY sector ORDER BY score DESC, id) AS place FROM signals JOIN symbols ON signals.symbol = symbols.symbol)
    SELECT id, sector, place, place > 5 AS overflow FROM x""")
def sector_quota(spark, d):
    s = signals(spark, d).join(symbols(spark, d).select("symbol", "sector"), "symbol")
    return ranking.quota(s, "sector", "score", "id", 5).select("id", "sector", "place", "overflow")


@query(f"""{SIG}, x AS (SELECT id, side AS bucket, row_number() OVER (PARTITION BY side ORDER BY score DESC, id) AS n FROM signals) SELECT id, bucket FROM x WHERE n <= 30""")
def bucket_split(spark, d):
    return ranking.bucket_split(signals(spark, d), F.col("side"), "score", "id", 30).select("id", "bucket")


@query(f"""{SIG}, x AS (SELECT id, symbol, row_number() OVER (PARTITION BY symbol ORDER BY created_at, id) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS c FROM signals)
    SELECT id, symbol FROM x WHERE c <= 7 OR floor(i * 7.0 / c) <> floor((i - 1) * 7.0 / c)""")
def sample_even(spark, d):
    return ranking.sample_even(signals(spark, d), "symbol", ["created_at", "id"], 7).select("id", "symbol")


@query(f"{SIG} SELECT symbol, round(max(score), 6) AS score FROM signals WHERE side <> 'WATCH' GROUP BY symbol")
def merge_picks(spark, d):
    s = signals(spark, d).select("symbol", "score", "side")
    m = ranking.merge_max(s.where("side = 'LONG'").drop("side"), s.where("side = 'SHORT'").drop("side"), "symbol", "score")
    return m.select("symbol", F.round("score", 6).alias("score"))


@query(f"{SIG} SELECT DISTINCT symbol FROM signals WHERE side = 'LONG' UNION SELECT symbol FROM signals WHERE side = 'SHORT'")
def collect_universe(spark, d):
    s = signals(spark, d)
    return ranking.union_distinct(s.where("side = 'LONG'").select("symbol"), s.where("side = 'SHORT'").select("symbol"))


@query(f"""{with_tables('fundamentals')}, m AS (SELECT sector, median(pe) AS median_pe FROM fundamentals GROUP BY sector)
    SELECT symbol, f.sector, round(pe, 6) AS pe, round(pb, 6) AS pb, round((pe / median_pe - 1) * 100, 6) AS peer_discount,
    CASE WHEN pe < 10 AND pb < 1 THEN 'CHEAP' WHEN pe > 40 OR pb > 4.5 THEN 'RICH' ELSE 'FAIR' END AS valuation FROM fundamentals f JOIN m ON m.sector = f.sector""")
def valuation_labels(spark, d):
    f = fundamentals(spark, d)
    m = f.groupBy("sector").agg(F.median("pe").alias("median_pe"))
    label = F.when((F.col("pe") < 10) & (F.col("pb") < 1), "CHEAP").when((F.col("pe") > 40) | (F.col("pb") > 4.5), "RICH").otherwise("FAIR")
    return f.join(m, "sector").select("symbol", "sector", F.round("pe", 6).alias("pe"), F.round("pb", 6).alias("pb"), F.round((F.col("pe") / F.col("median_pe") - 1) * 100, 6).alias("peer_discount"), label.alias("valuation"))


CLEAN = r"""trim(regexp_replace(regexp_replace(regexp_replace(text, '[\x{200B}-\x{200D}\x{FEFF}]', '', 'g'), '[ \t\r\f]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'))"""
NORM = rf"""trim(regexp_replace(regexp_replace(lower({CLEAN}), 'https?://[^ \n]+', '', 'g'), '[ \n!-/:-@\[-`{{-~]+', ' ', 'g'))"""
HASHED = f"{ITEMS}, h AS (SELECT *, {NORM} AS norm, sha256({NORM}) AS hash FROM raw_items)"
GOOD, BAD, WORDS = ["and", "with"], ["for", "was"], ["the", "and", "of", "les", "der", "que"]


def any_of(words: list[str]) -> str:
    return f"len(regexp_extract_all(text, '\\b({'|'.join(words)})\\b'))"


@query(f"{HASHED} SELECT external_id, length({CLEAN}) AS n_clean, hash FROM h")
def content_hashes(spark, d):
    return raw_items(spark, d).select("external_id", F.length(text.clean_text(F.col("text"))).alias("n_clean"), text.content_hash(F.col("text")).alias("hash"))


@query(f"""{HASHED}, r AS (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY published_at DESC, length(text) DESC, external_id) AS n FROM h WHERE norm <> '') SELECT external_id, source_name, published_at, hash FROM r WHERE n = 1""")
def dedupe_exact(spark, d):
    return text.dedupe_exact(raw_items(spark, d)).select("external_id", "source_name", "published_at", "hash")


@query(f"{HASHED} SELECT hash, count(*) AS n, count(DISTINCT source_name) AS sources, min(external_id) AS first_id FROM h GROUP BY hash")
def hash_groups(spark, d):
    return text.hash_groups(raw_items(spark, d))


QT = r"regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g')"
QUALITY = rf"""CASE WHEN contains({QT}, 'nterti') THEN -10 WHEN regexp_matches({QT}, '^https?://\S+$') THEN -5 ELSE CASE WHEN source_name IN ('src1', 'src2') THEN 3 ELSE 0 END
    + {' + '.join(f"CASE WHEN contains({QT}, '{w}') THEN 1 ELSE 0 END" for w in GOOD)} + {' + '.join(f"CASE WHEN contains({QT}, '{w}') THEN -3 ELSE 0 END" for w in BAD)} + CASE WHEN length({QT}) < 15 THEN -3 WHEN length({QT}) < 30 THEN -1 ELSE 0 END END"""


def quality():
    return text.item_quality(F.col("source_name"), F.col("text"), ["src1", "src2"], GOOD, BAD, ["nterti"])


@query(f"{ITEMS} SELECT external_id, {QUALITY} AS quality FROM raw_items")
def item_quality(spark, d):
    return raw_items(spark, d).select("external_id", quality().alias("quality"))


@query(f"{ITEMS}, q AS (SELECT source_name, {QUALITY} AS q FROM raw_items) SELECT source_name, count(*) AS n, sum(CASE WHEN q < 0 THEN 1 ELSE 0 END) AS dropped, round(avg(q), 6) AS mean_quality FROM q GROUP BY source_name")
def source_stats(spark, d):
    return text.source_stats(raw_items(spark, d), quality()).withColumn("mean_quality", F.round("mean_quality", 6))


@query(f"{ITEMS}, c AS (SELECT external_id, {any_of(GOOD)} AS p, {any_of(BAD)} AS n, regexp_matches(text, 'eren[a-z]|leau') AS buy FROM raw_items) SELECT external_id, CASE WHEN buy THEN 'positive' WHEN p + n = 0 THEN 'neutral' WHEN p > n THEN 'positive' ELSE 'negative' END AS polarity, CASE WHEN p > 0 AND n > 0 THEN 'mixed' WHEN p > 0 THEN 'positive' WHEN n > 0 THEN 'negative' ELSE 'neutral' END AS sentiment FROM c")
def item_polarity(spark, d):
    c = F.col("text")
    return raw_items(spark, d).select("external_id", text.item_polarity(c, GOOD, BAD, "eren[a-z]|leau").alias("polarity"), text.context_sentiment(c, GOOD, BAD).alias("sentiment"))


@query(rf"""{ITEMS}, t AS (SELECT external_id, unnest(string_split_regex(lower(text), '[^\p{{L}}\p{{N}}]+')) AS keyword FROM raw_items), h AS (SELECT keyword, external_id, count(*) AS n FROM t WHERE keyword IN ({', '.join(repr(w) for w in WORDS)}) GROUP BY keyword, external_id)
    SELECT keyword, count(*) AS items, sum(n) AS hits FROM h GROUP BY keyword""")
def keyword_counts(spark, d):
    return text.keyword_counts(raw_items(spark, d), WORDS)


@query(f"""{ITEMS}, a AS (SELECT external_id, string_split(text, chr(10)) AS parts FROM raw_items), l AS (SELECT external_id, unnest(parts) AS line, generate_subscripts(parts, 1) - 1 AS k FROM a)
    SELECT external_id, line, count(*) AS times, min(k) AS first_line FROM l WHERE trim(line) <> '' GROUP BY external_id, line HAVING count(*) >= 2""")
def output_lint(spark, d):
    return text.lint_lines(raw_items(spark, d))


@query(rf"""{ITEMS}, a AS (SELECT external_id, regexp_split_to_array(text, '\r?\n') AS parts FROM raw_items WHERE text IS NOT NULL),
    l AS (SELECT external_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS k FROM a), b AS (SELECT *, regexp_replace(line, '\s+', '', 'g') AS t FROM l),
    s AS (SELECT *, last_value(CASE WHEN contains(t, 'Und') THEN '' WHEN contains(t, 'De') THEN 'main' END IGNORE NULLS) OVER (PARTITION BY external_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS section FROM b),
    f AS (SELECT external_id, 'phrase' AS rule, 'HIGH' AS severity, k, line FROM s WHERE contains(t, 'theand') UNION ALL SELECT external_id, 'both', 'MEDIUM', k, line FROM s WHERE regexp_matches(t, 'leau.*und')
      UNION ALL SELECT external_id, 'inside', 'LOW', k, line FROM s WHERE section = 'main' AND contains(t, 'eren')
      UNION ALL SELECT external_id, 'again', 'LOW', k, line FROM (SELECT *, row_number() OVER (PARTITION BY external_id ORDER BY k) AS n FROM s WHERE contains(t, 'sch')) q WHERE n = 2)
    SELECT external_id, rule, severity, k, md5(substr(trim(line), 1, 80)) AS excerpt FROM f""")
def report_lint(spark, d):
    """A phrase, one followed by another, one within a section, and one in several lines."""
    rules = [lint.rule("phrase", "HIGH", "the and"), lint.rule("both", "MEDIUM", "leau", then="und"), lint.rule("inside", "LOW", "eren", section="main"), lint.rule("again", "LOW", "sch", least=2)]
    found = lint.lint(raw_items(spark, d), rules, {"main": ["De"], "": ["Und"]})
    return found.withColumn("excerpt", F.md5("excerpt"))


@query(f"""{ITEMS}, x AS (SELECT external_id, source_name, row_number() OVER (PARTITION BY source_name ORDER BY published_at DESC, external_id) AS n FROM raw_items) SELECT external_id, source_name FROM x WHERE n <= 10""")
def cap_per_source(spark, d):
    return ranking.cap_per_source(raw_items(spark, d), "source_name", [F.desc("published_at"), F.col("external_id")], 10).select("external_id", "source_name")


@query(r"SELECT page_id, lower(regexp_replace(split_part(split_part(url, '?', 1), '#', 1), '/+$', '')) AS canonical, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g')) AS body FROM pages")
def page_text(spark, d):
    p = spark.read.parquet(f"{d}/pages.parquet")
    return p.select("page_id", text.canonical_url(F.col("url")).alias("canonical"), text.strip_html(F.col("html")).alias("body"))
