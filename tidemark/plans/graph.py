"""Queries over rule graphs, cycles, macro figures and surges; each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import graph, regime, relations
from tidemark.plans.tables import cycles, daily_bars, neighbours, pair_rules, quotes, raw_items, read, signals, symbols, ticks, with_tables

QUERIES, SQL = {}, {}
QUOTES = with_tables("symbols", "daily_bars", "quotes")
RULES = with_tables("symbols", "daily_bars", "quotes", "pair_rules")
CYCLES = with_tables("symbols", "daily_bars", "quotes", "cycles")
MOVE = "coalesce({0}.return_4h, {0}.return_1d, 0.0)"
NEAR = "symbols", "neighbours"


def query(sql: str | None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.select(*[F.round(c, 5).alias(c) if kinds[c] == "double" else F.col(c) for c in cols])


PAIRED = f"""{RULES}, ep AS (SELECT r.rule, r.source, r.target, r.direction, {MOVE.format('s')} AS sr, {MOVE.format('t')} AS tr, t.return_4h AS t4, t.return_1d AS t1
      FROM (SELECT rule, source, direction, least_move, unnest(targets) AS target FROM pair_rules) r JOIN quotes s ON s.symbol = r.source AND coalesce(s.return_4h, s.return_1d) IS NOT NULL
      JOIN quotes t ON t.symbol = r.target AND coalesce(t.return_4h, t.return_1d) IS NOT NULL WHERE r.source <> r.target AND abs({MOVE.format('s')}) >= greatest(3.0, r.least_move)),
    pairs AS (SELECT rule, source, target, direction, sr AS source_return, tr AS target_return, CASE
      WHEN sr > 0 AND direction <> 'UP_LEADS_DOWN' THEN CASE WHEN tr >= 3.0 THEN 'ALREADY' WHEN t4 < 0 AND t1 < 0 THEN 'CURRENT_MISMATCH' WHEN tr < -1.0 THEN 'MISMATCH' WHEN tr <= 1.0 THEN 'NOT_YET' ELSE 'PARTIAL' END
      WHEN tr > 1.0 THEN 'MISMATCH' WHEN tr >= -1.0 THEN 'WEAKNESS_NOT_YET' WHEN tr <= -3.0 THEN 'ALREADY' ELSE 'PARTIAL' END AS gap_class FROM ep)"""


def expanded(spark, d) -> DataFrame:
    return graph.expand_pairs(pair_rules(spark, d), quotes(spark, d))


@query(f"{PAIRED} SELECT rule, source, target, direction, round(source_return, 5) AS source_return, round(target_return, 5) AS target_return, gap_class FROM pairs")
def expand_pairs(spark, d):
    return rounded(expanded(spark, d), "rule", "source", "target", "direction", "source_return", "target_return", "gap_class")


FEEDS = """feed AS (SELECT source, target, 0.5 + (source % 5) / 10.0 AS cond_prob, 1.0 + (target % 7) / 10.0 AS lift, source % 30 AS events FROM neighbours WHERE source % 3 = 0),
    fall AS (SELECT source, target, 0.4 + (target % 5) / 10.0 AS cond_prob, 1.0 + (source % 7) / 10.0 AS lift, target % 30 AS events FROM neighbours WHERE target % 2 = 0)"""


def feeds(spark, d) -> tuple[DataFrame, DataFrame]:
    """Two tables of statistics that have some of the edges each."""
    e = neighbours(spark, d)
    stats = lambda p, l: [(0.5 if p == "source" else 0.4) + (F.col(p) % 5) / 10.0, 1.0 + (F.col(l) % 7) / 10.0, F.col(p) % 30]
    name = lambda cols: [c.alias(n) for c, n in zip(cols, ("cond_prob", "lift", "events"))]
    return e.where("source % 3 = 0").select("source", "target", *name(stats("source", "target"))), e.where("target % 2 = 0").select("source", "target", *name(stats("target", "source")))


@query(f"""{PAIRED}, {with_tables('neighbours')[5:]}, {FEEDS}
    SELECT p.rule, p.source, p.target, round(coalesce(f.cond_prob, l.cond_prob), 5) AS cond_prob, round(coalesce(f.lift, l.lift), 5) AS lift, coalesce(f.events, l.events, 0) AS events
    FROM pairs p LEFT JOIN feed f ON f.source = p.source AND f.target = p.target LEFT JOIN fall l ON l.source = p.source AND l.target = p.target""")
def pair_stat_precedence(spark, d):
    return rounded(graph.attach_pair_stats(expanded(spark, d), *feeds(spark, d)), "rule", "source", "target", "cond_prob", "lift", "events")


MOVERS = f"{RULES}, mv AS (SELECT symbol, name, market, return_1d AS return_pct, volume_ratio FROM quotes WHERE abs(return_1d) >= 4.0)"


def movers(spark, d) -> DataFrame:
    return quotes(spark, d).where("abs(return_1d) >= 4.0").select("symbol", "name", "market", F.col("return_1d").alias("return_pct"), "volume_ratio")


@query(f"""{MOVERS} SELECT DISTINCT m.symbol, r.rule FROM mv m JOIN pair_rules r ON r.market IN (m.market, 'BOTH', 'CROSS') AND (r.source = m.symbol OR len(list_filter(r.keywords, lambda k: contains(lower(m.name), lower(k)))) > 0)""")
def match_rules(spark, d):
    return graph.match_rules(movers(spark, d), pair_rules(spark, d))


@query(f"""{CYCLES}, f AS (SELECT symbol, cycle, stage, row_number() OVER (PARTITION BY symbol ORDER BY cycle, CASE stage WHEN 'LEADER' THEN 0 WHEN 'VICTIM' THEN 4 ELSE place END, stage) AS n FROM (SELECT cycle, stage, place, symbol FROM cycles UNION ALL SELECT cycle + 1, 'VICTIM', 0, symbol FROM cycles WHERE symbol % 3 = 0) q)
    SELECT y.symbol, f.cycle, f.stage FROM symbols y LEFT JOIN f ON f.symbol = y.symbol AND n = 1""")
def cycle_stage(spark, d):
    c = cycles(spark, d).select("cycle", "stage", "place", "symbol")
    also = c.where("symbol % 3 = 0").select((F.col("cycle") + 1).alias("cycle"), F.lit("VICTIM").alias("stage"), F.lit(0).alias("place"), "symbol")
    return graph.cycle_stage(symbols(spark, d).select("symbol"), c.unionByName(also))


@query(f"""{MOVERS}, {with_tables('neighbours')[5:]}, h AS (SELECT DISTINCT t.symbol AS target, n.source, m.name, m.return_pct, m.symbol FROM neighbours n JOIN mv m ON m.symbol = n.source AND m.market = 'US' JOIN symbols t ON t.symbol = n.target AND t.market = 'KR')
    SELECT target, count(*) AS n_triggers, string_agg(name || '(' || printf('%+.1f', return_pct) || '%)', ', ' ORDER BY abs(return_pct) DESC, source) AS triggers FROM h GROUP BY target""")
def cross_market(spark, d):
    return graph.cross_market(movers(spark, d), neighbours(spark, d), symbols(spark, d))


STATUS = """CASE WHEN {r} IS NULL THEN 'DATA_MISSING' WHEN {e} = 'UP' AND {r} > 0 OR {e} <> 'UP' AND {r} < 0 THEN CASE WHEN {v} >= 1.0 AND {o} = CASE WHEN {e} = 'UP' THEN 'UP' ELSE 'DOWN' END THEN 'CONFIRMED' ELSE 'WATCH' END
      WHEN {e} = 'UP' AND {r} < -0.5 OR {e} <> 'UP' AND {r} > 0.5 THEN 'NOT_CONFIRMED' ELSE 'MIXED' END"""
LIVE = f"""{RULES}, ex AS (SELECT DISTINCT unnest(targets) AS target, CASE WHEN direction IN ('UP_LEADS_UP', 'DOWN_LEADS_UP') THEN 'UP' ELSE 'DOWN' END AS expected FROM pair_rules),
    live AS (SELECT ex.target, expected, {STATUS.format(r='q.return_1d', e='expected', v='q.volume_ratio', o='q.obv')} AS status FROM ex LEFT JOIN quotes q ON q.symbol = ex.target)"""


def live(spark, d) -> DataFrame:
    asked = pair_rules(spark, d).select(F.explode("targets").alias("target"), graph.expected_direction(F.col("direction")).alias("expected")).distinct()
    q = quotes(spark, d).select(F.col("symbol").alias("target"), "return_1d", "volume_ratio", "obv")
    return asked.join(q, "target", "left").select("target", "expected", graph.live_status(F.col("expected"), F.col("return_1d"), F.col("volume_ratio"), F.col("obv")).alias("status"))


@query(f"{LIVE} SELECT * FROM live")
def live_status(spark, d):
    return live(spark, d)


LEADLAG = """ll AS (SELECT source, target, 'UP_LEADS_UP' AS relation, 1.0 + (target % 7) / 10.0 AS lift, 0.5 AS cond_prob, source % 30 AS events, CASE source % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence FROM neighbours WHERE (source + target) % 5 <> 0),
    fb AS (SELECT source, target, CASE WHEN source % 2 = 0 THEN 'medium' ELSE 'low' END AS confidence FROM neighbours)"""


@query(f"""{LIVE}, {with_tables('neighbours')[5:]}, {LEADLAG}, mv AS (SELECT symbol FROM quotes WHERE abs(return_1d) >= 1.0),
    fit AS (SELECT DISTINCT l.target FROM live l JOIN quotes q ON q.symbol = l.target WHERE status = 'CONFIRMED' AND q.rsi < 75),
    own AS (SELECT target, arg_max(confidence, lift * 1000000 + source) AS best FROM ll WHERE source IN (SELECT symbol FROM mv) GROUP BY target),
    rest AS (SELECT DISTINCT target FROM fb WHERE confidence = 'medium' AND source IN (SELECT symbol FROM mv))
    SELECT fit.target, CASE best WHEN 'high' THEN 2.0 WHEN 'medium' THEN 1.0 WHEN 'low' THEN 0.0 ELSE CASE WHEN rest.target IS NOT NULL THEN 1.0 ELSE 0.0 END END AS boost FROM fit LEFT JOIN own ON own.target = fit.target LEFT JOIN rest ON rest.target = fit.target""")
def relation_boost(spark, d):
    e, q = neighbours(spark, d), quotes(spark, d)
    level = F.element_at(F.array(F.lit("high"), F.lit("medium"), F.lit("low")), (F.col("source") % 3 + 1).cast("int"))
    ll = e.where("(source + target) % 5 <> 0").select("source", "target", F.lit("UP_LEADS_UP").alias("relation"), (1.0 + (F.col("target") % 7) / 10.0).alias("lift"), F.lit(0.5).alias("cond_prob"), F.lit(1).alias("events"), level.alias("confidence"))
    fb = e.select("source", "target", F.when(F.col("source") % 2 == 0, "medium").otherwise("low").alias("confidence"))
    told = live(spark, d).join(q.select(F.col("symbol").alias("target"), "rsi"), "target").select("target", "status", F.lit(True).alias("has_evidence"), F.coalesce(F.col("rsi") < 75, F.lit(False)).alias("technical_ok"))
    return graph.relation_boost(told, ll, q.where("abs(return_1d) >= 1.0").select("symbol", F.col("return_1d").alias("return_pct")), fb)


BASE = """bc AS (SELECT symbol, CASE symbol % 4 WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' WHEN 2 THEN 'mixed' ELSE 'neutral' END AS sentiment, row_number() OVER (ORDER BY abs(return_1d) DESC, symbol) AS rank FROM quotes WHERE abs(return_1d) >= 4.0 QUALIFY rank <= 24),
    rp AS (SELECT source, target, CASE WHEN (source + target) % 2 = 0 THEN 'UP_LEADS_UP' ELSE 'DOWN_LEADS_DOWN' END AS relation, 1.0 + (source * 31 + target * 17) % 10 / 10.0 AS score FROM neighbours)"""


def base_candidates(spark, d) -> DataFrame:
    """The 24 strongest movers with a stand-in sentiment and their rank."""
    from pyspark.sql import Window

    kind = F.element_at(F.array(*map(F.lit, ("positive", "negative", "mixed", "neutral"))), (F.col("symbol") % 4 + 1).cast("int"))
    top = quotes(spark, d).where("abs(return_1d) >= 4.0").orderBy(F.desc(F.abs("return_1d")), "symbol").limit(24)
    return top.select("symbol", kind.alias("sentiment"), F.row_number().over(Window.orderBy(F.desc(F.abs("return_1d")), "symbol")).alias("rank"))


def research_pairs(spark, d) -> DataFrame:
    return neighbours(spark, d).select("source", "target", F.when((F.col("source") + F.col("target")) % 2 == 0, "UP_LEADS_UP").otherwise("DOWN_LEADS_DOWN").alias("relation"), (1.0 + (F.col("source") * 31 + F.col("target") * 17) % 10 / 10.0).alias("score"))


RESEARCH = f"""{QUOTES}, {with_tables('neighbours')[5:]}, {BASE},
    fw AS (SELECT c.symbol AS parent, p.target AS symbol, c.rank, row_number() OVER (PARTITION BY c.symbol ORDER BY p.score DESC, p.target) AS k FROM bc c JOIN rp p ON p.source = c.symbol AND p.relation = CASE WHEN c.sentiment IN ('positive', 'mixed') THEN 'UP_LEADS_UP' WHEN c.sentiment = 'negative' THEN 'DOWN_LEADS_DOWN' END WHERE c.rank <= 6 QUALIFY k <= 3),
    bw AS (SELECT c.symbol AS parent, p.source AS symbol, c.rank, row_number() OVER (PARTITION BY c.symbol ORDER BY p.score DESC, p.source) AS k FROM bc c JOIN rp p ON p.target = c.symbol WHERE c.rank <= 4 QUALIFY k <= 2),
    al AS (SELECT *, 'RESEARCH_LEADLAG' AS origin FROM fw UNION ALL SELECT *, 'RESEARCH_SOURCE' FROM bw),
    once AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY origin, rank, k) AS n FROM al WHERE symbol NOT IN (SELECT symbol FROM bc) QUALIFY n = 1),
    research AS (SELECT symbol, parent, origin FROM once ORDER BY origin, rank, k, symbol LIMIT 8)"""


@query(f"{RESEARCH} SELECT * FROM research")
def expand_research(spark, d):
    return graph.expand_research(base_candidates(spark, d), research_pairs(spark, d))


WATCH = """wl AS (SELECT symbol, CASE WHEN symbol % 2 = 0 THEN 'core' ELSE 'growth' END AS "group", symbol % 9 = 0 AS avoid FROM symbols WHERE sector >= 'NATION_2'),
    tok AS (SELECT DISTINCT trim(w, '.') AS word FROM (SELECT unnest(regexp_split_to_array(text, '[^\\p{L}\\p{N}.]+')) AS w FROM documents) q),
    watched AS (SELECT symbol, 'WATCHLIST_RELATED' AS origin FROM wl WHERE NOT avoid AND symbol NOT IN (SELECT symbol FROM bc) AND CAST(symbol AS VARCHAR) IN (SELECT word FROM tok))"""


def watchlist(spark, d) -> DataFrame:
    s = symbols(spark, d).where("sector >= 'NATION_2'")
    return s.select("symbol", F.when(F.col("symbol") % 2 == 0, "core").otherwise("growth").alias("group"), (F.col("symbol") % 9 == 0).alias("avoid"))


@query(f"{QUOTES}, {with_tables('neighbours')[5:]}, {BASE}, {WATCH} SELECT * FROM watched")
def expand_watchlist(spark, d):
    return graph.expand_watchlist(base_candidates(spark, d), raw_items(spark, d).select("text"), watchlist(spark, d))


UNIVERSE = f"{RESEARCH}, {WATCH}, al2 AS (SELECT symbol, 'DIRECT' AS origin, 1 AS o FROM bc UNION ALL SELECT symbol, origin, 2 FROM watched UNION ALL SELECT symbol, origin, CASE origin WHEN 'RESEARCH_LEADLAG' THEN 4 ELSE 5 END FROM research), uni AS (SELECT symbol, arg_min(origin, o) AS origin, count(DISTINCT origin) AS also FROM al2 GROUP BY symbol)"


def universe(spark, d) -> DataFrame:
    base = base_candidates(spark, d)
    return graph.expanded_universe(base.select("symbol", F.lit("DIRECT").alias("origin")), expand_watchlist(spark, d), expand_research(spark, d))


@query(f"{UNIVERSE} SELECT * FROM uni")
def expanded_universe(spark, d):
    return universe(spark, d)


@query(f"{UNIVERSE} SELECT origin, count(*) AS n FROM uni GROUP BY origin")
def candidate_coverage(spark, d):
    return graph.coverage(universe(spark, d))


SECTOR_WORDS = [("one", ["00001", "00002"]), ("two", ["00003", "2"])]


@query(f"""{with_tables('symbols')}, y AS (SELECT symbol, sector, name || CASE WHEN symbol % 7 = 0 THEN ' sea 00001' ELSE '' END AS name FROM symbols) SELECT y.symbol, coalesce(CASE WHEN y.symbol % 2 = 0 THEN sector END, CASE WHEN contains(lower(y.symbol || ' ' || name), '00001') OR contains(lower(y.symbol || ' ' || name), '00002') THEN 'one'
    WHEN contains(lower(y.symbol || ' ' || name), '00003') OR contains(lower(y.symbol || ' ' || name), '2') THEN 'two' END, 'unclassified') AS sector FROM y""")
def sector_enrichment(spark, d):
    s = symbols(spark, d)
    themes = F.when(F.col("symbol") % 7 == 0, F.array(F.lit("sea"), F.lit("00001")))
    return graph.enrich(s.select("symbol", "name", themes.alias("themes")), s.where("symbol % 2 = 0"), SECTOR_WORDS).select("symbol", "sector")


TRIGGERS = ["the", "eren", "tion", "quiz", "leau", "sche", "and", "zzzz"]


@query(f"""{CYCLES}, kw AS (SELECT DISTINCT lower(w) AS w FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM documents WHERE doc_id >= (SELECT max(doc_id) FROM documents) - 240) q WHERE length(w) BETWEEN 3 AND 12),
    tg AS (SELECT DISTINCT cycle, unnest([{', '.join(f"'{t}'" for t in TRIGGERS)}][cycle % 8 + 1 : 8]) AS t FROM cycles),
    nk AS (SELECT cycle, count(*) AS n_keywords FROM tg WHERE EXISTS (SELECT 1 FROM kw WHERE contains(kw.w, tg.t)) GROUP BY cycle),
    ns AS (SELECT cycle, count(*) AS n_sources FROM cycles c JOIN quotes q ON q.symbol = c.symbol AND abs(q.return_1d) >= 2.0 WHERE stage = 'LEADER' AND c.market = 'US' GROUP BY cycle),
    ac AS (SELECT c.cycle, coalesce(n_keywords, 0) AS n_keywords, coalesce(n_sources, 0) AS n_sources, least(100.0, coalesce(n_keywords, 0) * 15.0 + coalesce(n_sources, 0) * 20.0) AS match_score FROM (SELECT DISTINCT cycle FROM cycles) c LEFT JOIN nk ON nk.cycle = c.cycle LEFT JOIN ns ON ns.cycle = c.cycle)
    SELECT * FROM ac WHERE match_score >= 15 ORDER BY match_score DESC, cycle LIMIT 5""")
def active_cycles(spark, d):
    """Recent keywords are the words of the items of the last 240 minutes."""
    items = raw_items(spark, d)
    last = items.agg(F.max("external_id").alias("last_id"))
    recent = items.join(F.broadcast(last)).where("external_id >= last_id - 240").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), 0)).alias("keyword")).where("length(keyword) between 3 and 12").distinct()
    c = cycles(spark, d)
    told = F.slice(F.array(*map(F.lit, TRIGGERS)), (F.col("cycle") % 8 + 1).cast("int"), F.lit(8))
    return graph.active_cycles(c, c.select("cycle").distinct().select("cycle", F.explode(told).alias("trigger")), recent, quotes(spark, d), "US")


@query(f"{CYCLES} SELECT cycle, stage, place, c.sector, count(*) AS n, round(avg(return_1d), 5) AS mean_return FROM cycles c JOIN quotes q ON q.symbol = c.symbol WHERE return_1d IS NOT NULL GROUP BY cycle, stage, place, c.sector")
def cycle_returns(spark, d):
    return rounded(graph.cycle_returns(cycles(spark, d), quotes(spark, d)), "cycle", "stage", "place", "sector", "n", "mean_return")


LAG = f"""{CYCLES}, own AS (SELECT c.*, return_1d, rsi FROM cycles c LEFT JOIN quotes q ON q.symbol = c.symbol WHERE c.market = 'US'),
    ld AS (SELECT cycle, coalesce(avg(return_1d), 0.0) AS source_return FROM own WHERE stage = 'LEADER' GROUP BY cycle HAVING coalesce(avg(return_1d), 0.0) >= 3.0),
    lt AS (SELECT *, row_number() OVER (PARTITION BY cycle, stage, sector ORDER BY symbol) AS k FROM own WHERE place >= 2),
    gp AS (SELECT cycle, stage, sector, coalesce(avg(return_1d), 0.0) AS target_return, max(CASE WHEN k <= 2 AND rsi >= 80 THEN 1 ELSE 0 END) AS hot FROM lt GROUP BY cycle, stage, sector),
    rl AS (SELECT gp.cycle, sector, source_return, target_return, source_return - target_return AS lag, row_number() OVER (PARTITION BY gp.cycle, sector ORDER BY stage) AS n FROM gp JOIN ld ON ld.cycle = gp.cycle WHERE source_return - target_return >= 2.0 AND hot = 0 QUALIFY n = 1),
    lagging AS (SELECT * EXCLUDE (n) FROM rl ORDER BY lag DESC, cycle, sector LIMIT 6)"""


@query(f"{LAG} SELECT cycle, sector, round(source_return, 5) AS source_return, round(target_return, 5) AS target_return, round(lag, 5) AS lag FROM lagging")
def relative_lag(spark, d):
    return rounded(graph.relative_lag(cycles(spark, d), quotes(spark, d), "US"), "cycle", "sector", "source_return", "target_return", "lag")


MACRO_COLS = {"vix": "10 + y % 30", "us10y": "3 + y % 20 / 10.0", "fear_greed": "y % 100", "dollar": "95 + y % 12", "oil": "60 + y % 40", "hot_sectors": "y % 4", "us10y_chg": "y % 50 - 25", "dxy_chg": "(y % 30 - 15) / 10.0", "sp500_chg": "(y % 50 - 25) / 10.0", "wti_chg": "(y % 90 - 45) / 10.0", "wti": "60 + y % 40", "gold_chg": "(y % 40 - 20) / 10.0", "usd_krw": "1300 + y % 90", "usd_krw_chg": "(y % 34 - 17) / 10.0", "kospi_chg": "(y % 80 - 40) / 10.0"}
MACRO = with_tables("daily_bars") + ", mb AS (SELECT ts AS day, sum(volume) AS v, count(*) AS c FROM daily_bars GROUP BY ts), mc AS (SELECT *, " + ", ".join(f"CAST((CAST(v AS BIGINT) * {7 + 2 * i} + c * {13 + i}) % 100003 AS BIGINT) AS y{i}" for i in range(len(MACRO_COLS))) + " FROM mb), macro AS (SELECT day, " + ", ".join(f"CASE WHEN c % 11 <> {i % 11} THEN CAST({e.replace('y', f'y{i}')} AS DOUBLE) END AS {n}" for i, (n, e) in enumerate(MACRO_COLS.items())) + " FROM mc)"


def macro(spark, d) -> DataFrame:
    """A row of macro figures a day, some of them missing, out of that day's volume and bars."""
    g = daily_bars(spark, d).groupBy(F.col("ts").alias("day")).agg(F.sum("volume").alias("v"), F.count("*").alias("c"))
    for i in range(len(MACRO_COLS)):
        g = g.withColumn(f"y{i}", F.expr(f"(cast(v as bigint) * {7 + 2 * i} + c * {13 + i}) % 100003"))
    return g.select("day", *[F.expr(f"CASE WHEN c % 11 <> {i % 11} THEN CAST({e.replace('y', f'y{i}')} AS DOUBLE) END").alias(n) for i, (n, e) in enumerate(MACRO_COLS.items())])


@query(f"""{MACRO}, g AS (SELECT day,
      CASE WHEN fear_greed >= 75 THEN -5 WHEN fear_greed <= 30 THEN 3 ELSE 0 END + CASE WHEN us10y >= 4.5 THEN -8 WHEN us10y <= 3.8 THEN 5 ELSE 0 END + CASE WHEN vix >= 25 THEN -5 ELSE 0 END
      + CASE WHEN dollar >= 103 THEN -3 ELSE 0 END + CASE WHEN oil >= 85 THEN -2 ELSE 0 END + CASE WHEN hot_sectors >= 2 THEN -3 ELSE 0 END AS long_adj,
      CASE WHEN fear_greed <= 30 THEN 3 ELSE 0 END + CASE WHEN us10y >= 4.5 THEN 5 ELSE 0 END AS defensive_adj FROM macro)
    SELECT day, CAST(long_adj AS DOUBLE) AS long_adj, CAST(defensive_adj AS DOUBLE) AS defensive_adj, CASE WHEN long_adj <= -12 THEN 'HIGH' WHEN long_adj <= -5 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level FROM g""")
def macro_guard(spark, d):
    return regime.macro_guard(macro(spark, d)).select("day", "long_adj", "defensive_adj", "risk_level")


@query(f"""{MACRO}, g AS (SELECT *,
      CASE WHEN vix > 25 THEN 2 ELSE 0 END + CASE WHEN us10y_chg > 15 THEN 2 ELSE 0 END + CASE WHEN dxy_chg > 0.8 THEN 1 ELSE 0 END + CASE WHEN sp500_chg < -1 THEN 1 ELSE 0 END + CASE WHEN wti_chg > 3 THEN 1 ELSE 0 END + CASE WHEN gold_chg > 1.5 THEN 1 ELSE 0 END AS fear,
      CASE WHEN vix < 18 THEN 1 ELSE 0 END + CASE WHEN us10y_chg < -15 THEN 1 ELSE 0 END + CASE WHEN dxy_chg < -0.8 THEN 1 ELSE 0 END + CASE WHEN sp500_chg > 0.5 THEN 1 ELSE 0 END AS greed,
      list_filter([CASE WHEN vix > 30 THEN 'VIX_FEAR' WHEN vix > 25 THEN 'VIX_ALERT' WHEN vix < 14 THEN 'VIX_CALM' END, CASE WHEN us10y IS NULL THEN NULL WHEN us10y_chg > 15 THEN 'RATE_SPIKE' WHEN us10y_chg < -15 THEN 'RATE_DROP' END,
        CASE WHEN usd_krw IS NULL THEN NULL WHEN usd_krw_chg > 1 THEN 'WON_WEAK' WHEN usd_krw_chg < -1 THEN 'WON_STRONG' END, CASE WHEN dxy_chg > 0.8 THEN 'DOLLAR_STRONG' WHEN dxy_chg < -0.8 THEN 'DOLLAR_WEAK' END,
        CASE WHEN wti IS NULL THEN NULL WHEN wti_chg > 3 THEN 'OIL_SPIKE' WHEN wti_chg < -3 THEN 'OIL_DROP' END, CASE WHEN gold_chg > 1.5 THEN 'GOLD_UP' WHEN gold_chg < -1.5 THEN 'GOLD_DOWN' END,
        CASE WHEN coalesce(sp500_chg, 0) < -1.5 AND coalesce(kospi_chg, 0) < -1.5 THEN 'BOTH_DOWN' WHEN coalesce(sp500_chg, 0) > 1 AND coalesce(kospi_chg, 0) > 0.5 THEN 'BOTH_UP' WHEN kospi_chg < -3 THEN 'KOSPI_DROP' WHEN sp500_chg < -2 THEN 'SP500_DROP' END], lambda x: x IS NOT NULL) AS codes FROM macro)
    SELECT day, CAST(fear AS DOUBLE) AS fear, CAST(greed AS DOUBLE) AS greed, CASE WHEN fear >= 3 THEN 'RISK_OFF' WHEN greed >= 2 AND fear = 0 THEN 'RISK_ON' ELSE 'NEUTRAL' END AS regime, array_to_string(codes[1:5], ',') AS readings FROM g""")
def macro_regime(spark, d):
    return regime.macro_regime(macro(spark, d)).select("day", "fear", "greed", "regime", "readings")


@query(f"""{LAG}, sg AS (SELECT symbol, side, max(least(100.0, score)) AS score FROM (SELECT o_custkey % (SELECT count(*) FROM supplier) AS symbol, CASE o_orderstatus WHEN 'F' THEN 'LONG' WHEN 'O' THEN 'SHORT' ELSE 'WATCH' END AS side, o_totalprice / 4000.0 AS score FROM orders) q GROUP BY symbol, side),
    sl AS (SELECT c.symbol, max(lag) AS lag FROM lagging l JOIN cycles c ON c.cycle = l.cycle AND c.sector = l.sector AND c.place >= 2 GROUP BY c.symbol)
    SELECT sg.symbol, side, round(CASE WHEN side = 'LONG' THEN least(100.0, greatest(0.0, score - 8.0) + CASE WHEN lag >= 3 THEN least(5.0, lag * 0.5) ELSE 0 END) ELSE score END, 5) AS score FROM sg LEFT JOIN sl ON sl.symbol = sg.symbol""")
def adjust_picks(spark, d):
    """The best score of each symbol and side under a guard of -8 points."""
    picks = signals(spark, d).groupBy("symbol", "side").agg(F.max("score").alias("score"))
    c = cycles(spark, d)
    lags = graph.relative_lag(c, quotes(spark, d), "US").join(c.where("place >= 2").select("cycle", "sector", "symbol"), ["cycle", "sector"]).groupBy("symbol").agg(F.max("lag").alias("lag"))
    guard = picks.agg(F.lit(-8.0).alias("long_adj"))
    return rounded(graph.adjust_picks(picks, guard, lags), "symbol", "side", "score")


@query(f"""{QUOTES}, t AS (SELECT return_1d, CASE WHEN symbol % 8 = 7 THEN 'VICTIM' ELSE 'OTHER' END AS role, CAST(symbol % 100 AS DOUBLE) AS sent FROM quotes), m AS (SELECT count(*) FILTER (return_1d >= 1 AND role <> 'VICTIM') AS up, count(*) FILTER (return_1d <= -1) AS down, avg(sent) AS sentiment FROM t)
    SELECT up, down, round(sentiment, 5) AS sentiment, CASE WHEN up > down * 2 AND sentiment > 60 THEN 'RISK_ON' WHEN down > up * 2 OR sentiment < 40 THEN 'DEFENSIVE' ELSE 'MIXED' END AS mood FROM m""")
def market_mood(spark, d):
    q = quotes(spark, d).withColumn("role", F.when(F.col("symbol") % 8 == 7, "VICTIM").otherwise("OTHER"))
    return rounded(regime.market_mood(q, (F.col("symbol") % 100).cast("double")), "up", "down", "sentiment", "mood")


@query(f"{with_tables('daily_bars')} SELECT symbol, round(arg_max(volume, ts), 5) AS latest, round(min(volume), 5) AS low, round(max(volume), 5) AS high, count(volume) AS n FROM daily_bars GROUP BY symbol")
def range_summary(spark, d):
    return rounded(regime.range_summary(daily_bars(spark, d), "volume", "ts", "symbol"), "symbol", "latest", "low", "high", "n")


CATALYSTS = [("contract", ["eren", "tion"], 0.7), ("earnings", ["quer"], 0.9), ("policy", ["sche", "ung"], 0.7)]
RELATIONS = ["BENEFICIARY", "LAGGING_BENEFICIARY", "PEER_MOMENTUM"]
FOUND = "CASE WHEN contains(t, 'quer') THEN 'earnings' WHEN contains(t, 'eren') OR contains(t, 'tion') THEN 'contract' WHEN contains(t, 'sche') OR contains(t, 'ung') THEN 'policy' ELSE 'volume_surge_only' END"


@query(f"""{QUOTES}, {with_tables('neighbours')[5:]}, tx AS (SELECT doc_id AS symbol, lower(text) AS t FROM documents),
    hot AS (SELECT q.symbol AS source, return_1d AS rp, CASE WHEN return_1d > 0 THEN 'BULLISH' ELSE 'BEARISH' END AS direction, {FOUND} AS catalyst, CASE {FOUND} WHEN 'earnings' THEN 0.9 WHEN 'volume_surge_only' THEN CASE WHEN volume_ratio >= 3 THEN 0.35 WHEN volume_ratio >= 2 THEN 0.25 ELSE 0.15 END ELSE 0.7 END AS confidence
      FROM quotes q LEFT JOIN tx ON tx.symbol = q.symbol WHERE abs(return_1d) >= 5.0),
    led AS (SELECT h.source, n.target, abs(h.rp) * 0.6 - abs(q.return_1d) AS gap, CASE n.target % 3 WHEN 0 THEN 75.0 WHEN 1 THEN 65.0 ELSE 60.0 END + least((abs(h.rp) * 0.6 - abs(q.return_1d)) * 1.5, 15.0) + confidence * 10 - CASE WHEN catalyst = 'volume_surge_only' THEN 10 ELSE 0 END AS score
      FROM hot h JOIN neighbours n ON n.source = h.source JOIN quotes q ON q.symbol = n.target WHERE abs(h.rp) * 0.6 - abs(q.return_1d) >= 2.0)
    SELECT h.source, direction, catalyst, confidence, target, round(gap, 5) AS gap, round(score, 5) AS score FROM hot h LEFT JOIN led ON led.source = h.source""")
def surge_scan(spark, d):
    """The item whose number is the symbol's stands for what was said of it."""
    moves = quotes(spark, d).select("symbol", F.col("return_1d").alias("return_pct"), "volume_ratio")
    texts = raw_items(spark, d).select(F.col("external_id").alias("symbol"), "text")
    edges = neighbours(spark, d).withColumn("relation", F.element_at(F.array(*map(F.lit, RELATIONS)), (F.col("target") % 3 + 1).cast("int")))
    return rounded(regime.surge_scan(moves, texts, edges, CATALYSTS), "source", "direction", "catalyst", "confidence", "target", "gap", "score")


@query("""WITH t AS (SELECT event_id, dayofweek(ts) BETWEEN 1 AND 5 AS wd, hour(ts) + minute(ts) / 60.0 AS h FROM events) SELECT event_id, wd AND h < 6.5 AS kr, wd AND h >= 13.5 AND h < 20.5 AS us, wd AND (h < 6.5 OR h >= 13.5 AND h < 20.5) AS any FROM t""")
def market_open(spark, d):
    e = read(spark, d, "events")
    at = lambda m: regime.is_open(F.col("ts"), F.lit(m))
    return e.select("event_id", at("KR").alias("kr"), at("US").alias("us"), at("ALL").alias("any"))


@query(f"""{with_tables('symbols')}, a AS (SELECT symbol, CASE symbol % 5 WHEN 0 THEN CAST(symbol AS VARCHAR) WHEN 1 THEN '$abc' || symbol WHEN 2 THEN 'x' || symbol || '.us' WHEN 3 THEN lpad(CAST(symbol AS VARCHAR), 6, '0') || '.KQ' ELSE ' y' || symbol || ' ' END AS q FROM symbols),
    c AS (SELECT symbol, regexp_replace(upper(trim(regexp_replace(q, '^\\$', ''))), '\\.US$', '') AS u FROM a), f AS (SELECT symbol, CASE WHEN regexp_matches(u, '^\\d{{1,6}}$') THEN lpad(u, 6, '0') || '.KS' ELSE u END AS canonical FROM c)
    SELECT symbol, canonical, CASE WHEN canonical LIKE '%.KS' OR canonical LIKE '%.KQ' THEN 'KR' ELSE 'US' END AS market FROM f""")
def symbol_spellings(spark, d):
    k = F.col("symbol").cast("string")
    q = F.when(F.col("symbol") % 5 == 0, k).when(F.col("symbol") % 5 == 1, F.concat(F.lit("$abc"), k)).when(F.col("symbol") % 5 == 2, F.concat(F.lit("x"), k, F.lit(".us")))
    q = q.when(F.col("symbol") % 5 == 3, F.concat(F.lpad(k, 6, "0"), F.lit(".KQ"))).otherwise(F.concat(F.lit(" y"), k, F.lit(" ")))
    return symbols(spark, d).select("symbol", regime.canonical_symbol(q).alias("canonical")).withColumn("market", regime.market_of(F.col("canonical")))


@query(f"""{with_tables('symbols')}, a AS (SELECT CASE c_custkey % 4 WHEN 0 THEN CAST(c_custkey AS VARCHAR) WHEN 1 THEN 'SUPPLIER#' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') WHEN 2 THEN substr('supplier#' || lpad(CAST(c_custkey AS VARCHAR), 9, '0'), 1, 17) ELSE 'nobody' || c_custkey END AS query FROM customer),
    m AS (SELECT a.query, y.symbol, row_number() OVER (PARTITION BY a.query ORDER BY CASE WHEN lower(a.query) = CAST(y.symbol AS VARCHAR) THEN 0 WHEN lower(a.query) = lower(y.name) THEN 1 ELSE 2 END, length(y.name), y.symbol) AS n FROM a JOIN symbols y ON lower(a.query) = CAST(y.symbol AS VARCHAR) OR starts_with(lower(y.name), lower(a.query)))
    SELECT DISTINCT a.query, m.symbol FROM a LEFT JOIN m ON m.query = a.query AND n = 1""")
def resolve_symbol(spark, d):
    k = F.col("c_custkey").cast("string")
    name = F.concat(F.lit("supplier#"), F.lpad(k, 9, "0"))
    q = F.when(F.col("c_custkey") % 4 == 0, k).when(F.col("c_custkey") % 4 == 1, F.upper(name)).when(F.col("c_custkey") % 4 == 2, F.substring(name, 1, 17)).otherwise(F.concat(F.lit("nobody"), k))
    return regime.resolve_symbol(read(spark, d, "customer").select(q.alias("query")), symbols(spark, d))


@query(f"""{with_tables('symbols')}, wl AS (SELECT symbol, CASE WHEN symbol % 2 = 0 THEN 'core' ELSE 'growth' END AS g, symbol % 9 = 0 AS avoid FROM symbols WHERE sector >= 'NATION_2')
    SELECT y.symbol, wl.g AS watch_group FROM symbols y LEFT JOIN wl ON wl.symbol = y.symbol WHERE NOT coalesce(avoid, false)""")
def watchlist_tags(spark, d):
    return regime.tag_watchlist(symbols(spark, d).select("symbol"), watchlist(spark, d))


CAL = "cal AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS date, CASE o_orderpriority WHEN '1-URGENT' THEN 'high' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium' ELSE 'low' END AS importance FROM orders), td AS (SELECT max(CAST(o_orderdate AS DATE)) - 20 AS day FROM orders)"


@query(f"WITH {CAL} SELECT id, date, importance, date - day AS days_away FROM cal, td WHERE date - day BETWEEN -2 AND 14 AND importance <> 'medium'")
def upcoming_events(spark, d):
    o = read(spark, d, "orders")
    kind = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "high").when(F.col("o_orderpriority") == "3-MEDIUM", "medium").otherwise("low")
    cal = o.select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("date"), kind.alias("importance"))
    day = F.broadcast(cal.agg(F.date_sub(F.max("date"), 20).alias("day")))
    return regime.upcoming(cal.join(day), F.col("day"), back=2).drop("day")


@query("""WITH s AS (SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN 'KR' ELSE 'US' END AS market, CASE c_custkey % 5 WHEN 0 THEN 'pykrx' WHEN 1 THEN 'FDR' WHEN 2 THEN 'yfinance' WHEN 3 THEN NULL ELSE 'manual' END AS src, c_acctbal > 0 AS f FROM customer)
    SELECT c_custkey, CASE WHEN market = 'KR' AND src IN ('pykrx', 'FDR') THEN 'high' WHEN src = 'yfinance' THEN CASE WHEN f THEN 'high' ELSE 'medium' END ELSE 'low' END AS quality FROM s""")
def data_quality(spark, d):
    src = F.element_at(F.array(F.lit("pykrx"), F.lit("FDR"), F.lit("yfinance"), F.lit(None), F.lit("manual")), (F.col("c_custkey") % 5 + 1).cast("int"))
    return read(spark, d, "customer").select("c_custkey", regime.data_quality(F.when(F.col("c_nationkey") % 2 == 0, "KR").otherwise("US"), src, F.col("c_acctbal") > 0).alias("quality"))


ORDERS = "bl AS (SELECT o_custkey AS symbol, CAST(o_orderdate AS DATE) AS date, CASE WHEN o_totalprice >= 300000 THEN 'HIGH' WHEN o_totalprice >= 100000 THEN 'MEDIUM' ELSE 'LOW' END AS tier, CASE WHEN o_orderkey % 4 = 0 THEN 'STATIC' ELSE 'DART' END AS source, CASE o_orderkey % 3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'LOW' END AS confidence, o_totalprice * 150 AS amount FROM orders), td AS (SELECT max(CAST(o_orderdate AS DATE)) AS day FROM orders)"


def backlog(spark, d) -> DataFrame:
    o = read(spark, d, "orders")
    tier = F.when(F.col("o_totalprice") >= 300000, "HIGH").when(F.col("o_totalprice") >= 100000, "MEDIUM").otherwise("LOW")
    b = o.select(F.col("o_custkey").alias("symbol"), F.to_date("o_orderdate").alias("date"), tier.alias("tier"), F.when(F.col("o_orderkey") % 4 == 0, "STATIC").otherwise("DART").alias("source"), F.when(F.col("o_orderkey") % 3 == 0, "HIGH").when(F.col("o_orderkey") % 3 == 1, "LOW").alias("confidence"), (F.col("o_totalprice") * 150).alias("amount"))
    return b.join(F.broadcast(b.agg(F.max("date").alias("day"))))


@query(f"WITH {ORDERS} SELECT symbol, CASE max(CASE tier WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END) WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END AS tier, CASE max(CASE tier WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END) WHEN 3 THEN 15.0 WHEN 2 THEN 8.0 ELSE 3.0 END AS boost FROM bl, td WHERE day - date BETWEEN 0 AND 60 GROUP BY symbol")
def backlog_boost(spark, d):
    return regime.backlog_boost(backlog(spark, d), F.col("day"))


@query(f"""WITH {ORDERS}, e AS (SELECT *, day - date AS age FROM bl, td WHERE day - date BETWEEN 0 AND 30), g AS (SELECT count(*) FILTER (age <= 1 AND source = 'STATIC') AS fresh, count(*) FILTER (source <> 'STATIC') AS rest, count(*) FILTER (source <> 'STATIC' AND coalesce(confidence, 'LOW') = 'LOW') AS low, count(*) FILTER (amount > 50000000) AS far FROM e)
    SELECT * FROM (SELECT 'static_as_new' AS finding, fresh AS n FROM g UNION ALL SELECT 'low_confidence_ratio', CASE WHEN rest > 0 AND low * 1.0 / rest > 0.7 THEN low ELSE 0 END FROM g UNION ALL SELECT 'amount_outlier', far FROM g) q WHERE n > 0""")
def audit_backlog(spark, d):
    return regime.audit_backlog(backlog(spark, d), F.col("day"))


@query("""WITH p AS (SELECT o_orderkey AS id, o_custkey % 10 AS book, CASE WHEN o_orderstatus = 'O' THEN 'open' ELSE 'closed' END AS status, CAST(o_orderdate AS DATE) AS exit_at, CASE WHEN o_orderkey % 7 <> 0 THEN (o_totalprice - 150000) / 3000 END AS r FROM orders),
    t AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY exit_at DESC, id) AS n FROM p WHERE status <> 'open' AND (SELECT max(exit_at) FROM p) - exit_at < 400 QUALIFY n <= 50)
    SELECT book, count(*) AS closed, count(*) FILTER (coalesce(r, 0) > 0) AS wins, round(count(*) FILTER (coalesce(r, 0) > 0) * 100.0 / count(*), 5) AS win_rate, round(avg(coalesce(r, 0.0)), 5) AS mean_return FROM t GROUP BY book""")
def position_summary(spark, d):
    o = read(spark, d, "orders")
    p = o.select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 10).alias("book"), F.when(F.col("o_orderstatus") == "O", "open").otherwise("closed").alias("status"), F.to_date("o_orderdate").alias("exit_at"), F.when(F.col("o_orderkey") % 7 != 0, (F.col("o_totalprice") - 150000) / 3000).alias("return_pct"))
    p = p.join(F.broadcast(p.agg(F.max("exit_at").alias("day"))))
    return rounded(regime.position_summary(p, F.col("day"), days=400), "book", "closed", "wins", "win_rate", "mean_return")


@query(f"""{with_tables(*NEAR)}, e AS (SELECT source, target, CASE WHEN (source + target) % 2 = 0 THEN 'UP' ELSE 'DOWN' END AS direction, CASE WHEN source % 2 = 0 THEN 'UP_LEADS_UP' ELSE 'UP_LEADS_DOWN' END AS relation FROM neighbours)
    SELECT target, direction, count(*) AS n, string_agg(source || ' → ' || target || ' (' || relation || ')', '; ' ORDER BY source || ' → ' || target || ' (' || relation || ')') AS relations FROM e GROUP BY target, direction""")
def relation_sets(spark, d):
    e = neighbours(spark, d).select("source", "target", F.when((F.col("source") + F.col("target")) % 2 == 0, "UP").otherwise("DOWN").alias("direction"), F.when(F.col("source") % 2 == 0, "UP_LEADS_UP").otherwise("UP_LEADS_DOWN").alias("relation"))
    return graph.relation_sets(e.unionByName(e.where("source % 5 = 0")))


@query(f"""{with_tables('symbols')}, e AS (SELECT symbol // 8 AS cycle, CASE WHEN symbol % 8 < 2 AND symbol // 8 % 4 <> 0 THEN 'LEADER' WHEN symbol % 8 < 7 THEN 'SECOND' ELSE 'VICTIM' END AS stage, CASE WHEN symbol % 8 < 2 OR symbol % 8 = 7 OR symbol // 8 % 5 = 1 THEN 0 ELSE 2 END AS place, symbol, name FROM symbols
      UNION ALL SELECT symbol // 8, 'VICTIM', 0, symbol, name || CASE WHEN symbol % 2 = 0 THEN 'x' ELSE '' END FROM symbols WHERE symbol % 9 = 0), c AS (SELECT cycle, count(*) FILTER (stage = 'LEADER') AS l, count(*) FILTER (place > 0) AS b FROM e GROUP BY cycle)
    SELECT 'no_leader' AS finding, cycle, NULL AS symbol FROM c WHERE l = 0 UNION ALL SELECT 'no_beneficiary', cycle, NULL FROM c WHERE b = 0 UNION ALL SELECT 'several_names', NULL, symbol FROM e GROUP BY symbol HAVING count(DISTINCT name) > 1 UNION ALL SELECT 'repeated', cycle, symbol FROM e GROUP BY cycle, symbol HAVING count(*) > 1""")
def audit_cycles(spark, d):
    """Cycles with planted faults."""
    s, k = symbols(spark, d), F.col("symbol")
    c = F.expr("symbol div 8")
    stage = F.when((k % 8 < 2) & (c % 4 != 0), "LEADER").when(k % 8 < 7, "SECOND").otherwise("VICTIM")
    e = s.select(c.alias("cycle"), stage.alias("stage"), F.when((k % 8 < 2) | (k % 8 == 7) | (c % 5 == 1), 0).otherwise(2).alias("place"), "symbol", "name")
    more = s.where("symbol % 9 = 0").select(c.alias("cycle"), F.lit("VICTIM").alias("stage"), F.lit(0).alias("place"), "symbol", F.concat("name", F.when(k % 2 == 0, "x").otherwise("")).alias("name"))
    return graph.audit_cycles(e.unionByName(more))


@query("""WITH b AS (SELECT c_custkey AS symbol, 1 AS mentions, ['a' || c_nationkey, 'b'] AS catalysts, ['r' || c_nationkey] AS risks FROM customer), m AS (SELECT o_orderkey AS id, o_custkey AS symbol, ['b', o_orderpriority] AS catalysts, CASE WHEN o_orderkey % 2 = 0 THEN [o_orderstatus] ELSE [] END AS risks FROM orders),
    al AS (SELECT symbol, mentions, catalysts, risks, 0 AS o, 0 AS id FROM b UNION ALL SELECT symbol, 1, catalysts, risks, 1, id FROM m),
    x AS (SELECT symbol, x, o, id, p, kind FROM (SELECT symbol, o, id, unnest(catalysts) AS x, generate_subscripts(catalysts, 1) AS p, 'c' AS kind FROM al UNION ALL SELECT symbol, o, id, unnest(risks), generate_subscripts(risks, 1), 'r' FROM al) q),
    f AS (SELECT symbol, kind, x, min(o * 1e15 + id * 100 + p) AS w FROM x GROUP BY symbol, kind, x), r AS (SELECT *, row_number() OVER (PARTITION BY symbol, kind ORDER BY w, x) AS k FROM f QUALIFY k <= 5),
    a AS (SELECT symbol, string_agg(x, '|' ORDER BY k) FILTER (kind = 'c') AS catalysts, string_agg(x, '|' ORDER BY k) FILTER (kind = 'r') AS risks FROM r GROUP BY symbol)
    SELECT t.symbol, t.mentions, coalesce(a.catalysts, '') AS catalysts, coalesce(a.risks, '') AS risks FROM (SELECT symbol, sum(mentions) AS mentions FROM al GROUP BY symbol) t LEFT JOIN a ON a.symbol = t.symbol""")
def merge_candidates(spark, d):
    c, o = read(spark, d, "customer"), read(spark, d, "orders")
    nation = F.col("c_nationkey").cast("string")
    base = c.select(F.col("c_custkey").alias("symbol"), F.lit(1).cast("long").alias("mentions"), F.array(F.concat(F.lit("a"), nation), F.lit("b")).alias("catalysts"), F.array(F.concat(F.lit("r"), nation)).alias("risks"))
    more = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("symbol"), F.array(F.lit("b"), F.col("o_orderpriority")).alias("catalysts"), F.when(F.col("o_orderkey") % 2 == 0, F.array("o_orderstatus")).otherwise(F.array().cast("array<string>")).alias("risks"))
    m = graph.merge_candidates(base, more)
    return m.select("symbol", "mentions", F.array_join("catalysts", "|").alias("catalysts"), F.array_join("risks", "|").alias("risks"))
