"""Rule graphs: pair rules, supply chains, cycles, and candidates that follow from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.relations import gap_class, primary_return
from tidemark.operators.terms import term_places

#: Points of a confirmed relation by its confidence.
BOOSTS = {"high": 2.0, "medium": 1.0}


def expand_pairs(rules: DataFrame, quotes: DataFrame, least_move: float = 3.0) -> DataFrame:
    """rule, source, target, direction, returns and gap_class of the targets of moving sources.

    A source moves when its return passes the greater of ``least_move`` and its rule's
    own.  Targets that are the source itself or have no quote go."""
    has = quotes.where("return_4h is not null or return_1d is not null")
    px = has.select("symbol", "return_4h", "return_1d", primary_return(F.col("return_4h"), F.col("return_1d")).alias("move"))
    end = lambda side: px.select(*[F.col(c).alias(side if c == "symbol" else f"{side}_{c}") for c in px.columns])
    edges = rules.select("rule", "source", "direction", "least_move", F.explode("targets").alias("target")).where("target <> source")
    d = edges.join(end("source"), "source").where(F.abs("source_move") >= F.greatest(F.lit(least_move), F.col("least_move"))).join(end("target"), "target")
    gap = gap_class(F.col("direction"), F.col("source_move"), F.col("target_move"), F.col("target_return_4h"), F.col("target_return_1d"))
    return d.select("rule", "source", "target", "direction", F.col("source_move").alias("source_return"), F.col("target_move").alias("target_return"), gap.alias("gap_class"))


def attach_pair_stats(pairs: DataFrame, *tables: DataFrame) -> DataFrame:
    """``pairs`` with cond_prob, lift and events of the first of ``tables`` that has the (source, target)."""
    out = pairs
    for k, t in enumerate(tables):
        own = t.groupBy("source", "target").agg(F.max_by(F.struct("cond_prob", "lift", "events"), F.struct("lift", "cond_prob", "events")).alias(f"_s{k}"))
        out = out.join(own, ["source", "target"], "left")
    return out.withColumn("_s", F.coalesce(*(f"_s{k}" for k in range(len(tables))))).select(*pairs.columns, "_s.cond_prob", "_s.lift", F.coalesce("_s.events", F.lit(0)).alias("events"))


def match_rules(movers: DataFrame, rules: DataFrame) -> DataFrame:
    """symbol, rule: movers whose market a rule takes and that it lists, or whose name holds one of its keywords.

    Keywords of any length are found in the names by one automaton for all of them."""
    takes = (F.col("rule_market") == F.col("market")) | F.col("rule_market").isin("BOTH", "CROSS")
    r = rules.withColumnRenamed("market", "rule_market")
    listed = movers.join(r.select("rule", "rule_market", F.col("source").alias("symbol")), "symbol").where(takes).select("symbol", "rule")
    words = r.select("rule", "rule_market", F.explode("keywords").alias("k")).select("rule", "rule_market", F.lower("k").alias("alias")).where("alias <> ''")
    names = movers.select(F.struct("symbol", "market").alias("external_id"), F.lower("name").alias("text"))
    held = term_places(names, words.select(F.lit("").alias("symbol"), "alias", F.lit(False).alias("needs")).distinct(), around=0).select("external_id.*", "alias").distinct()
    named = held.join(words, "alias").where(takes).select("symbol", "rule")
    return listed.unionByName(named).distinct()


def cycle_stage(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """``symbols`` with the cycle and stage of each one's first entry, in order of cycle,
    leaders first, then by place, then victims; null where no cycle has it."""
    rank = F.when(F.col("stage") == "LEADER", 0).when(F.col("stage") == "VICTIM", 4).otherwise(F.col("place"))
    first = edges.groupBy("symbol").agg(F.min(F.struct("cycle", rank.alias("r"), "stage")).alias("e")).select("symbol", "e.cycle", "e.stage")
    return symbols.join(first, "symbol", "left")


def cross_market(movers: DataFrame, edges: DataFrame, dim: DataFrame, source: str = "US", target: str = "KR") -> DataFrame:
    """target, n_triggers, triggers: symbols of one market that movers of the other lead to,
    most triggers first; of the triggers, the strongest ten are listed."""
    from_ = movers.where(F.col("market") == source).select(F.col("symbol").alias("source"), "name", "return_pct")
    to = dim.where(F.col("market") == target).select(F.col("symbol").alias("target"))
    hits = edges.select("source", "target").distinct().join(from_, "source").join(to, "target")
    w = Window.partitionBy("target").orderBy(F.desc(F.abs("return_pct")), "source")
    ranked = hits.withColumn("n", F.row_number().over(w))
    text = F.concat("name", F.lit("("), F.format_string("%+.1f", "return_pct"), F.lit("%)"))
    top = F.array_sort(F.collect_list(F.when(F.col("n") <= 10, F.struct("n", text.alias("t")))))
    return ranked.groupBy("target").agg(F.count("*").alias("n_triggers"), F.array_join(F.transform(top, lambda x: x["t"]), ", ").alias("triggers")).orderBy(F.desc("n_triggers"), "target")


def live_status(expected: Column, today: Column, volume_ratio: Column, obv: Column) -> Column:
    """How a target stands today against the direction expected of it (UP or else DOWN)."""
    signed = F.when(expected == "UP", today).otherwise(-today)
    flow = F.when(expected == "UP", "UP").otherwise("DOWN")
    backed = F.coalesce((volume_ratio >= 1.0) & (obv == flow), F.lit(False))
    return F.when(today.isNull(), "DATA_MISSING").when((signed > 0) & backed, "CONFIRMED").when(signed > 0, "WATCH").when(signed < -0.5, "NOT_CONFIRMED").otherwise("MIXED")


def expected_direction(relation: Column) -> Column:
    return F.when(F.upper(relation).isin("UP_LEADS_UP", "DOWN_LEADS_UP"), "UP").otherwise("DOWN")


def relation_boost(targets: DataFrame, leadlag: DataFrame, movers: DataFrame, fallback: DataFrame) -> DataFrame:
    """target, boost: points of targets with evidence, a fit chart and a confirmed status
    that a mover leads to.

    The best relation whose source moves counts by its confidence; only where no
    relation has a moving source a fallback of medium confidence gives one point."""
    moving = movers.where(F.abs("return_pct") > 0).select(F.col("symbol").alias("source")).distinct()
    fit = targets.where("has_evidence and technical_ok and status = 'CONFIRMED'").select("target").distinct()
    own = leadlag.join(moving, "source", "left_semi").groupBy("target").agg(F.max_by("confidence", F.struct("lift", "cond_prob", "events", "source", "relation")).alias("best"))
    rest = fallback.where("confidence = 'medium'").join(moving, "source", "left_semi").select("target", F.lit(1.0).alias("plain")).distinct()
    points = F.when(F.col("best") == "high", BOOSTS["high"]).when(F.col("best") == "medium", BOOSTS["medium"]).when(F.col("best").isNotNull(), 0.0)
    return fit.join(own, "target", "left").join(rest, "target", "left").select("target", F.coalesce(points, F.col("plain"), F.lit(0.0)).alias("boost"))


def expand_research(candidates: DataFrame, pairs: DataFrame, most: int = 8, forward: tuple[int, int] = (6, 3), reverse: tuple[int, int] = (4, 2)) -> DataFrame:
    """symbol, parent, origin: what research relations add to ranked ``candidates`` (symbol,
    sentiment, rank), none that is there already and each once, the first ``most`` in order.

    The first candidates look forward, positive and mixed ones along UP_LEADS_UP, negative
    ones along DOWN_LEADS_DOWN, each to its best targets; then the very first look back."""
    want = F.when(F.col("sentiment").isin("positive", "mixed"), "UP_LEADS_UP").when(F.col("sentiment") == "negative", "DOWN_LEADS_DOWN")
    best = F.row_number().over(Window.partitionBy("parent").orderBy(F.desc("score"), "symbol"))
    ahead = candidates.where(F.col("rank") <= forward[0]).select(F.col("symbol").alias("source"), want.alias("relation"), "rank").join(pairs, ["source", "relation"])
    ahead = ahead.select(F.col("source").alias("parent"), F.col("target").alias("symbol"), "rank", "score").withColumn("k", best).where(F.col("k") <= forward[1]).withColumn("origin", F.lit("RESEARCH_LEADLAG"))
    back = candidates.where(F.col("rank") <= reverse[0]).select(F.col("symbol").alias("target"), "rank").join(pairs, "target")
    back = back.select(F.col("target").alias("parent"), F.col("source").alias("symbol"), "rank", "score").withColumn("k", best).where(F.col("k") <= reverse[1]).withColumn("origin", F.lit("RESEARCH_SOURCE"))
    fresh = ahead.unionByName(back).join(candidates.select("symbol"), "symbol", "left_anti")
    order = F.struct("origin", "rank", "k")
    once = fresh.groupBy("symbol").agg(F.min(F.struct("origin", "rank", "k", "parent")).alias("o")).select("symbol", "o.*")
    return once.orderBy(order, "symbol").limit(most).select("symbol", "parent", "origin")


def expand_watchlist(candidates: DataFrame, evidence: DataFrame, watchlist: DataFrame) -> DataFrame:
    """symbol, origin of watched symbols that evidence names, by themselves or without
    their suffix, and that are neither candidates nor avoided."""
    words = evidence.select(F.explode(F.split(F.coalesce("text", F.lit("")), r"[^\p{L}\p{N}.]+")).alias("word")).select(F.regexp_replace("word", r"^\.+|\.+$", "").alias("word")).where("word <> ''").distinct()
    asked = watchlist.where("not avoid").join(candidates.select("symbol").distinct(), "symbol", "left_anti")
    asked = asked.select("symbol", F.explode(F.array_distinct(F.array(F.col("symbol").cast("string"), F.substring_index(F.col("symbol").cast("string"), ".", 1)))).alias("word"))
    return asked.join(words, "word", "left_semi").select("symbol", F.lit("WATCHLIST_RELATED").alias("origin")).distinct()


#: Origins of candidates, those that win first.
ORIGINS = ["DIRECT", "WATCHLIST_RELATED", "CORRELATION_PEER", "RESEARCH_LEADLAG", "RESEARCH_SOURCE"]


def expanded_universe(*parts: DataFrame) -> DataFrame:
    """symbol, origin, also: each symbol once under its first origin, with the number of origins."""
    every = parts[0].select("symbol", "origin")
    for p in parts[1:]:
        every = every.unionByName(p.select("symbol", "origin"))
    order = F.array_position(F.array(*map(F.lit, ORIGINS)), F.col("origin"))
    return every.groupBy("symbol").agg(F.min_by("origin", order).alias("origin"), F.count_distinct("origin").alias("also"))


def coverage(universe: DataFrame) -> DataFrame:
    return universe.groupBy("origin").agg(F.count("*").alias("n"))


def enrich(df: DataFrame, dim: DataFrame, keywords: list[tuple[str, list[str]]]) -> DataFrame:
    """``df`` with the sector of the dimension, else the first whose keyword stands in the
    symbol, the name or, where ``df`` has them, the themes, else unclassified."""
    themes = [F.array_join("themes", " ")] if "themes" in df.columns else []
    text = F.lower(F.concat_ws(" ", F.col("symbol").cast("string"), "name", *themes))
    guess = F.coalesce(*(F.when(F.greatest(*(F.instr(text, w.lower()) for w in words), F.lit(0)) > 0, sector) for sector, words in keywords))
    known = dim.select("symbol", F.col("sector").alias("_known")).dropDuplicates(["symbol"])
    return df.join(known, "symbol", "left").withColumn("sector", F.coalesce(F.nullif("_known", F.lit("")), guess, F.lit("unclassified"))).drop("_known")


def active_cycles(edges: DataFrame, triggers: DataFrame, keywords: DataFrame, quotes: DataFrame, market: str, most: int = 5) -> DataFrame:
    """cycle, n_keywords, n_sources, match_score: 15 points for a trigger that stands in a recent
    keyword, 20 for a leader of the market that moved 2 % in a day; at least 15, 100 at most; the best five."""
    words = keywords.select(F.lower("keyword").alias("text")).where("length(text) > 0").distinct().withColumn("external_id", F.col("text"))
    asked = triggers.select("cycle", F.lower("trigger").alias("alias")).where("alias <> ''").distinct()
    held = term_places(words, asked.select(F.lit("").alias("symbol"), "alias", F.lit(False).alias("needs")).distinct(), around=0).select("alias").distinct()
    told = asked.join(held, "alias", "left_semi").groupBy("cycle").agg(F.count("*").alias("n_keywords"))
    moved = edges.where((F.col("stage") == "LEADER") & (F.col("market") == market)).join(quotes.where("abs(return_1d) >= 2.0").select("symbol"), "symbol").groupBy("cycle").agg(F.count("*").alias("n_sources"))
    d = edges.select("cycle").distinct().join(told, "cycle", "left").join(moved, "cycle", "left").na.fill(0, ["n_keywords", "n_sources"])
    d = d.withColumn("match_score", F.least(F.lit(100.0), F.col("n_keywords") * 15.0 + F.col("n_sources") * 20.0)).where("match_score >= 15")
    return d.orderBy(F.desc("match_score"), "cycle").limit(most)


def cycle_returns(edges: DataFrame, quotes: DataFrame) -> DataFrame:
    """cycle, stage, place, sector, n, mean_return over the symbols that have a quote."""
    return edges.join(quotes.where("return_1d is not null").select("symbol", "return_1d"), "symbol").groupBy("cycle", "stage", "place", "sector").agg(F.count("*").alias("n"), F.avg("return_1d").alias("mean_return"))


def relative_lag(edges: DataFrame, quotes: DataFrame, market: str, least_source: float = 3.0, least_lag: float = 2.0, most: int = 6) -> DataFrame:
    """cycle, sector, source_return, target_return, lag: later beneficiaries that trail their
    cycle's leaders, those of the greatest lag first.

    Leaders have to have risen; of a group's first two symbols none may have an RSI of 80
    or more; a group without quotes counts as unmoved; a sector counts once a cycle."""
    own = edges.where(F.col("market") == market).join(quotes.select("symbol", "return_1d", "rsi"), "symbol", "left")
    lead = own.where("stage = 'LEADER'").groupBy("cycle").agg(F.coalesce(F.avg("return_1d"), F.lit(0.0)).alias("source_return")).where(F.col("source_return") >= least_source)
    late = own.where("place >= 2").withColumn("k", F.row_number().over(Window.partitionBy("cycle", "stage", "sector").orderBy("symbol")))
    groups = late.groupBy("cycle", "stage", "sector").agg(F.coalesce(F.avg("return_1d"), F.lit(0.0)).alias("target_return"), F.max(F.when((F.col("k") <= 2) & (F.col("rsi") >= 80), 1).otherwise(0)).alias("hot"))
    d = groups.join(lead, "cycle").withColumn("lag", F.col("source_return") - F.col("target_return")).where((F.col("lag") >= least_lag) & (F.col("hot") == 0))
    d = d.withColumn("_n", F.row_number().over(Window.partitionBy("cycle", "sector").orderBy("stage"))).where("_n = 1")
    return d.orderBy(F.desc("lag"), "cycle", "sector").limit(most).select("cycle", "sector", "source_return", "target_return", "lag")


def adjust_picks(picks: DataFrame, guard: DataFrame, lags: DataFrame) -> DataFrame:
    """LONG picks with the macro guard's points, not below 0, and half a point a percent of
    their relative lag from 3 % on, five at most, not above 100; others as they are."""
    d = picks.crossJoin(F.broadcast(guard.select("long_adj").limit(1))).join(lags.select("symbol", "lag"), "symbol", "left")
    guarded = F.greatest(F.lit(0.0), F.col("score") + F.col("long_adj"))
    boost = F.when(F.col("lag") >= 3.0, F.least(F.lit(5.0), F.col("lag") * 0.5)).otherwise(0.0)
    return d.withColumn("score", F.when(F.col("side") == "LONG", F.least(F.lit(100.0), guarded + boost)).otherwise(F.col("score"))).drop("long_adj", "lag")


def relation_sets(edges: DataFrame) -> DataFrame:
    """target, direction, n, relations: the distinct relations of each target by direction, the first twenty in order."""
    text = F.concat(F.col("source").cast("string"), F.lit(" → "), F.col("target").cast("string"), F.lit(" ("), F.col("relation"), F.lit(")"))
    d = edges.select("target", "direction", text.alias("t")).distinct().withColumn("k", F.row_number().over(Window.partitionBy("target", "direction").orderBy("t")))
    return d.groupBy("target", "direction").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("k") <= 20, F.col("t")))), "; ").alias("relations"))


def merge_candidates(base: DataFrame, more: DataFrame) -> DataFrame:
    """symbol, mentions, catalysts, risks: mentions add up, one for each row of ``more``;
    distinct catalysts and risks, five at most, those of ``base`` first."""
    both = base.select("symbol", "mentions", "catalysts", "risks", F.lit(0).alias("o"), F.lit(0).cast("long").alias("id")).unionByName(
        more.select("symbol", F.lit(1).cast("long").alias("mentions"), "catalysts", "risks", F.lit(1).alias("o"), F.col("id").cast("long").alias("id")))

    def first_five(name: str) -> DataFrame:
        each = both.select("symbol", "o", "id", F.posexplode(name).alias("p", "x")).groupBy("symbol", "x").agg(F.min(F.struct("o", "id", "p")).alias("w"))
        top = each.withColumn("k", F.row_number().over(Window.partitionBy("symbol").orderBy("w", "x"))).where("k <= 5")
        return top.groupBy("symbol").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda e: e["x"]).alias(name))

    total = both.groupBy("symbol").agg(F.sum("mentions").alias("mentions"))
    out = total.join(first_five("catalysts"), "symbol", "left").join(first_five("risks"), "symbol", "left")
    none = F.array().cast("array<string>")
    return out.select("symbol", "mentions", F.coalesce("catalysts", none).alias("catalysts"), F.coalesce("risks", none).alias("risks"))


def audit_cycles(edges: DataFrame) -> DataFrame:
    """finding, cycle, symbol: cycles without leaders or beneficiaries, symbols under several names, and repeats."""
    c = edges.groupBy("cycle").agg(F.count_if(F.col("stage") == "LEADER").alias("leaders"), F.count_if(F.col("place") > 0).alias("late"))
    no_lead = c.where("leaders = 0").select(F.lit("no_leader").alias("finding"), "cycle", F.lit(None).cast("long").alias("symbol"))
    no_late = c.where("late = 0").select(F.lit("no_beneficiary").alias("finding"), "cycle", F.lit(None).cast("long").alias("symbol"))
    names = edges.groupBy("symbol").agg(F.count_distinct("name").alias("n")).where("n > 1").select(F.lit("several_names").alias("finding"), F.lit(None).cast("long").alias("cycle"), "symbol")
    twice = edges.groupBy("cycle", "symbol").count().where("count > 1").select(F.lit("repeated").alias("finding"), "cycle", "symbol")
    return no_lead.unionByName(no_late).unionByName(names).unionByName(twice)
