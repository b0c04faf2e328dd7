"""Mentions of symbols and themes in items, what they say, and the candidates that follow."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.cleaning import either
from tidemark.operators.ranking import top_per
from tidemark.operators.terms import term_places
from tidemark.operators.text import count_of, truncate
from tidemark.sources.shared import checkpointed

def holds(c: Column, words: list[str]) -> Column:
    """Whether a text holds any of the words as a part."""
    return F.greatest(*(F.instr(c, w) for w in words), F.lit(0)) > 0


def needs_context(alias: str, marked: bool, macro: set[str]) -> bool:
    """Aliases that are marked, macro words, or up to five upper-case ASCII characters."""
    return marked or alias in macro or (alias.isascii() and alias.isupper() and len(alias) <= 5)


def alias_mentions(items: DataFrame, aliases: DataFrame | list[tuple[str, str, bool]], macro: list[str], stock_words: str) -> DataFrame:
    """external_id, symbol, alias, at (0-based), before and after: every counted mention in every item,
    longest aliases first, each character used once, with up to 100 characters on either side.

    ``aliases`` (symbol, alias, marked) is a table of any size, or a few rows.  An alias of two symbols counts for
    the first of them."""
    if isinstance(aliases, DataFrame):
        a = F.col("alias")
        short = a.rlike(r"^[\x00-\x7F]{1,5}$") & (F.upper(a) == a) & (F.lower(a) != a)
        book = aliases.select("symbol", "alias", (F.col("marked") | a.isin(macro) | short).alias("needs"))
    else:
        book = [(s, a, needs_context(a, m, set(macro))) for s, a, m in aliases]
    return term_places(items, book, stock_words, single=True)


def mention_table(hits: DataFrame) -> DataFrame:
    """external_id, symbol, mentions, aliases in order of first mention."""
    g = hits.groupBy("external_id", "symbol", "alias").agg(F.count("*").alias("n"), F.min("at").alias("at"))
    return g.groupBy("external_id", "symbol").agg(F.sum("n").alias("mentions"), F.transform(F.array_sort(F.collect_list(F.struct("at", "alias"))), lambda x: x["alias"]).alias("aliases"))


def top_mentions(hits: DataFrame, false_positives: list[str], most: int = 10) -> DataFrame:
    """symbol, items, mentions: the most mentioned symbols that aren't known to be false."""
    g = hits.where(~F.col("symbol").isin(false_positives)).groupBy("symbol").agg(F.count_distinct("external_id").alias("items"), F.count("*").alias("mentions"))
    return g.orderBy(F.desc("mentions"), "symbol").limit(most)


def drop_attribution(hits: DataFrame, brokers: list[str], suffix: str, self_news: str) -> DataFrame:
    """``hits`` without brokers that are named as a source: a suffix stands right after the
    name, or no news of their own in the 100 characters after it."""
    after = F.col("after")
    source = F.col("alias").isin(brokers) & (after.rlike(f"^(?:{suffix})") | ~after.rlike(self_news))
    return hits.where(~source)


def _window(window: int) -> Column:
    """A hit with up to ``window`` characters on either side."""
    return F.concat(F.substring("before", -window, window) if window else F.lit(""), "alias", F.substring("after", 1, window))


def first_places(hits: DataFrame, stream: int, window: int) -> DataFrame:
    """symbol, o and context of the first hit of each alias in each item; ``o`` orders them by stream, length of the alias, item and place."""
    first = hits.groupBy("symbol", "alias", "external_id").agg(F.min(F.struct("at", _window(window).alias("context"))).alias("hit"))
    o = F.struct(F.lit(stream).alias("stream"), (-F.length("alias")).alias("length"), "external_id", F.col("hit.at").alias("at"))
    return first.select("symbol", o.alias("o"), "hit.context")


def evidence_streams(items: DataFrame, hits: DataFrame, tickers: DataFrame, brokers: list[str], suffix: str, self_news: str, window: int = 80) -> DataFrame:
    """symbol, o and context of what may be direct evidence, by four streams: the first counted mention
    of an alias in an item; an alias behind a house's name that leads a text; the symbol's
    ticker as a word; and $ticker.

    ``hits`` are alias_mentions() of ``items``; ``tickers`` (symbol, ticker) are looked for in all items, where the symbol is mentioned in any.
    Names of houses as sources don't count."""
    lead = rf"^(?i:{either(brokers)})\s*[)\]:]\s*"
    seen = hits.select("symbol").distinct()
    fair = drop_attribution(hits, brokers, suffix, self_news)
    streams = [first_places(fair, 1, window).withColumn("context", F.regexp_replace("context", lead, ""))]
    behind = items.where(F.col("text").rlike(lead + r".{5}")).select("external_id", F.regexp_replace("text", lead, "").alias("text"))
    aliases = hits.where(~F.col("alias").isin(brokers)).select("symbol", "alias", F.lit(False).alias("needs")).distinct()
    streams.append(first_places(drop_attribution(term_places(behind, aliases), brokers, suffix, self_news), 2, window * 3 // 4))
    own = tickers.join(seen, "symbol").where((F.length("ticker") >= 2) & ~F.col("ticker").rlike(r"^\d+$"))
    alone = lambda c, edge: ~F.coalesce(c.rlike(edge), F.lit(False))
    both = own.select("symbol", F.explode(F.array("ticker", F.concat(F.lit("$"), "ticker"))).alias("alias"), F.lit(False).alias("needs"))
    places = term_places(items, both)
    marked = F.col("alias").startswith("$")
    streams.append(first_places(places.where(~marked & alone(F.col("before"), r"[\p{L}\p{N}_]$") & alone(F.col("after"), r"^[\p{L}\p{N}_]")), 3, window))
    streams.append(first_places(places.where(marked), 4, window))
    return reduce(DataFrame.unionByName, streams)


def direct_evidence(found: DataFrame, noise: str, most: int = 10) -> DataFrame:
    """symbol, contexts, n: the first distinct contexts of each symbol without noise, and how many there
    are of the first ``most``.  ``found`` has symbol, o (an order) and context."""
    first = found.where(~F.col("context").rlike(noise)).groupBy("symbol", "context").agg(F.min("o").alias("o"))
    top = first.withColumn("k", F.row_number().over(Window.partitionBy("symbol").orderBy("o", "context"))).where(F.col("k") <= most)
    return top.groupBy("symbol").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "context"))), lambda x: x["context"]).alias("contexts"), F.count("*").alias("n"))


def titles(items: DataFrame, hits: DataFrame, most: int = 3, length: int = 60) -> DataFrame:
    """symbol, titles: of the first ``most`` items that mention it, cut at ``length`` characters."""
    said = hits.select("symbol", "external_id").distinct()
    top = said.withColumn("k", F.row_number().over(Window.partitionBy("symbol").orderBy("external_id"))).where(F.col("k") <= most)
    cut = truncate(F.coalesce("title", F.lit("")), length)
    return top.join(items.select("external_id", cut.alias("title")), "external_id").groupBy("symbol").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "title"))), lambda x: x["title"]).alias("titles"))


def candidate_table(hits: DataFrame, evidence: DataFrame, sources: DataFrame, good: str, bad: str, most: int = 20) -> DataFrame:
    """symbol, mentions, sentiment, catalysts, risks, titles, evidence: the most mentioned symbols, better
    told and better backed ones first among equals.

    ``evidence`` is direct_evidence(), ``sources`` titles().  The sentiment is that of all contexts; of the first three, those with good words are
    catalysts and those with bad ones risks, cut at 60 characters."""
    m = hits.groupBy("symbol").agg(F.count("*").alias("mentions"))
    none = F.array().cast("array<string>")
    d = m.join(evidence, "symbol", "left").join(sources, "symbol", "left").withColumns({"contexts": F.coalesce("contexts", none), "titles": F.coalesce("titles", none)})
    said = lambda p: F.exists("contexts", lambda x: x.rlike(p))
    three = F.slice("contexts", 1, 3)
    cut = lambda p: F.transform(F.filter(three, lambda x: x.rlike(p)), lambda x: F.substring(x, 1, 60))
    mood = F.when(said(good) & said(bad), "mixed").when(said(good), "positive").when(said(bad), "negative").otherwise("neutral")
    d = d.select("symbol", "mentions", mood.alias("sentiment"), cut(good).alias("catalysts"), cut(bad).alias("risks"), "titles", F.coalesce("n", F.lit(0).cast("long")).alias("evidence"))
    rank = F.when(F.col("sentiment") == "positive", 2).when(F.col("sentiment") == "mixed", 1).when(F.col("sentiment") == "neutral", 0).otherwise(-1)
    return d.orderBy(F.desc("mentions"), F.desc(rank), F.desc(F.size("catalysts")), F.desc(F.size("titles")), "symbol").limit(most)


def sentiment_alpha(sentiment: Column, n_catalysts: Column, n_risks: Column, n_titles: Column, source_points: Column, mentions: Column, evidence: Column, n_material: Column, n_reaction: Column) -> Column:
    """0 to 100: polarity 20, novelty 15, sources 15, confirmation 15, directness 10, materiality 15, reaction 10."""
    polarity = F.when(sentiment == "positive", 12.0 + F.least(n_catalysts * 2.0, F.lit(8.0))).when(sentiment == "mixed", F.when(n_catalysts > n_risks, 8.0).otherwise(5.0)).when(sentiment == "negative", 2.0).otherwise(5.0)
    directness = F.when(evidence >= 3, 10.0).when(evidence == 2, 7.0).when(evidence == 1, 4.0).otherwise(0.0)
    upto = lambda v, high: F.least(v, F.lit(high))
    parts = [upto(n_titles * 4.0, 15.0), upto(source_points, 15.0), upto(F.greatest(mentions - 1, F.lit(0)) * 2.5, 15.0), directness, upto(n_material * 3.0, 15.0), upto(n_reaction * 2.5, 10.0)]
    return F.least(F.lit(100.0), reduce(lambda a, b: a + b, parts, polarity))


def themes(text: Column, words: dict[str, list[str]]) -> Column:
    """Names of the themes of which any word stands in the text, sorted."""
    return F.array_sort(F.array_compact(F.array(*(F.when(holds(text, w), F.lit(n)) for n, w in words.items()))))


def first_category(text: Column, words: list[tuple[str, list[str]]], otherwise: str | None = None) -> Column:
    """The first category of which any word stands in the lower-cased text."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.coalesce(*(F.when(holds(low, [w.lower() for w in ws]), F.lit(n)) for n, ws in words), F.lit(otherwise))


def refined_polarity(text: Column, good: list[str], bad: list[str], overrides: list[str], noise: str) -> Column:
    """Polarity by the number of different good and bad words: noise is neutral; with an override
    it is positive unless bad words lead by more than one; ties with both are mixed."""
    many = lambda ws: sum(((F.instr(text, w) > 0).cast("int") for w in ws), F.lit(0))
    p, n = many(good), many(bad)
    told = F.when(p > n, "positive").when(n > p, "negative").when(p > 0, "mixed").otherwise("neutral")
    return F.when(text.rlike(noise), "neutral").when(holds(text, overrides), F.when(many([b for b in bad if b not in overrides]) > p + 1, "negative").otherwise("positive")).otherwise(told)


def event_polarity(text: Column, good: list[str], bad: list[str]) -> Column:
    """Polarity of one event by the number of different words; ties with both are negative."""
    many = lambda ws: sum(((F.instr(text, w) > 0).cast("int") for w in ws), F.lit(0))
    p, n = many(good), many(bad)
    return F.when((n > p) | ((n == p) & (n > 0)), "negative").when(p > n, "positive").otherwise("neutral")


def reassign(catalysts: Column, risks: Column, good: list[str], bad: list[str]) -> tuple[Column, Column]:
    """Catalysts that say something bad become risks, and risks that say something good catalysts; the moved ones come last."""
    kind = lambda x: event_polarity(x, good, bad)
    fell = F.filter(catalysts, lambda x: kind(x) == "negative")
    every = F.concat(risks, fell)
    return F.concat(F.filter(catalysts, lambda x: kind(x) != "negative"), F.filter(every, lambda x: kind(x) == "positive")), F.filter(every, lambda x: kind(x) != "positive")


def evidence_quality(texts: DataFrame, sector_words: dict[str, list[str]]) -> DataFrame:
    """symbol, quality of what was said (symbol, name, sector, text; one row a text, null where none):
    DIRECT where a text has the symbol or a name of three letters and more as words, SECTOR with a
    word of its sector, else WEAK; REJECT without texts."""
    low = F.lower("text")
    word = lambda c: F.regexp_count(F.concat(F.lit(" "), F.regexp_replace(low, r"[^\p{L}\p{N}]+", "  "), F.lit(" ")), F.concat(F.lit(" \\Q"), F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "  "), F.lit("\\E "))) > 0
    direct = word(F.col("symbol").cast("string")) | ((F.length("name") >= 3) & word(F.col("name")))
    sector = F.coalesce(*(F.when(F.lower("sector") == s, holds(low, ws)) for s, ws in sector_words.items()), F.lit(False))
    rank = F.when(F.col("text").isNull(), 0).when(direct, 3).when(sector, 2).otherwise(1)
    return texts.groupBy("symbol").agg(F.element_at(F.array(F.lit("REJECT"), F.lit("WEAK"), F.lit("SECTOR"), F.lit("DIRECT")), F.max(rank) + 1).alias("quality"))


def news_sentiment(texts: DataFrame, good: list[str], bad: list[str]) -> DataFrame:
    """symbol, n, score: 20 to 80 by the share of good words among all told ones, 55 where none is."""
    many = lambda ws: sum(((F.length("t") - F.length(F.replace(F.col("t"), F.lit(w), F.lit("")))) / len(w) for w in ws), F.lit(0.0))
    g = texts.where("text is not null").withColumn("t", F.lower("text")).groupBy("symbol").agg(F.count("*").alias("n"), F.sum(many(good)).alias("p"), F.sum(many(bad)).alias("m"))
    return g.select("symbol", "n", F.when(F.col("p") + F.col("m") == 0, 55.0).otherwise(F.round(20.0 + 60.0 * F.col("p") / (F.col("p") + F.col("m")), 1)).alias("score"))


def confidence_label(sources: Column, reports: Column, verified: Column) -> Column:
    score = sources + 2 * reports + F.when(verified, 2).otherwise(0)
    return F.when(score >= 7, "high").when(score >= 3, "medium").otherwise("low")


def sector_radar(clusters: DataFrame, words: list[tuple[str, list[str]]]) -> DataFrame:
    """sector, bull, bear, score, novelty, sources, confidence over clusters (polarity, headline, sources) that name a sector's words."""
    named = F.array_compact(F.array(*(F.when(holds(F.col("headline"), ws), F.lit(n)) for n, ws in words)))
    d = clusters.select("polarity", "sources", F.explode(named).alias("sector"))
    g = d.groupBy("sector").agg(F.count_if(F.col("polarity") == "positive").alias("bull"), F.count_if(F.col("polarity") == "negative").alias("bear"), F.count_if(F.col("sources") == 1).alias("novelty"), F.sum("sources").alias("sources"))
    n = F.col("bull") + F.col("bear")
    return g.where(n > 0).select("sector", "bull", "bear", (F.col("bull") / n * 100).alias("score"), "novelty", "sources", F.when(n >= 3, "high").when(n == 2, "medium").otherwise("low").alias("confidence"))


def sentiment_delta(now: DataFrame, before: DataFrame, key: str = "sector") -> DataFrame:
    """key, delta, trend of the scores against the window before."""
    d = now.select(key, F.col("score").alias("_n")).join(before.select(key, F.col("score").alias("_b")), key).withColumn("delta", F.col("_n") - F.col("_b"))
    return d.select(key, "delta", F.when(F.col("delta") >= 10, "rising").when(F.col("delta") <= -10, "cooling").otherwise("steady").alias("trend"))


def cluster_scores(clusters: DataFrame, macro: list[str], good: list[str], bad: list[str], research: str, ads: str) -> DataFrame:
    """``clusters`` without advertisements and orphans, with their bucket and score.

    The score adds half a point a source, 3 for a research source, 2 with tickers, and for each
    keyword of the bucket 2 (macro) or 1.5."""
    t = F.col("headline")
    many = lambda ws: sum(((F.instr(t, w) > 0).cast("int") for w in ws), F.lit(0))
    d = clusters.where(~t.rlike(ads)).where(~((F.col("polarity") == "neutral") & ~F.col("is_macro") & (F.col("n_tickers") == 0)))
    base = F.col("score") + 0.5 * F.col("sources") + F.when(F.col("source_name").rlike(research), 3.0).otherwise(0.0) + F.when(F.col("n_tickers") > 0, 2.0).otherwise(0.0)
    bucket = F.when(F.col("is_macro"), "macro").when(F.col("polarity") == "negative", "negative").otherwise("positive")
    bonus = F.when(F.col("is_macro"), 2.0 * many(macro)).when(F.col("polarity") == "negative", 1.5 * many(bad)).otherwise(1.5 * many(good))
    return d.select("id", bucket.alias("bucket"), (base + bonus).alias("score"))


def within_budget(scored: DataFrame, caps: dict[str, int], total: int) -> DataFrame:
    """id, bucket, score: the best of each bucket up to its cap, then up to ``total`` of all: while
    there are too many, the last positive goes if there are as many as negatives, else the last negative, then macros.

    ``caps`` names the buckets positive, negative and macro.  How many stay follows from the three counts: what
    macros leave is what the other two share, and the larger of them is cut down to the smaller before both are."""
    best = reduce(DataFrame.unionByName, [top_per(scored.where(F.col("bucket") == name), ["bucket"], "score", "id", cap) for name, cap in caps.items()])
    best = checkpointed(best)
    p, n, m = (F.count_if(F.col("bucket") == b) for b in ("positive", "negative", "macro"))
    counts = best.agg(p.alias("p"), n.alias("n"), F.least(m, F.lit(total)).alias("m")).withColumn("s", F.least(F.col("p") + F.col("n"), total - F.col("m")))
    half = F.floor(F.col("s") / 2)
    counts = counts.withColumn("left_p", F.when(F.col("p") >= F.col("n"), F.greatest(F.col("s") - F.col("n"), half)).otherwise(F.col("s") - F.greatest(F.col("s") - F.col("p"), F.col("s") - half)))
    pairs = (("positive", F.col("left_p")), ("negative", F.col("s") - F.col("left_p")), ("macro", F.col("m")))
    room = counts.select(F.inline(F.array(*(F.struct(F.lit(b).alias("bucket"), c.cast("long").alias("room")) for b, c in pairs))))
    return best.join(F.broadcast(room), "bucket").where(F.col("rank") <= F.col("room")).select("id", "bucket", "score")


def category_headlines(items: DataFrame, words: list[tuple[str, list[str]]], most: int = 2) -> DataFrame:
    """category, k, id: each headline once, under the first category it names, the first ``most`` of each."""
    d = items.withColumn("category", first_category(F.col("headline"), words)).where("category is not null and headline <> ''")
    once = d.withColumn("_n", F.row_number().over(Window.partitionBy("headline").orderBy("id"))).where("_n = 1")
    return once.withColumn("k", F.row_number().over(Window.partitionBy("category").orderBy("id"))).where(F.col("k") <= most).select("category", "k", "id")


def symbol_summary(scenarios: DataFrame, *edges: DataFrame) -> DataFrame:
    """symbol, score, side, mentions: the best scenario's fields and how often the symbol stands in all histories."""
    best = scenarios.groupBy("symbol").agg(F.max(F.struct("score", "side")).alias("b"), F.count("*").alias("n")).select("symbol", "b.score", "b.side", "n")
    ends = [e.select(F.explode(F.array("source", "target")).alias("symbol")) for e in edges]
    m = reduce(lambda a, b: a.unionByName(b), ends).groupBy("symbol").agg(F.count("*").alias("m"))
    d = best.join(m, "symbol", "full")
    return d.select("symbol", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("side", F.lit("")).alias("side"), (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("mentions"))


def audit_aliases(aliases: DataFrame, macro: list[str], common: list[str]) -> DataFrame:
    """symbol, alias, finding, severity of aliases that are prone to false mentions."""
    a, n = F.col("alias"), F.length("alias")
    plain = a.rlike(r"^[\x00-\x7F]*$")
    rules = [
        (a.rlike(r"^[A-Za-z0-9]$"), "single_character", "HIGH"), (a.isin(macro), "macro_word", "HIGH"),
        ((n <= 2) & plain & ~((a == F.upper(a)) & a.rlike("[A-Z]")) & ~F.col("marked"), "short_unprotected", "MEDIUM"), (a.isin(common), "common_word", "MEDIUM"), (n > 20, "too_long", "LOW"),
    ]
    found = F.array_compact(F.array(*(F.when(c, F.struct(F.lit(name).alias("finding"), F.lit(level).alias("severity"))) for c, name, level in rules)))
    return aliases.select("symbol", "alias", F.explode(found).alias("f")).select("symbol", "alias", "f.finding", "f.severity")


def lint_reports(reports: DataFrame, patterns: list[tuple[str, str]], forbidden: list[str], gate: float = 70.0) -> DataFrame:
    """id, finding, n: leftover patterns and forbidden words in stored reports, and SHORT calls under the gate."""
    t = F.coalesce("text", F.lit(""))
    counts = [F.struct(F.lit(name).alias("finding"), F.size(F.regexp_extract_all(t, F.lit(p), 0)).alias("n")) for name, p in patterns]
    counts.append(F.struct(F.lit("forbidden").alias("finding"), count_of(t, forbidden).alias("n")))
    counts.append(F.struct(F.lit("short_gate").alias("finding"), F.when((F.col("side") == "SHORT") & (F.col("score") < gate), 1).otherwise(0).alias("n")))
    return reports.select("id", F.explode(F.array(*counts)).alias("f")).where("f.n > 0").select("id", "f.finding", "f.n")
