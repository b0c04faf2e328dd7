"""Evidence out of items: mentions, URL de-duplication, clusters and amounts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import text as tx
from tidemark.operators.ranking import top_per
from tidemark.sources.shared import checkpointed

#: Fixed value: won a dollar.
KRW_PER_USD = 1370.0


def url_dedupe(items: DataFrame, url: str = "url") -> DataFrame:
    """The newest item of each canonical URL; items without a URL all stay."""
    d = items.withColumn("_u", tx.canonical_url(F.col(url)))
    # rows without a URL get a group of their own each, so that they don't meet in one task
    own = F.when(F.coalesce("_u", F.lit("")) != "", F.col("_u")).otherwise(F.concat(F.lit("\n"), F.col("external_id").cast("string")))
    w = Window.partitionBy(own).orderBy(F.desc("published_at"), "external_id")
    return d.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_u")


def tokens(c: Column) -> Column:
    """Lower-case words of letters and digits of any script, in order."""
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


#: Terms up to which their table is shipped to the items instead of the items' words to it.
SHIPPED_TERMS = 500_000


def items_for_terms(items: DataFrame, terms: DataFrame, since: Column | None = None) -> DataFrame:
    """term, external_id, n: mentions as whole words in items since a moment.

    A term of several words stands where all of them do, one after the other: runs of as many words
    as any term has are made where an item is read, meet the terms in an equi join and count together."""
    own = items if since is None else items.where(F.col("published_at") >= since)
    asked = terms.select("term", tokens(F.col("term")).alias("ws")).where("size(ws) > 0")
    asked = checkpointed(asked.select("term", F.size("ws").alias("k"), F.concat_ws(" ", "ws").alias("run")))
    sizes = asked.groupBy("k").agg(F.count("*").alias("n")).collect()  # a row a length of terms
    runs = lambda k: F.when(F.size("ws") >= k, F.transform(F.sequence(F.lit(1), F.size("ws") - k + 1), lambda i: F.concat_ws(" ", F.slice("ws", i, k)))).otherwise(none)
    none = F.array().cast("array<string>")
    every = F.flatten(F.array(*(F.col("ws") if r.k == 1 else runs(r.k) for r in sizes), none))
    said = own.select("external_id", tokens(F.col("text")).alias("ws")).select("external_id", F.explode(every).alias("run"))
    asked = asked.select("term", "run")
    hits = said.join(F.broadcast(asked) if sum(r.n for r in sizes) <= SHIPPED_TERMS else asked, "run")
    return hits.groupBy("term", "external_id").agg(F.count("*").alias("n"))


def dollar_tickers(items: DataFrame, block: list[str]) -> DataFrame:
    """external_id, ticker, n of ``$WORD`` marks that aren't on the block list."""
    t = items.select("external_id", F.explode(F.regexp_extract_all("text", F.lit(r"\$([A-Z]{1,5})\b"), 1)).alias("ticker"))
    return t.where(~F.col("ticker").isin(block)).groupBy("external_id", "ticker").agg(F.count("*").alias("n"))


def first_distinct(rows: DataFrame, keys: list[str], value: str, order: list[str], most: int) -> DataFrame:
    """keys and an array of the first ``most`` distinct values by ``order``.

    Values meet once a key, and of each the first place counts; the first of each of 64 parts of
    a key go on, so no task sees more of a key than these."""
    first = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.min(F.struct(*order)).alias("_o"))
    part = Window.partitionBy(*keys, F.pmod(F.xxhash64(value), F.lit(64))).orderBy("_o", value)
    best = first.withColumn("_k", F.row_number().over(part)).where(F.col("_k") <= most)
    best = best.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy("_o", value))).where(F.col("_k") <= most)
    return best.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", value))), lambda x: x[value]).alias(value))


def cluster_lists(items: DataFrame, hash_: Column, columns: dict[str, int]) -> DataFrame:
    """hash and, for each array column of ``items``, the first of its distinct values in the cluster: of the newest
    items first, in order within an item, as many as ``columns`` says."""
    own = checkpointed(items.select(hash_.alias("hash"), (-F.unix_micros("published_at")).alias("_age"), "external_id", *columns))  # texts are read once
    out = own.select("hash").distinct()
    for name, most in columns.items():
        each = own.select("hash", "_age", "external_id", F.posexplode(name).alias("_i", name))
        out = out.join(first_distinct(each, ["hash"], name, ["_age", "external_id", "_i"], most), "hash", "left")
    return out.withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in columns})


def clusters(items: DataFrame, good: list[str], bad: list[str], quality: Column, research: list[str]) -> DataFrame:
    """One row a content hash: its size, sources, majority polarity (ties go to
    positive, then negative), newest time, representative and score.

    The score adds every member's quality above zero, 1.5 a source and 2 a
    research source.  Sources are counted, never collected."""
    p = tx.item_polarity(F.col("text"), good, bad)
    d = items.select("external_id", "source_name", "published_at", tx.content_hash(F.col("text")).alias("hash"), p.alias("polarity"), F.greatest(F.lit(0), quality).alias("q"))
    own = d.groupBy("hash", "source_name").agg(
        F.count("*").alias("size"), F.count_if(F.col("polarity") == "positive").alias("pos"), F.count_if(F.col("polarity") == "negative").alias("neg"), F.count_if(F.col("polarity") == "neutral").alias("neu"),
        F.max(F.struct("published_at", "external_id")).alias("last"), F.sum("q").alias("q"))
    g = own.groupBy("hash").agg(
        F.sum("size").alias("size"), F.count("source_name").alias("sources"), F.count_if(F.col("source_name").isin(research)).alias("research"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum("neu").alias("neu"),
        F.max("last.published_at").alias("newest"), F.max("last")["external_id"].alias("representative"), F.sum("q").alias("q"))
    most = F.greatest("pos", "neg", "neu")
    label = F.when(F.col("pos") == most, "positive").when(F.col("neg") == most, "negative").otherwise("neutral")
    return g.select("hash", "size", "sources", "newest", "representative", label.alias("polarity"), (F.col("q") + 1.5 * F.col("sources") + 2.0 * F.col("research")).alias("score"))


def sentiment_by(items: DataFrame, key: str) -> DataFrame:
    """bull, bear, score (bull share in percent) and confidence by ``key``;
    groups without either polarity are left out."""
    g = items.groupBy(key).agg(F.count_if(F.col("polarity") == "positive").alias("bull"), F.count_if(F.col("polarity") == "negative").alias("bear"))
    n = F.col("bull") + F.col("bear")
    return g.where(n > 0).withColumn("score", 100.0 * F.col("bull") / n).withColumn("confidence", F.when(n >= 3, "high").when(n == 2, "medium").otherwise("low"))


def mood(score: Column) -> Column:
    return F.when(score >= 65, "STRONG").when(score >= 55, "WARM").when(score > 45, "NEUTRAL").when(score > 35, "COOL").otherwise("WEAK")


#: Units of amounts, in 100 million won and in millions of dollars.
WON_UNITS = {"조": 10_000.0, "억": 1.0, "백만": 0.01}
DOLLAR_UNITS = {"billion": 1000.0, "b": 1000.0, "million": 1.0, "m": 1.0, "억달러": 100.0, "백만달러": 1.0}


def amounts(c: Column, units: dict[str, float], pattern: str) -> Column:
    """Array of (at, unit, value) of the numbers that a unit follows, in order."""
    hits = F.regexp_extract_all(c, F.lit(pattern), 0)
    unit = lambda h: F.lower(F.regexp_replace(h, r"[\d,.\s]", ""))
    size = lambda h: F.regexp_replace(h, r"[^\d.]", "").try_cast("double")
    factor = F.create_map(*[F.lit(x) for pair in units.items() for x in pair])
    return F.transform(hits, lambda h, i: F.struct(i.alias("at"), unit(h).alias("unit"), (size(h) * F.element_at(factor, unit(h))).alias("value")))


def krw_amount(c: Column) -> Column:
    """The first amount in units of 100 million won: trillions with the hundreds of millions
    that are the next number, else hundreds of millions, else millions; null without any."""
    found = amounts(c, WON_UNITS, r"\d[\d,]*\s*(?:조|억|백만)")
    of = lambda u: F.get(F.filter(found, lambda x: x["unit"] == u), F.lit(0))
    follows = F.get(F.filter(found, lambda x: (x["at"] == of("조")["at"] + 1) & (x["unit"] == "억")), F.lit(0))["value"]
    return F.coalesce(of("조")["value"] + F.coalesce(follows, F.lit(0.0)), of("억")["value"], of("백만")["value"])


def usd_amount(c: Column) -> Column:
    """The first amount in millions of dollars, billions before millions, Latin units before
    Korean ones; null without any."""
    latin = amounts(c, DOLLAR_UNITS, r"(?i)\d[\d,]*(?:\.\d+)?\s*(?:billion|million|B|M)\b")
    korean = amounts(c, DOLLAR_UNITS, r"\d[\d,]*\s*(?:억|백만)\s*달러")
    first = lambda found, *units: F.get(F.filter(found, lambda x: x["unit"].isin(*units)), F.lit(0))["value"]
    return F.coalesce(first(latin, "billion", "b"), first(latin, "million", "m"), first(korean, "억달러"), first(korean, "백만달러"))


def usd_to_krw(millions: Column, rate: float = KRW_PER_USD) -> Column:
    """Millions of dollars as units of 100 million won."""
    return millions * 1e6 * rate / 1e8


def backlog_tier(amount: Column, scale: float = 1.0) -> Column:
    return F.when(amount >= 150000 * scale, "HIGH").when(amount >= 30000 * scale, "MEDIUM").otherwise("LOW")


def backlog_report(events: DataFrame, most: int = 10, few: int = 5, scale: float = 1.0) -> DataFrame:
    """``events`` with tier, bucket and place: what a report on orders shows, the newest first in each bucket.

    new: filings with an amount, neither amended nor cancelled; unparsed: those without one; high: the newest
    event of each symbol of the highest tier, standing entries too; risk: amended or cancelled; second:
    those further down a chain.  An event may be in several buckets."""
    d = events.withColumn("tier", backlog_tier(F.col("amount"), scale))
    filed, whole = F.col("source") != "STATIC", ~F.col("is_amendment") & ~F.col("is_cancellation")
    newest = Window.partitionBy("symbol").orderBy(F.desc("event_date"), "id")
    high = d.where(F.col("tier") == "HIGH").withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")
    buckets = [
        ("new", d.where(filed & F.col("amount").isNotNull() & whole), most), ("unparsed", d.where((F.col("source") == "DART") & F.col("amount").isNull() & ~F.col("is_cancellation")), few),
        ("high", high, most), ("risk", d.where(filed & ~whole), few), ("second", d.where(filed & (F.col("chain_tier") >= 2)), few),
    ]
    one = lambda name, rows, n: top_per(rows.withColumn("bucket", F.lit(name)).withColumn("_day", F.datediff("event_date", F.lit("1970-01-01"))), ["bucket"], "_day", "id", n)
    return reduce(DataFrame.unionByName, [one(*b) for b in buckets]).withColumnRenamed("rank", "place").drop("_day")


#: Fixed value: letters that tell the share classes of one product.
CLASS_LETTERS = "LABCDE"


def same_product(a: Column, b: Column) -> Column:
    """Share classes of one product, told by their symbols."""
    stem = lambda c: F.regexp_replace(c, f"[{CLASS_LETTERS}]+$", "")
    return (a == b) | ((stem(a) == stem(b)) & (stem(a) != "") & (F.abs(F.length(a) - F.length(b)) <= 1))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 where either has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def staleness(bars: DataFrame, symbols: DataFrame, asof: Column, most_days: int = 4) -> DataFrame:
    """symbol, days since the last bar (999 without one) and whether that is stale."""
    last = bars.groupBy("symbol").agg(F.max("ts").alias("last_ts"))
    d = symbols.select("symbol").join(last, "symbol", "left")
    days = F.coalesce(F.datediff(asof, F.col("last_ts")), F.lit(999))
    return d.select("symbol", days.alias("days"), (days > most_days).alias("stale"))


def referential_audit(edges: DataFrame, dim: DataFrame) -> DataFrame:
    """finding, source, target of edges with an unknown end, to themselves, or repeated."""
    known = dim.select("symbol").distinct()
    lost = lambda end, name: edges.join(known.withColumnRenamed("symbol", end), end, "left_anti").select(F.lit(name).alias("finding"), "source", "target")
    loops = edges.where("source = target").select(F.lit("self_loop").alias("finding"), "source", "target")
    twice = edges.groupBy("source", "target").count().where("count > 1").select(F.lit("duplicate").alias("finding"), "source", "target")
    return lost("source", "unknown_source").unionByName(lost("target", "unknown_target")).unionByName(loops).unionByName(twice)


#: Words that stand where a name or sector is still to come.
PLACEHOLDERS = ["TBD", "TODO", "N/A", "dummy"]
SEVERITIES = ["HIGH", "MEDIUM", "LOW"]


def audit_universe(dim: DataFrame, rules: DataFrame, brokers: list[str]) -> DataFrame:
    """severity, finding and subject: faults of symbols (symbol, name, sector, market) and of rules
    (rule, source, target, direction, least_move).

    A repeated id is found once, a repeated edge (source, target, direction) under its last rule."""
    empty = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    held = r"(?i)\b(?:" + "|".join(PLACEHOLDERS) + r")\b"
    of_dim = [
        ("missing_name", "HIGH", empty("name")), ("missing_sector", "MEDIUM", empty("sector")), ("bad_code", "HIGH", (F.col("market") == "KR") & ~F.col("symbol").rlike(r"^\d{6}$")),
        ("placeholder", "HIGH", F.concat_ws(" ", "name", "sector").rlike(held)), ("short_ticker", "LOW", F.length("symbol") <= 1),
    ]
    of_rule = [
        ("self_loop", "HIGH", F.col("source") == F.col("target")), ("missing_threshold", "MEDIUM", F.col("least_move").isNull()), ("bad_threshold", "HIGH", F.col("least_move") <= 0),
        ("missing_field", "HIGH", empty("rule") | empty("source") | empty("target") | empty("direction")), ("broker_target", "LOW", F.col("target").isin(brokers)),
    ]

    def marked(df: DataFrame, subject: str, faults: list[tuple]) -> DataFrame:
        """All faults of a row at once: the table is read once."""
        each = F.array(*(F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(s).alias("severity"), F.lit(f).alias("finding"))) for f, s, c in faults))
        return df.select(F.col(subject).alias("subject"), F.explode(F.array_compact(each)).alias("f")).select("f.severity", "f.finding", "subject")

    one = lambda df, finding, severity: df.select(F.lit(severity).alias("severity"), F.lit(finding).alias("finding"), F.col("rule").alias("subject"))
    known = dim.select("symbol").distinct()
    lost = lambda end, severity: one(rules.join(known.withColumnRenamed("symbol", end), end, "left_anti"), f"unknown_{end}", severity)
    twice = rules.groupBy("rule").count().where("count > 1")
    edges = rules.groupBy("source", "target", "direction").agg(F.count("*").alias("n"), F.max("rule").alias("rule")).where("n > 1")
    parts = [marked(dim, "symbol", of_dim), marked(rules, "rule", of_rule), one(twice, "duplicate_id", "HIGH"), one(edges, "duplicate_edge", "MEDIUM"), lost("source", "HIGH"), lost("target", "MEDIUM")]
    return reduce(DataFrame.unionByName, parts)


def by_severity(findings: DataFrame) -> DataFrame:
    """The gravest findings first."""
    return findings.orderBy(F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity")), "finding", "subject")
