"""Reviews of past signals: outcomes, performance, roll-ups, exits and alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_price(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol").agg(F.max_by("close", "ts").alias("price"), F.max("ts").alias("price_ts"))


def attach_price(signals: DataFrame, latest: DataFrame) -> DataFrame:
    """Left join: a signal without a price stays unevaluated."""
    return signals.join(latest.select("symbol", "price"), "symbol", "left")


def review_state(priced: DataFrame, asof: Column) -> DataFrame:
    """outcome() with the state of each row (created_at, lag_days): pending until its lag has
    passed, then no_price without one of its prices, else evaluable; only these have a return."""
    late = F.datediff(asof, F.col("created_at")) < F.coalesce(F.col("lag_days"), F.lit(0))
    state = F.when(late, "pending").when(F.col("entry").isNull() | F.col("price").isNull() | F.col("created_at").isNull(), "no_price").otherwise("evaluable")
    d = outcome(priced).withColumn("state", state)
    told = F.col("state") == "evaluable"
    return d.withColumn("return_pct", F.when(told, F.col("return_pct"))).withColumn("hit", F.when(told, F.col("hit")))


def outcome(priced: DataFrame) -> DataFrame:
    """return_pct signed by side and hit (null where it can't be told or for WATCH)."""
    sign = F.when(F.col("side") == "LONG", 1).when(F.col("side") == "SHORT", -1)
    d = priced.withColumn("return_pct", F.when(F.col("entry") > 0, sign * (F.col("price") / F.col("entry") - 1) * 100))
    return d.withColumn("hit", (F.col("return_pct") > 0).cast("int"))


def performance(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count("return_pct").alias("evaluable"), F.avg("return_pct").alias("mean_return"), F.sum("hit").alias("wins"),
        (F.sum("hit") / F.count("hit") * 100).alias("win_rate"), F.max("return_pct").alias("best"), F.min("return_pct").alias("worst"))


def performance_sets(df: DataFrame, *dims: str) -> DataFrame:
    """Performance overall and by each of ``dims`` (side and sector where none is named), in one pass of grouping sets."""
    dims = dims or ("side", "sector")
    sets = df.groupingSets([[], *([d] for d in dims)], *dims)
    return sets.agg(F.count("*").alias("n"), F.count("return_pct").alias("evaluable"), F.avg("return_pct").alias("mean_return"), F.sum("hit").alias("wins"))


def style_feedback(df: DataFrame, good: float = 60.0, bad: float = 40.0) -> DataFrame:
    p = performance(df, "sector")
    label = F.when(F.col("win_rate") >= good, "good").when((F.col("win_rate") <= bad) & (F.col("n") >= 2), "bad")
    return p.withColumn("feedback", label).where("feedback is not null").select("sector", "n", "win_rate", "feedback")


def first_crossing(signals: DataFrame, threshold: float = 80.0) -> DataFrame:
    """The earliest signal of each (symbol, side) that reaches the threshold."""
    first = Window.partitionBy("symbol", "side").orderBy("created_at", "id")
    return signals.where(F.col("score") >= threshold).withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def signal_rollup(signals: DataFrame) -> DataFrame:
    """symbol, first_id (the earliest row with a usable price, where ``price`` is a column), max_score and its time, repeats."""
    at = F.struct("created_at", "id")
    usable = F.when(F.col("price") > 0, at) if "price" in signals.columns else at
    return signals.groupBy("symbol").agg(
        F.min(usable)["id"].alias("first_id"), F.max("score").alias("max_score"), F.max(F.struct("score", "created_at"))["created_at"].alias("max_at"), F.count("*").alias("repeats"))


def repeat_counts(signals: DataFrame, days: int = 3) -> DataFrame:
    """How many signals of the same (symbol, side) each has in the days up to it, itself included."""
    day = F.datediff("created_at", F.lit("1970-01-01"))
    w = Window.partitionBy("symbol", "side").orderBy("_day").rangeBetween(-days, 0)
    return signals.withColumn("_day", day).withColumn("repeats", F.count("*").over(w)).drop("_day")


def position_exit(positions: DataFrame, price: str = "price") -> DataFrame:
    """Stop first, then target, then timeout after 7 days, else open."""
    p, long = F.col(price), F.col("side") == "LONG"
    stop = F.when(long, p <= F.col("stop")).otherwise(p >= F.col("stop"))
    target = F.when(long, p >= F.col("target")).otherwise(p <= F.col("target"))
    return positions.withColumn("exit", F.when(stop, "STOP").when(target, "TARGET").when(F.col("held_days") >= 7, "TIMEOUT").otherwise("OPEN"))


def price_alerts(picks: DataFrame, latest: DataFrame) -> DataFrame:
    """Picks whose price has reached target or invalidation."""
    d = position_exit(picks.join(latest.select("symbol", "price"), "symbol").withColumn("held_days", F.lit(0)))
    return d.where("exit in ('STOP', 'TARGET')").drop("held_days")


def admit(picks: DataFrame, open_positions: DataFrame, book: str, capacity: int = 6, least: float = 80.0, least_small: float = 75.0) -> DataFrame:
    """The best picks of each book, one a symbol and none that is open in it, up
    to the book's free places; where ``small_cap`` is a column, such symbols need less of a score."""
    floor = F.when(F.col("small_cap"), least_small).otherwise(least) if "small_cap" in picks.columns else F.lit(least)
    fresh = picks.where(F.col("score") >= floor).join(open_positions.select(book, "symbol"), [book, "symbol"], "left_anti")
    best = Window.partitionBy(book, "symbol").orderBy(F.desc("score"), "id")
    fresh = fresh.withColumn("rank", F.row_number().over(best)).where("rank = 1")
    ranked = fresh.withColumn("rank", F.row_number().over(Window.partitionBy(book).orderBy(F.desc("score"), "id"))).where(F.col("rank") <= capacity)
    held = open_positions.select(book, "symbol").distinct().groupBy(book).agg(F.count("*").alias("held"))
    return ranked.join(held, book, "left").where(F.col("rank") <= capacity - F.coalesce("held", F.lit(0))).drop("held")


def signal_coverage(signals: DataFrame) -> DataFrame:
    """Symbols, signals, those that can't be evaluated, and symbols that never crossed the threshold."""
    g = signals.groupBy("symbol").agg(F.count("*").alias("n"), F.count_if(F.col("side") == "WATCH").alias("watch"), F.max((F.col("score") >= 80).cast("int")).alias("crossed"))
    return g.agg(F.count("*").alias("symbols"), F.sum("n").alias("signals"), F.sum("watch").alias("unevaluable"), F.count_if(F.col("crossed") == 0).alias("never_crossed"))


def upsert_signals(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row a (symbol, side, day), or a longer key where those columns are there: seen_count, first and
    last id, the first price that isn't null, the best score, and whether any was sent."""
    both = old.unionByName(new)
    key = [c for c in ("source", "symbol", "side", "relation", "created_at") if c in both.columns]
    more = [F.min_by("price", F.when(F.col("price").isNotNull(), F.col("id"))).alias("first_price")] if "price" in both.columns else []
    more += [F.max("sent").alias("sent")] if "sent" in both.columns else []
    return both.groupBy(*key).agg(F.count("*").alias("seen_count"), F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.max("score").alias("max_score"), *more)


def archive_duplicates(signals: DataFrame) -> DataFrame:
    """Marks all but the least id of each (symbol, side) and rolls up the rest onto it."""
    w = Window.partitionBy("symbol", "side")
    d = signals.withColumn("keep_id", F.min("id").over(w)).withColumn("seen", F.count("*").over(w)).withColumn("last_seen", F.max("created_at").over(w)).withColumn("first_seen", F.min("created_at").over(w))
    d = d.withColumn("missing_price", F.col("price").isNull() if "price" in signals.columns else F.lit(False))
    return d.withColumn("archived", F.col("id") != F.col("keep_id")).select("id", "symbol", "side", "keep_id", "seen", "first_seen", "last_seen", "missing_price", "archived")


def duplicate_stats(signals: DataFrame) -> DataFrame:
    """groups, to_archive, missing_price and unverified of the rows (symbol, side, price, price_source, archived) that aren't archived."""
    live = signals.where(~F.coalesce("archived", F.lit(False)))
    own = live.groupBy("symbol", "side").agg(F.count("*").alias("n"), F.count_if(F.col("price").isNull()).alias("missing"), F.count_if(F.col("price_source") == "unverified").alias("unverified"))
    many = F.col("n") > 1
    return own.agg(F.count_if(many).alias("groups"), F.coalesce(F.sum(F.when(many, F.col("n") - 1)), F.lit(0)).alias("to_archive"), F.coalesce(F.sum("missing"), F.lit(0)).alias("missing_price"), F.coalesce(F.sum("unverified"), F.lit(0)).alias("unverified"))


def backfill_prices(signals: DataFrame, closes: DataFrame, within: int = 8) -> DataFrame:
    """``signals`` (id, symbol, created_at, price, verified) with missing and unverified prices from the
    close of their day or of the next trading day within ``within`` days, and where each came from.

    Signals and closes meet by symbol and day: each signal asks for its own day and those after it."""
    need = signals.where(F.col("price").isNull() | ~F.col("verified"))
    asked = need.select("id", "symbol", "created_at", F.explode(F.expr(f"sequence(created_at, date_add(created_at, {within}), interval 1 day)")).alias("ts"))
    found = asked.join(closes.where("close is not null").select("symbol", "ts", "close"), ["symbol", "ts"]).groupBy("id").agg(F.min(F.struct("ts", "close")).alias("c"), F.min("created_at").alias("_day"))
    found = found.select("id", F.col("c")["close"].alias("_close"), F.when(F.col("c")["ts"] == F.col("_day"), "exact_date_close").otherwise("nearest_trading_day_close").alias("_from"))
    d = signals.join(found, "id", "left")
    asks = F.col("price").isNull() | ~F.col("verified")
    source = F.when(~asks, "kept").when(F.col("_close").isNotNull(), F.col("_from")).otherwise("failed_no_price")
    return d.withColumn("price_source", source).withColumn("price", F.when(asks, F.coalesce("_close", "price")).otherwise(F.col("price"))).drop("_close", "_from")
