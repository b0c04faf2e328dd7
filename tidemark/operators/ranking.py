"""Sorts, quotas and set operations with total orders: ties end with the key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.shared import checkpointed


def top_k(df: DataFrame, by: str, key: str, k: int) -> DataFrame:
    return df.orderBy(F.desc_nulls_last(by), key).limit(k)


def best_per(df: DataFrame, keys: list[str], by: str, tie: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(by), tie)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def top_per(df: DataFrame, keys: list[str], by: str, tie: str, k: int) -> DataFrame:
    """The k best rows of each key with their rank, cut first within 64 parts of
    a key so that no key is sorted whole in one task."""
    order = [F.desc_nulls_last(by), F.col(tie)]
    part = Window.partitionBy(*keys, F.pmod(F.xxhash64(tie), F.lit(64))).orderBy(*order)
    d = df.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= k)
    return d.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def places(df: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """``df`` with each row's place in its group and the group's size, however large a group is.

    Rows are dealt by ranges of (group, order); a row's place is the one within its range
    and the sizes of the group's ranges before it, which are a small table."""
    d = checkpointed(df.repartitionByRange(F.col(group), *order).withColumn("_part", F.spark_partition_id()))
    sizes = d.groupBy(group, "_part").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(group)
    sizes = sizes.select(F.col(group).alias("_g"), F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_n").over(w).alias("size"))
    inner = F.row_number().over(Window.partitionBy(group, "_part").orderBy(*order))
    d = d.withColumn("place", inner).join(sizes, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p")))
    return d.withColumn("place", F.col("place") + F.col("_before")).drop("_part", "_g", "_p", "_before")


def quota(df: DataFrame, group: str, by: str, tie: str, cap: int) -> DataFrame:
    """Place within the group, and whether the row is beyond the group's cap (overflow goes last)."""
    return places(df, group, [F.desc_nulls_last(by), F.asc(tie)]).drop("size").withColumn("overflow", F.col("place") > cap)


def bucket_split(df: DataFrame, bucket: Column, by: str, tie: str, cap: int) -> DataFrame:
    d = df.withColumn("bucket", bucket)
    w = Window.partitionBy("bucket").orderBy(F.desc_nulls_last(by), tie)
    return d.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= cap).drop("_n")


def sample_even(df: DataFrame, group: str, order: list[str], n: int) -> DataFrame:
    """n rows of each group (all, if it has fewer), evenly spaced in their order."""
    i, c = F.col("place") - 1, F.col("size")
    keep = (c <= n) | (F.floor(i * n / c) != F.floor((i - 1) * n / c))
    return places(df, group, [F.asc(o) for o in order]).where(keep).drop("place", "size")


def cap_per_source(df: DataFrame, source: str, order: list[Column], n: int) -> DataFrame:
    w = Window.partitionBy(source).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def merge_max(a: DataFrame, b: DataFrame, key: str, by: str) -> DataFrame:
    """Union of two pick lists, the best score of each key."""
    return a.unionByName(b).groupBy(key).agg(F.max(by).alias(by))


def except_seen(df: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(seen.select(*keys).distinct(), keys, "left_anti")


def union_distinct(first: DataFrame, *rest: DataFrame) -> DataFrame:
    for df in rest:
        first = first.unionByName(df, allowMissingColumns=True)
    return first.distinct()


def not_seen(items: DataFrame, seen: DataFrame, key: str = "hash") -> DataFrame:
    """Items whose hash isn't among those seen before."""
    return items.join(seen.select(key).distinct(), key, "left_anti")


def rank_pairs(df: DataFrame, most: int | None = None) -> DataFrame:
    """Pairs of medium confidence first, then by lift, probability and events, with their rank where ``most`` is given."""
    order = [F.when(F.col("confidence") == "medium", 0).otherwise(1), F.desc("lift"), F.desc("cond_prob"), F.desc("events"), "source", "target"]
    if most is None:
        return df.orderBy(*order)
    top = df.orderBy(*order).limit(most)  # at most that many rows meet in the window
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def two_sided_quota(df: DataFrame, score: str, most: int = 8, per_side: int = 2) -> DataFrame:
    """Distinct (source, target) rows in order of ``score``, at most ``most``, and ``per_side`` of each source and of each target.

    Taken in order, a row never gives way to a later one.  So rows that stand first on both
    sides can be taken at once, round by round; each round takes the best of all that is left, so
    ``most`` rounds are enough."""
    order = [F.desc(score), "source", "target"]
    place = lambda key: F.row_number().over(Window.partitionBy(key).orderBy(*order))
    todo, taken = checkpointed(df.select("source", "target", score)), None
    for _ in range(most):
        sure = checkpointed(todo.withColumn("_s", place("source")).withColumn("_t", place("target")).where("_s = 1 and _t = 1").select("source", "target", score).orderBy(*order).limit(most))
        if sure.isEmpty():
            break
        taken = sure if taken is None else checkpointed(taken.unionByName(sure))
        full = {key: taken.groupBy(key).count().where(F.col("count") >= per_side).select(key) for key in ("source", "target")}
        todo = checkpointed(todo.join(sure.select("source", "target"), ["source", "target"], "left_anti").join(full["source"], "source", "left_anti").join(full["target"], "target", "left_anti"))
    return df.limit(0).select("source", "target", score) if taken is None else taken.orderBy(*order).limit(most)


def order_scenarios(df: DataFrame, caps: dict[str, int], bonus: float = 5.0) -> DataFrame:
    """The first of each side by score with its place; watched LONG rows stand higher by ``bonus``."""
    worth = F.col("score") + F.when((F.col("side") == "LONG") & F.col("watched"), bonus).otherwise(0.0)
    # a side at a time and with its own cap as a literal, so that each part of it is cut before it moves
    one = lambda side, cap: top_per(df.where(F.col("side") == side).withColumn("_worth", worth), ["side"], "_worth", "id", cap)
    return reduce(DataFrame.unionByName, [one(*c) for c in caps.items()]).withColumnRenamed("rank", "place").drop("_worth")


def prefilter(df: DataFrame, keys: list[str], most: int = 40, rsi: str = "rsi", obv: str = "obv", volume_ratio: str = "volume_ratio") -> DataFrame:
    """The first ``most`` of each of ``keys`` by a priority that takes no deep score.

    LONG rows need an RSI below 75 and come by how far below they are, a rising OBV (5) and the
    volume ratio (3 each, up to 3); SHORT rows need one above 40 and come by it, a rising OBV takes off 5."""
    known = F.nullif(F.col(rsi), F.lit(0.0))
    up = F.when(F.col(obv) == "UP", 5.0).otherwise(0.0)
    level, heat = F.coalesce(known, F.lit(50.0)), F.coalesce(F.nullif(F.col(volume_ratio), F.lit(0.0)), F.lit(1.0))
    long = F.col("side") == "LONG"
    worth = F.when(long, (75 - level) * 0.5 + up + F.least(heat, F.lit(3.0)) * 3).otherwise(level * 0.5 - up)
    fits = F.when(long, F.coalesce(known, F.lit(100.0)) < 75).otherwise(F.coalesce(known, F.lit(0.0)) > 40)
    return top_per(df.where(fits).withColumn("_worth", F.round(worth, 9)), keys, "_worth", "symbol", most).drop("_worth", "rank")


def order_amount(df: DataFrame, most: int) -> DataFrame:
    """The greatest amounts first, unknown ones last."""
    return df.orderBy(F.desc_nulls_last("amount"), F.desc("date"), "id").limit(most)


def sector_overlap(strong: DataFrame, weak: DataFrame) -> DataFrame:
    """sector, standing: strong, weak, or mixed where it is both."""
    both = strong.select("sector").intersect(weak.select("sector"))
    return both.withColumn("standing", F.lit("mixed")).unionByName(strong.select("sector").subtract(both).withColumn("standing", F.lit("strong"))).unionByName(weak.select("sector").subtract(both).withColumn("standing", F.lit("weak")))


def dedupe_picks(picks: DataFrame) -> DataFrame:
    """The best pick of each symbol, then one a (source, symbol, relation) of those that have a source."""
    w = Window.partitionBy("symbol").orderBy(F.desc("score"), "id")
    d = picks.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    key = F.when(F.col("source").isNotNull(), F.concat_ws("|", "source", "symbol", F.coalesce("relation", F.lit("")))).otherwise(F.concat(F.lit("#"), F.col("id").cast("string")))
    return d.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "id"))).where("_n = 1").drop("_n")
