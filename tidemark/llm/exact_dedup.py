"""Exact de-duplication with an extendible-hash index on shared files.

Native throughout: DataFrame functions only.  A text's address is 64 bits of hash.
A directory maps leading bits of it to buckets: a bucket that has more addresses than
its capacity is split by one more bit, round by round, which doubles the directory
where it is as deep, while its neighbours keep their local depth and share one
bucket among several slots.  Rows go to their bucket's file in the shared folder,
one shuffle for all of them, and each file is read by the task that owns it, without
another: there the rows of one address form a chain, and the bytes of their
normalised texts are compared.

A chain that is more than a quarter of a task's share is dealt over several owners
by salt; each compares its part, and one text of each part is compared again.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialise, shared_path

#: Characters of text that one owner task reads, and owner tasks at most.
OWNER_CHARS, OWNERS = 100_000_000, 1 << 16
#: Buckets that an owner has on average, and buckets at most for which the capacity is chosen.
BUCKETS, MOST_BUCKETS = 16, 1 << 16
#: Addresses of a bucket below which splitting it isn't worth a round.
LEAST_CAPACITY = 64
#: Bits of a directory; a slot that is overfull at that depth has a directory of its own below it.
BITS = 20
#: A run of white space that isn't one space already.
RUNS = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def normalised(column: str = "text") -> Column:
    """The text with each run of white space as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(column, F.lit("")), RUNS, " ")


def directory(addresses: DataFrame, capacity: int) -> list[tuple[int, DataFrame]]:
    """For each level its bits and a table slot, bucket: the leading bits of an
    address, and the bucket they belong to.

    A level has at most 2^BITS slots for each overfull slot of the level above, of
    which there are as many as the capacity fits into the addresses, at most; with
    a hash that spreads there is one level."""
    total, levels, todo = addresses.count(), [], addresses.select("address")
    depth = min(BITS, max(0, math.ceil(math.log2(max(1, total / capacity)))))
    for level in range(1, 64 // BITS + 1):
        slots = todo.groupBy(F.shiftrightunsigned("address", 64 - BITS * level).alias("slot")).agg(F.count("*").alias("n"))
        slots = slots.withColumn("local", F.lit(depth if level == 1 else 1))
        prefix = F.expr(f"shiftright(slot, {BITS} - local)")
        over = (F.col("load") > capacity) & (F.col("local") < BITS)
        while True:  # one more bit for the buckets that are over capacity
            slots = slots.withColumn("prefix", prefix).withColumn("load", F.sum("n").over(Window.partitionBy("local", "prefix"))).checkpoint()
            if slots.where(over).isEmpty():
                break
            slots = slots.select("slot", "n", F.when(over, F.col("local") + 1).otherwise(F.col("local")).alias("local"))
        crowded = slots.where(F.col("load") > capacity)
        reach = slots.agg(F.max("local")).first()[0] or 0
        own = slots.join(crowded.select("slot"), "slot", "left_anti") if level < 64 // BITS else slots
        levels.append((BITS * (level - 1) + reach, own.select(F.expr(f"shiftright(slot, {BITS - reach})").alias("slot"), F.xxhash64(F.lit(level), "local", "prefix").alias("bucket")).distinct()))
        if level == 64 // BITS or crowded.isEmpty():
            return levels
        todo = todo.withColumn("slot", F.shiftrightunsigned("address", 64 - BITS * level)).join(crowded.select("slot"), "slot", "left_semi").select("address")
    return levels


def indexed(docs: DataFrame, capacity: int | None, address: Callable[[Column], Column]) -> DataFrame:
    """The index's files as their owners read them: bucket, salt, address, row (a struct
    of the columns of ``docs``), and body, the normalised text."""
    spark = docs.sparkSession
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")).withColumn("address", address(normalised("row.text")))
    chains = rows.groupBy("address").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.length("row.text"), F.lit(0)) + 1).alias("chars"))
    chains = materialise(chains, "exact-chains")
    distinct, chars = chains.agg(F.count("*"), F.coalesce(F.sum("chars"), F.lit(0))).first()
    owners = min(OWNERS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(chars / OWNER_CHARS)))
    placed = rows
    levels = directory(chains, capacity or max(LEAST_CAPACITY, math.ceil(distinct / min(MOST_BUCKETS, BUCKETS * owners))))
    for k, (bits, slots) in enumerate(levels):
        slots = slots.withColumnRenamed("bucket", f"bucket{k}").withColumnRenamed("slot", f"slot{k}")
        slot = F.shiftrightunsigned("address", 64 - bits) if bits else F.lit(0).cast("long")
        placed = placed.withColumn("at", slot).join(F.broadcast(slots), F.col("at") == F.col(f"slot{k}"), "left").drop("at", f"slot{k}")
    # no more than 4 chains an owner can be over a quarter of its share
    share = max(1, chars // (4 * owners))
    large = chains.where(F.col("chars") > share).select("address", F.ceil(F.col("chars") / share).alias("salts"))
    placed = placed.join(F.broadcast(large), "address", "left")
    salt = F.when(F.col("salts").isNotNull(), F.pmod(F.xxhash64("row.doc_id", F.spark_partition_id()), F.col("salts")) + 1).otherwise(0)
    placed = placed.select(F.coalesce(*(f"bucket{k}" for k in reversed(range(len(levels))))).alias("bucket"), salt.alias("salt"), "address", "row")
    name = f"exact_index_{uuid.uuid4().hex}"
    placed.repartition(owners, "bucket", "salt").write.bucketBy(owners, "bucket", "salt").option("path", shared_path(spark, "exact-index")).saveAsTable(name)
    index = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay
    return index.withColumn("body", normalised("row.text"))


def exact_groups(docs: DataFrame, capacity: int | None = None, address: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row.

    Texts are equal when they are identical once every run of white space is
    one space; null counts as empty.  The row of the least doc_id stays.  Rows
    of a null doc_id count in group_size, stay only where their group has no
    other doc_id (keep_id is then null), and of rows that share the least doc_id
    all are marked kept: rows that are equal in everything can't be told apart.
    An empty table gives an empty one; columns other than doc_id and text aren't read.
    Whole texts of any length are compared.
    """
    index = indexed(docs.select("doc_id", "text"), capacity, address)
    chain = Window.partitionBy("bucket", "salt", "address", "body")
    compared = index.select(
        F.col("row.doc_id").alias("doc_id"), "salt", "address", F.unhex(F.sha2("body", 256)).alias("digest"),
        F.min("row.doc_id").over(chain).alias("keep_id"), F.count("*").over(chain).alias("group_size"),
        F.when((F.col("salt") > 0) & (F.row_number().over(chain.orderBy(F.col("row.doc_id"))) == 1), F.col("body")).alias("body"),
    )
    compared = materialise(compared, "exact-compared")
    whole = compared.where("body is not null").groupBy("address", "body").agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    whole = whole.select("address", F.unhex(F.sha2("body", 256)).alias("digest"), "keep_id", "group_size")
    salted = compared.where("salt > 0").select("doc_id", "address", "digest").join(F.broadcast(whole), ["address", "digest"])
    columns = ["doc_id", "keep_id", "group_size", "digest"]
    every = compared.where("salt = 0").select(*columns).unionByName(salted.select(*columns))
    return every.select("doc_id", "keep_id", "group_size", F.expr("doc_id <=> keep_id").alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def keep_first(docs: DataFrame, capacity: int | None = None, address: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row of each group of equal texts stays, all columns: that of the least
    doc_id, rows without one last; of rows that share it, one.  Null texts count as
    empty, an empty table gives an empty one.  Rows move once, into the index."""
    index = indexed(docs, capacity, address)
    order = [F.col("row.doc_id").asc_nulls_last(), F.col("row.text").asc_nulls_last()]
    first = lambda *keys: F.row_number().over(Window.partitionBy(*keys, "address", "body").orderBy(*order))
    heads = index.withColumn("place", first("bucket", "salt")).where("place = 1")
    salted = heads.where("salt > 0").withColumn("place", first()).where("place = 1")
    every = heads.where("salt = 0").select("row").unionByName(salted.select("row"))
    return every.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
