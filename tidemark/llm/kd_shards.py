"""Shards of near equal bytes by a k-d tree over the metadata of documents.

Native throughout: DataFrame functions only.  What the tree divides are groups of equal
texts, each weighing its bytes.  A node that owns several shards is cut at the weighted
median along the dimension in which it is widest, compared with all groups; the two
halves own the lower and the upper shards, until a leaf is one shard.  Of a median the
driver sees no more than quantiles of each node and the weights between them: a round
narrows every node of a level to the stretch that holds its median, and groups of the
same coordinate are told apart by their hash.

A group of more than a 64th of a shard, in bytes or in rows, goes to the emptiest shard before the
tree is built, and the tree fills up what is left.  One of more than a quarter of a
shard is dealt over several.
"""

from __future__ import annotations

import heapq
import json
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import materialise

#: Groups over this part of a shard are placed first; so there are 2 * LARGE of them a shard at most.
LARGE = 64
#: A group of over this part of a shard is dealt over several.
QUARTER = 4
#: Quantiles of a node that the driver sees in a round.
PROBES = 127
#: A cut is good if it is within this part of a shard of the median.
CLOSE = 1 / 2000
#: Rounds of a cut along a coordinate, and then along the hash; two do where coordinates differ.
ROUNDS = 8
#: Rows of a key that one task numbers at most; where there are few, a key is spread over all partitions as well.
NUMBERED = 200_000
#: Groups are told apart by these.
KEY = ["hash", "crc", "size"]


def coordinate(name: str, kind: T.DataType) -> Column:
    """A column as a double: numbers, dates and moments in their own order, texts in that of
    their first six bytes; null, and what isn't finite, is -1."""
    c = F.col(f"`{name}`")
    if isinstance(kind, T.StringType):
        number = F.conv(F.rpad(F.hex(F.substring(c.cast("binary"), 1, 6)), 12, "0"), 16, 10).cast("double")
    elif isinstance(kind, (T.DateType, T.TimestampType)):
        number = F.unix_micros(c.cast("timestamp")).cast("double")
    elif isinstance(kind, (T.NumericType, T.BooleanType)):
        number = c.cast("double")
    else:
        raise ValueError(f"{name} is no dimension: numbers, dates, moments and texts are")
    return F.when(F.abs(number) < float("inf"), number).otherwise(-1.0)


def small(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of a few ``rows`` that the driver knows, as a literal of the plan."""
    names = [f.split()[0] for f in schema.split(", ")]
    text = json.dumps([dict(zip(names, r)) for r in rows])
    kind = ", ".join(f.replace(" ", ": ", 1) for f in schema.split(", "))
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), F.lit(f"array<struct<{kind}>>"))))


def numbered(rows: DataFrame, key: str, order: str, name: str) -> DataFrame:
    """``rows`` with ``name``: a number from 0 without gaps within ``key``, whatever its size.

    A key's rows are dealt to pieces by ``order``, which no two rows share; pieces are
    numbered apart, each from the sum of those before it."""
    pieces = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows.count() / NUMBERED))
    rows = rows.withColumn("__piece", F.pmod(F.xxhash64(order), F.lit(pieces)).cast("int"))
    counts = rows.groupBy(key, "__piece").agg(F.count("*").alias("__n"))
    before = counts.select(key, "__piece", (F.sum("__n").over(Window.partitionBy(key).orderBy("__piece")) - F.col("__n")).alias("__before"))
    place = F.row_number().over(Window.partitionBy(key, "__piece").orderBy(order)) - 1
    return rows.join(materialise(before, "shard-pieces"), [key, "__piece"]).withColumn(name, F.col("__before") + place).drop("__piece", "__before")


def place_large(groups: list[tuple[int, int]], shards: int, total: int) -> tuple[list[list[int]], list[int]]:
    """Shards of (bytes, copies) groups, the largest first to the emptiest shard, and the load of each shard."""
    share = max(1.0, total / shards / QUARTER)
    loads = [(0, s) for s in range(shards)]
    out: list[list[int]] = [[] for _ in groups]
    for k in sorted(range(len(groups)), key=lambda k: (-groups[k][0], k)):
        size, copies = groups[k]
        parts = min(copies, math.ceil(size / share))
        for p in range(parts):
            load, s = heapq.heappop(loads)
            own = copies // parts + (p < copies % parts)
            heapq.heappush(loads, (load + size // copies * own, s))
            out[k].append(s)
    return out, [load for _, load in sorted((s, load) for load, s in loads)]


def room(loads: list[int], rest: int) -> list[float]:
    """What each shard takes of ``rest`` more bytes, so that all come as near to equal as they can."""
    level, filled = 0.0, sorted(loads)
    for k in range(1, len(filled) + 1):
        level = (rest + sum(filled[:k])) / k
        if k == len(filled) or level <= filled[k]:
            break
    return [max(0.0, level - x) for x in loads]


def _wide(spans: list[tuple[float, float]], whole: list[float]) -> int:
    """The dimension that is widest compared with all groups; the first of several."""
    ratio = [(hi - lo) / w if w > 0 else 0.0 for (lo, hi), w in zip(spans, whole)]
    return max(range(len(ratio)), key=lambda d: (ratio[d], -d))


def _quantiles(rows: DataFrame, column: Column) -> dict[int, list]:
    """For each node some values of ``column``, the least and the largest among them."""
    asked = F.array(*(F.lit(k / (PROBES + 1)) for k in range(1, PROBES + 1)))
    found = rows.groupBy("node").agg(F.percentile_approx(column, asked, F.lit(4 * PROBES)).alias("probes"), F.min(column).alias("least"), F.max(column).alias("most"))
    return {r.node: sorted({r.least, *r.probes, r.most}) for r in found.collect()}


def _weights(rows: DataFrame, column: Column, probes: dict[int, list], kind: str) -> dict[int, dict[int, int]]:
    """Bytes of each node by the number of its probes that lie below."""
    spark = rows.sparkSession
    table = small(spark, [(k, v) for k, v in probes.items()], f"node int, probes array<{kind}>")
    place = F.size(F.filter("probes", lambda p: p < column))
    found = rows.join(F.broadcast(table), "node").groupBy("node", place.alias("place")).agg(F.sum("weight").alias("weight"))
    out: dict[int, dict[int, int]] = {k: {} for k in probes}
    for r in found.collect():
        out[r.node][r.place] = r.weight
    return out


def _narrow(rows: DataFrame, column: Column, kind: str, wanted: dict[int, float], close: float) -> dict[int, tuple]:
    """For each node (value, bytes before it, bytes at it, fits): its median is at ``value``.
    ``fits`` says that what is up to and with the value is close to what is wanted."""
    done: dict[int, tuple] = {}
    low: dict[int, tuple] = dict.fromkeys(wanted, (None, 0))
    high: dict[int, tuple] = dict.fromkeys(wanted, (None, 0))
    for _ in range(ROUNDS):
        todo = [n for n in wanted if n not in done]
        if not todo:
            break
        bounds = small(rows.sparkSession, [(n, low[n][0], high[n][0]) for n in todo], f"node int, low {kind}, high {kind}")
        inside = (F.col("low").isNull() | (column > F.col("low"))) & (F.col("high").isNull() | (column <= F.col("high")))
        own = rows.join(F.broadcast(bounds), "node").where(inside).drop("low", "high")
        probes = _quantiles(own, column)
        weights = _weights(own, column, probes, kind)
        for n in todo:
            before = low[n][1]
            for k, value in enumerate(probes[n]):
                step = weights[n].get(k, 0)
                if before + step >= wanted[n] - close or k == len(probes[n]) - 1:
                    break
                before += step
            fits = abs(before + step - wanted[n]) <= close
            if fits or k == 0:  # the first probe is the least value: no other is in its stretch
                done[n] = (value, before, step, fits)
            else:
                low[n], high[n] = (probes[n][k - 1], before), (value, step)
    return {n: done.get(n, (high[n][0], low[n][1], high[n][1], False)) for n in wanted}


def build(groups: DataFrame, dims: int, caps: list[float], total: int) -> DataFrame:
    """``groups`` (at: coordinates, hash, weight) with node, the shard of each.

    The driver holds the cuts, one fewer than there are shards."""
    rows = groups.withColumn("node", F.lit(0))
    owned = {0: (0, len(caps))}
    close = max(1.0, CLOSE * total / len(caps))
    whole: list[float] = []
    at = F.element_at("at", F.col("dim"))
    while any(b - a > 1 for a, b in owned.values()):
        live = {n: (a, b) for n, (a, b) in owned.items() if b - a > 1}
        spans = rows.where(F.col("node").isin(list(live))).groupBy("node").agg(
            F.sum("weight").alias("weight"), *(f(F.col("at")[d]).alias(f"{n}{d}") for d in range(dims) for n, f in (("lo", F.min), ("hi", F.max)))
        ).collect()
        whole = whole or [max(0.0, r[f"hi{d}"] - r[f"lo{d}"]) for r in spans for d in range(dims)]
        dim = {r.node: _wide([(r[f"lo{d}"], r[f"hi{d}"]) for d in range(dims)], whole) for r in spans}
        wanted = {}
        for r in spans:
            a, b = live[r.node]
            left, all_ = sum(caps[a : (a + b) // 2]), sum(caps[a:b])
            wanted[r.node] = r.weight * (left / all_ if all_ else 0.5)
        chosen = small(rows.sparkSession, [(n, d + 1) for n, d in dim.items()] or [(-1, 1)], "node int, dim int")
        split = rows.join(F.broadcast(chosen), "node")
        cuts = _narrow(split, at, "double", wanted, close)
        # groups of the median's own coordinate are cut by their hash
        ties = {n: c for n, c in cuts.items() if not c[3]}
        edges: dict[int, int] = {}
        if ties:
            same = split.join(F.broadcast(small(rows.sparkSession, [(n, c[0]) for n, c in ties.items()], "node int, value double")), "node").where(at == F.col("value"))
            for n, (value, before, step, _) in _narrow(same, F.col("hash"), "long", {n: wanted[n] - c[1] for n, c in ties.items()}, close).items():
                nearer = 2 * before + step <= 2 * (wanted[n] - ties[n][1])  # with the group at the cut than without it
                edges[n] = value if nearer else max(value - 1, -(1 << 63))
        table, then = [], {}
        for n, (a, b) in owned.items():
            if n not in live:
                then[2 * n + 1] = (a, b)
                continue
            then[2 * n + 1], then[2 * n + 2] = (a, (a + b) // 2), ((a + b) // 2, b)
            if n in cuts:
                table.append((n, dim[n] + 1, cuts[n][0], edges.get(n)))
        cut = F.broadcast(small(rows.sparkSession, table or [(-1, 1, 0.0, 0)], "node int, dim int, value double, edge long"))
        right = (at > F.col("value")) | ((at == F.col("value")) & (F.col("hash") > F.col("edge")))
        rows = rows.join(cut, "node", "left").withColumn("node", 2 * F.col("node") + F.when(F.coalesce(right, F.lit(False)), 2).otherwise(1))
        rows = materialise(rows.drop("dim", "value", "edge"), "shard-tree")
        owned = then
    leaves = small(rows.sparkSession, [(n, a) for n, (a, _) in owned.items()], "node int, shard int")
    return rows.join(F.broadcast(leaves), "node")


def shard_documents(docs: DataFrame, shards: int = 16, dims: tuple[str, ...] = ("source", "lang", "n_chars"), carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot and row of every row of ``docs``.

    size is the UTF-8 bytes of the text (null: none) plus 1.  The sizes of shards 0 to ``shards`` - 1 are near equal;
    slots of a shard are 0, 1, 2 and so on.  Rows of equal texts share a shard, unless their
    group is over a quarter of one.  ``dims`` are the metadata that the tree may cut; those that
    ``docs`` lacks are left out, without any the text's hash is cut.  ``row`` is a struct of the columns
    ``carry``, so their names don't matter.  Null metadata come before all others;
    repeated and null doc_ids have a slot each; a text larger than a shard is in one by itself;
    there may be shards without rows where there are few; an empty table gives an empty one.
    """
    kinds = {f.name: f.dataType for f in docs.schema.fields}
    at = [coordinate(d, kinds[d]) for d in dims if d in kinds] or [F.lit(0.0)]
    text = F.coalesce("text", F.lit(""))
    row = F.struct(*(F.col(f"`{c}`") for c in carry)) if carry else F.lit(None).cast("string")
    rows = docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"), F.xxhash64(text).alias("hash"),
        F.array(*at).alias("at"), row.alias("row"), F.monotonically_increasing_id().alias("rid"),
    )
    rows = materialise(rows, "shard-rows")
    least = F.array(*(F.min(F.col("at")[d]) for d in range(len(at))))
    groups = rows.groupBy(*KEY).agg(F.count("*").alias("copies"), least.alias("at")).withColumn("weight", F.col("size") * F.col("copies"))
    groups = materialise(groups, "shard-groups")
    total, n_rows = groups.agg(F.coalesce(F.sum("weight"), F.lit(0)), F.coalesce(F.sum("copies"), F.lit(0))).first()
    parts = shards * LARGE
    is_large = (F.col("weight") * parts > total) | ((F.col("copies") * parts > n_rows) & (F.col("copies") > 1))
    large = groups.where(is_large).orderBy(*KEY).select(*KEY, "weight", "copies").collect()  # 2 * parts of them at most
    placed, loads = place_large([(r.weight, r.copies) for r in large], shards, total)
    table = small(docs.sparkSession, [(r.hash, r.crc, r.size, p) for r, p in zip(large, placed)], "hash long, crc long, size long, placed array<int>")
    marked = rows.drop("at").join(F.broadcast(table), KEY, "left")
    dealt = marked.where(F.size("placed") > 1).withColumn("group", F.xxhash64(*KEY))
    dealt = numbered(dealt, "group", "rid", "part").withColumn("shard", F.col("placed")[F.pmod("part", F.size("placed")).cast("int")])
    whole = marked.where(F.size("placed") == 1).withColumn("shard", F.col("placed")[0])
    tree = build(groups.where(~is_large).select(*KEY, "at", "weight"), len(at), room(loads, total - sum(r.weight for r in large)), total)
    rest = marked.where(F.col("placed").isNull()).join(tree.select(*KEY, "shard"), KEY)
    own = ["doc_id", "size", "crc", "row", "rid", "shard"]
    out = materialise(rest.select(*own).unionByName(whole.select(*own)).unionByName(dealt.select(*own)), "shard-placed")
    out = numbered(out, "shard", "rid", "slot")
    return out.select("doc_id", "size", F.col("crc").alias("text_crc32"), "shard", "slot", "row")


def write_shards(docs: DataFrame, path: str, shards: int = 16, dims: tuple[str, ...] = ("source", "lang", "n_chars")) -> None:
    """Writes all columns of ``docs`` as ``row`` below ``path``, a folder a shard, its rows in order of slot within a file."""
    out = shard_documents(docs, shards, dims, tuple(docs.columns)).select("shard", "slot", "size", "row")
    files = F.floor(F.col("slot") / NUMBERED)
    out.repartition("shard", files).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
