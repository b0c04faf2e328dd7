"""SimHash near-duplicates through a hierarchical index in Gray order.

Fingerprints that share a band of bits are sorted by Gray rank, in which
neighbours differ in few bits.  Consecutive fingerprints form nodes, nodes form
upper nodes, and each node keeps what its members share: the mask of bits they
agree on and the pattern in it.  Two nodes are compared before their members: the
masks widen downward, so the differences within both of them add up, and all pairs
below are pruned once they pass the bound; two nodes whose members can't differ in more bits
than the bound are linked as wholes, without listing pairs.

Two fingerprints within ``bound`` bits agree on one of ``bound`` + 1 bands, so
dealing each under its bands loses no link.  A band value that too many
fingerprints share is dealt again by bands of the other bits, level by level.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import extend_rows, in_struct, map_texts, materialise, out_of_struct, touched
from tidemark.llm.components import components

#: Words of a shingle, seed of its hash, and the bits by which linked fingerprints may differ.
SHINGLE, SEED, BOUND = 4, 42, 4
#: Children of an index node.
FAN = 8
#: Fingerprints that a band value may gather before it is dealt by further bands.
CROWD = 4096
#: Levels of bands; beyond the last one too few bits are left to tell fingerprints apart.
LEVELS = 3

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: str) -> int:
    """64 bits as an unsigned integer; a text without words has 0."""
    words = text.encode().translate(_LOWER).split()
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED) if words else 0
    joined = b" ".join(words)
    stops = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = np.concatenate([[0], stops[: -SHINGLE]]).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, (stops[SHINGLE - 1 :] - 1).tolist())], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 4096):
        part = hashes[at : at + 4096]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprint_column() -> Callable[[list[str]], dict[str, list]]:
    def work(texts: list[str]) -> dict[str, list]:
        found = np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64).tolist()
        return {"fp": found}

    return work


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) of every row."""
    return map_texts(docs, fingerprint_column, T.StructType([T.StructField("fp", T.LongType())]))


def bands(bits: list[int], n: int) -> list[list[int]]:
    """``bits`` in ``n`` runs of nearly one length."""
    cuts = [round(i * len(bits) / n) for i in range(n + 1)]
    return [bits[a:b] for a, b in zip(cuts, cuts[1:])]


def _mask(bits: list[int]) -> int:
    value = sum(1 << b for b in bits)
    return value - (1 << 64) if value >> 63 else value


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """Place of each code word in the reflected Gray sequence."""
    rank = fp.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def least_labels(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The least number connected with each of 0..n-1."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        while True:
            jumped = new[new]
            if (jumped == new).all():
                break
            new = jumped
        if (new == label).all():
            return label
        label = new


class GrayIndex:
    """The hierarchy over fingerprints that are sorted by bucket and Gray rank."""

    def __init__(self, bucket: np.ndarray, fp: np.ndarray):
        starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        sizes = np.diff(np.append(starts, len(fp)))
        # levels[0] are the fingerprints; a node of an upper level holds FAN nodes below at most
        self.ands, self.ors, self.child, self.count = [fp], [fp], [None], [None]
        while sizes.max(initial=0) > 1:
            n = -(-sizes // FAN)
            first = np.concatenate([s + FAN * np.arange(k) for s, k in zip(starts.tolist(), n.tolist())])
            ends = np.repeat(starts + sizes, n)
            self.ands.append(np.bitwise_and.reduceat(self.ands[-1], first))
            self.ors.append(np.bitwise_or.reduceat(self.ors[-1], first))
            self.child.append(first)
            self.count.append(np.minimum(FAN, ends - first))
            starts, sizes = np.cumsum(n) - n, n
        self.roots = starts

    def first_leaf(self, level: int, node: np.ndarray) -> np.ndarray:
        while level:
            node, level = self.child[level][node], level - 1
        return node

    def leaf_spans(self, level: int, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low, high = node, node
        while level:
            low, high = self.child[level][low], self.child[level][high] + self.count[level][high] - 1
            level -= 1
        return low, high + 1

    def links(self, bound: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Arrays of leaf pairs that span the linked sets of each bucket."""
        top = len(self.ands) - 1
        stack = [(top, self.roots[i : i + 4096], self.roots[i : i + 4096]) for i in range(0, len(self.roots), 4096)]
        while stack:
            level, a, b = stack.pop()
            fixed_a, fixed_b = ~(self.ands[level][a] ^ self.ors[level][a]), ~(self.ands[level][b] ^ self.ors[level][b])
            apart = np.bitwise_count((self.ands[level][a] ^ self.ands[level][b]) & fixed_a & fixed_b)
            near = apart <= bound
            a, b = a[near], b[near]
            if not len(a):
                continue
            if level == 0:
                different = a != b
                yield a[different], b[different]
                continue
            spread = np.bitwise_count((self.ors[level][a] | self.ors[level][b]) ^ (self.ands[level][a] & self.ands[level][b]))
            whole = spread <= bound
            for node in (a[whole], b[whole]):
                low, high = self.leaf_spans(level, node)
                n = high - low
                yield np.repeat(low, n), np.concatenate([np.arange(s, e) for s, e in zip(low.tolist(), high.tolist())] or [np.zeros(0, dtype=np.int64)])
            yield self.first_leaf(level, a[whole]), self.first_leaf(level, b[whole])
            a, b = a[~whole], b[~whole]
            step = 4096
            for at in range(0, len(a), step):
                x, y = a[at : at + step], b[at : at + step]
                nx, ny = self.count[level][x], self.count[level][y]
                i, j = np.divmod(np.arange(FAN * FAN), FAN)
                real = (i < nx[:, None]) & (j < ny[:, None]) & ((x != y)[:, None] | (i <= j))
                left, right = (self.child[level][x][:, None] + i)[real], (self.child[level][y][:, None] + j)[real]
                stack.append((level - 1, left, right))


def index_links(bucket: np.ndarray, fp: np.ndarray, bound: int = BOUND) -> tuple[np.ndarray, np.ndarray]:
    """Edges, as pairs of fingerprints, that connect what is linked in each bucket
    (a forest: fewer edges than fingerprints)."""
    order = np.lexsort((gray_rank(fp), bucket))
    bucket, fp = bucket[order], fp[order]
    label = np.arange(len(fp))
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def settle() -> None:
        nonlocal label, held, size
        u = np.concatenate([label, *(x for x, _ in held)])
        v = np.concatenate([np.arange(len(fp)), *(y for _, y in held)])
        label, held, size = least_labels(len(fp), u, v), [], 0

    for u, v in GrayIndex(bucket, fp).links(bound):
        held.append((u, v))
        size += len(u)
        if size > 1_000_000:
            settle()
    settle()
    linked = np.flatnonzero(label != np.arange(len(fp)))
    return fp[linked], fp[label[linked]]


def link_fingerprints(fps: DataFrame, bound: int = BOUND) -> DataFrame:
    """Edges (u, v) over the distinct fingerprints ``fp``, enough of them that
    the connected sets are those of all links."""
    spark = fps.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def masks(depth: int) -> list[int]:
        """One for each path through the bands of ``depth`` levels."""
        paths: list[tuple[int, list[int]]] = [(0, list(range(64)))]
        for _ in range(depth):
            paths = [(_mask(own), [b for b in rest if b not in set(own)]) for _, rest in paths for own in bands(rest, bound + 1)]
        return [m for m, _ in paths]

    def deal(df: DataFrame, depth: int) -> DataFrame:
        """Each row once under every band of the bits that its bucket doesn't fix."""
        out = df.select("fp", "bucket", "path", F.explode(F.lit(list(range(bound + 1)))).alias("k")).withColumn("path", F.col("path") * (bound + 1) + F.col("k"))
        mask = F.element_at(F.array(*map(F.lit, masks(depth))), F.col("path") + 1)
        return out.select("fp", "path", F.xxhash64("bucket", "path", F.col("fp").bitwiseAND(mask)).alias("bucket"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # whole buckets, some at a time; rows come sorted by bucket
        held: list[pa.RecordBatch] = []
        rows = 0

        def solve(table: pa.Table) -> pa.RecordBatch:
            fp = table.column("fp").to_numpy().view(np.uint64)
            u, v = index_links(table.column("bucket").to_numpy(), fp, bound)
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= 400_000 and batch.column(0)[-1] != held[0].column(0)[0]:
                table = pa.Table.from_batches(held)
                bucket = table.column("bucket").to_numpy()
                cut = int(np.searchsorted(bucket, bucket[-1]))  # the last bucket may go on
                if cut:
                    yield solve(table.slice(0, cut))
                held, rows = table.slice(cut).combine_chunks().to_batches(), table.num_rows - cut
        if rows:
            yield solve(pa.Table.from_batches(held))

    rows = fps.select("fp", F.lit(0).cast("long").alias("bucket"), F.lit(0).alias("path"))
    ready: list[DataFrame] = []
    for depth in range(1, LEVELS + 1):
        rows = deal(rows, depth)
        if depth == LEVELS:
            break
        crowded = materialise(rows.groupBy("bucket").count().where(F.col("count") > CROWD).select("bucket"), "simhash-crowded")
        if crowded.isEmpty():
            break
        ready.append(rows.join(crowded, "bucket", "left_anti"))
        rows = rows.join(crowded, "bucket", "left_semi")
    for calm in ready:
        rows = rows.unionByName(calm)
    work = rows.select("bucket", "fp").repartition(parts, "bucket").sortWithinPartitions("bucket")
    return work.mapInArrow(run, "u long, v long").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row.

    component_id is the least doc_id that is reachable over links of BOUND bits
    or fewer, itself included.  Null and empty texts have fingerprint zero and
    link like any other.  A row of null doc_id links too but names no component;
    where all rows of one are null it is null.  Equal rows each get a row, an
    empty table gives an empty one, other columns aren't read.

    Equal fingerprints are one node from the start, so a group of copies costs
    one; what is collected nowhere is fingerprints, links or components.
    """
    rows = materialise(fingerprints(docs), "simhash-rows")
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = components(link_fingerprints(nodes.select("fp"))).withColumnRenamed("node", "fp")
    named = nodes.join(found, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    # written, so that the join reads two plain shuffles and AQE may split a component of many fingerprints
    names = materialise(named.groupBy("component").agg(F.min("least").alias("component_id")), "simhash-names")
    named = named.join(names, "component").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each group of near-duplicates stays, all columns: that of the
    least doc_id; of rows of the group that share it, one.  Null and empty texts are
    copies of one another; an empty table gives an empty one.  Rows without a doc_id
    stay where their group has none at all, one for each fingerprint.

    Only rows whose doc_id has lost a row, is null or stands twice are fingerprinted
    again and move; the others stay where they are read.  Whole texts of any length are
    fingerprinted; columns may have any names: rows are carried as one struct."""
    found = materialise(near_duplicates(docs), "simhash-found")
    stays = F.col("doc_id").eqNullSafe(F.col("component_id"))
    doubtful = found.groupBy("doc_id").agg(F.count("*").alias("n"), F.min(stays).alias("all_stay")).where("doc_id is null or n > 1 or not all_stay")
    near, far = touched(docs.select("doc_id", "text", in_struct(docs).alias("row")), doubtful, "doc_id")
    named = extend_rows(near, fingerprint_column, T.StructField("fp", T.LongType()))
    kept = found.where(stays).select(F.col("doc_id").alias("id"), F.col("fingerprint").alias("hex")).distinct()
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    order = Window.partitionBy("doc_id", F.when(F.col("doc_id").isNull(), F.col("fp"))).orderBy("fp", "text")
    chosen = named.join(kept, (hexed == F.col("hex")) & F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
    chosen = chosen.withColumn("place", F.row_number().over(order)).where("place = 1")
    return far.select(*out_of_struct(docs)).unionByName(chosen.select(*out_of_struct(docs)))
