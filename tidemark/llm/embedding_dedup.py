"""Embedding near-duplicates as an exact metric range join.

Cosine c of two unit vectors is distance sqrt(2 - 2c), so links are pairs
within radius r = sqrt(2 - 2 * 0.98).  Pivots split each label's vectors into cells: a
vector's home is its nearest pivot.  If u lies within r of v and has pivot p
for its home, the triangle inequality gives d(v, p) <= d(v, home) + 2r; v is
replicated to those cells, where every neighbour of a cell's home vectors is
then found without looking elsewhere.  A cell that is still large is split again
by pivots of its own, as often as that parts it.  Cells are joined independently, in
blocks of home vectors and members of bounded size.  Links are verified by cosine.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialise
from tidemark.llm.components import components
from tidemark.llm.simhash import least_labels

#: Pivots of all labels together, at most; they are rows of the least hashes.
PIVOTS = 512
#: Vectors of a label for which it gets one pivot more.
CELL = 1500
#: Home vectors of a cell that one task joins.
SLICE = 2000
#: Members of a cell that one task joins; a cell of more has as many home vectors in a slice too.
MEMBERS = 8000
#: A cell of more home vectors is split again, into FAN cells at most, by tasks of CHUNK members.
SPLIT, FAN, CHUNK = 8000, 64, 8192
#: How often, so that the numbers of cells fit 64 bits.
LEVELS = 8
#: A split has to save half of the comparisons, and makes so many copies of a member at most.
GAIN, COPIES = 0.5, 4
#: Comparisons that a task holds at a time.
HELD = 1 << 20
KEYS = ["label", "dim", "level", "cell"]


def _vectors(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _unit(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    x = x / scale
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def can_link():
    """Whether a row can link: label and vector not null, components finite, not all zero."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col("label").isNotNull() & fine & F.exists("embedding", lambda x: x != 0), F.lit(False))


def choose_pivots(classes: DataFrame) -> dict[tuple, np.ndarray]:
    """Pivots of each (label, dimension): a bounded set of vectors, whatever the input."""
    sizes = classes.groupBy("label", "dim").count().orderBy(F.desc("count")).limit(PIVOTS // 2).collect()
    total = sum(r["count"] for r in sizes)
    asked = {(r.label, r.dim): max(1, min(math.ceil(r["count"] / CELL), PIVOTS * r["count"] // (2 * total) or 1)) for r in sizes}
    spark = classes.sparkSession
    if not asked:
        return {}
    wanted = F.broadcast(spark.createDataFrame([(a, b, n) for (a, b), n in asked.items()], "label string, dim int, n int"))
    # the k-th of n hash ranges gives its least hash: an aggregation, not a sort of a label's vectors
    slot = F.expr("pmod(shiftright(h, 8), n)")
    picked = classes.join(wanted, ["label", "dim"]).withColumn("slot", slot).groupBy("label", "dim", "slot").agg(F.min_by("embedding", "h").alias("embedding"))
    out: dict[tuple, list] = {}
    for r in picked.collect():
        out.setdefault((r.label, r.dim), []).append(r.embedding)
    return {k: _unit(np.array(sorted(v), dtype=np.float64)) for k, v in out.items()}


def _reach(x: np.ndarray, pivots: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest pivot of each vector, and the (vector, pivot) pairs whose cell it goes to."""
    far = np.sqrt(np.maximum(0, 2 - 2 * x @ pivots.T))
    return far.argmin(axis=1), *np.nonzero(far <= far.min(axis=1, keepdims=True) + 2 * radius + 1e-9)


def cells(classes: DataFrame, pivots: dict[tuple, np.ndarray], radius: float) -> DataFrame:
    """A row for each vector and cell: its home, and the cells that its neighbours may call home."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, dim = batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
            take, cell, home = [], [], []
            for key in sorted(set(zip(label.tolist(), dim.tolist()))):
                own = np.flatnonzero((label == key[0]) & (dim == key[1]))
                if key not in pivots:  # a label beyond the pivots' number is one cell
                    take.append(own), cell.append(np.zeros(len(own), dtype=np.int64)), home.append(np.ones(len(own), dtype=bool))
                    continue
                nearest, i, c = _reach(_unit(_vectors(batch.column(3).take(pa.array(own)))), pivots[key], radius)
                take.append(own[i]), cell.append(c), home.append(nearest[i] == c)
            if take:
                rows = np.concatenate(take)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows)), batch.column(1).take(pa.array(rows)), batch.column(2).take(pa.array(rows)), pa.array(np.concatenate(cell)), pa.array(np.concatenate(home)), batch.column(3).take(pa.array(rows)), batch.column(4).take(pa.array(rows))],
                    names=["class_id", "label", "dim", "cell", "home", "embedding", "copies"],
                )

    kind = classes.schema["embedding"].dataType.simpleString()
    dealt = classes.select("class_id", "label", "dim", "embedding", "copies").mapInArrow(run, f"class_id long, label string, dim int, cell long, home boolean, embedding {kind}, copies long")
    return dealt.select("class_id", "label", "dim", F.lit(0).alias("level"), "cell", "home", "embedding", "copies")


def split_cells(dealt: DataFrame, radius: float) -> DataFrame:
    """``dealt`` with its large cells split by pivots of their own.

    What holds for pivots of a label holds for those of a cell: a neighbour of one of
    its home vectors is a member, and goes to the home vector's new cell.  Pivots meet
    the members in tasks of CHUNK; the driver sees no vector.  A cell that a sample of CHUNK
    shows not to part stays whole."""
    done = []
    kind = dealt.schema["embedding"].dataType.simpleString()
    for level in range(LEVELS):
        sizes = dealt.groupBy(*KEYS).agg(F.sum(F.col("home").cast("long")).alias("homes"), F.count("*").alias("members")).where(F.col("homes") > SPLIT)
        sizes = sizes.withColumn("n", F.least(F.lit(FAN), F.greatest(F.lit(2), F.ceil(F.col("homes") / CELL))).cast("int")).withColumn("chunks", F.ceil(F.col("members") / CHUNK).cast("int"))
        sizes = materialise(sizes, "embedding-sizes")
        if sizes.isEmpty():
            break
        rows = dealt.join(sizes, KEYS).withColumn("h", F.xxhash64("embedding", F.lit(level)))
        picked = rows.where("home").withColumn("slot", F.expr("pmod(shiftright(h, 8), n)")).groupBy(*KEYS, "slot").agg(F.min_by("embedding", "h").alias("embedding"), F.first("chunks").alias("chunks"))
        picked = materialise(picked.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(*KEYS, "chunk", "slot", "embedding"), "embedding-pivots")
        rows = rows.withColumn("chunk", F.expr("int(pmod(xxhash64(class_id), chunks))")).select("class_id", *KEYS, "chunk", "home", "embedding", "copies")

        def reach(members: pa.Table, pivots: pa.Table) -> tuple:
            if not members.num_rows or not pivots.num_rows:
                return (np.zeros(0, dtype=np.int64),) * 3
            pivots = pivots.sort_by("slot")
            return _reach(_unit(_vectors(members.column("embedding"))), _unit(_vectors(pivots.column("embedding"))), radius)

        def measure(members: pa.Table, pivots: pa.Table) -> pa.Table:
            """Shares of the comparisons and copies of members that a split would leave."""
            nearest, i, c = reach(members, pivots)
            home = members.column("home").to_numpy(zero_copy_only=False).astype(bool)
            homes = np.bincount(nearest[home], minlength=FAN)
            each = np.bincount(c, minlength=FAN)
            many = max(1, len(home))
            first = (members if members.num_rows else pivots).select(KEYS).slice(0, 1)
            return first.append_column("gain", pa.array([float(homes @ each) / max(1, int(home.sum()) * many)])).append_column("copied", pa.array([len(i) / many]))

        def deal(members: pa.Table, pivots: pa.Table) -> pa.Table:
            nearest, i, c = reach(members, pivots)
            out = members.take(pa.array(i))
            home = out.column("home").to_numpy(zero_copy_only=False).astype(bool) & (nearest[i] == c)
            cell = out.column("cell").to_numpy() * FAN + c
            return pa.table([*(out.column(k) for k in ("class_id", "label", "dim")), pa.array(out.column("level").to_numpy() + 1, pa.int32()), pa.array(cell), pa.array(home), out.column("embedding"), out.column("copies")], names=["class_id", *KEYS, "home", "embedding", "copies"])

        meet = lambda a, b: a.groupBy(*KEYS, "chunk").cogroup(b.groupBy(*KEYS, "chunk"))
        tried = meet(rows.where("chunk = 0"), picked.where("chunk = 0")).applyInArrow(measure, "label string, dim int, level int, cell long, gain double, copied double")
        parting = materialise(tried.where((F.col("gain") <= GAIN) & (F.col("copied") <= COPIES)).select(*KEYS), "embedding-parting")
        if parting.isEmpty():
            break
        done.append(dealt.join(parting, KEYS, "left_anti"))
        new = meet(rows.join(parting, KEYS, "left_semi"), picked.join(parting, KEYS, "left_semi")).applyInArrow(deal, f"class_id long, label string, dim int, level int, cell long, home boolean, embedding {kind}, copies long")
        dealt = materialise(new, "embedding-cells")
    for part in done:
        dealt = dealt.unionByName(part)
    return dealt


def blocks(dealt: DataFrame) -> DataFrame:
    """Each cell as a grid of blocks: a slice of its home vectors by a part of its
    members.  A row goes once to each block that has it as either."""
    sizes = dealt.groupBy(*KEYS).agg(F.sum(F.col("home").cast("long")).alias("homes"), F.count("*").alias("members")).where("homes > 0")
    sizes = sizes.withColumn("slices", F.ceil(F.col("homes") / F.when(F.col("members") > MEMBERS, MEMBERS).otherwise(SLICE))).withColumn("parts", F.ceil(F.col("members") / MEMBERS))
    spread = dealt.join(sizes.drop("homes", "members"), KEYS).withColumn("slice", F.expr("pmod(xxhash64(class_id), slices)")).withColumn("part", F.expr("pmod(xxhash64(class_id, 1), parts)"))
    own = F.when(F.col("home"), F.expr("transform(sequence(0L, parts - 1), p -> slice * parts + p)")).otherwise(F.expr("array_repeat(0L, 0)"))
    spread = spread.withColumn("block", F.explode(F.array_union(own, F.expr("transform(sequence(0L, slices - 1), s -> s * parts + part)"))))
    home, member = F.col("home") & (F.expr("block div parts") == F.col("slice")), F.col("block") % F.col("parts") == F.col("part")
    return spread.select(*KEYS, "block", "class_id", home.alias("home"), member.alias("member"), "embedding", "copies")


def join_cell(table: pa.Table, threshold: float) -> pa.Table:
    """class_id, linked copies and a linked class for the rows of a block that have links.

    Pairs are folded into counts and labels as they are found."""
    ids = table.column("class_id").to_numpy()
    x = _unit(_vectors(table.column("embedding")))
    copies = table.column("copies").to_numpy()
    home = np.flatnonzero(table.column("home").to_numpy(zero_copy_only=False))
    member = np.flatnonzero(table.column("member").to_numpy(zero_copy_only=False))
    count, label = np.zeros(len(ids), dtype=np.int64), np.arange(len(ids))
    others = x[member]
    step = max(1, HELD // max(1, len(member)))
    for at in range(0, len(home), step):
        own = home[at : at + step]
        dots = x[own] @ others.T
        i, j = np.nonzero(dots >= threshold - 1e-9)
        # products of matrices may round otherwise: what is near the threshold is summed anew
        sure = dots[i, j] >= threshold + 1e-9
        for k in np.array_split(np.flatnonzero(~sure), range(HELD // 64, int((~sure).sum()), HELD // 64)):
            sure[k] = (x[own[i[k]]] * others[j[k]]).sum(axis=1) >= threshold
        sure &= own[i] != member[j]
        u, v = own[i[sure]], member[j[sure]]
        count += np.bincount(u, weights=copies[v], minlength=len(ids)).astype(np.int64)
        if len(u):
            old = np.arange(len(ids))
            label = least_labels(len(ids), np.concatenate([old, u]), np.concatenate([label, v]))
    linked = np.flatnonzero((count > 0) | (label != np.arange(len(ids))))
    return pa.table({"u": ids[linked], "n": count[linked], "v": ids[label[linked]]})


def near_duplicates(vectors: DataFrame, threshold: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``vectors``
    (vec_id, embedding, label).

    Labels of any type are compared by their text.  Vectors of one label link when their cosine, in double precision, is
    ``threshold`` or more.  Rows that are null, zero, not finite or without a
    label link with nothing: n_links 0, component_id their own vec_id.
    n_links counts the other rows linked directly, component_id is the least
    vec_id reachable.  Vectors of different lengths don't link.  Equal vectors are
    one class and linked through it; rows that repeat a vec_id count as rows.
    A null vec_id links but names no component.  An empty table gives an empty one.
    """
    rows = vectors.select("vec_id", F.col("label").cast("string").alias("label"), "embedding")
    good = rows.where(can_link())
    classes = good.groupBy("label", "embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    classes = classes.withColumn("h", F.xxhash64("label", "embedding")).withColumn("dim", F.size("embedding"))
    classes = materialise(classes.withColumn("class_id", F.monotonically_increasing_id()), "embedding-classes")
    radius = math.sqrt(2 - 2 * threshold)
    dealt = split_cells(materialise(cells(classes, choose_pivots(classes), radius), "embedding-cells"), radius)
    found = blocks(dealt).groupBy(*KEYS, "block").applyInArrow(lambda t: join_cell(t, threshold), "u long, n long, v long")
    found = materialise(found, "embedding-links")
    links = found.groupBy(F.col("u").alias("class_id")).agg(F.sum("n").alias("others"))
    joined = components(found.select("u", "v")).withColumnRenamed("node", "class_id")
    named = classes.select("class_id", "label", "embedding", "least", "copies").join(links, "class_id", "left").join(joined, "class_id", "left").withColumn("component", F.coalesce("component", "class_id"))
    # written, so that the join reads two plain shuffles and AQE may split a component of many classes
    least = materialise(named.groupBy("component").agg(F.min("least").alias("component_id")), "embedding-names")
    named = named.join(least, "component").select("label", "embedding", "component_id", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    linked = good.join(named, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    rest = rows.where(~can_link()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(rest).select("vec_id", "n_links", "component_id", F.expr("vec_id <=> component_id").alias("kept"))
