"""Hard negatives by threshold joins over an inverted index, in the manner of L2AP.

Rows and anchors meet in blocks.  In a block the dimensions are ordered by their
energy, light ones first.  A row's leading dimensions aren't indexed as long as their norm
times the anchor's is below every threshold of the block: what has only these in common
with an anchor can't reach it.  An anchor goes through the lists of the
indexed dimensions from the heaviest on, adds up partial scores, and drops the rows whose
score so far and the product of the remaining norms don't reach the threshold.  What
survives is scored in whole.

Thresholds begin high and are lowered, round by round and for those anchors only whose
windows aren't full.  Where a bounded sample holds enough positives of an anchor, its
last threshold is one that surely fills the window; what begins higher only saves
work.  A window's last threshold is its lower end.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialise

#: Components of rows and of anchors that a block holds, about.
ROW_CELLS, ANCHOR_CELLS = 1 << 20, 1 << 18
#: Rows of a block at least, where more blocks would keep more cores busy.
LEAST_ROWS = 1024
#: Rows of the sample that thresholds begin with, about.
SAMPLE = 4096
#: Dimensions that are added up before rows are dropped.
STEP = 8
#: How far a window's threshold falls, round by round, as a part of the window.
FALLS = (0.1, 0.4, 1.0)
#: A threshold that everything reaches.
ALL = -(1 << 62)
#: Vectors of at least this norm could have inner products beyond 64 bits.
MOST_NORM = float(1 << 31)


def quantised(vectors: DataFrame, scale: int = 256, label: Column | None = None) -> DataFrame:
    """vec_id, label (as text) and v: floor(scale * component) of the rows of ``vectors`` (vec_id, embedding, label) that take part.

    Those are the rows whose id, label and vector aren't null, whose components are neither null nor
    infinite nor NaN, and whose norm, scaled, is below 2^31, so that inner products fit 64 bits.
    Of rows that repeat a vec_id the one of the least label and vector stays."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    own = vectors.select("vec_id", "embedding", (F.col("label") if label is None else label).cast("string").alias("label"))
    own = own.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(fine, F.lit(False)))
    own = own.withColumn("x", F.transform("embedding", lambda x: x.cast("double") * scale))
    own = own.where(F.aggregate("x", F.lit(0.0), lambda s, x: s + x * x) < MOST_NORM**2)
    rows = own.select("vec_id", "label", F.transform("x", lambda x: F.floor(x)).alias("v"))
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("row")).select("vec_id", "row.label", "row.v")


class BlockIndex:
    """Inverted lists of a block's rows, without what ``least`` covers: the lowest threshold over an anchor's norm."""

    def __init__(self, x: np.ndarray, least: float):
        square = x.astype(np.float64) ** 2
        self.order = np.argsort(square.sum(axis=0), kind="stable")
        norms = np.sqrt(np.cumsum(square[:, self.order], axis=1))
        # what is left before each step; dimensions are left out by whole steps
        self.edges = list(range(0, x.shape[1], STEP))
        before = np.concatenate([np.zeros((len(x), 1)), norms[:, [e - 1 for e in self.edges[1:]]]], axis=1) if x.shape[1] else np.zeros((len(x), 0))
        whole = norms[:, -1] if x.shape[1] else np.zeros(len(x))
        slack = least * (1 - 1e-9)
        left_out = (np.concatenate([before[:, 1:], whole[:, None]], axis=1) < slack).sum(axis=1) if x.shape[1] else np.zeros(len(x), dtype=np.int64)
        self.rows = np.argsort(left_out, kind="stable")
        self.left_out = left_out[self.rows]
        self.x, self.before = x[self.rows][:, self.order], before[self.rows]

    def find(self, q: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
        """The rows that score ``threshold`` or more with ``q``, and their scores."""
        q = q[self.order]
        square = np.sqrt(np.concatenate([[0.0], np.cumsum(q.astype(np.float64) ** 2)]))
        rest = square[self.edges]  # the anchor's norm before each step
        bar = threshold - 1e-6 * abs(threshold) - 1
        live, score = None, None
        if threshold > ALL:
            live = np.arange(int(np.searchsorted(self.left_out, len(self.edges) - 1, side="right")) if self.edges else len(self.x))
            score = np.zeros(len(live), dtype=self.x.dtype)
            for step in range(len(self.edges) - 1, -1, -1):
                own = int(np.searchsorted(self.left_out[live], step, side="right"))  # rows whose list goes on
                part = slice(self.edges[step], self.edges[step] + STEP)
                score[:own] += (self.x[:own, part] if own and live[own - 1] == own - 1 else self.x[live[:own], part]) @ q[part]
                # what is left of a row is what stands before this step, or before where its list ends
                at = np.maximum(self.left_out[live], step)
                keep = score + rest[at] * self.before[live, at] * (1 + 1e-9) >= bar
                live, score = live[keep], score[keep]
        found = self.x if live is None else self.x[live]
        exact = (found @ q).astype(np.int64)
        good = exact >= threshold
        return self.rows[good if live is None else live[good]], exact[good]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) and len(column.flatten()) else np.zeros((len(column), 0), np.int64)


def _exact_kind(x: np.ndarray, q: np.ndarray) -> type:
    """Sums of doubles are exact below 2^53."""
    most = [np.sqrt((m.astype(np.float64) ** 2).sum(axis=1).max(initial=0.0)) for m in (x, q)]
    return np.float64 if most[0] * most[1] < 1 << 52 else np.int64


def _best(scores: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:n]


def _least(q: np.ndarray, thresholds: np.ndarray) -> float:
    """The lowest threshold over a norm: what is below it can't be reached by any anchor."""
    norm = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))
    return float(np.where(norm > 0, thresholds / np.maximum(norm, 1e-300), np.where(thresholds > 0, np.inf, -1.0)).min(initial=np.inf))


def join_positives(rows: pa.Table, anchors: pa.Table, n: int) -> pa.Table:
    """The first ``n`` rows of a block of each anchor's label that reach its threshold."""
    out: list[list] = [[], [], []]
    x, q = _matrix(rows.column("v")), _matrix(anchors.column("v"))
    kind = _exact_kind(x, q)
    ids, labels = rows.column("vec_id").to_numpy(), np.array(rows.column("label").to_pylist(), dtype=object)
    a_ids, a_labels, bars = anchors.column("vec_id").to_numpy(), np.array(anchors.column("label").to_pylist(), dtype=object), anchors.column("bar").to_numpy()
    for label in sorted(set(a_labels)):
        mine, own = np.flatnonzero(a_labels == label), np.flatnonzero(labels == label)
        if not own.size:
            continue
        index = BlockIndex(x[own].astype(kind), _least(q[mine], bars[mine]))
        for k in mine.tolist():
            at, score = index.find(q[k].astype(kind), int(bars[k]))
            at = own[at]
            other = ids[at] != a_ids[k]
            at, score = at[other], score[other]
            best = _best(score, ids[at], n)
            out[0].append(np.full(len(best), a_ids[k])), out[1].append(ids[at[best]]), out[2].append(score[best])
    done = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in out]
    return pa.table(dict(zip(("anchor_id", "positive_id", "positive_score"), done)))


def join_negatives(rows: pa.Table, anchors: pa.Table, n: int) -> pa.Table:
    """The first ``n`` rows of a block of other labels in each of an anchor's windows, as far down as their thresholds."""
    out: list[list] = [[], [], [], []]
    x, q = _matrix(rows.column("v")), _matrix(anchors.column("v"))
    kind = _exact_kind(x, q)
    ids, labels = rows.column("vec_id").to_numpy(), np.array(rows.column("label").to_pylist(), dtype=object)
    a_ids, a_labels, windows = anchors.column("vec_id").to_numpy(), anchors.column("label").to_pylist(), anchors.column("windows").to_pylist()
    bars = np.array([min(w["bar"] for w in own) for own in windows], dtype=np.int64)
    index = BlockIndex(x.astype(kind), _least(q, bars))
    for k, own in enumerate(windows):
        at, score = index.find(q[k].astype(kind), int(bars[k]))
        other = labels[at] != a_labels[k]
        at, score = at[other], score[other]
        for w in own:
            inside = np.flatnonzero((score <= w["upper"]) & (score >= w["bar"]))
            best = inside[_best(score[inside], ids[at[inside]], n)]
            for column, values in zip(out, (np.full(len(best), a_ids[k]), np.full(len(best), w["positive_id"]), ids[at[best]], score[best])):
                column.append(values)
    done = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in out]
    return pa.table(dict(zip(("anchor_id", "positive_id", "negative_id", "negative_score"), done)))


def meet(rows: DataFrame, anchors: DataFrame, cells: tuple[int, int], work, schema: str) -> DataFrame:
    """``work`` on every block of ``rows`` with every block of ``anchors`` of the same dimension."""
    n_rows, n_anchors = cells
    place = lambda n: F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(n)).cast("int")
    other = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.select("*", F.size("v").alias("dim"), place(n_rows).alias("part")).withColumn("share", other(n_anchors))
    # columns of their own, as anchors are rows too
    right = anchors.select(*(F.col(c).alias(c) for c in anchors.columns), F.size("v").alias("dim"), place(n_anchors).alias("share")).withColumn("part", other(n_rows))

    nothing = pa.schema([(f.split()[0], pa.int64()) for f in schema.split(", ")]).empty_table()

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        return work(a, b) if a.num_rows and b.num_rows else nothing

    keys = ["dim", "part", "share"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, schema)


def first(found: DataFrame, keys: list[str], score: str, row_id: str, n: int) -> DataFrame:
    """The first ``n`` of each key with their ``rank``: by score, ties by id."""
    order = Window.partitionBy(*keys).orderBy(F.desc(score), row_id)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def _blocks(frame: DataFrame, cells: int, cores: int) -> tuple[int, int]:
    n, total = frame.agg(F.count("*"), F.coalesce(F.sum(F.size("v")), F.lit(0))).first()
    return n, max(1, math.ceil(total / cells), min(cores, math.ceil(n / LEAST_ROWS)))


def begin(rows: DataFrame, anchors: DataFrame, n: int, n_rows: int, cells: int) -> DataFrame:
    """``anchors`` with ``sure``, the score of their n-th positive in a sample (null: it has fewer), and
    ``high``, that of about the 2n-th of all rows if scores went on to fall as they do there."""
    share = max(1, n_rows // SAMPLE)
    sample = rows.where(F.pmod(F.xxhash64("vec_id", F.lit(11)), F.lit(share)) == 0)
    found = meet(sample, anchors.withColumn("bar", F.lit(ALL)), (1, cells), lambda a, b: join_positives(a, b, n), "anchor_id long, positive_id long, positive_score long")
    best = found.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.count("*").alias("n"), F.min("positive_score").alias("least"), F.max("positive_score").alias("most"))
    best = best.where(F.col("n") >= n)
    grow = max(0.0, math.log(share / 2)) / math.log(n) if n > 1 else 0.0
    high = F.col("least") + F.floor((F.col("most") - F.col("least")) * grow).cast("long")
    return anchors.join(best.select("vec_id", F.col("least").alias("sure"), high.alias("high")), "vec_id", "left")


def find_positives(rows: DataFrame, anchors: DataFrame, n: int) -> DataFrame:
    """anchor_id, positive_id and positive_score: each anchor's first ``n`` other rows of its label, all of them if they are fewer."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    (n_rows, parts), (_, shares) = _blocks(rows, ROW_CELLS, cores), _blocks(anchors, ANCHOR_CELLS, 1)
    todo = materialise(begin(rows, anchors, n, n_rows, shares), "negatives-anchors")
    done = None
    for fall in (0.0, 0.5, 1.0):
        bar = F.col("high") - F.floor((F.col("high") - F.col("sure")) * fall).cast("long")
        bar = F.when(F.col("sure").isNull(), F.lit(ALL)).otherwise(bar if fall < 1 else F.col("sure"))
        found = meet(rows, todo.withColumn("bar", bar), (parts, shares), lambda a, b: join_positives(a, b, n), "anchor_id long, positive_id long, positive_score long")
        found = materialise(first(found, ["anchor_id"], "positive_score", "positive_id", n), "negatives-positives")
        full = found.groupBy("anchor_id").count().where(F.col("count") >= n).select(F.col("anchor_id").alias("vec_id"))
        over = todo.join(full, "vec_id", "left_anti").where(F.col("sure").isNotNull() & (bar > F.col("sure")))
        todo = materialise(over, "negatives-anchors")
        kept = found.join(todo.select(F.col("vec_id").alias("anchor_id")), "anchor_id", "left_anti").drop("rank")
        done = kept if done is None else done.unionByName(kept)
        if todo.isEmpty():
            break
    return done


def find_negatives(rows: DataFrame, anchors: DataFrame, positives: DataFrame, n: int, low: int, high: int) -> DataFrame:
    """For each anchor and positive the first ``n`` rows of another label that score from ``low`` to ``high`` percent of the positive."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    (_, parts), (_, shares) = _blocks(rows, ROW_CELLS, cores), _blocks(anchors, ANCHOR_CELLS, 1)
    wide = F.col("positive_score").cast("decimal(20,0)")
    todo = positives.where(F.col("positive_score") >= 0).withColumn("lower", F.ceil(wide * low / 100).cast("long")).withColumn("upper", F.floor(wide * high / 100).cast("long"))
    todo = materialise(todo.where(F.col("lower") <= F.col("upper")), "negatives-windows")
    done = None
    for fall in FALLS:
        bar = F.col("upper") - F.floor((F.col("upper") - F.col("lower")) * fall).cast("long") if fall < 1 else F.col("lower")
        windows = todo.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list(F.struct("positive_id", "upper", bar.alias("bar"))).alias("windows"))
        found = meet(rows, anchors.join(windows, "vec_id"), (parts, shares), lambda a, b: join_negatives(a, b, n), "anchor_id long, positive_id long, negative_id long, negative_score long")
        found = materialise(first(found, ["anchor_id", "positive_id"], "negative_score", "negative_id", n), "negatives-found")
        full = found.groupBy("anchor_id", "positive_id").count().where(F.col("count") >= n)
        over = todo.where(bar > F.col("lower")).join(full, ["anchor_id", "positive_id"], "left_anti")
        left = materialise(over, "negatives-windows")
        scored = found.join(positives, ["anchor_id", "positive_id"]).join(left.select("anchor_id", "positive_id"), ["anchor_id", "positive_id"], "left_anti")
        done, todo = scored if done is None else done.unionByName(scored), left
        if todo.isEmpty():
            break
    return done


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    ``rows`` (vec_id, label, v) are whole-numbered vectors of norms below 2^31, as quantised() makes them; those of
    different lengths don't meet.  A row's score is its inner product with the anchor, higher ones come
    first, ties by the smaller vec_id.  Positives are an anchor's first ``positives`` other rows of
    its label, all of them if they are fewer.  For each of them the first ``negatives`` rows of
    another label that score from ``low`` to ``high`` percent of its score, 0 <= low <= high, are
    returned, with their ranks from 1; an anchor or positive without any has no row.  A
    positive of a negative score has an empty window.  Empty vectors score 0 with each other.  An
    empty table gives an empty one.
    """
    rows = materialise(rows.select("vec_id", "label", "v"), "negatives-rows")
    anchors = rows.where(is_anchor)
    found = find_positives(rows, anchors, positives)
    found = materialise(found, "negatives-positives")
    done = find_negatives(rows, anchors, found, negatives, low, high)
    return done.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
