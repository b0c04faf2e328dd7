"""Packing documents into fixed windows by order-preserving dynamic programming.

The documents of a partition form one stream of ids.  Windows are consecutive
stretches of it, cut at document or sentence ends (or, inside a sentence of
over ``STRIDE`` ids, every ``STRIDE`` ids).  The cuts minimise padding plus a
penalty for each document that a cut truncates:

    best[j] = penalty[j] + (room - at[j]) + min(best[i] + at[i])

over cuts i at most ``room`` ids before j, where a monotone queue holds the
minimum.  Long streams are solved in stretches.  At a stretch's end the best
ways to all places where the next window may begin are followed back to the last
cut that they share: it belongs to the best cuts of the whole stream, whatever
follows, so all up to there is settled and the rest is carried into the next
stretch.  Memory grows with the distance to that cut, not with the partition.
"""

from __future__ import annotations

import heapq
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.llm.bpe import WordBPE, word_level
from tidemark.llm.common import slices

#: Padding that a cut is worth: at a sentence's end, and inside a sentence.
SENTENCE_PENALTY, INSIDE_PENALTY = 2, 64
#: Ids after which a long sentence may be cut.
STRIDE = 256
#: Ids of a stretch that is solved at once.
STRETCH = 1 << 19
#: Id that ends a document.
END_ID = 1

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("start", T.LongType()),
    T.StructField("length", T.LongType()),
    T.StructField("ids_crc32", T.LongType()),
    T.StructField("doc_tokens", T.LongType()),
    T.StructField("sequence_id", T.LongType()),
    T.StructField("offset", T.LongType()),
])


def cut_points(ids: np.ndarray, doc_ends: np.ndarray, enders: np.ndarray, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
    """Places where the stream may be cut, from 0 to its end, and their penalties."""
    price = np.full(len(ids) + 1, INSIDE_PENALTY, dtype=np.int64)  # of a cut before each id, and at the end
    price[1:][enders[ids]] = SENTENCE_PENALTY
    price[doc_ends] = price[0] = 0
    at = np.flatnonzero(price < INSIDE_PENALTY)
    gaps = np.diff(at)
    wide = np.flatnonzero(gaps > stride)
    if len(wide):
        n = (gaps[wide] - 1) // stride
        inner = np.repeat(at[wide], n) + stride * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + 1)
        at = np.union1d(at, inner)
    return at, price[at]


def best_cuts(at: np.ndarray, penalty: np.ndarray, room: int, last: bool) -> list[int]:
    """Cuts from 0 to the end (``last``) of the least padding plus penalties; else
    those of them that are the same however the stream goes on."""
    places, costs = at.tolist(), (penalty + room - at).tolist()
    best, back = [0], [0]
    queue: deque[tuple[int, int]] = deque([(0, 0)])  # (best[i] + at[i], i), rising
    for j in range(1, len(places)):
        floor = places[j] - room
        while places[queue[0][1]] < floor:
            queue.popleft()
        low, i = queue[0]
        value = costs[j] + low
        best.append(value)
        back.append(i)
        value += places[j]
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, j))
    j = len(places) - 1
    if not last:
        # the next window begins at one of these; ways are followed from the latest of them on
        ways = {-i for i in range(int(np.searchsorted(at, at[-1] - room)), len(places))}
        heap = sorted(ways)
        while len(heap) > 1:
            way = -back[-heapq.heappop(heap)]
            if way not in ways:
                ways.add(way)
                heapq.heappush(heap, way)
        j = -heap[0]
    cuts = [j]
    while j:
        j = back[j]
        cuts.append(j)
    return [places[k] for k in reversed(cuts)]


class Packer:
    """Packs one partition's stream; documents go in, columns of pieces come out."""

    def __init__(self, coder: WordBPE, room: int, first_sequence: int):
        self.room, self.sequence = room, first_sequence
        self.enders = np.zeros(coder.size, dtype=bool)
        self.enders[[coder.vocab[m + coder.END] for m in ".!?"]] = True
        self.enders[END_ID] = False
        self.keys: list[object] = []  # doc_ids of the documents held
        # of each, its ids before the part that is held, the held ones, and all
        self.before, self.lengths, self.totals = [np.zeros(0, dtype=np.int64) for _ in range(3)]
        self.parts: list[np.ndarray] = []
        self.held, self.enough = 0, STRETCH

    def add(self, keys: list, ids: np.ndarray, counts: np.ndarray) -> bool:
        """Documents by their ids, without END_ID, one after the other; whether there is enough to solve."""
        totals = counts + 1
        ends = np.cumsum(totals)
        stream = np.full(len(ids) + len(counts), END_ID, dtype="<u4")
        inside = np.ones(len(stream), dtype=bool)
        inside[ends - 1] = False
        stream[inside] = ids
        self.keys += keys
        self.before = np.concatenate([self.before, np.zeros(len(keys), dtype=np.int64)])
        self.lengths, self.totals = np.concatenate([self.lengths, totals]), np.concatenate([self.totals, totals])
        self.parts.append(stream)
        self.held += len(stream)
        return self.held >= self.enough

    def solve(self, last: bool) -> dict[str, object]:
        stream = np.concatenate(self.parts)
        ends = np.cumsum(self.lengths)
        begins = ends - self.lengths
        cuts = np.array(best_cuts(*cut_points(stream, ends, self.enders, min(STRIDE, self.room)), self.room, last), dtype=np.int64)
        done = int(cuts[-1])
        # a piece runs from a cut or a document's begin to the next of either
        low = np.union1d(cuts[:-1], begins[begins < done])
        high = np.append(low[1:], done)
        owner, window = np.searchsorted(ends, low, side="right"), np.searchsorted(cuts, low, side="right") - 1
        raw = memoryview(stream.tobytes())
        rows = {
            "doc_id": [self.keys[k] for k in owner.tolist()],
            "start": self.before[owner] + low - begins[owner],
            "length": high - low,
            "ids_crc32": [zlib.crc32(raw[a:b]) for a, b in zip((4 * low).tolist(), (4 * high).tolist())],
            "doc_tokens": self.totals[owner],
            "sequence_id": self.sequence + window,
            "offset": low - cuts[window],
        }
        self.sequence += len(cuts) - 1
        first = int(np.searchsorted(ends, done, side="right"))
        self.keys, self.before, self.lengths, self.totals = self.keys[first:], self.before[first:], self.lengths[first:], self.totals[first:]
        if len(self.keys) and (inside := done - int(begins[first])) > 0:
            self.before[0] += inside
            self.lengths[0] -= inside
        self.parts, self.held = [stream[done:]], len(stream) - done
        self.enough = max(STRETCH, 2 * self.held)
        return rows


def pack(docs: DataFrame, vocabulary: str, room: int = 2048) -> DataFrame:
    """Packs all documents into sequences of at most ``room`` ids.

    Returns a row a piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset.  Every id of a document, and the END_ID after it, lies in
    exactly one piece.  Documents keep the order in which a scan partition holds
    them and are packed where they are read: no shuffle, and at most one ragged
    sequence a partition.  Sequence ids are the partition's number times 2^40
    plus a count; a lost task's sequences are made again as a whole.

    A null or empty text is a document of END_ID alone; a null doc_id is kept;
    rows of one doc_id are packed as documents of their own; an empty table
    gives an empty one.
    """
    source = docs.select("doc_id", "text")
    schema = T.StructType([source.schema["doc_id"], *SCHEMA.fields[1:]])
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_level(vocabulary)
        packer = Packer(coder, room, TaskContext.get().partitionId() << 40)
        out = lambda rows: pa.RecordBatch.from_pydict(rows, schema=target)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                keys = batch.column(0).slice(at, 4096).to_pylist()
                for first, texts in slices(batch.column(1).slice(at, 4096).to_pylist()):
                    if packer.add(keys[first : first + len(texts)], *coder.encode_many(texts)):
                        yield out(packer.solve(last=False))
        if packer.held:
            yield out(packer.solve(last=True))

    return source.mapInArrow(run, schema)
