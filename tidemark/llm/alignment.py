"""Alignment of two tokenizers over a corpus, each distinct text once.

Texts are shuffled whole, so that equal ones meet: one row a distinct text with the
number of its copies.  Only these are tokenised by both vocabularies and aligned: where
tokens of both end at the same byte a group ends, and tokens whose byte ranges overlap are
linked.  How many documents hold an id pair linked is counted over distinct texts,
weighted by their copies, and pre-aggregated in every task.  A text keeps its own pairs in
packed form, meets the count table in slices of bounded size, and the measures are joined
back to the doc_ids by the text's digest.

Neither vocabulary has a token over the start of a word, so both cut a text before a
single space between two visible characters.  What lies between two such places is
worked out once in a worker process and remembered.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.llm.bpe import BREAK, ByteLevelBPE, Numbers, encode_pieces, joined
from tidemark.llm.common import materialise, slices
from tidemark.llm.pieces import MEMO_BYTES, spans

#: Pairs of the count table that a worker holds at one time: 17 bytes each, as it is broadcast.
SLICE_PAIRS = 4_000_000
#: (document, pair) entries that a counting task gathers before it sorts them.
GATHER = 4_000_000
#: Pieces that a worker remembers; it only saves time.
PIECES = 400_000
#: A pair (a, b) as one number; vocabularies are below 2^20 ids.
SHIFT = 20

MEASURES = T.StructType([
    T.StructField("digest", T.BinaryType()),
    T.StructField("copies", T.LongType()),
    *(T.StructField(n, T.LongType()) for n in ("n_a", "n_b", "n_groups", "n_links")),
    T.StructField("groups_sha256", T.StringType()),
    T.StructField("pairs", T.BinaryType()),
    T.StructField("times", T.BinaryType()),
])
#: Where a text may be cut if not every space stands between visible characters.
SAFE = re.compile(r"(?<=\S)(?= \S)")


def packed(x: np.ndarray, kind: str) -> bytes:
    """Little-endian numbers, one byte plane after the other: high bytes are mostly zeros and compress away."""
    return x.astype(kind).view(np.uint8).reshape(len(x), np.dtype(kind).itemsize).T.tobytes()


def unpacked(b: bytes, kind: str) -> np.ndarray:
    wide = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(b, dtype=np.uint8).reshape(wide, len(b) // wide).T).view(kind).ravel() if b else np.zeros(0, kind)


def decimals(n: int) -> np.ndarray:
    """The numbers below ``n`` in decimal, a row each, filled up with zero bytes."""
    return np.char.mod("%d", np.arange(n)).astype("S").view(np.uint8).reshape(n, -1)


def align(a: np.ndarray, a_ends: np.ndarray, b: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of two tokenizations of the same bytes, by their tokens' ids and ends: the ends of the
    groups, and the places of the a and of the b token of every link, in order.

    Two tokens overlap in one stretch, and a stretch between two ends of either is in one
    token of each: there is a link for each of them."""
    ends = np.union1d(a_ends, b_ends)
    return np.intersect1d(a_ends, b_ends, assume_unique=True), np.searchsorted(a_ends, ends), np.searchsorted(b_ends, ends)


class Aligner:
    """Aligned pieces of text, each worked out once."""

    def __init__(self, first: str, second: str):
        import sentencepiece

        self.a = ByteLevelBPE(first)
        self.a.special = None  # their strings are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_file=second)
        self.b_bytes = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
        self.a_sizes, self.b_sizes = (np.array(list(map(len, x)), dtype=np.int64) for x in (self.a.bytes_of, self.b_bytes))
        self.digits = decimals(max(len(self.a_sizes), len(self.b_sizes)))
        self.clear()

    def clear(self) -> None:
        #: Of each piece: n_a, n_b, n_groups, n_links, and 1 where both give its bytes back.
        self.figures = np.zeros((0, 5), np.int64)
        self.groups: list[bytes] = []
        self.flat, self.starts, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.number, self.uses, self.chars = Numbers(), np.zeros(0, np.int64), 0

    @staticmethod
    def cut(text: str) -> list[str]:
        """Pieces of a space and ``text``.  Each begins with that space or one between visible characters."""
        if ByteLevelBPE.UNEVEN.search(text):
            return SAFE.split(" " + text)
        return [" " + p for p in text.split(" ")]

    def _first(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the first vocabulary, piece after piece, and their counts."""
        alone = [k for k, p in enumerate(pieces) if p[-1].isspace() or p[1].isspace() or BREAK in p]
        odd = set(alone)
        plain = [k for k in range(len(pieces)) if k not in odd]
        parts = [(plain, *encode_pieces(self.a.merges, self.a.SPLIT, "".join(pieces[k] + BREAK for k in plain), self.a._symbols))] if plain else []
        for k in alone:
            words = [w.encode() for w in self.a.SPLIT.findall(pieces[k])]
            ids, _ = self.a.merges.encode(self.a.base[np.frombuffer(b"".join(words), dtype=np.uint8)], np.array(list(map(len, words))))
            parts.append(([k], ids, np.array([len(ids)])))
        return joined(parts, len(pieces))

    def _learn(self, pieces: list[str]) -> None:
        a, n_a = self._first(pieces)
        lists = self.b.encode([p[1:] for p in pieces], num_threads=1)
        n_b = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
        b = np.fromiter(itertools.chain.from_iterable(lists), dtype=np.int64, count=int(n_b.sum()))
        raw = [p.encode() for p in pieces]
        good = np.ones(len(pieces), dtype=bool)
        if b"".join(map(self.b_bytes.__getitem__, b.tolist())) != b"".join(raw):
            good = np.array([b"".join(map(self.b_bytes.__getitem__, x)) == r for x, r in zip(lists, raw)])
            a, b = a[np.repeat(good, n_a)], b[np.repeat(good, n_b)]
            n_a, n_b = n_a * good, n_b * good
        a_ends, b_ends = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        ends = np.cumsum(np.fromiter(map(len, raw), dtype=np.int64, count=len(raw)) * good)
        common, i, j = align(a, a_ends, b, b_ends)
        group = lambda x: np.searchsorted(common, x)
        n_groups = np.diff(np.searchsorted(common, ends, side="right"), prepend=0)
        n_links = n_a + n_b - n_groups
        # the groups in decimal: those of a, then those of b, each id with the mark after it
        ids = np.concatenate([a, b])
        last = np.concatenate([a_ends == common[group(a_ends)], b_ends == common[group(b_ends)]]) if len(ids) else np.zeros(0, bool)
        mark = np.where(last, np.repeat([ord("|"), ord(";")], [len(a), len(b)]), ord(",")).astype(np.uint8)
        order = np.argsort(np.concatenate([2 * group(a_ends), 2 * group(b_ends) + 1]), kind="stable")
        rows = np.concatenate([self.digits[ids[order]], mark[order, None]], axis=1)
        text = rows[rows != 0].tobytes()
        owner = np.concatenate([np.repeat(np.arange(len(pieces)), n_a), np.repeat(np.arange(len(pieces)), n_b)])[order]
        stops = np.cumsum(np.bincount(owner, weights=(rows != 0).sum(axis=1), minlength=len(pieces))).astype(np.int64).tolist()
        self.groups += [text[x:y] for x, y in zip([0, *stops], stops)]
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(n_links) - n_links])
        self.sizes = np.concatenate([self.sizes, n_links])
        self.flat = np.concatenate([self.flat, a[i] << SHIFT | b[j]])
        self.figures = np.concatenate([self.figures, np.stack([n_a, n_b, n_groups, n_links, good.astype(np.int64)], axis=1)])

    def _forget(self) -> None:
        """Keeps the half of the pieces that were met most often."""
        keep = np.sort(np.argsort(-self.uses, kind="stable")[: min(PIECES, len(self.uses)) // 2])
        names = list(self.number)
        self.number = Numbers((names[k], n) for n, k in enumerate(keep.tolist()))
        self.groups = [self.groups[k] for k in keep.tolist()]
        self.flat = self.flat[spans(self.starts[keep], self.sizes[keep])]
        self.sizes, self.figures, self.uses = self.sizes[keep], self.figures[keep], self.uses[keep] // 2
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.chars = sum(map(len, self.number))

    def numbers(self, lists: list[list[str]]) -> np.ndarray:
        """The numbers of all pieces one after the other; new ones are worked out."""
        if len(self.number) > PIECES or self.chars > MEMO_BYTES:
            self._forget()
        known = len(self.number)
        found = np.fromiter(map(self.number.__getitem__, itertools.chain.from_iterable(lists)), dtype=np.int64)
        if fresh := len(self.number) - known:
            new = list(itertools.islice(reversed(self.number), fresh))[::-1]
            self._learn(new)
            self.chars += sum(map(len, new))
        self.uses = np.append(self.uses, np.zeros(fresh, np.int64)) + np.bincount(found, minlength=len(self.number))
        return found

    def measure(self, texts: list[str]) -> dict[str, list]:
        """Measures of each text; one that is empty, or that a vocabulary doesn't give back, has zeros."""
        lists = [self.cut(t) if t else [] for t in texts]
        found = self.numbers(lists)
        stops = np.cumsum(np.fromiter(map(len, lists), dtype=np.int64, count=len(lists)))
        sums = np.concatenate([np.zeros((1, 5), np.int64), np.cumsum(self.figures[found], axis=0)])[np.concatenate([[0], stops])]
        figures = np.diff(sums, axis=0)
        many = np.diff(stops, prepend=0)
        whole = (figures[:, 4] == many) & (many > 0)
        figures[~whole] = 0
        # (text, pair) entries, those of texts without tokens left out
        kept = found[np.repeat(whole, many)]
        sizes = self.sizes[kept]
        text = np.repeat(np.repeat(np.arange(len(lists)), many * whole), sizes)
        entry = np.sort(text << 2 * SHIFT + 4 | self.flat[spans(self.starts[kept], sizes)])
        head = np.flatnonzero(np.diff(entry, prepend=-1))
        times = np.diff(np.append(head, len(entry)))
        text, pair = entry[head] >> 2 * SHIFT + 4, entry[head] & (1 << 2 * SHIFT + 4) - 1
        edges = np.searchsorted(text, np.arange(len(lists) + 1)).tolist()
        out: dict[str, list] = {n: figures[:, k].tolist() for k, n in enumerate(("n_a", "n_b", "n_groups", "n_links"))}
        out |= {"groups_sha256": [], "pairs": [], "times": []}
        places = found.tolist()
        for d, (stop, good) in enumerate(zip(stops.tolist(), whole.tolist())):
            start = int(stops[d - 1]) if d else 0
            out["groups_sha256"].append(hashlib.sha256(b"".join(map(self.groups.__getitem__, places[start:stop]))[:-1]).hexdigest() if good else "")
            rows = slice(edges[d], edges[d + 1])
            out["pairs"].append(packed(np.diff(pair[rows], prepend=0), "<u8"))
            out["times"].append(packed(times[rows], "<u4"))
        return out


@functools.lru_cache(maxsize=2)
def aligner(first: str, second: str) -> Aligner:
    return Aligner(first, second)


def distinct_texts(docs: DataFrame) -> DataFrame:
    """text (null as empty) and copies, one row a distinct text: a shuffle by the full text."""
    return docs.select(F.coalesce("text", F.lit("")).alias("text")).groupBy("text").agg(F.count("*").alias("copies"))


def measured(texts: DataFrame, first: str, second: str) -> DataFrame:
    """Measures and packed pairs of the distinct ``texts`` by their digest."""
    target = to_arrow_schema(MEASURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = aligner(first, second)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                copies = batch.column(1).slice(at, 4096)
                for start, own in slices(batch.column(0).slice(at, 4096).to_pylist()):
                    made = work.measure(own) | {"digest": [hashlib.sha256(t.encode()).digest() for t in own], "copies": copies.slice(start, len(own))}
                    yield pa.RecordBatch.from_arrays([pa.array(made[f.name], type=f.type) if isinstance(made[f.name], list) else made[f.name] for f in target], schema=target)

    return texts.select("text", "copies").mapInArrow(run, MEASURES)


def pair_counts(classes: DataFrame) -> DataFrame:
    """pair, a, n (documents that hold the pair linked) and best (n is the highest of its a)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, weights, size = [], [], 0

        def folded() -> tuple[np.ndarray, np.ndarray]:
            keys, where = np.unique(np.concatenate(pairs), return_inverse=True)
            return keys, np.bincount(where, weights=np.concatenate(weights), minlength=len(keys))

        def batch_of(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n.astype(np.int64))], names=["pair", "n"])

        for batch in batches:
            for own, copies in zip(batch.column(0), batch.column(1).to_pylist()):
                x = np.cumsum(unpacked(own.as_py(), "<u8").astype(np.int64))
                pairs.append(x), weights.append(np.full(len(x), float(copies)))
                size += len(x)
                if size > GATHER:
                    keys, n = folded()
                    if len(keys) > GATHER // 2:  # more distinct pairs than fit: the shuffle adds them up
                        yield batch_of(keys, n)
                        pairs, weights, size = [], [], 0
                    else:
                        pairs, weights, size = [keys], [n], len(keys)
        if size:
            yield batch_of(*folded())

    counts = classes.select("pairs", "copies").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = counts.withColumn("a", F.shiftright("pair", SHIFT))
    most = counts.groupBy("a").agg(F.max("n").alias("most"))  # at most a row an id of the first vocabulary
    return counts.join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def looked_up(classes: DataFrame, counts: DataFrame, slice_pairs: int = SLICE_PAIRS) -> DataFrame:
    """The measures of every class by its digest, with n_best and count_sum.  The count table is
    broadcast in slices of about ``slice_pairs`` pairs, as many as it takes; their sums are added up."""
    spark = classes.sparkSession
    parts = max(1, -(-counts.count() // slice_pairs))
    kept = ["digest", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    rows = classes.select(*kept, "pairs", "times")
    schema = T.StructType([*rows.select(*kept).schema.fields, T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])
    found = None
    for part in range(parts):
        own = counts.where(F.pmod(F.xxhash64("pair"), F.lit(parts)) == part).select("pair", "n", "best").toArrow()
        order = np.argsort(own.column("pair").to_numpy())
        # a number above all pairs stands last, so that every search ends at an entry
        table = spark.sparkContext.broadcast((
            np.append(own.column("pair").to_numpy()[order], np.iinfo(np.int64).max),
            np.append(own.column("n").to_numpy()[order], 0),
            np.append(own.column("best").to_numpy(zero_copy_only=False)[order], False),
        ))

        def run(batches: Iterator[pa.RecordBatch], table=table) -> Iterator[pa.RecordBatch]:
            keys, counted, best = table.value
            for batch in batches:
                n_best, count_sum = [], []
                for own, times in zip(batch.column(len(kept)), batch.column(len(kept) + 1)):
                    pair, times = np.cumsum(unpacked(own.as_py(), "<u8").astype(np.int64)), unpacked(times.as_py(), "<u4").astype(np.int64)
                    at = np.searchsorted(keys, pair)
                    times = np.where(keys[at] == pair, times, 0)
                    n_best.append(int((times * best[at]).sum()))
                    count_sum.append(int((times * counted[at]).sum()))
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64())], names=schema.names)

        more = rows.mapInArrow(run, schema)
        found = more if found is None else found.unionByName(more)
    return found if parts == 1 else found.groupBy(*kept).agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def alignments(docs: DataFrame, first: str, second: str, slice_pairs: int = SLICE_PAIRS) -> tuple[DataFrame, DataFrame]:
    """The measures of each document, and the table of id pairs.

    ``first`` is a byte-level vocabulary file, ``second`` a sentence-piece model that adds a
    space in front and neither drops nor changes characters.  Special tokens' strings are plain text.

    Returns a row for each row of ``docs`` (doc_id, n_a, n_b, n_groups, n_links, n_best,
    count_sum, groups_sha256), and pair, n, best of each id pair (first id << 20 | second id).
    A text that is null or empty, or that a vocabulary doesn't give back byte by byte, has
    no tokens: zeros and an empty groups_sha256.  Equal texts count as so many documents
    and get a row each, repeated and null doc_ids too; an empty table gives empty ones.  A very long text is one row of a
    task, its work grows with its length but for stretches without a single space between
    visible characters, which the second vocabulary's library encodes whole.  Other columns
    aren't read, so their names don't matter.
    """
    classes = materialise(measured(distinct_texts(docs), first, second), "alignment-texts", block_mb=16)
    counts = materialise(pair_counts(classes), "alignment-pairs")
    # written, so that the join reads two plain shuffles and AQE may split a text of many copies
    done = materialise(looked_up(classes, counts, slice_pairs), "alignment-measures")
    keys = docs.select("doc_id", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest"))
    return keys.join(done, "digest").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"), counts
