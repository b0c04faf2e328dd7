"""Stupid-backoff scores of documents under a bigram model of the whole corpus.

Tokens are ids of a public vocabulary, so the unigram table is bounded by the
vocabulary and may be broadcast.  Bigrams aren't bounded: each (document,
bigram) pair is dealt by the bigram's hash, where the count table of that hash
range is built and joined to the pairs, and the scores are summed by document.

    S(w | v) = c(v w) / c(v)      if the model has the bigram
               0.4 * c(w) / N     else

All counts are those of the whole corpus.  The model leaves out bigrams that only the
scored document has: else none would ever back off, as the corpus holds every
document that is scored.

The count table of a hash range and its join are numpy in one Arrow group a range:
exploded, the pairs alone would be over twice the disk that the input may cost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.llm.bpe import word_level
from tidemark.llm.common import materialise, slices

BACKOFF = 0.4
#: Stands before the first token of a document; no vocabulary here has the id.
START = 65535
#: Characters of the corpus for which there is one hash range more.
RANGE_CHARS = 15_000_000
#: Tokens and documents of a run: what one row of a hash range gathers.
RUN_TOKENS, RUN_DOCS = 700_000, 60_000
#: Rows and characters of text that a task holds as Python strings and encodes at one time.
TEXT_ROWS, TEXT_CHARS = 512, 400_000
#: Pairs of a range that are joined at once.
STRETCH = 300_000
#: An odd number and its inverse modulo 2^32: multiplying scrambles bigrams, and back.
MIX = 0x9E3779B1
UNMIX = pow(MIX, -1, 1 << 32)

PAIRS = T.StructType([
    T.StructField("part", T.LongType()),
    T.StructField("run", T.LongType()),
    T.StructField("hashes", T.BinaryType()),
    T.StructField("rows", T.BinaryType()),
    T.StructField("times", T.BinaryType()),
])
RUNS = T.StructType([T.StructField("run", T.LongType()), T.StructField("docs", T.ArrayType(T.LongType())), T.StructField("tokens", T.ArrayType(T.LongType()))])


def planes(x: np.ndarray, kind: str) -> bytes:
    """Little-endian numbers byte plane by byte plane: high bytes are mostly
    zeros and compress away."""
    return x.astype(kind).view(np.uint8).reshape(len(x), -1).T.tobytes()


def unplanes(b: bytes, kind: str) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, dtype=np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _token_lists(batches: Iterator[pa.RecordBatch], vocabulary: str) -> Iterator[tuple[list, list[np.ndarray]]]:
    coder = word_level(vocabulary)
    for batch in batches:
        for at in range(0, batch.num_rows, TEXT_ROWS):
            keys = batch.column(0).slice(at, TEXT_ROWS).to_pylist()
            for first, texts in slices(batch.column(1).slice(at, TEXT_ROWS).to_pylist(), TEXT_CHARS):
                ids, counts = coder.encode_many(texts)
                yield keys[first : first + len(texts)], np.split(ids, np.cumsum(counts)[:-1])


def bigrams_by_hash(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs of a bigram's hash (high 32 bits) and its document's number (low ones), sorted, and how often each is.
    A bigram is 32 bits, and so is its hash: products of that width wrap by themselves."""
    sizes = np.array([len(x) for x in lists], dtype=np.int64)
    token = np.concatenate([*lists, np.zeros(0, dtype=np.uint32)]).astype(np.uint32, copy=False)
    hashed = np.empty_like(token)
    hashed[1:] = token[:-1]
    hashed[(np.cumsum(sizes) - sizes)[sizes > 0]] = START
    hashed <<= np.uint32(16)
    hashed |= token
    hashed *= np.uint32(MIX)
    packed = hashed.astype(np.uint64)
    packed <<= np.uint64(32)
    packed |= np.repeat(np.arange(len(lists), dtype=np.uint32), sizes)
    packed.sort()
    first = np.flatnonzero(np.concatenate([[True], packed[1:] != packed[:-1]])) if len(packed) else np.zeros(0, dtype=np.int64)
    return packed[first], np.diff(first, append=len(packed))


def explode_bigrams(docs: DataFrame, vocabulary: str, parts: int) -> DataFrame:
    """(document, bigram, times) triples by hash range, packed: a row has what
    one run of documents has in one range, sorted by the bigram's hash, and a row of range
    -1 has the run's documents and their token counts.  A run is made by one
    task, so its documents are numbered within it."""
    schema = T.StructType([*PAIRS.fields, *RUNS.fields[1:]])
    target = to_arrow_schema(schema)

    def pack(run: int, keys: list, lists: list[np.ndarray]) -> pa.RecordBatch:
        packed, times = bigrams_by_hash(lists)
        hashed = packed >> np.uint64(32)
        part = (hashed * np.uint64(parts)) >> np.uint64(32)  # ranges of the hash, so they stand in order
        names, starts = np.unique(part, return_index=True)
        made: dict[str, list] = {f.name: [] for f in schema}
        add = lambda *values: [made[k].append(v) for k, v in zip(made, values)]
        for name, a, b in zip(names.tolist(), starts.tolist(), [*starts[1:].tolist(), len(part)]):
            steps = np.diff(hashed[a:b], prepend=np.uint64(0))
            add(name, run, planes(steps, "<u4"), planes(packed[a:b] & np.uint64(0xFFFF), "<u2"), planes(times[a:b], "<u4"), None, None)
        add(-1, run, None, None, None, keys, list(map(len, lists)))
        return pa.RecordBatch.from_pydict(made, schema=target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        keys: list = []
        lists: list[np.ndarray] = []
        size = 0
        for more, tokens in _token_lists(batches, vocabulary):
            keys += more
            lists += tokens
            size += sum(map(len, tokens))
            if size > RUN_TOKENS or len(keys) > RUN_DOCS - 4096:
                yield pack(number, keys, lists)
                keys, lists, size, number = [], [], 0, number + 1
        if keys:
            yield pack(number, keys, lists)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def unigrams(pairs: DataFrame, runs: DataFrame) -> np.ndarray:
    """Counts of all tokens over the whole corpus; at START, of the documents
    that have any."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(START + 1, dtype=np.int64)
        for batch in batches:
            for h, t in zip(batch.column(0), batch.column(1)):
                bigram = bigrams_of(h.as_py())
                total += np.bincount(bigram & 0xFFFF, weights=unplanes(t.as_py(), "<u4"), minlength=START + 1).astype(np.int64)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"token": pa.array(seen, pa.int32()), "n": pa.array(total[seen], pa.int64())})

    table = pairs.select("hashes", "times").mapInArrow(count, "token int, n long").groupBy("token").agg(F.sum("n").alias("n"))
    out = np.zeros(START + 1, dtype=np.int64)
    for row in table.collect():  # at most one row an entry of the vocabulary
        out[row.token] = row.n
    out[START] = runs.agg(F.sum(F.size(F.filter("tokens", lambda n: n > 0)))).first()[0] or 0
    return out


def hashes_of(b: bytes) -> np.ndarray:
    return np.cumsum(unplanes(b, "<u4"), dtype=np.uint64)


def bigrams_of(b: bytes) -> np.ndarray:
    return ((hashes_of(b) * np.uint64(UNMIX)) & np.uint64(0xFFFFFFFF)).astype(np.int64)


def lm_scores(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Returns doc_id, n_tokens, n_backoff, log_score (sum of natural
    logarithms) and per_token (its mean; null without tokens), rounded to six
    places.

    Null texts count as empty: no tokens, log_score 0.  Rows of one doc_id
    (null too) are scored apart and summed as one document.  An empty table
    gives an empty one.

    The pairs are written once to the shared folder; what is shuffled after are
    the packed pairs and, for each run and range, one partial score a document.
    """
    spark = docs.sparkSession
    if word_level(vocabulary).size > START:
        raise ValueError(f"bigrams are two numbers of 16 bits: a vocabulary may have {START} entries")
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(chars / RANGE_CHARS))
    made = materialise(explode_bigrams(docs, vocabulary, parts), "lm-pairs", block_mb=4)
    pairs, runs = made.where("part >= 0").select(*PAIRS.names), made.where("part < 0").select(*RUNS.names)
    counts = unigrams(pairs, runs)
    total = int(counts[:START].sum())
    shared = spark.sparkContext.broadcast(counts)  # START + 1 numbers, whatever the corpus

    def score(table: pa.Table) -> pa.Table:
        """One hash range: its count table, joined to its pairs a stretch of
        hashes at a time, so that few of them are held unpacked."""
        c1 = shared.value
        hashes = [hashes_of(b.as_py()).astype(np.uint32) for b in table.column("hashes")]
        rows = [unplanes(b.as_py(), "<u2") for b in table.column("rows")]
        times = [unplanes(b.as_py(), "<u4") for b in table.column("times")]
        logs = [np.zeros(int(r.max()) + 1) for r in rows]
        backed = [np.zeros(len(x), dtype=np.int64) for x in logs]
        low, high = min(int(h[0]) for h in hashes), max(int(h[-1]) for h in hashes) + 1
        steps = -(-sum(map(len, hashes)) // STRETCH)
        bounds = [low + (high - low) * k // steps for k in range(steps + 1)]
        cuts = [[*np.searchsorted(h, np.array(bounds[:-1], dtype=np.uint32)).tolist(), len(h)] for h in hashes]
        for k in range(steps):
            spans = [slice(c[k], c[k + 1]) for c in cuts]
            flat = np.concatenate([h[x] for h, x in zip(hashes, spans)])
            own = np.concatenate([t[x] for t, x in zip(times, spans)]).astype(np.int64)
            keys, place = np.unique(flat, return_inverse=True)
            others = np.bincount(place, weights=own, minlength=len(keys)).astype(np.int64)[place] - own
            bigram = ((flat.astype(np.uint64) * np.uint64(UNMIX)) & np.uint64(0xFFFFFFFF)).astype(np.int64)
            off = others == 0
            value = own * np.log(np.where(off, BACKOFF * c1[bigram & 0xFFFF] / total, (others + own) / np.maximum(c1[bigram >> 16], 1)))
            at = 0
            for i, x in enumerate(spans):
                n = x.stop - x.start
                own_rows = rows[i][x]
                logs[i] += np.bincount(own_rows, weights=value[at : at + n], minlength=len(logs[i]))
                backed[i] += np.bincount(own_rows, weights=(own * off)[at : at + n], minlength=len(logs[i])).astype(np.int64)
                at += n
        out: dict[str, list] = {"run": table.column("run").to_pylist(), "rows": [], "backed": [], "logs": []}
        for r, n, x in zip(rows, backed, logs):
            names = np.unique(r)
            out["rows"].append(planes(np.diff(names, prepend=np.uint16(0)), "<u2"))
            out["backed"].append(planes(n[names], "<u4"))
            out["logs"].append(x[names].tobytes())
        return pa.table(out, schema=pa.schema([("run", pa.int64()), ("rows", pa.binary()), ("backed", pa.binary()), ("logs", pa.binary())]))

    partial = pairs.groupBy("part").applyInArrow(score, "run long, rows binary, backed binary, logs binary")
    target = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("n_backoff", pa.int64()), ("s", pa.float64())])

    def add_up(table: pa.Table) -> pa.Table:
        """One run: the row with its documents, and its partial scores."""
        head = next((d, n) for d, n in zip(table.column("docs").to_pylist(), table.column("tokens").to_pylist()) if d is not None)
        logs, backed = np.zeros(len(head[0])), np.zeros(len(head[0]))
        for r, b, x in zip(table.column("rows"), table.column("backed"), table.column("logs")):
            if r.is_valid:
                rows = np.cumsum(unplanes(r.as_py(), "<u2"), dtype=np.int64)
                logs[rows] += np.frombuffer(x.as_py(), dtype=np.float64)
                backed[rows] += unplanes(b.as_py(), "<u4")
        return pa.table([pa.array(head[0], pa.int64()), pa.array(head[1], pa.int64()), pa.array(backed.astype(np.int64)), pa.array(logs)], schema=target)

    both = partial.unionByName(runs, allowMissingColumns=True)
    scored = both.groupBy("run").applyInArrow(add_up, "doc_id long, n long, n_backoff long, s double")
    return (
        scored.groupBy("doc_id")
        .agg(F.sum("n").alias("n_tokens"), F.sum("n_backoff").alias("n_backoff"), F.sum("s").alias("s"))
        .select("doc_id", "n_tokens", "n_backoff", F.round("s", 6).alias("log_score"), F.when(F.col("n_tokens") > 0, F.round(F.col("s") / F.col("n_tokens"), 6)).alias("per_token"))
    )
