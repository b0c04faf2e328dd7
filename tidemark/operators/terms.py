"""Places of the terms of a table in texts, by an Aho-Corasick automaton.

A text is read once, however many terms there are.  The automaton is built once in a worker
process out of a table that is shipped only if its size allows it; a larger table is dealt by
hash to parts of that size, each of which reads the texts on its own.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.sources.shared import checkpointed

#: Characters of terms in one automaton, some hundred bytes each.
MOST_CHARS = 400_000
#: Characters around hits, and their fields as so many, that a worker holds before it hands them on.
HELD_CHARS, ROW_CHARS = 2_000_000, 400
PLACES = T.StructType([
    T.StructField("symbol", T.StringType()), T.StructField("alias", T.StringType()), T.StructField("at", T.IntegerType()), T.StructField("rank", T.IntegerType()),
    T.StructField("before", T.StringType()), T.StructField("after", T.StringType()),
])
_built: dict[int, ahocorasick.Automaton] = {}


def automaton(table: Broadcast, number: int) -> ahocorasick.Automaton:
    """The automaton of a broadcast table of (symbol, alias, ...); a process keeps the last few."""
    if number not in _built:
        while len(_built) > 3:
            _built.pop(next(iter(_built)))
        found = ahocorasick.Automaton()
        own: dict[str, list] = {}
        for row in table.value:
            own.setdefault(row[1], []).append(row)
        for alias, rows in own.items():
            found.add_word(alias, rows)
        found.make_automaton()
        _built[number] = found
    return _built[number]


def terms_table(spark, terms: DataFrame | list[tuple]) -> DataFrame:
    """symbol, alias, needs and rank (the place in a list, 0 in a table) without empty terms, each pair once."""
    if not isinstance(terms, DataFrame):
        terms = spark.createDataFrame([(s, a, bool(n), k) for k, (s, a, n) in enumerate(terms)] or [(None, None, None, 0)], "symbol string, alias string, needs boolean, rank int")
    rank = F.col("rank") if "rank" in terms.columns else F.lit(0)
    own = terms.select(F.col("symbol").cast("string").alias("symbol"), "alias", "needs", rank.alias("rank")).where("alias <> '' and symbol is not null")
    return own.groupBy("symbol", "alias").agg(F.bool_or(F.coalesce("needs", F.lit(False))).alias("needs"), F.min("rank").alias("rank"))


def dealt(table: DataFrame, most_chars: int = MOST_CHARS) -> list[Broadcast]:
    """The rows of a written table, of which ``alias`` is the second column, in parts of about so many characters of it, each shipped on its own."""
    chars = table.agg(F.coalesce(F.sum(F.length("alias")), F.lit(0))).first()[0]
    parts = max(1, math.ceil(chars / most_chars))
    own = [table.where(F.pmod(F.xxhash64("alias"), F.lit(parts)) == part) if parts > 1 else table for part in range(parts)]
    return [table.sparkSession.sparkContext.broadcast([tuple(r) for r in part.orderBy(*table.columns[:2]).collect()]) for part in own]


def resolve(rows: list[tuple], length: int) -> list[tuple]:
    """Of (symbol, alias, place, rank, ...) those that count: longest first, then by rank, alias and symbol, each character used once."""
    used, out = bytearray(length), []
    for row in sorted(rows, key=lambda r: (-len(r[1]), r[3], r[1], r[0], r[2])):
        at, end = row[2], row[2] + len(row[1])
        if not any(used[at:end]):
            used[at:end] = b"\1" * len(row[1])
            out.append(row)
    return out


def places_in(batches: Iterator[pa.RecordBatch], book: ahocorasick.Automaton, target: pa.Schema, place: int, stock: re.Pattern | None, window: int, around: int, settled: bool) -> Iterator[pa.RecordBatch]:
    """The places of the automaton's terms in the texts of column ``place``, in batches of about HELD_CHARS:
    one text at a time is a Python string, and how many places the texts of a batch have doesn't matter."""
    others = [n for n in range(len(target) - len(PLACES) + 1) if n != place]

    def made(batch: pa.RecordBatch, at_rows: list[int], rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows) if rows else [[]] * len(PLACES)
        ids = [batch.column(n).take(pa.array(at_rows, pa.int64())) for n in others]
        return pa.RecordBatch.from_arrays([*ids, *(pa.array(c, type=f.type) for c, f in zip(columns, list(target)[len(others) :]))], schema=target)

    for batch in batches:
        at_rows, rows, held = [], [], 0
        for k, value in enumerate(batch.column(place)):
            text = value.as_py()
            if not text or not len(book):
                continue
            hits = []
            for end, entries in book.iter(text):
                for symbol, alias, needs, rank in entries:
                    at = end + 1 - len(alias)
                    if needs:
                        near = text[max(0, at - window) : end + 1 + window]
                        if not (f"${alias}" in near or f"({alias})" in near or stock and stock.search(near)):
                            continue
                    hits.append((symbol, alias, at, rank))
            for hit in resolve(hits, len(text)) if settled else hits:
                at, end = hit[2], hit[2] + len(hit[1])
                rows.append((*hit, text[max(0, at - around) : at], text[end : end + around]))
                at_rows.append(k)
                held += ROW_CHARS + len(rows[-1][4]) + len(rows[-1][5])
                if held >= HELD_CHARS:
                    yield made(batch, at_rows, rows)
                    at_rows, rows, held = [], [], 0
        yield made(batch, at_rows, rows)


def term_places(items: DataFrame, terms: DataFrame | list[tuple], stock_words: str | None = None, window: int = 80, around: int = 100, single: bool = False, most_chars: int = MOST_CHARS) -> DataFrame:
    """external_id, symbol, alias, at (0-based), and up to ``around`` characters before and after: every place of every term.

    ``terms`` are symbol, alias, needs, in a list or a table (its rank, if there is one, settles ties).  One that needs context counts only where a stock word,
    $alias or (alias) stands within ``window`` characters.  With ``single`` the longest terms come first and
    use up their characters; what doesn't count uses up nothing.  A null text has no places."""
    books = dealt(checkpointed(terms_table(items.sparkSession, terms)), most_chars)
    parts = len(books)
    here = single and parts == 1
    source = items.select("external_id", "text")
    if single and parts > 1:  # a text's places come from several parts and meet again by its number
        source = checkpointed(source.withColumn("_row", F.monotonically_increasing_id()))
    keys = [f for f in source.schema.fields if f.name != "text"]
    schema = T.StructType([*keys, *PLACES.fields])
    target = to_arrow_schema(schema)
    place = source.columns.index("text")
    found = None
    for shipped in books:

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped, number=shipped._jbroadcast.id()) -> Iterator[pa.RecordBatch]:
            stock = re.compile(stock_words) if stock_words else None
            return places_in(batches, automaton(shipped, number), target, place, stock, window, around, here)

        more = source.mapInArrow(run, schema)
        found = more if found is None else found.unionByName(more)
    if single and parts > 1:

        def settle(own: pa.Table) -> pa.Table:
            rows = list(zip(own.column("symbol").to_pylist(), own.column("alias").to_pylist(), own.column("at").to_pylist(), own.column("rank").to_pylist(), range(own.num_rows)))
            kept = resolve(rows, max(r[2] + len(r[1]) for r in rows))
            return own.take(pa.array(sorted(r[4] for r in kept), pa.int64()))

        found = found.groupBy("_row").applyInArrow(settle, schema).drop("_row")
    return found.drop("rank")
