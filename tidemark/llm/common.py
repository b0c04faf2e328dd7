"""Helpers that the operators of this package share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Characters of text that a task holds as Python strings at one time.
SLICE_CHARS = 2_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where the session has none and runs on one machine (tests, a laptop) a
    folder of its own is made and set as the checkpoint folder.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(conf)
        return conf
    if spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
    return spark.sparkContext.getCheckpointDir()


#: The folder below the shared one in which this thread's tables go at present.
_folder: ContextVar[str] = ContextVar("folder", default="")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, or in the folder that folder() has set."""
    return f"{shared_dir(spark)}/{_folder.get()}{name}-{uuid.uuid4().hex}"


@contextmanager
def folder(spark: SparkSession, name: str) -> Iterator[str]:
    """Tables that this thread writes meanwhile are in one folder of their own, whose path is given.
    Other threads' tables are elsewhere, so that discard() of the folder hits none of them."""
    own = f"{_folder.get()}{name}-{uuid.uuid4().hex}/"
    token = _folder.set(own)
    try:
        yield f"{shared_dir(spark)}/{own}"
    finally:
        _folder.reset(token)


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared folder that nothing reads any more."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def in_struct(docs: DataFrame) -> Column:
    """All columns of a row as one, so that no name of theirs clashes with an operator's own."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns))


def out_of_struct(docs: DataFrame, row: str = "row", **changed: Column) -> list[Column]:
    """The columns of in_struct() again, some of them changed."""
    return [changed.get(c, F.col(row).getField(c)).alias(c) for c in docs.columns]


#: Marks of touched(): what it broadcasts has no more rows, whatever the input.
MARKS = 1 << 20


def touched(rows: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` as those whose ``key`` may be among ``keys``, and those whose key surely isn't.

    Only the first need a shuffle to be joined with what belongs to the keys.  They are told
    by a hash of the key: where most marks are taken all rows are among the first."""
    marks = keys.select(F.pmod(F.xxhash64(key), F.lit(MARKS)).alias("__mark")).distinct()
    marked = rows.withColumn("__mark", F.pmod(F.xxhash64(key), F.lit(MARKS)))
    return tuple(marked.join(F.broadcast(marks), "__mark", how).drop("__mark") for how in ("left_semi", "left_anti"))


def materialise(df: DataFrame, name: str, block_mb: int = 128) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that what follows
    doesn't repeat the work and a lost executor costs nothing but a re-read.

    A row group of ``block_mb`` is buffered while it is written, and read in
    batches of rows that stay within one: tables of wide rows take small ones."""
    path = shared_path(df.sparkSession, name)
    df.write.option("parquet.block.size", block_mb << 20).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(texts: list[str | None], most: int = SLICE_CHARS) -> Iterator[tuple[int, list[str]]]:
    """Consecutive runs of texts of about ``most`` characters, with the first one's place."""
    start, run, size = 0, [], 0
    for i, text in enumerate(texts):
        text = text or ""
        run.append(text)
        size += len(text)
        if size >= most:
            yield start, run
            start, run, size = i + 1, [], 0
    if run:
        yield start, run


def map_texts(
    docs: DataFrame,
    make: Callable[[], Callable[[list[str]], dict[str, list]]],
    fields: T.StructType,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``key`` and the columns that ``make()(texts)`` computes, for every row.

    ``make`` runs once in a task; a null text counts as empty.  Only the two
    columns named are read, so other columns and their names don't matter.
    """
    source = docs.select(key, text)
    out = T.StructType([source.schema[key], *fields.fields])
    target = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            column = batch.column(1)
            at = 0
            while at < batch.num_rows:
                # a few rows at a time become Python strings; the rest stays in Arrow
                take = max(1, min(batch.num_rows - at, 4096))
                values = column.slice(at, take).to_pylist()
                for start, run_ in slices(values):
                    made = work(run_)
                    arrays = [batch.column(0).slice(at + start, len(run_))]
                    arrays += [pa.array(made[f.name], type=f.type) for f in target if f.name != key]
                    yield pa.RecordBatch.from_arrays(arrays, schema=target)
                at += take

    return source.mapInArrow(run, out)


def extend_rows(docs: DataFrame, make: Callable[[], Callable[[list[str]], dict[str, list]]], field: T.StructField, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, and the column ``field`` of ``make()(texts)``."""
    place = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, field])
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            made: list = []
            for at in range(0, batch.num_rows, 4096):
                for _, run_ in slices(batch.column(place).slice(at, 4096).to_pylist()):
                    made += work(run_)[field.name]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, type=target.field(len(target) - 1).type)], schema=target)

    return docs.mapInArrow(run, schema)


def filter_texts(docs: DataFrame, make: Callable[[], Callable[[list[str]], dict[str, list]]], keep: str, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, for which the Boolean column ``keep``
    of ``make()(texts)`` holds."""
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            mask: list[bool] = []
            for at in range(0, batch.num_rows, 4096):
                for _, run_ in slices(batch.column(place).slice(at, 4096).to_pylist()):
                    mask += work(run_)[keep]
            yield batch.filter(pa.array(mask, type=pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
