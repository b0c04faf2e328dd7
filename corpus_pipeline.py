"""A corpus pipeline out of the operators: what is toxic goes, copies and
near-copies go, secrets are blanked, and what is left is packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import exact_dedup, packing, secret_scan, simhash, toxicity
from tidemark.llm.common import discard, folder
from tidemark.llm.queries import vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold stay; the model learns from the
    labels of the documents of this stage."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are equal but for white space the one of the least doc_id stays."""
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-copies, linked over any number of steps, the one of the least doc_id stays."""
    return simhash.keep_first(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; secrets in their texts are blanked, null texts stay null."""
    return secret_scan.redact_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of pieces in sequences of at most 2048 ids; a null text is its end id alone."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"), room=2048)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash_dedup", drop_near_copies),
    ("secret_scan", redact_secrets),
    ("packing", pack_sequences),
]

#: Toxicity is a trained model and packing a dynamic program: SQL can express
#: neither; tests/llm/test_pipeline.py checks the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over whole ``documents``; an empty table gives no row.

    A run has a folder of its own in the shared one.  Each stage's table is written there;
    the table before it and what the stage wrote on its way are then deleted.  The last
    stage's tables and its predecessor's stay, as the result reads them."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    with folder(spark, "pipeline") as own:
        for name, stage in STAGES[:-1]:
            with folder(spark, name) as work:
                made = stage(spark, docs, sf_dir)
            made.write.parquet(f"{own}{name}")
            docs = spark.read.schema(made.schema).parquet(f"{own}{name}")
            for path in [work, before]:
                if path:
                    discard(spark, path)
            before = f"{own}{name}"
        return STAGES[-1][1](spark, docs, sf_dir)
