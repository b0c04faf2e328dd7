"""Secret scan with an incremental ledger of blobs.

Every text version is addressed by its content (SHA-256).  The ledger is a
Parquet table in a shared folder with one row for each blob and rule version
that was scanned, and the findings in it.  A scan looks only at the pairs the ledger doesn't
have, appends them, and joins the findings back to all paths (rows) of a blob.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.llm.common import in_struct, materialise, out_of_struct, shared_path, slices, touched

#: Goes up whenever a rule below changes; blobs are then scanned anew.
RULE_VERSION = 2

#: Rules that must be reported (fixed values): kind, pattern, group whose length counts, least length.
BASE_RULES = [
    ("assign", re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE), 1, 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile(r"[0-9a-f]{32,}"), 0, 32),
]
#: A private key: up to its END line, with no other BEGIN between, or else over the base64
#: that follows: runs of 16 characters and more, and lines of any length that follow at once.
#: Lines may be quoted or indented, and end with a newline or its escape.  Takes linear time.
_PEM = re.compile(r"""
    -----BEGIN\x20(?P<label>[A-Z ]*)PRIVATE\x20KEY-----
    (?: (?:(?!-----BEGIN\x20)[\s\S])*?-----END\x20(?P=label)PRIVATE\x20KEY-----
    |   (?:
            (?:\\+[nrt]|[\s"'`>\#*|,;+]|//(?=\s))++  (?: (?:Proc-Type|DEK-Info|Version|Comment):(?:(?!\\+[nr])[^\r\n])*+ | [A-Za-z0-9+/=_-]{16,}+ )
        |   [\x20\t"'`,;+]*+ (?:(?:\\+[nr])++[\x20\t"'`,;+]*+(?:\r?\n)?+|\r?\n|\r) (?:[\x20\t"'`>\#*|,;+]|//(?=\s))*+
            [A-Za-z0-9+/=]++ (?=[\x20\t"'`,;]*+(?:\\+[nr]|[\r\n]|\Z))
        )*+
    )""", re.ASCII | re.VERBOSE)
#: Public token formats that are reported besides.
MORE_RULES = [
    ("pem", _PEM, 0, 1),
    ("github", re.compile(r"gh[pousr]_[A-Za-z0-9]+"), 0, 40),
    ("slack", re.compile(r"xox[abprs]-[A-Za-z0-9-]+"), 0, 15),
    ("jwt", re.compile(r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"), 0, 30),
]
#: Where the assignment rule can match at all: a cheap first look.
_NAMES = re.compile(r"[:=]")
ORDER = {kind: k for k, (kind, *_) in enumerate([*BASE_RULES, *MORE_RULES])}


def find_secrets(text: str, rules: list = BASE_RULES + MORE_RULES) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind as listed; code points, end exclusive."""
    found = []
    for kind, pattern, group, least in rules:
        if kind == "assign" and not _NAMES.search(text) or kind == "access" and "AKIA" not in text:
            continue
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                found.append((kind, m.start(), m.end()))
    return sorted(found, key=lambda f: (f[1], ORDER[f[0]]))


def redact(text: str | None, mark: str = "[SECRET]") -> str | None:
    """The text with every span, overlapping ones as one, replaced by ``mark``."""
    if not text:
        return text
    out, at = [], 0
    for _, start, end in sorted(find_secrets(text), key=lambda f: f[1:]):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:] if out else text


LEDGER = T.StructType([
    T.StructField("blob", T.BinaryType()),
    T.StructField("rule_version", T.IntegerType()),
    T.StructField("kinds", T.ArrayType(T.StringType())),
    T.StructField("starts", T.ArrayType(T.LongType())),
    T.StructField("ends", T.ArrayType(T.LongType())),
    T.StructField("is_base", T.ArrayType(T.BooleanType())),
])


def scan_blobs(blobs: DataFrame) -> DataFrame:
    """Ledger rows of (blob, text) rows."""
    target = to_arrow_schema(LEDGER)
    base = {kind for kind, *_ in BASE_RULES}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                keys = batch.column(0).slice(at, 1024).to_pylist()
                for first, texts in slices(batch.column(1).slice(at, 1024).to_pylist()):
                    found = [find_secrets(t) for t in texts]
                    yield pa.RecordBatch.from_pydict({
                        "blob": keys[first : first + len(texts)],
                        "rule_version": [RULE_VERSION] * len(texts),
                        "kinds": [[k for k, _, _ in f] for f in found],
                        "starts": [[a for _, a, _ in f] for f in found],
                        "ends": [[b for _, _, b in f] for f in found],
                        "is_base": [[k in base for k, _, _ in f] for f in found],
                    }, schema=target)

    return blobs.select("blob", "text").mapInArrow(run, LEDGER)


def has_files(spark, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def scan_secrets(docs: DataFrame, ledger: str | None = None) -> DataFrame:
    """Findings of every row's text: doc_id, blob (hex) and findings, an array
    of (kind, start, end, is_base) structs in the order of find_secrets().

    ``ledger`` is the folder of the ledger, shared and kept between calls; what
    it has isn't scanned again.  Without one a new ledger is begun in the
    session's shared folder.

    A null text counts as empty.  A null doc_id is kept, equal rows each get a
    row and share one scan, an empty table gives an empty one.  Copies meet in
    a partial aggregation where they are read, so a group of copies of any size
    moves at most one text a task.
    """
    spark = docs.sparkSession
    ledger = ledger or shared_path(spark, "secret-ledger")
    versions = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("blob", F.unhex(F.sha2("text", 256)))
    unseen = versions.select("blob", "text")
    if has_files(spark, ledger):
        seen = spark.read.schema(LEDGER).parquet(ledger).where(F.col("rule_version") == RULE_VERSION).select("blob").distinct()
        unseen = unseen.join(seen, "blob", "left_anti")
    scan_blobs(unseen.groupBy("blob").agg(F.first("text").alias("text"))).write.mode("append").parquet(ledger)
    findings = (
        spark.read.schema(LEDGER).parquet(ledger)
        .where(F.col("rule_version") == RULE_VERSION)
        .select("blob", F.arrays_zip(F.col("kinds").alias("kind"), F.col("starts").alias("start"), F.col("ends").alias("end"), "is_base").alias("findings"))
        .where(F.size("findings") > 0)
        .dropDuplicates(["blob"])  # two scans at once may both have written a blob
    )
    # written, so that the join reads two plain shuffles and AQE may split a text of many rows
    findings = materialise(findings, "secret-found")
    return versions.select("doc_id", "blob").join(findings, "blob", "left").select("doc_id", F.lower(F.hex("blob")).alias("blob"), F.coalesce("findings", F.array()).alias("findings"))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of scan_secrets()' rows."""
    base = F.filter("findings", lambda f: f["is_base"])
    line = lambda spans: F.array_join(F.transform(spans, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(line(base), 256).alias("base_sha256"), line(F.col("findings")).alias("spans"))


def redact_documents(docs: DataFrame, ledger: str | None = None) -> DataFrame:
    """``docs`` with the secrets in ``text`` replaced and n_chars, where it is a
    column, brought up to date; all rows and columns stay.  A null text stays null.

    Findings come from the ledger's scan.  Only texts that have some, and few others,
    move to meet them; the rest stay where they are read.  Equal rows and null
    doc_ids stay as they are; whole texts of any length are scanned; an empty table gives an empty
    one.  Columns may have any names: rows are carried as one struct."""
    plain = docs.select("text", F.lit(None).cast("long").alias("doc_id"))
    found = scan_secrets(plain, ledger).where(F.size("findings") > 0).select(F.unhex("blob").alias("blob"), "findings")
    found = materialise(found.dropDuplicates(["blob"]), "secret-findings")
    rows = docs.select(in_struct(docs).alias("row"), F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("blob"))
    near, far = touched(rows, found, "blob")
    text = F.expr("""
        aggregate(
          array_sort(transform(findings, f -> struct(f.start AS s, f.end AS e))),
          struct('' AS done, 0L AS at),
          (a, f) -> CASE
            WHEN f.s >= a.at THEN struct(a.done || substring(row.text, int(a.at) + 1, int(f.s - a.at)) || '[SECRET]' AS done, f.e AS at)
            ELSE struct(a.done AS done, greatest(a.at, f.e) AS at) END,
          a -> a.done || substring(row.text, int(a.at) + 1))""")
    joined = near.join(found, "blob", "left").withColumn("text", F.when(F.col("findings").isNotNull(), text).otherwise(F.col("row.text")))
    changed = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("findings").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return joined.select(*out_of_struct(docs, **changed)).unionByName(far.select(*out_of_struct(docs)))
