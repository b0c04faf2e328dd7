"""A table of keyed rows that batches are merged into, in buckets of files.

A merge reads and writes the buckets of the batch's keys and leaves all other files alone.
Which folder holds a bucket is told by a manifest a version; a version is there when its
manifest has been renamed into place, so readers see a batch as a whole or not at all, and of two
merges at once one fails and is done again.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: How rows of one key become one: by column the aggregate of its values.
FOLDS = {"sum": F.sum, "min": F.min, "max": F.max}


def _fs(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def versions(spark: SparkSession, path: str) -> list[int]:
    """The versions of a store, the oldest first; none where there is no store yet."""
    fs, place = _fs(spark, f"{path}/manifests")
    if not fs.exists(place):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(place)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def manifest(spark: SparkSession, path: str, version: int) -> dict:
    """n_buckets and, by bucket, the folder of its rows."""
    return json.loads("\n".join(r.value for r in spark.read.text(f"{path}/manifests/{version}.json", wholetext=True).collect()))


def commit(spark: SparkSession, path: str, version: int, content: dict) -> None:
    """Puts a manifest in place; raises where another merge has put that version there."""
    fs, temporary = _fs(spark, f"{path}/manifests/.{uuid.uuid4().hex}")
    out = fs.create(temporary)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    final = _fs(spark, f"{path}/manifests/{version}.json")[1]
    if fs.exists(final) or not fs.rename(temporary, final):
        fs.delete(temporary, False)
        raise FileExistsError(f"version {version} of {path} is there already")


def read_store(spark: SparkSession, path: str, version: int | None = None, buckets: list[int] | None = None) -> DataFrame | None:
    """The rows of a version, the newest by default, of some buckets or all; None where there are none."""
    known = versions(spark, path)
    if not known:
        return None
    held = manifest(spark, path, known[-1] if version is None else version)["buckets"]
    folders = [f for b, f in held.items() if buckets is None or int(b) in buckets]
    return spark.read.parquet(*(f"{path}/{f}" for f in folders)) if folders else None


def merge(batch: DataFrame, path: str, keys: list[str], folds: dict[str, str], n_buckets: int = 64) -> int:
    """Merges ``batch`` into the store and returns the new version.

    Rows of the same ``keys`` become one, by ``folds`` (column: sum, min or max); keys may be null.  The
    number of buckets is the store's own once there is one; an empty batch makes a version all the same."""
    spark = batch.sparkSession
    known = versions(spark, path)
    before = manifest(spark, path, known[-1]) if known else {"n_buckets": n_buckets, "buckets": {}}
    fold = lambda df: df.groupBy(*keys).agg(*(FOLDS[how](c).alias(c) for c, how in folds.items()))
    bucket = F.pmod(F.xxhash64(*keys), F.lit(before["n_buckets"])).cast("int")
    folder = f"data/{uuid.uuid4().hex}"
    # folded and written beside the store first: what it touches is then known without doing the work twice
    folded = fold(batch.select(*keys, *folds)).withColumn("bucket", bucket)
    folded.write.partitionBy("bucket").parquet(f"{path}/{folder}-batch")
    new = spark.read.schema(folded.schema).parquet(f"{path}/{folder}-batch")
    touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # n_buckets at most
    held = read_store(spark, path, known[-1], touched) if known and touched else None
    rows = new.drop("bucket") if held is None else fold(held.unionByName(new.drop("bucket")))
    if touched:
        rows.withColumn("bucket", bucket).repartition(len(touched), "bucket").write.partitionBy("bucket").parquet(f"{path}/{folder}")
    fs, place = _fs(spark, f"{path}/{folder}-batch")
    version = (known[-1] + 1) if known else 0
    commit(spark, path, version, {"n_buckets": before["n_buckets"], "buckets": before["buckets"] | {str(b): f"{folder}/bucket={b}" for b in touched}})
    fs.delete(place, True)
    return version
