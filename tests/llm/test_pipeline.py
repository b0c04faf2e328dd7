"""Each stage of the pipeline against brute force on the rows that it was given."""

import re
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import pytest
from pyspark.sql import functions as F

pytest.importorskip("tidemark.llm")
pipeline = pytest.importorskip("corpus_pipeline")

from tidemark.llm import common, exact_dedup, secret_scan, simhash, toxicity  # noqa: E402


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").cache()
    steps = dict(pipeline.STAGES)
    assert list(steps) == ["toxicity", "exact_dedup", "simhash_dedup", "secret_scan", "packing"]
    columns = docs.columns

    model = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    one = steps["toxicity"](spark, docs, sf).cache()
    assert one.columns == columns
    assert {r.doc_id for r in one.collect()} == {r.doc_id for r in docs.collect() if model.score(r.text or "")[0] < toxicity.THRESHOLD}

    two = steps["exact_dedup"](spark, one, sf).cache()
    first = {}
    for r in one.collect():
        first[norm(r.text)] = min(first.get(norm(r.text), r.doc_id), r.doc_id)
    assert two.columns == columns and sorted(r.doc_id for r in two.collect()) == sorted(first.values())

    three = steps["simhash_dedup"](spark, two, sf).cache()
    prints = {r.doc_id: simhash.fingerprint(r.text or "") for r in two.collect()}
    component = {d: d for d in prints}
    for _ in prints:
        new = {d: min(component[e] for e in prints if (prints[d] ^ prints[e]).bit_count() <= simhash.BOUND) for d in prints}
        if new == component:
            break
        component = new
    assert three.columns == columns and sorted(r.doc_id for r in three.collect()) == sorted(set(component.values()))

    four = steps["secret_scan"](spark, three, sf).cache()
    assert four.columns == columns and four.dtypes == docs.dtypes
    assert {r.doc_id: r.text for r in four.collect()} == {r.doc_id: secret_scan.redact(r.text) for r in three.collect()}

    rows = pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in four.select("doc_id").collect()}
    total = {r.doc_id: r.doc_tokens for r in rows}
    assert all(sum(r.length for r in rows if r.doc_id == d) == n for d, n in total.items())


def test_stages_on_an_empty_table_and_on_odd_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(None, None, "en", None, None), (None, "", None, "s", 0), (10**6, "same  text", "en", "s", 10), (10**6, "same  text", "en", "s", 10), (10**6 + 1, "w " * 60_000, "en", "s", 120_000)], docs.schema)
    for name, stage in pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0
        got = stage(spark, odd, sf)
        kept = {"toxicity": 5, "exact_dedup": 3, "secret_scan": 5}.get(name)
        assert kept is None or (got.count() == kept and got.columns == docs.columns)
        assert {r.doc_id for r in got.collect()} >= {10**6, 10**6 + 1}


def test_run_keeps_nothing_but_its_last_table(spark, sf):
    """Nor does it delete what others write meanwhile: two runs at once, and a table beside them."""
    shared = Path(common.shared_dir(spark).removeprefix("file:"))
    here = lambda: {str(p.parent.relative_to(shared)) for p in shared.rglob("_SUCCESS")}
    before = here()
    beside = common.materialise(spark.range(5), "beside")
    with ThreadPoolExecutor(2) as pool:
        rows = [f.result() for f in [pool.submit(lambda: sorted(map(tuple, pipeline.run(spark, sf).select("doc_id", "start", "length").collect()))) for _ in range(2)]]
    assert rows[0] == rows[1] and beside.count() == 5
    left = [p for p in here() - before if p.startswith("pipeline")]
    assert len({p.split("/")[0] for p in left}) == 2 and {p.split("/")[1] for p in left} == {"secret_scan"}


def test_columns_may_have_any_name(spark):
    names = ["__blob", "__findings", "__mark", "__fp", "__id", "__hex", "__place", "blob", "findings", "row", "fp", "id", "hex", "place", "n", "bucket", "salt", "a b", "c.d"]
    rows = [(1, "password = hunter2hunter2 and more words here", 0), (2, "password = hunter2hunter2 and more words here", 0), (3, "clean words only", 16), (None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long").withColumns({f"`{n}`" if "." in n else n: F.lit(f"own {n}") for n in names if "." not in n})
    docs = docs.toDF(*docs.columns)
    own = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    for stage, n in ((secret_scan.redact_documents, 4), (simhash.keep_first, 3), (exact_dedup.keep_first, 3)):
        got = stage(docs)
        assert got.columns == docs.columns and got.count() == n
        assert all(r[c] == f"own {c}" for r in got.collect() for c in own)
    assert {r.doc_id: (r.text, r.n_chars) for r in secret_scan.redact_documents(docs).collect()}[3] == ("clean words only", 16)
