"""Readers on small files, and streams that arrive in several batches."""

import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.operators import pairs
from tidemark.sources import readers, store
from tidemark.streaming import flows


def put(path, content):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(content, encoding="utf-8")
    return str(path)


def test_prices_keep_leading_zeros(spark, tmp_path):
    p = put(tmp_path / "p.csv", "market,ticker,date,close,open,high,low,volume\nKR,5930,2024-01-02,1.5,1,2,1,10\nUS,ABC,2024-01-02,,1,2,1,10\n")
    assert [(r.ticker, r.close) for r in readers.read_prices(spark, p).orderBy("market").collect()] == [("005930", 1.5), ("ABC", None)]


def test_first_file_wins(spark, tmp_path):
    head = "source_symbol,target_symbol,relation,ranking_score,caution\n"
    a = put(tmp_path / "a.csv", head + "A,B,UP,1.0,\nA,C,UP,9.0,thin\n")
    b = put(tmp_path / "b.csv", head + "A,B,UP,5.0,\nA,D,UP,2.0,\n")
    schema = "source_symbol string, target_symbol string, relation string, ranking_score double, caution string"
    got = [(r.target_symbol, r.ranking_score) for r in readers.read_research_pairs(spark, [a, b], schema).collect()]
    assert got == [("D", 2.0), ("B", 1.0)]
    assert readers.read_research_pairs(spark, [a, b], schema, allow_caution=True, limit=1).first().target_symbol == "C"


def test_rules_and_feeds(spark, tmp_path):
    p = put(tmp_path / "r.json", '{"id": "r1", "source": "A", "targets": ["A", "B", "C"], "direction": "UP"}\n')
    rules = readers.load_rules(spark, p, "id string, source string, targets array<string>, direction string")
    assert sorted(r.target for r in rules.collect()) == ["B", "C"]
    xml = "<rss><channel><item><title>One &lt;b&gt;x&lt;/b&gt;</title><link>http://a</link><pubDate>Tue, 02 Jan 2024 03:04:05 +0000</pubDate></item><item><title>Two</title></item></channel></rss>"
    feed = {r.title: r for r in readers.parse_feed(spark.createDataFrame([(xml,), (None,)], "xml string")).collect()}
    assert set(feed) == {"One x", "Two"} and feed["Two"].published_at is None
    assert feed["One x"].published_at == datetime.datetime(2024, 1, 2, 3, 4, 5) and len(feed["Two"].external_id) == 16


def test_filings_and_facts(spark):
    f = spark.createDataFrame([("c", ["8-K", "10-K"], ["d1", "d2"], ["a1", "a2"], ["1.01,9.01", "1.01"])], "company string, form array<string>, date array<string>, accession array<string>, items array<string>")
    assert [r.accession for r in readers.zip_filing_arrays(f).collect()] == ["a1"]
    g = spark.createDataFrame([("c", "y", "10-K", "2024", 1.0), ("c", "x", "10-Q", "2022", 2.0), ("c", "x", "10-K", "2023", 3.0), ("c", "x", "8-K", "2025", 4.0)], "company string, concept string, form string, end string, value double")
    assert readers.latest_fact(g, ["x", "y"]).first().value == 3.0
    s = spark.createDataFrame([("a", 1, "5"), ("a", 2, "."), ("a", 3, None)], "series string, ts int, value string")
    assert [tuple(r) for r in readers.latest_observation(s).collect()] == [("a", 1, "5")]


def test_store_and_precedence(spark, tmp_path):
    new = spark.createDataFrame([("t", 1), ("t", 1), ("t", 2)], "source_type string, external_id long")
    assert [r.external_id for r in readers.ingest_new(new, new.where("external_id = 1"), ["source_type", "external_id"]).collect()] == [2]
    a = spark.createDataFrame([(1, 1.0), (2, None)], "symbol long, price double")
    b = spark.createDataFrame([(2, 5.0), (1, 9.0)], "symbol long, price double")
    assert sorted(map(tuple, readers.coalesce_sources("symbol", "price", first=a, second=b).collect())) == [(1, 1.0, "first"), (2, 5.0, "second")]
    rows = spark.createDataFrame([(1, True, "d"), (2, False, "d")], "id long, sent boolean, day string")
    readers.append_if_sent(rows, str(tmp_path / "h"), "day")
    readers.append_if_sent(rows, str(tmp_path / "h"), "day")
    assert [r.id for r in spark.read.parquet(str(tmp_path / "h")).collect()] == [1, 1]
    readers.write_csv(rows, str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == 2


def test_latest_package(spark):
    p = spark.createDataFrame([("/x/research_package_20240101/a.csv",), ("/x/research_package_20240301/a.csv",), ("/y",)], "path string")
    assert readers.latest_package(p).first().package == "research_package_20240301"


def test_quiet_period_holds_across_batches(spark, tmp_path):
    t0 = datetime.datetime(2024, 1, 1)
    minutes = [0, 60, 200, 319, 460, 600]
    rows = spark.createDataFrame([("A", t0 + datetime.timedelta(minutes=m), i) for i, m in enumerate(minutes)], "symbol string, ts timestamp, id long")
    for k in range(3):  # three files, one a batch
        rows.where(F.col("id").between(2 * k, 2 * k + 1)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = flows.latest_quiet(stream, str(tmp_path / "out"))
    assert sorted(r.id for r in got.collect()) == sorted(r.id for r in pairs.quiet(rows).collect()) == [0, 2, 4, 5]


def test_bars_are_updated_by_later_batches(spark, tmp_path):
    t0 = datetime.datetime(2024, 1, 1)
    rows = spark.createDataFrame([("A", t0 + datetime.timedelta(minutes=m), i, float(i)) for i, m in enumerate((0, 10, 20, 250))], "symbol string, ts timestamp, id long, price double")
    for k in range(4):
        rows.where(F.col("id") == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = flows.latest(flows.bars(stream), str(tmp_path / "out"), ["symbol", "ts"]).orderBy("ts").collect()
    assert [(r.open, r.high, r.close, r.volume) for r in got] == [(0, 2, 2, 3), (3, 3, 3, 1)]


def test_merges_touch_their_own_buckets(spark, tmp_path):
    path, keys, folds = f"{tmp_path}/store", ["k"], {"n": "sum", "last": "max"}
    frame = lambda rows: spark.createDataFrame(rows, "k long, n long, last long")
    assert store.read_store(spark, path) is None
    assert store.merge(frame([(i, 1, i) for i in range(200)] + [(None, 5, 1)]), path, keys, folds, 8) == 0
    files = lambda: {p: p.stat().st_mtime_ns for p in (tmp_path / "store" / "data").rglob("*.parquet")}
    old, first = files(), store.manifest(spark, path, 0)["buckets"]
    assert store.merge(frame([(7, 2, 99), (7, 1, 3), (500, 1, 1)]), path, keys, folds) == 1
    second = store.manifest(spark, path, 1)["buckets"]
    moved = {b for b in first if first[b] != second[b]}
    assert 1 <= len(moved) <= 2 and all(files()[p] == t for p, t in old.items())  # no file that was there has changed
    got = {r.k: (r.n, r["last"]) for r in store.read_store(spark, path).collect()}
    assert got[7] == (4, 99) and got[500] == (1, 1) and got[None] == (5, 1) and len(got) == 202
    assert {r.k: r.n for r in store.read_store(spark, path, 0).collect()}[7] == 1  # the version before is still whole
    with pytest.raises(FileExistsError):
        store.commit(spark, path, 1, {})
    assert store.merge(frame([]), path, keys, folds) == 2 and store.read_store(spark, path).count() == 202
