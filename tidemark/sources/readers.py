"""Sources and sinks: typed scans of landed files, and rows out of nested ones."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PRICES = "market string, ticker string, date date, close double, open double, high double, low double, volume bigint"
PEERS = "market string, ticker string, peer_ticker string, correlation double, rank int"


def padded(ticker: str) -> Column:
    """KR tickers are six digits; others stay."""
    return F.when(F.col("market") == "KR", F.lpad(ticker, 6, "0")).otherwise(F.col(ticker))


def read_prices(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PRICES).csv(path, header=True).withColumn("ticker", padded("ticker"))


def read_peers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PEERS).csv(path, header=True).withColumn("ticker", padded("ticker")).withColumn("peer_ticker", padded("peer_ticker"))


def read_research_pairs(spark: SparkSession, paths: list[str], schema: str, allow_caution: bool = False, limit: int = 200) -> DataFrame:
    """Pairs of several files: the first file wins for each (source_symbol,
    target_symbol, relation); the top ``limit`` by ranking_score."""
    parts = [spark.read.schema(schema).csv(p, header=True).withColumn("_file", F.lit(i)) for i, p in enumerate(paths)]
    d = reduce(DataFrame.unionByName, parts)
    if not allow_caution:
        d = d.where(F.coalesce(F.col("caution"), F.lit("")) == "")
    w = Window.partitionBy("source_symbol", "target_symbol", "relation").orderBy("_file", F.desc_nulls_last("ranking_score"))
    d = d.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_file")
    return d.orderBy(F.desc_nulls_last("ranking_score"), "source_symbol", "target_symbol", "relation").limit(limit)


def latest_package(paths: DataFrame, path: str = "path") -> DataFrame:
    """The newest research_package_* folder by name."""
    name = F.regexp_extract(path, r"(research_package_[^/]*)", 1)
    return paths.select(name.alias("package")).where("package <> ''").agg(F.max("package").alias("package"))


def load_rules(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Pair rules with nested targets as flat edges (id, source, target, direction ...)."""
    return spark.read.schema(schema).json(path).withColumn("target", F.explode("targets")).drop("targets").where("source <> target")


def ingest_new(new: DataFrame, store: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose key isn't stored yet, one a key."""
    return new.dropDuplicates(keys).join(store.select(*keys).distinct(), keys, "left_anti")


def append_if_sent(rows: DataFrame, path: str, by: str) -> None:
    """Append the rows that were sent to a table partitioned ``by`` a column."""
    rows.where("sent").write.mode("append").partitionBy(by).parquet(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path, header=True)


def parse_feed(pages: DataFrame, xml: str = "xml") -> DataFrame:
    """Items of RSS documents: title, summary and url cut to 300, 500 and 500
    characters, tags stripped, the id 16 digits of a SHA-1 of url or text."""
    item = "channel struct<item: array<struct<title: string, description: string, link: string, pubDate: string>>>"
    d = pages.select(F.explode(F.from_xml(xml, item)["channel"]["item"]).alias("i"))
    plain = lambda c, n: F.substring(F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]*>", " "), r"\s+", " ")), 1, n)
    d = d.select(plain(F.col("i.title"), 300).alias("title"), plain(F.col("i.description"), 500).alias("summary"), F.substring(F.coalesce("i.link", F.lit("")), 1, 500).alias("url"), F.col("i.pubDate").alias("published"))
    key = F.when(F.col("url") != "", F.col("url")).otherwise(F.concat("title", F.lit(" "), "summary"))
    at = F.try_to_timestamp(F.regexp_replace("published", r"^\w{3}, ", ""), F.lit("d MMM yyyy HH:mm:ss Z"))
    return d.withColumn("external_id", F.substring(F.sha1(key), 1, 16)).withColumn("published_at", at).drop("published")


def page_links(pages: DataFrame) -> DataFrame:
    """page_id, url, n: the targets of the links of HTML pages."""
    links = F.regexp_extract_all("html", F.lit(r'<a [^>]*href="([^"]*)"'), 1)
    return pages.select("page_id", F.explode(links).alias("url")).groupBy("page_id", "url").agg(F.count("*").alias("n"))


def filings_to_items(filings: DataFrame) -> DataFrame:
    """Filings (receipt, company, report, filed as yyyyMMdd) as items."""
    return filings.select(
        F.sha1("receipt").alias("external_id"), F.concat_ws(" ", F.concat(F.lit("["), "company", F.lit("]")), "report").alias("title"), F.try_to_timestamp("filed", F.lit("yyyyMMdd")).alias("published_at"))


def zip_filing_arrays(filings: DataFrame) -> DataFrame:
    """Parallel arrays form, date, accession, items as rows: agreements (item 1.01) of 8-K forms."""
    d = filings.select("company", F.explode(F.arrays_zip("form", "date", "accession", "items")).alias("f")).select("company", "f.*")
    return d.where(F.col("form").isin("8-K", "8-K/A") & F.col("items").contains("1.01"))


def latest_observation(series: DataFrame) -> DataFrame:
    """The last usable value of each series; '.', '0', blanks and nulls aren't."""
    usable = series.where("value is not null and trim(value) not in ('', '.', '0')")
    return usable.groupBy("series").agg(F.max("ts").alias("ts"), F.max_by("value", "ts").alias("value"))


def latest_fact(facts: DataFrame, concepts: list[str], forms: tuple[str, ...] = ("10-K", "10-Q")) -> DataFrame:
    """The newest fact of each company, of the first concept of the list that it reports."""
    rank = F.array_position(F.array(*map(F.lit, concepts)), F.col("concept"))
    w = Window.partitionBy("company").orderBy("_r", F.desc("end"))
    d = facts.withColumn("_r", rank).where((F.col("_r") > 0) & F.col("form").isin(*forms))
    return d.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_r")


def coalesce_sources(key: str, value: str, **sources: DataFrame) -> DataFrame:
    """The first non-null value of each key in the order given, and where it is from."""
    parts = [df.where(F.col(value).isNotNull()).select(key, F.lit(i).alias("_p"), F.lit(name).alias("origin"), value) for i, (name, df) in enumerate(sources.items())]
    d = reduce(DataFrame.unionByName, parts)
    best = F.min_by(F.struct("origin", value), "_p")
    return d.groupBy(key).agg(best.alias("b")).select(key, f"b.{value}", "b.origin")
