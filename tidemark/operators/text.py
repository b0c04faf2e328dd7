"""Text normalisation, quality, polarity and exact de-duplication of items."""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Texts of an Arrow batch that are strings at a time and leave a worker together.
TEXTS = 128


def plain_text(c: Column) -> Column:
    """Entities unescaped and characters in their NFKC form; only texts that have an & or
    anything beyond ASCII go through Python, in Arrow batches."""

    @F.arrow_udf("string")
    def folded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        fold = lambda t: t if t is None else unicodedata.normalize("NFKC", html.unescape(t))
        for texts in batches:
            for k in range(0, len(texts), TEXTS):
                yield pa.array([fold(t.as_py()) for t in texts.slice(k, TEXTS)], pa.string())

    # what the function is not meant for reaches it as null
    c = F.col(c) if isinstance(c, str) else c
    odd = c.rlike("[&\\x{80}-\\x{10FFFF}]")
    return F.coalesce(folded(F.when(odd, c)), c)


def clean_text(c: Column) -> Column:
    """plain_text() without zero-width characters; white space within a line is one space, empty lines go."""
    c = F.regexp_replace(plain_text(c), "[​-‍﻿]", "")
    c = F.regexp_replace(c, r"[ \t\r\f]+", " ")
    return F.trim(F.regexp_replace(c, r" ?\n[ \n]*", "\n"))


def normalise(c: Column) -> Column:
    """clean_text, lower case, without URLs and marks, words separated by one space."""
    c = F.regexp_replace(F.lower(clean_text(c)), r"https?://[^ \n]+", "")
    return F.trim(F.regexp_replace(c, r"[ \n!-/:-@\[-`{-~]+", " "))


def content_hash(c: Column) -> Column:
    return F.sha2(normalise(c), 256)


def canonical_url(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.substring_index(F.substring_index(c, "?", 1), "#", 1), "/+$", ""))


def truncate(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n - 1), F.lit("…"))).otherwise(c)


def strip_html(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", " "), r"[ \t\r\n]+", " "))


def mask_secrets(c: Column) -> Column:
    return F.regexp_replace(c, r"(?i)(password|passwd|secret|token|api_?key)([ \"']*[:=][ \"']*)[A-Za-z0-9+/_.=-]+", "$1$2***")


def count_of(c: Column, words: list[str]) -> Column:
    """How often any of the words stands in the text as a whole word."""
    return F.size(F.regexp_extract_all(c, F.lit(r"\b(" + "|".join(words) + r")\b"), 0))


def keyword_counts(items: DataFrame, words: list[str], text: str = "text") -> DataFrame:
    """keyword, items, hits: from one pass over the texts, tokens joined to the
    broadcast word list (its length is that of ``words``)."""
    tokens = items.select("external_id", F.explode(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")).alias("keyword"))
    hits = tokens.where(F.col("keyword").isin(words)).groupBy("keyword", "external_id").agg(F.count("*").alias("n"))
    return hits.groupBy("keyword").agg(F.count("*").alias("items"), F.sum("n").alias("hits"))


def context_sentiment(c: Column, good: list[str], bad: list[str]) -> Column:
    p, n = count_of(c, good), count_of(c, bad)
    return F.when((p > 0) & (n > 0), "mixed").when(p > 0, "positive").when(n > 0, "negative").otherwise("neutral")


def item_polarity(c: Column, good: list[str], bad: list[str], override: str | None = None) -> Column:
    """More of one kind decides; ties are negative, none at all neutral.  A text that
    matches ``override``, as an explicit recommendation to buy, is positive whatever else it says."""
    p, n = count_of(c, good), count_of(c, bad)
    told = F.when(p + n == 0, "neutral").when(p > n, "positive").otherwise("negative")
    return F.when(c.rlike(override), "positive").otherwise(told) if override else told


#: Fixed value: three and more emoji in a row.
EMOJI = r"[\x{1F300}-\x{1F9FF}\x{2600}-\x{27BF}]{3,}"


def item_quality(source: Column, text: Column, trusted: list[str], good: list[str], bad: list[str], marks: list[str]) -> Column:
    """-10 with a mark of our own, -5 for nothing but a URL; else 3 for a trusted source, 1 for each good
    keyword, -3 for each bad one, -2 for emoji with little text, -3 under 15 and -1 under 30 characters."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    n = F.length(t)
    has = lambda w: F.instr(t, w) > 0
    rules = [F.when(source.isin(trusted), 3).otherwise(0), F.when(t.rlike(EMOJI) & (n < 80), -2).otherwise(0), F.when(n < 15, -3).when(n < 30, -1).otherwise(0)]
    rules += [F.when(has(w), 1).otherwise(0) for w in good] + [F.when(has(w), -3).otherwise(0) for w in bad]
    own = reduce(lambda a, b: a | b, (has(m) for m in marks), F.lit(False))
    return F.when(own, -10).when(t.rlike(r"^https?://\S+$"), -5).otherwise(reduce(lambda a, b: a + b, rules))


def dedupe_exact(items: DataFrame) -> DataFrame:
    """The newest, then longest, item of each normalised text; empty ones go."""
    keys = items.select("external_id", "published_at", F.length("text").alias("size"), normalise(F.col("text")).alias("_norm")).where("_norm <> ''")
    newest = keys.groupBy(F.sha2("_norm", 256).alias("hash")).agg(F.max_by("external_id", F.struct("published_at", "size", -F.col("external_id"))).alias("external_id"))
    return items.join(newest, "external_id")  # texts move only for the join, and not at all where the keys fit a broadcast


def hash_groups(items: DataFrame) -> DataFrame:
    return items.groupBy(content_hash("text").alias("hash")).agg(F.count("*").alias("n"), F.countDistinct("source_name").alias("sources"), F.min("external_id").alias("first_id"))


def source_stats(items: DataFrame, quality: Column) -> DataFrame:
    return items.withColumn("_q", quality).groupBy("source_name").agg(F.count("*").alias("n"), F.sum((F.col("_q") < 0).cast("int")).alias("dropped"), F.avg("_q").alias("mean_quality"))


def lint_lines(items: DataFrame) -> DataFrame:
    """Lines that stand twice or more in one item, with their count and first place."""
    lines = items.select("external_id", F.posexplode(F.split("text", "\n")).alias("k", "line")).where("trim(line) <> ''")
    return lines.groupBy("external_id", "line").agg(F.count("*").alias("times"), F.min("k").alias("first_line")).where("times >= 2")


def adjacent_duplicates(items: DataFrame) -> DataFrame:
    """Lines of each item without those that repeat the line before."""
    lines = items.select("external_id", F.posexplode(F.split("text", "\n")).alias("k", "line"))
    before = F.lag("line").over(Window.partitionBy("external_id").orderBy("k"))
    return lines.withColumn("_b", before).where("_b is null or _b <> line").drop("_b")
