"""Names of all queries, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans import cards, cleaning, flows, graph, landed, market, mentions, scoring, signals


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return market.QUERIES | signals.QUERIES | scoring.QUERIES | flows.QUERIES | graph.QUERIES | cleaning.QUERIES | mentions.QUERIES | cards.QUERIES | landed.QUERIES


def oracle_sql() -> dict[str, str]:
    return market.SQL | signals.SQL | scoring.SQL | flows.SQL | graph.SQL | cleaning.SQL | mentions.SQL | cards.SQL | landed.SQL
