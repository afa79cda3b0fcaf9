"""Name -> query over the test tables, and name -> equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from termloom.plans import mining_queries, search_queries, text_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**text_queries.QUERIES, **mining_queries.QUERIES, **search_queries.QUERIES}
ORACLES: dict[str, str] = {**text_queries.ORACLES, **mining_queries.ORACLES, **search_queries.ORACLES}
