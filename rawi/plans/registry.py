"""Queries over the library's own operators, with the SQL they are checked against.

Each module of ``MODULES`` has ``QUERIES`` (name -> function of (spark, sf_dir))
and ``SQL`` (name -> text) where SQL can express the result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rawi.plans import answer_queries, corpus_queries, data_queries, flow_queries, index_queries, meter_queries, request_queries, rhyme_queries, stream_queries, verse_queries

MODULES = (corpus_queries, rhyme_queries, data_queries, verse_queries, flow_queries, meter_queries, answer_queries, request_queries, index_queries, stream_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: fn for m in MODULES for name, fn in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
