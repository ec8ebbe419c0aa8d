"""Web search as a Spark data source.

``spark.read.format("rawi_search").option("queries", ...).load()`` reads a row per
result.  Options: ``queries`` (a JSON array of texts), ``client`` (``module:callable``
that makes a search client; the mock if not given), ``partitions``, ``results`` a
query, ``retries``, ``pause_ms`` between two requests of a partition.  A query that
fails after all retries is a row with an ``error``, so it does not end the read; a
query without results is a row without a place.  Queries are option text, so there are
as many as a driver can hold; ``operators.web.fetch`` searches for a table of them.
"""

from __future__ import annotations

import json
import time
from importlib import import_module

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Queries(InputPartition):
    """The queries of a partition with their numbers."""

    def __init__(self, queries: list[tuple[int, str]]):
        self.queries = queries


class SearchReader(DataSourceReader):
    def __init__(self, options: dict):
        self.queries = json.loads(options.get("queries", "[]"))
        self.client = options.get("client", "rawi.operators.web:MockSearch")
        self.n_partitions, self.results = int(options.get("partitions", "8")), int(options.get("results", "10"))
        self.retries, self.pause = int(options.get("retries", "2")), float(options.get("pause_ms", "0")) / 1000
        if self.n_partitions < 1 or self.results < 1 or self.retries < 0:
            raise ValueError("partitions and results are at least 1, retries at least 0")

    def partitions(self) -> list[InputPartition]:
        numbered = list(enumerate(self.queries))
        return [Queries(numbered[k :: self.n_partitions]) for k in range(min(self.n_partitions, max(1, len(numbered))))]

    def read(self, partition: Queries):
        module, _, name = self.client.partition(":")
        client, last = getattr(import_module(module), name)(), None
        for number, query in partition.queries:
            page = error = None
            for _ in range(self.retries + 1):
                if last is not None:
                    time.sleep(max(0.0, self.pause - (time.monotonic() - last)))
                last = time.monotonic()
                try:
                    page, error = json.loads(client.search(query, self.results)), None
                    break
                except Exception as e:  # noqa: BLE001 a search may fail in any way
                    error = f"{type(e).__name__}: {e}"
            found = [r for r in (page or {}).get("organic_results") or [] if (r.get("title") or "").strip() and (r.get("link") or "").strip()]
            if error or not found:
                yield number, query, None, None, None, None, error
            for place, r in enumerate(found[: self.results]):
                yield number, query, place, r["title"], r["link"], r.get("snippet") or "", None


class SearchSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "rawi_search"

    def schema(self) -> str:
        return "query_id int, query string, place int, title string, url string, snippet string, error string"

    def reader(self, schema) -> DataSourceReader:
        return SearchReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session."""
    spark.dataSource.register(SearchSource)
