"""Web retrieval: result parsing, judging gates and rounds, behind a search interface."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rawi.functions.text import strip
from rawi.operators.flow import shared


class Search(Protocol):
    def search(self, query: str, n: int) -> str: ...


class MockSearch:
    """Canned result pages in turn, then one made-up result per query."""

    def __init__(self, pages: list[str] | None = None):
        self.pages = list(pages or [])

    def search(self, query: str, n: int) -> str:
        import json

        if self.pages:
            return self.pages.pop(0)
        return json.dumps({"organic_results": [{"title": f"About {query}", "link": f"https://example.org/?q={query}", "snippet": query}]})


def fetch(queries: DataFrame, make: Callable[[], Search], n: int = 10) -> DataFrame:
    """``queries`` (query_id, query) with the raw result ``page`` of each; failures are null pages."""

    def run(batches):
        import pyarrow as pa

        client = make()
        for batch in batches:
            pages = []
            for query in batch.column("query").to_pylist():
                try:
                    pages.append(client.search(query, min(n, 100)) if query else None)
                except Exception:  # noqa: BLE001 a search may fail in any way
                    pages.append(None)
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("query"), pa.array(pages, pa.string())], names=["query_id", "query", "page"])

    return queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("query").cast("string").alias("query")).mapInArrow(run, "query_id long, query string, page string")


def results(pages: DataFrame, most: int = 10) -> DataFrame:
    """One row per result with title and link, at most ``most`` per query; ``total`` counts them all."""
    shape = "organic_results array<struct<title: string, link: string, snippet: string>>"
    found = F.filter(F.from_json("page", shape)["organic_results"], lambda r: F.coalesce(strip(r["title"]) != "", F.lit(False)) & F.coalesce(strip(r["link"]) != "", F.lit(False)))
    rows = pages.select("query_id", "query", F.size(found).alias("total"), F.posexplode(F.slice(found, 1, most)).alias("place", "r"))
    return rows.select("query_id", "query", "total", "place", F.col("r.title").alias("title"), F.col("r.link").alias("url"), F.coalesce("r.snippet", F.lit("")).alias("snippet"))


def worth_following(judged: DataFrame, least: float = 7) -> DataFrame:
    """Results judged worth following with a score of ``least`` or more, whose index is a result's."""
    inside = (F.col("result_index") >= 0) & (F.col("result_index") < F.col("total"))
    return judged.filter(F.coalesce(F.col("is_worth_following"), F.lit(False)) & (F.col("relevance_score") >= least) & inside)


def verdicts(judged_json: Column) -> Column:
    """Array of verdicts in a judge's JSON answer."""
    return F.from_json(judged_json, "evaluated_results array<struct<result_index: int, relevance_score: double, is_worth_following: boolean>>, followup_needed boolean")["evaluated_results"]


def listing(found: DataFrame) -> DataFrame:
    """Per query the numbered title, url and snippet blocks, in order."""
    block = F.concat((F.col("place") + 1).cast("string"), F.lit(". "), F.col("title"), F.lit("\n"), F.col("url"), F.lit("\n"), F.col("snippet"))
    return found.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", block.alias("b")))), lambda x: x["b"]), "\n\n").alias("text"))


def distinct_results(found: DataFrame) -> DataFrame:
    """The first row of each url by query and place."""
    place = F.row_number().over(Window.partitionBy("url").orderBy("query_id", "place"))
    return found.withColumn("_n", place).filter("_n = 1").drop("_n")


class RuleSearch:
    """Results by a function of the query: a list of (title, link, snippet)."""

    def __init__(self, rule: Callable[[str], list[tuple[str, str, str]]]):
        self.rule = rule

    def search(self, query: str, n: int) -> str:
        import json

        return json.dumps({"organic_results": [{"title": t, "link": u, "snippet": s} for t, u, s in self.rule(query)[:n]]})


@dataclass
class Rounds:
    """Results worth following, and a row for each request and round: queries, results and those that were kept."""

    kept: DataFrame
    summary: DataFrame


def _large(df: DataFrame) -> DataFrame:
    """A side that grows with the requests: joined by a shuffle, not sent to all executors by way of the driver while its files are small."""
    return df.hint("merge")


def rounds(requests: DataFrame, key: str, ask: Callable[[DataFrame, int], DataFrame], make: Callable[[], Search], judge: Callable[[DataFrame], DataFrame], max_rounds: int = 1, max_queries: int = 5, per_query: int = 3, least: float = 7) -> Rounds:
    """Searches for each request, round after round, until nothing more is asked for.

    ``ask(frontier, round)`` gives (key, query_no, query) of the requests that are still
    open; the first ``max_queries`` of each are searched.  A url counts for a request
    once: those of earlier rounds are taken out by an anti-join.  ``judge(found)`` gives
    (key, result_index, relevance_score, is_worth_following, followup_needed) for rows
    (key, result_index, title, url, snippet).  A request stays open if it had results
    and one of its verdicts asks for more.  Frontier, seen urls and results of a round
    are written tables, so the plan of a round does not hold the rounds before it.
    """
    kind = requests.schema[key].dataType.simpleString()
    spark = requests.sparkSession
    kept, told = [], []
    frontier = shared(requests)
    seen = spark.createDataFrame([], f"{key} {kind}, url string")
    for number in range(1, max_rounds + 1):
        if frontier.isEmpty():
            break
        place = F.row_number().over(Window.partitionBy(key).orderBy("query_no"))
        asked = ask(frontier, number).filter("query IS NOT NULL").withColumn("nth", place).filter(F.col("nth") <= max_queries)
        asked = shared(asked.select(key, "query_no", "query").withColumn("query_id", F.monotonically_increasing_id()))
        hits = results(fetch(asked.select("query_id", "query"), make, per_query), per_query).select("query_id", "place", "title", "url", "snippet")
        hits = asked.select("query_id", key, "query_no").join(_large(hits), "query_id")
        first = Window.partitionBy(key, "url").orderBy("query_no", "place")
        new = hits.withColumn("nth", F.row_number().over(first)).filter("nth = 1").join(_large(seen), [key, "url"], "left_anti")
        index = F.row_number().over(Window.partitionBy(key).orderBy("query_no", "place")) - 1
        found = shared(new.select(key, index.alias("result_index"), "title", "url", "snippet", F.lit(number).alias("round")))
        judged = shared(judge(found.drop("round")).select(key, "result_index", "relevance_score", "is_worth_following", "followup_needed"))
        good = judged.filter(F.coalesce("is_worth_following", F.lit(False)) & (F.col("relevance_score") >= least)).select(key, "result_index", "relevance_score")
        good = good.groupBy(key, "result_index").agg(F.max("relevance_score").alias("relevance_score"))
        kept.append(shared(found.join(_large(good), [key, "result_index"])))
        counts = [frontier.select(key)] + [df.groupBy(key).agg(F.count("*").alias(name)) for df, name in ((asked, "n_queries"), (found, "n_found"), (kept[-1], "n_kept"))]
        row = reduce(lambda a, b: a.join(_large(b), key, "left"), counts)
        told.append(shared(row.select(key, F.lit(number).alias("round"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_queries", "n_found", "n_kept")])))
        more = judged.groupBy(key).agg(F.bool_or(F.coalesce("followup_needed", F.lit(False))).alias("more")).filter("more").select(key)
        seen = shared(seen.unionByName(found.select(key, "url")))
        frontier = shared(frontier.join(_large(more), key, "left_semi"))
    if not told:
        return Rounds(spark.createDataFrame([], f"{key} {kind}, result_index int, title string, url string, snippet string, round int, relevance_score double"), spark.createDataFrame([], f"{key} {kind}, round int, n_queries long, n_found long, n_kept long"))
    return Rounds(reduce(DataFrame.unionByName, kept), reduce(DataFrame.unionByName, told))
