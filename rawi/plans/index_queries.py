"""Corpus search answered from an inverted index on disk."""

from __future__ import annotations

from pyspark.sql import functions as F

from rawi.operators import index as I
from rawi.operators.search import Criteria
from rawi.plans.corpus_queries import AND, OR, SQL as CORPUS_SQL, _sql, corpus
from rawi.operators.flow import shared_folder

_BUILT: dict[tuple, I.Index] = {}
#: Small blocks, so that the index of a table of some thousand rows has several.
BLOCK = 4096


def index(spark, sf_dir) -> I.Index:
    """The index of a data folder's documents, built once for an application."""
    docs = corpus(spark, sf_dir)
    key = (spark.sparkContext.applicationId, *sorted(docs.inputFiles()))
    if key not in _BUILT:
        _BUILT[key] = I.build(docs, shared_folder(spark, "index"), BLOCK)
    return _BUILT[key]


def index_search_and(spark, sf_dir):
    return I.search(index(spark, sf_dir), AND).select("poem_idx", "meter", "theme", "poet_name")


def index_search_or(spark, sf_dir):
    return I.search(index(spark, sf_dir), OR).select("poem_idx", "meter", "theme", "poet_era")


def index_search_limit(spark, sf_dir):
    return I.search(index(spark, sf_dir), Criteria(meter="en"), 25).select("poem_idx", "title")


def index_postings(spark, sf_dir):
    """Every value with all ordinals of its rows."""
    ordinals = F.transform("offsets", lambda o: F.lit(BLOCK) * F.col("block").cast("long") + o)
    lists = index(spark, sf_dir).postings.select("attribute", "value", "block", ordinals.alias("ordinals"))
    whole = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("block", "ordinals"))), lambda x: x["ordinals"]))
    return lists.groupBy("attribute", "value").agg(whole.alias("o")).select("attribute", "value", F.size("o").cast("long").alias("n"), F.md5(F.array_join("o", ",").cast("binary")).alias("ordinals"))


QUERIES = {f.__name__: f for f in (index_search_and, index_search_or, index_search_limit, index_postings)}
_VALUES = " UNION ALL ".join(f"SELECT '{a}' AS attribute, lower(trim({a}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS value, ordinal FROM placed" for a in ("meter", "theme", "qafiya", "poet_name", "poet_era"))
SQL = {
    "index_search_and": CORPUS_SQL["corpus_search_and"],
    "index_search_or": CORPUS_SQL["corpus_search_or"],
    "index_search_limit": CORPUS_SQL["corpus_search_limit"],
    "index_postings": _sql(f""", placed AS (SELECT *, row_number() OVER (ORDER BY poem_idx) - 1 AS ordinal FROM corpus), named AS ({_VALUES})
        SELECT attribute, value, count(*) AS n, md5(string_agg(CAST(ordinal AS VARCHAR), ',' ORDER BY ordinal)) AS ordinals FROM named WHERE value <> '' GROUP BY attribute, value"""),
}
