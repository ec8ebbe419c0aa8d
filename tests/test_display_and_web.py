"""Texts made from rows, and web results."""

import json

from pyspark.sql import functions as F

from rawi.functions import display as D
from rawi.operators import web as W


def test_texts(spark):
    row = spark.createDataFrame([("t", "p", "e", "m", "q", "", ["a", "b"], ["x maybe", "y"])], "t string, p string, e string, m string, q string, th string, v array<string>, amb array<string>")
    got = row.select(
        D.example_text(*[F.col(c) for c in ("t", "p", "e", "m", "q", "th", "v")]).alias("example"), D.constraint_text({"meter": F.col("m"), "theme": F.col("th")}).alias("c"), D.clarifications(F.col("amb"), ["maybe"]).alias("a"),
        D.clarifications(F.col("amb"), ["never"]).alias("none"), D.listing(F.col("v"), "Candidate").alias("l"), D.parity_message(F.lit(4)).alias("even"), D.parity_message(F.lit(3)).alias("odd"),
        D.web_example_text(F.col("t"), F.lit("u"), F.lit("s"), F.lit(0.0)).alias("w"), D.narrative_lines(F.lit('{"analysis":["s1"],"final_poem":"f"}')).alias("n"), D.narrative_lines(F.lit("plain")).alias("raw"),
    ).first()
    assert got.example == "t (p, e)\nm | q\na\nb\n" and got.c == "meter: m" and got.a == "- x maybe" and got.none is None
    assert got.l == "Candidate 1:\na\n\nCandidate 2:\nb" and got.even == "even: 2 pairs" and got.odd == "odd: 3 lines"
    assert got.w == "t\nu\ns" and got.n == "s1\nf" and got.raw == "plain"


def test_web(spark):
    page = json.dumps({"organic_results": [{"title": "a", "link": "u1", "snippet": "s"}, {"title": "", "link": "u2"}, {"title": "b", "link": "u3"}, {"title": "c", "link": "u1"}]})
    queries = spark.createDataFrame([(1, "q1"), (2, None)], "query_id long, query string").coalesce(1)
    found = W.results(W.fetch(queries, lambda: W.MockSearch([page])), most=2).cache()
    assert [(r.title, r.total, r.place) for r in found.orderBy("place").collect()] == [("a", 3, 0), ("b", 3, 1)]
    assert W.listing(found).first().text == "1. a\nu1\ns\n\n2. b\nu3\n"
    assert W.distinct_results(W.results(W.fetch(queries, lambda: W.MockSearch([page])))).count() == 2
    judged = spark.createDataFrame([(0, 8.0, True, 2), (1, 6.0, True, 2), (5, 9.0, True, 2), (1, 9.0, None, 2)], "result_index int, relevance_score double, is_worth_following boolean, total int")
    assert W.worth_following(judged).count() == 1
