"""Retrieval rounds against a plain loop, search as a data source, and the template catalogue."""

import json
import os
import sys
import tempfile
import time

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from rawi.operators import web as W
from rawi.sources import search_source as S
from rawi.sources import templates as T
from rawi.sources.files import resolve_template

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def rule(query):
    if "none" in query:
        return []
    return [(f"t {query}", f"u{(len(query) * 7 + i * 3) % 11}", query) for i in range(5)]


def brute(requests, max_rounds, max_queries, per_query):
    kept, summary = [], []
    for key, words in requests:
        seen = set()
        for number in range(1, max_rounds + 1):
            queries = [f"{w}{'!' * number}" for w in words if w is not None][:max_queries]
            found = []
            for q in queries:
                for t, u, s in rule(q)[:per_query]:
                    if u not in seen:
                        seen.add(u)
                        found.append((t, u))
            scores = [(len(u) + key + k) % 11 for k, (_, u) in enumerate(found)]
            good = [(key, k, t, u, number, s) for k, ((t, u), s) in enumerate(zip(found, scores, strict=True)) if s >= 7]
            kept += good
            summary.append((key, number, len(queries), len(found), len(good)))
            if not any(s % 3 == 0 for s in scores):
                break
    return sorted(kept), sorted(summary)


@pytest.mark.parametrize(("max_rounds", "max_queries"), [(1, 5), (4, 2), (6, 1)])
def test_rounds_like_a_loop(spark, max_rounds, max_queries):
    requests = [(1, ["a", "bb", "ccc"]), (2, ["none"]), (3, []), (4, ["x", None, "yyyy"]), (8, ["long word", "b", "c", "d", "e", "f"])]
    df = spark.createDataFrame(requests, "id long, words array<string>")
    ask = lambda open_, k: open_.select("id", F.posexplode("words").alias("query_no", "w")).select("id", "query_no", F.concat("w", F.lit("!" * k)).alias("query"))

    def judge(found):
        score = (F.length("url") + F.col("id") + F.col("result_index")) % 11
        return found.withColumns({"relevance_score": score.cast("double"), "is_worth_following": F.lit(True), "followup_needed": score % 3 == 0})

    got = W.rounds(df, "id", ask, lambda: W.RuleSearch(rule), judge, max_rounds, max_queries, 3)
    kept, summary = brute(requests, max_rounds, max_queries, 3)
    assert sorted((r.id, r.result_index, r.title, r.url, r["round"], int(r.relevance_score)) for r in got.kept.collect()) == kept
    assert sorted(map(tuple, got.summary.collect())) == summary
    assert len(got.kept._jdf.queryExecution().optimizedPlan().toString()) < 4000 * max_rounds, "no round holds the plan of another"


def test_no_requests(spark):
    got = W.rounds(spark.createDataFrame([], "id long, words array<string>"), "id", None, None, None)
    assert got.kept.count() == got.summary.count() == 0


CLIENT = '''
import json


class Client:
    """Fails for some queries, once or always."""

    calls = {}

    def search(self, query, n):
        self.calls[query] = self.calls.get(query, 0) + 1
        if query == "bad" or query == "shaky" and self.calls[query] < 3:
            raise OSError(f"no answer to {query}")
        if query == "empty":
            return "{}"
        return json.dumps({"organic_results": [{"title": f"{query} {i}", "link": f"u{i}"} for i in range(n + 2)] + [{"title": " ", "link": "no"}]})
'''


@pytest.fixture(scope="module")
def client(spark):
    path = tempfile.mkdtemp(prefix="spark-") + "/made_search_client.py"
    with open(path, "w") as f:
        f.write(CLIENT)
    spark.sparkContext.addPyFile(path)
    return "made_search_client:Client"


def test_search_as_a_source(spark, client):
    S.register(spark)
    read = spark.read.format("rawi_search").options(queries=json.dumps(["a", "bad", "shaky", "empty", "é"]), client=client, partitions=2, results=2)
    got = sorted(map(tuple, read.load().collect()), key=lambda r: (r[0], r[2] or 0))
    assert got == [
        (0, "a", 0, "a 0", "u0", "", None), (0, "a", 1, "a 1", "u1", "", None), (1, "bad", None, None, None, None, "OSError: no answer to bad"),
        (2, "shaky", 0, "shaky 0", "u0", "", None), (2, "shaky", 1, "shaky 1", "u1", "", None), (3, "empty", None, None, None, None, None), (4, "é", 0, "é 0", "u0", "", None), (4, "é", 1, "é 1", "u1", "", None),
    ]
    assert spark.read.format("rawi_search").option("queries", "[]").load().count() == 0


def test_the_source_gives_what_fetch_gives(spark):
    S.register(spark)
    queries = ["one", "two words", "three"]
    source = spark.read.format("rawi_search").option("queries", json.dumps(queries)).load()
    assert source.rdd.getNumPartitions() == 3
    fetched = W.results(W.fetch(spark.createDataFrame(list(enumerate(queries)), "query_id long, query string"), W.MockSearch))
    columns = ["query", "place", "title", "url", "snippet"]
    assert sorted(map(tuple, source.select(*columns).collect())) == sorted(map(tuple, fetched.select(*columns).collect()))


def test_requests_are_paced(client):
    reader = S.SearchReader({"queries": json.dumps(["a", "b", "c"]), "client": client, "pause_ms": "50", "partitions": "1"})
    began = time.monotonic()
    list(reader.read(reader.partitions()[0]))
    assert time.monotonic() - began >= 0.1
    with pytest.raises(ValueError):
        S.SearchReader({"results": "0"})


FILES = {
    "generation/poem.yaml": "name: poem\ndescription: d\ntemplate: 'Write {meter} on {theme}, {meter}'\n",
    "generation/poem_en.yaml": "name: poem_en\ndescription: d\ntemplate: English {theme}\nmetadata: {version: 1}\n",
    "evaluation/deep/judge.yaml": "name: judge\ndescription: d\ntemplate: no parameters\nmetadata: {language: english}\n",
    "search/find_ar.yaml": "name: find\ndescription: d\ntemplate: 'x {a_1} {b c}'\n",
    "search/broken.yaml": "name: [",
    "search/half.yaml": "name: half\ntemplate: t\n",
    "search/list.yaml": "- 1\n- 2\n",
    "search/empty.yaml": "",
    "elsewhere/lost.yaml": "name: lost\ndescription: d\ntemplate: t\n",
    "search/readme.txt": "name: no",
}


def test_catalogue(spark):
    root = tempfile.mkdtemp(prefix="spark-")
    for name, text in FILES.items():
        os.makedirs(os.path.dirname(f"{root}/{name}"), exist_ok=True)
        with open(f"{root}/{name}", "w") as f:
            f.write(text)
    found = T.catalogue(spark, root)
    sound = {r.name: r for r in T.chosen(found).collect()}
    assert {n: (r.base, r.category, r.language, r.parameters) for n, r in sound.items()} == {
        "poem": ("poem", "generation", "arabic", ["meter", "theme"]), "poem_en": ("poem", "generation", "english", ["theme"]), "judge": ("judge", "evaluation", "english", []), "find": ("find", "search", "arabic", ["a_1"]),
    }
    assert json.loads(sound["poem_en"].metadata) == {"version": 1}
    bad = {r.path.rsplit("/", 1)[-1]: r.error for r in T.broken(found).collect()}
    assert set(bad) >= {"broken.yaml", "half.yaml", "list.yaml", "lost.yaml"} and "description" in bad["half.yaml"] and "category" in bad["lost.yaml"]
    assert [r.name for r in T.names(found).collect()] == ["find", "judge", "poem", "poem_en"]
    assert [r.name for r in T.names(found, "english").collect()] == ["judge", "poem_en"]
    assert [r.name for r in T.chosen(found, "generation", "english").collect()] == ["poem_en"]
    assert resolve_template(T.chosen(found), "poem", "english").first().name == "poem_en"
    assert resolve_template(T.chosen(found), "judge", "arabic").first().name == "judge"
