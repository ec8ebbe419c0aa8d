"""Requests, settings, stories and the two rhyme detectors on hand-made rows."""

import json

import pytest
from pyspark.sql import functions as F

from rawi.functions import arabic as A
from rawi.operators import requests as R
from rawi.operators import trace as T
from rawi.operators.flow import Flow
from rawi.operators.providers import MockProvider, RuleProvider
from rawi.sources.settings import settings

FULL = {f: None for f in R.FIELDS} | {"meter": "كامل", "line_count": 4, "theme": "null", "keywords": ["بحر"]}


def test_answers_become_constraints_or_errors(spark):
    answers = {
        "fenced": "so\n```json\n" + json.dumps(FULL, ensure_ascii=False) + "\n```\n{",
        "bare": "x " + json.dumps(FULL | {"line_count": "12"}) + " {y}",
        "short": '{"meter": "a"}',
        "list": json.dumps(FULL | {"sections": {"a": 1}}),
        "prose": "none",
        "open": '{"meter": "a"',
        "array": "[1, 2]",
    }
    rows = spark.createDataFrame([(k, k) for k in answers] + [("null", None)], "id string, prompt string")
    got = {r["id"]: r for r in R.understood(rows, "prompt", lambda: RuleProvider(answers.get)).collect()}
    c = got["fenced"]["constraints"]
    assert (c.meter, c.line_count, c.theme, c.keywords, c.sections) == ("كامل", 4, None, ["بحر"], [])
    assert got["bare"]["constraints"].line_count == 12
    assert got["short"]["error"].startswith("missing: qafiya, line_count")
    assert got["list"]["error"] == "not a list: sections"
    assert {got[k]["error"] for k in ("prose", "open", "array", "null")} == {"no JSON object"}
    assert got["prose"]["constraints"] is None


def test_a_failing_model_is_an_error_value(spark):
    def fail(_):
        raise OSError("away")

    rows = spark.createDataFrame([(1, "p")], "id int, prompt string")
    assert R.understood(rows, "prompt", lambda: RuleProvider(fail)).first()["error"] == "OSError: away"


def test_only_unknown_meters_are_asked_for(spark):
    rows = spark.createDataFrame([(1, "كامل", "x", 9), (2, None, "غزل", 8), (3, "?", None, 7)], "id int, meter string, theme string, tone int")
    said = lambda p: '{"meter_name": "Rajaz"}' if "غزل" in p else "{}"
    got = {r.id: r for r in R.with_meter(rows, lambda: RuleProvider(said)).collect()}
    assert (got[1].meter, got[1].tone, got[1].error) == ("كامل", 9, None)
    assert got[1].feet_text.split()[0] == "Mutafaelon"
    assert (got[2].meter, got[2].feet_text) == ("Rajaz", "Mustafelon Mustafelon Mustafelon")
    assert (got[3].meter, got[3].error) == (None, "no meter name")


def test_enrichment_without_sources_passes_through(spark):
    rows = spark.createDataFrame([(1, "a")], "id int, meter string")
    out = R.enriched(rows, "id", {})
    assert [tuple(r) for r in out.collect()] == [(1, "a", False)]
    assert R.sources_of({"data_enrichment": {"sources": [{"type": "corpus"}]}}) == [{"type": "corpus"}]
    assert R.sources_of({}, [{"type": "web_search"}]) == [{"type": "web_search"}]


def test_corpus_examples_hold_all_values(spark):
    corpus = spark.createDataFrame([(i, f"t{i}", m, q) for i, (m, q) in enumerate([("Kamel", "l"), ("kamel long", "m"), (None, "l"), ("Kamel", "l"), ("", "l")])], "poem_idx long, title string, meter string, qafiya string")
    asked = spark.createDataFrame([(1, "KAMEL", None), (2, "kamel", "l"), (3, None, "l"), (4, None, " "), (5, "zz", None)], "id int, meter string, qafiya string")
    got = {r.id: [e.poem_idx for e in r.examples] for r in R.corpus_examples(asked, "id", corpus, ["meter", "qafiya"], 2).collect()}
    assert got == {1: [0, 1], 2: [0, 3], 3: [0, 2]}
    assert R.corpus_examples(asked, "id", corpus.limit(0), ["meter"], 2).count() == 0


def test_rewriting_and_repair_keep_what_a_model_does_not_change(spark):
    poems = spark.createDataFrame([(1, ["a"]), (2, [])], "id int, verses array<string>")
    assert [r.verses for r in R.rewritten(poems, F.lit("p"), lambda: MockProvider([""])).orderBy("id").collect()] == [["a"], []]
    assert [r.verses for r in R.rewritten(poems, F.lit("p"), lambda: MockProvider(["x\n\ny"])).collect()] == [["x", "y"]] * 2
    rows = spark.createDataFrame([("a", "b", None), ("c", "d", "rhyme")], "first string, second string, reason string")
    got = {tuple(r) for r in R.repaired_pairs(rows, lambda: MockProvider(["e\nf\ng"])).collect()}
    assert got == {("a", "b", None), ("e", "f", "rhyme")}


def test_stories_take_the_last_poem(spark):
    rows = [("x", 1, "n1", "ask", "c"), ("x", 2, "n2", "b", "poem one"), ("x", 3, "n3", None, "poem two, Quality 5"), ("y", 1, "n", "p", None)]
    calls = spark.createDataFrame(rows, "id string, step int, name string, given string, made string").withColumn("why", F.lit("w"))
    got = {r.id: r for r in T.story(calls, "id", "name", "given", "made", "why").collect()}
    assert (got["x"].prompt, got["x"].constraints, got["x"].poem, got["x"].quality) == ("ask", "c", "poem two, Quality 5", "poem two, Quality 5")
    assert got["x"].steps.startswith("Step 1: n1\nInput: ask\nOutput: c\nReasoning: w\n\n\nStep 2")
    assert (got["y"].constraints, got["y"].poem) == ("No constraints available", "No poem generated")
    out = {r.execution_id: json.loads(r.json) for r in T.exported(calls, "id", "name", "made").collect()}
    assert [c["step"] for c in out["x"]["calls"]] == [1, 2, 3]
    assert out["y"]["calls"][0]["made"] is None


@pytest.mark.parametrize(
    "ends,doubled,loose",
    [
        ([], None, None),
        (["بدر"], None, None),
        (["مدّر", "مدّر"], "مد", None),
        (["مدّر", "قدر"], "ر", None),
        (["قمر", "شجر"], None, "ر"),
        (["قمرَ", "شجر"], None, "َر"),
        (["قمر", "عمر"], None, None),
        (["قمور", "شجر"], None, None),
        (["مر", "شر"], None, None),
        (["شجرة", "حملة"], None, "ه"),
    ],
)
def test_rhyme_detectors(spark, ends, doubled, loose):
    d = spark.createDataFrame([(ends,)], "ends array<string>")
    assert tuple(d.select(A.doubled_rhyme(F.col("ends")), A.loose_rhyme(F.col("ends"))).first()) == (doubled, loose)


def test_settings():
    text = '{"data": {"rhyme_dict_path": "${ROOT}/r"}, "llm": {"openai": {"model": "m"}}, "serving": {"port": 1}}'
    got = settings(text, {"ROOT": "/d", "SERPAPI_KEY": "k", "OPENAI_API_KEY": "o"})
    assert (got.data.rhyme_dict_path, got.data.search_api_key, got.data.enable_search) == ("/d/r", "k", True)
    assert got.llm == {"openai": {"model": "m", "api_key": "o"}}
    assert got.rest == {"serving": {"port": 1}}
    assert settings("", {}).data.enable_search is False
    with pytest.raises(ValueError, match="typo"):
        settings('{"data": {"typo": 1}}', {})


def test_flows_tell_how_they_ended(spark):
    flow = Flow().then("double", lambda d: d.withColumn("x", F.col("x") * 2), ("x",)).then("more", lambda d: d.withColumn("y", F.lit(1)))
    rows = spark.createDataFrame([(1,)], "x int")
    assert flow.attempt(rows, lambda d: d.first().x) == {"success": True, "result": 2, "error": None, "nodes": ["double", "more"]}
    bad = flow.attempt(rows.select(F.col("x").alias("z")), lambda d: d.count())
    assert (bad["success"], bad["result"], bad["error"]) == (False, None, "ValueError: double needs x")
