"""The inverted index against the scan."""

import random
import tempfile
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from rawi.operators import index as I
from rawi.operators.search import Criteria, search

SCHEMA = "poem_idx long, title string, meter string, verses array<string>, qafiya string, theme string, poet_name string, poet_era string, poet_location string, description string, language_type string"


def rows(n=400):
    rng = random.Random(2)
    pick = lambda *x: rng.choice(x)
    return [
        (
            i * 7 % n * 10, f"Title {i}", pick("Kamil", " kamil majzu ", "Tawil", "", None), [f"word{rng.randrange(9)} line", " ", "x"][: rng.randint(0, 3)], pick("q", "l", None), pick("praise", "Praise ", "love"),
            pick("hot", "hot", f"poet {rng.randrange(60)}"), pick("era 1", None), pick("", "Place 1"), None, pick("", "fusha", "dialect"),
        )
        for i in range(n)
    ]


@pytest.fixture(scope="module")
def both(spark):
    corpus = spark.createDataFrame(rows(), SCHEMA)
    return corpus, I.build(corpus, tempfile.mkdtemp(prefix="spark-") + "/index", block=32)


CASES = [
    Criteria(meter="KAMIL"), Criteria(meter="kamil", theme=" praise", poet_name="hot"), Criteria(meter="kamil", poet_name="poet 1", mode="OR"), Criteria(meter="none such"), Criteria(meter="none such", theme="love", mode="OR"),
    Criteria(theme="love", min_verses=2, keywords=("word3", "line")), Criteria(qafiya="q", max_verses=1, language_type="fusha", poet_location="place", keywords=("word3", "title 1"), mode="OR"), Criteria(keywords=("word5",)), Criteria(), Criteria(poet_era="ra 1", poet_name="poet"),
]


@pytest.mark.parametrize("limit", [None, 7])
@pytest.mark.parametrize("case", range(len(CASES)))
def test_index_gives_what_the_scan_gives(both, case, limit):
    corpus, index = both
    want, got = search(corpus, CASES[case], limit), I.search(index, CASES[case], limit)
    assert got.columns == corpus.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_without_named_values_and_blocks(both, monkeypatch):
    corpus, index = both
    for name in ("NAMED_VALUES", "NAMED_BLOCKS", "SENT_ROWS"):
        monkeypatch.setattr(I, name, 1)
    for case in CASES:
        assert sorted(r.poem_idx for r in I.search(index, case).collect()) == sorted(r.poem_idx for r in search(corpus, case).collect())
        if case.meter:
            assert [r.poem_idx for r in I.search(index, case, 5).collect()] == [r.poem_idx for r in search(corpus, case, 5).collect()]


def test_lists_hold_every_row_once(both):
    corpus, index = both
    ordinal = {i: k for k, i in enumerate(sorted(r.poem_idx for r in corpus.collect()))}
    want = {}
    for r in corpus.collect():
        for a in ("meter", "theme", "qafiya", "poet_name", "poet_era"):
            value = (r[a] or "").strip().lower()
            if value:
                want.setdefault((a, value), []).append(ordinal[r.poem_idx])
    got = {}
    for r in index.postings.collect():
        assert r.offsets == sorted(r.offsets) and max(r.offsets) < 32
        got.setdefault((r.attribute, r.value), []).extend(r.block * 32 + o for o in r.offsets)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert {(r.attribute, r.value): (r.n, r.first, r.last, r.n_blocks) for r in index.values.collect()} == {k: (len(v), min(v), max(v), len({o // 32 for o in v})) for k, v in want.items()}


def test_only_blocks_with_matches_are_read(both, spark):
    corpus, index = both
    found = I.search(index, Criteria(poet_name="poet 11"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    blocks = {r.block for r in index.postings.filter("attribute = 'poet_name' AND value = 'poet 11'").collect()}
    total = index.rows.select("block").distinct().count()
    assert "PartitionFilters" in plan and 0 < len(blocks) < total
    first = I.search(index, Criteria(poet_name="hot"), 3)
    told = first._jdf.queryExecution().optimizedPlan().toString()
    assert "block" in told and first.count() == 3
    read = index.rows.filter(F.col("block").isin(list(blocks))).select(F.input_file_name().alias("f")).distinct().count()
    assert read < index.rows.select(F.input_file_name().alias("f")).distinct().count()


def test_empty_corpus_and_second_opening(spark, both):
    corpus, index = both
    path = tempfile.mkdtemp(prefix="spark-") + "/index"
    I.build(corpus.limit(3), path, block=2)
    again = I.opened(spark, path)
    assert again.columns == index.columns and I.search(again, Criteria()).count() == 3
    assert I.search(again, replace(CASES[0], meter="no")).count() == 0
