"""Steps that must hold on large tables: they agree with their plain twins, and work text by text or without what grows."""

import random
import tempfile
from pathlib import Path
from types import SimpleNamespace

from pyspark.sql import functions as F

from rawi.functions import arabic as A
from rawi.functions import scansion as S
from rawi.operators import index as I
from rawi.operators import web as R
from rawi.operators.search import Criteria
from rawi.plans import answer_queries as W
from rawi.plans import verse_queries as V

CORPUS = "poem_idx long, title string, meter string, verses array<string>, qafiya string, theme string, poet_name string, poet_era string, poet_location string, description string, language_type string"


def test_mark_issues_text_by_text(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choices("ابتلويىكءؤ" + S.MARKS + "ـ xپ\n.،😀", k=rng.randrange(0, 60))) for _ in range(3_000)] + ["", "الل", "ّّ", "بّ", "لاللُ", "ب\nَ", "ب😀َ"]
    got = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select("t", S.mark_issues(F.col("t")).alias("i"), S.n_mark_issues(F.col("t")).alias("n"))
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()  # no list of a whole Arrow batch's issues
    for t, issues, n in got.collect():
        assert issues == S.unmarked(t or "") and n == len(issues), repr(t)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_all_words_of_a_line_are_cleaned_once_at_most(spark):
    rows = [("قلب حبَّ،", "حب"), ("قلب abc !", "قلب"), ("abc", ""), ("", ""), ("  قلب\u0085", "قلب\u0085"), ("قلب\u0085\u0085", ""), (None, "")]
    got = spark.createDataFrame(rows, "line string, want string").select("want", A.last_clean_word(F.col("line")).alias("word"))
    assert [r.word for r in got.collect()] == [r.want for r in got.collect()]
    assert plan(got).count("transform(") == 1


def test_marked_words_cleans_each_distinct_word(spark):
    assert "Aggregate [w#" in plan(W.marked_words(spark, "/root/testdata/sf0.001"))


def test_rounds_send_nothing_that_grows_to_all_executors(spark, monkeypatch):
    plans, shared = [], R.shared
    monkeypatch.setattr(R, "shared", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or shared(df))
    requests = spark.createDataFrame([(1, "a"), (2, "b")], "k long, word string")
    ask = lambda frontier, n: frontier.select("k", F.lit(0).alias("query_no"), F.concat("word", F.lit(f" {n}")).alias("query"))
    judge = lambda found: found.withColumns({"relevance_score": F.lit(8.0), "is_worth_following": F.lit(True), "followup_needed": F.col("k") == 1})
    kept = R.rounds(requests, "k", ask, R.MockSearch, judge, max_rounds=2).kept.collect()
    assert sorted((r.k, r.round, r.title) for r in kept) == [(1, 1, "About a 1"), (1, 2, "About a 2"), (2, 1, "About b 1")]
    assert any("SortMergeJoin" in p for p in plans) and not any("BroadcastHashJoin" in p for p in plans)


def test_index_moves_and_writes_the_rows_once(spark):
    rng = random.Random(3)
    words = [f"{rng.getrandbits(40):x}" for _ in range(4_000)]
    rows = [(k, f"t{k}", rng.choice(["Kamil", "Rajaz"]), rng.sample(words, 200), "q", "love", f"poet {rng.randrange(9)}", "era", "", "", "") for k in [None, None, *range(600), *[7] * 90, -5, 1 << 60, (1 << 60) + 1]]
    path = tempfile.mkdtemp(prefix="spark-")
    spark.createDataFrame(rows, CORPUS).write.parquet(f"{path}/corpus")
    index = I.build(spark.read.parquet(f"{path}/corpus"), f"{path}/index", block=64)
    size = lambda folder: sum(f.stat().st_size for f in Path(folder).rglob("*.parquet"))
    assert size(f"{path}/index/ranges") < size(f"{path}/index/rows") / 10 and "body" not in index.rows.columns
    got = [(r.block * 64 + r.offset, r.poem_idx) for r in index.rows.orderBy("block", "offset").collect()]
    assert [o for o, _ in got] == list(range(len(rows)))
    assert [i for _, i in got] == [None, None] + sorted(r[0] for r in rows if r[0] is not None)


def test_index_of_one_key_and_of_null_keys(spark):
    for keys in ([5] * 300, [None] * 70, [None] * 70 + [3] * 70 + [4]):
        rows = [(k, f"t{i}", "Kamil", [f"line {i}"], "q", "love", "poet", "era", "", "", "") for i, k in enumerate(keys)]
        index = I.build(spark.createDataFrame(rows, CORPUS), tempfile.mkdtemp(prefix="spark-") + "/index", block=16)
        assert sorted(r.block * 16 + r.offset for r in index.rows.collect()) == list(range(len(rows)))
        assert I.search(index, Criteria(meter="kamil", keywords=("line 69",))).count() == 1


def test_words_of_lines_are_read_once(monkeypatch):
    read, unit = [], S._UNIT
    monkeypatch.setattr(S, "_UNIT", SimpleNamespace(findall=lambda text: read.append(len(text)) or unit.findall(text)))
    rng = random.Random(4)
    words = [f"{rng.choice('قفعسهد')}{rng.choice(S.SHORT)}{rng.choice('لمنت')}{rng.choice(S.MARKS)}" for _ in range(20)]
    lines = [" ".join(rng.choices(words, k=30)) for _ in range(200)]
    for line in lines:
        S.scanned(line)
    assert sum(read) < sum(map(len, lines)) / 5


def test_words_read_apart_give_what_the_whole_line_gives(monkeypatch):
    rng = random.Random(6)
    words = ["بَ", "هُ", "هِ", "ه", "#", "#ب", "اً", "بْ", "بّ", "ـ", "قَمَرٌ", "ب", "اٌ", "وا", "بّاً", "ْ", "ُ", "دَرْ", "دَرْسْ", "بُ ", "x", "", "\t"]
    lines = [" ".join(rng.choices(words, k=rng.randrange(0, 9))) for _ in range(4_000)]
    got = [S.scanned(x) for x in lines + lines]
    # without what is kept
    monkeypatch.setattr(S._Reading, "read_word", lambda self, word: self.read(S._UNIT.findall(word + " "), False) or all(u[0] for u in S._UNIT.findall(word + " ")))
    again = [S.scanned(x) for x in lines]
    assert got == again + again


def test_scansion_reads_lines_on_all_cores(spark):
    told = V.scansion(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(doc_id" in told[told.index("ArrowEvalPython") :]
