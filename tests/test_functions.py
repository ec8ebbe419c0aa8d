"""Text, rhyme, meter and scansion functions on hand-written rows."""

import pytest
from pyspark.sql import functions as F

from rawi.functions import arabic as A
from rawi.functions import scansion as S
from rawi.functions import semi as J
from rawi.functions import text as X
from rawi.operators import corpus as C
from rawi.operators import curate as K
from rawi.operators import flow as W
from rawi.operators import meters as M
from rawi.operators import rhyme as R
from rawi.operators import scores as SC
from rawi.operators import search as Q
from rawi.operators.providers import MockProvider, check_options, generate, provider
from rawi.sources import corpus as SRC
from rawi.sources import files as FI
from rawi.streaming import results as ST


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).first().y


@pytest.fixture(scope="module")
def corpus(spark):
    names = ["poem title", "poem meter", "poem verses", "poem qafiya", "poem theme", "poet name", "poet era", "poet location", "poem language type"]
    data = [
        ("t1", "بحر الكامل", "a\nb\nc", "ق", "love", "ابن المعتز", "Abbasid", "", ""),
        ("t2", "بحر الطويل", "a\nb", "ع", "satire", "ابن المعتز", "Abbasid", "x", "fusha"),
        ("t3", "الكامل", "a\n \nb\nc\nd", "ق", "love", "أحمد شوقي", "Nahda", "", "fusha"),
        ("t4", "الوافر", None, "د", "praise", "المتنبي", "Abbasid", None, None),
    ]
    raw = spark.createDataFrame(data, ", ".join(f"`{n}` string" for n in names))
    return SRC.rename(raw, F.substring("poem title", 2, 1).cast("long"))


def found(df):
    return sorted(r.poem_idx for r in df.collect())


def test_search(corpus):
    assert found(Q.search(corpus, Q.Criteria(meter="الكامل"))) == [1, 3]
    assert found(Q.search(corpus, Q.Criteria(meter="الكامل", theme="love", qafiya="ق"))) == [1, 3]
    assert found(Q.search(corpus, Q.Criteria(meter="الطويل", theme="love", mode="OR"))) == [1, 2, 3]
    assert found(Q.search(corpus, Q.Criteria(theme="none", mode="OR"))) == []
    assert found(Q.search(corpus, Q.Criteria())) == [1, 2, 3, 4]
    assert found(Q.search(corpus, Q.Criteria(meter="الكامل"), 1)) == [1]
    assert found(Q.search(corpus, Q.Criteria(min_verses=3))) == [1, 3]
    assert found(Q.search(corpus, Q.Criteria(min_verses=0, max_verses=2))) == [2, 4]
    assert found(Q.search(corpus, Q.Criteria(language_type="fusha"))) == [1, 2, 3, 4]
    assert found(Q.search(corpus, Q.Criteria(poet_location="x"))) == [2]
    assert found(Q.search(corpus, Q.Criteria(keywords=("d", "t3")))) == [3]
    assert Q.from_constraints({"line_count": 1}).min_verses == 0
    assert Q.should_search([], {}) and not Q.should_search(["meter"], {})


def test_statistics(corpus):
    s = C.statistics(corpus).first()
    assert (s.total, s.n_meter, s.n_theme, s.n_poet_name) == (4, 4, 3, 3)
    assert C.statistics(corpus.filter("poem_idx < 0")).count() == 0
    assert C.sample(corpus, 2).count() == 2 and C.sample(corpus, 10).count() == 4
    assert C.feasibility(corpus, Q.Criteria(meter="x")).first().feasible is False
    assert Q.diverse(corpus, Q.Criteria(meter="الكامل", theme="love"), 3).count() == 3


def test_lines_and_pairs(spark):
    assert one(spark, F.size(X.pairs(X.verses(F.col("x")))), "a\n\nb\nc") == 0
    assert one(spark, F.to_json(X.pairs(X.verses(F.col("x")))), "a\nb") == '[{"first":"a","second":"b"}]'
    assert one(spark, X.final_poem(F.col("x")), "x Final Poem: a\nb\n\nc") == "a\nb"
    assert one(spark, X.final_poem(F.col("x")), "x") is None
    assert one(spark, X.render(F.col("x"), {"a": F.lit("1")}), "{a}{b}") is None
    assert one(spark, X.render(F.col("x"), {"a": F.lit("1")}), "{a}!") == "1!"
    assert one(spark, X.error_kind(F.col("x")), "Quota reached") == "rate_limit"
    assert one(spark, X.known_model(F.col("x"), [("gpt-4", 1), ("gpt", 2)], 3), "gpt-5") == 2


def test_arabic(spark):
    assert one(spark, A.clean_word(F.col("x")), "كِتَابٌ،") == "كتاب"
    assert one(spark, A.clean_word(F.col("x")), "abc") == ""
    assert one(spark, A.rhyme_tail(F.col("x")), "قَلبُ") == "بُ"
    assert one(spark, A.last_consonant(F.col("x")), "كتابي") == "ب"
    assert one(spark, A.without_prefix(F.col("x")), "وَالكتاب") == "الكتاب"
    assert one(spark, A.without_prefix(F.col("x")), "وال") == "وال"
    assert one(spark, A.without_vowel_end(F.col("x")), "كتبوا") == "كتب"
    for key, ok in (("ب", True), ("ا", False), ("بَُ", False), ("x", False), ("َ", False), ("لبُ", True)):
        assert one(spark, A.is_rhyme_key(F.col("x")), key) is ok, key
    assert one(spark, A.one_vowel(F.col("x")), "بَُ") == "بُ"
    assert one(spark, A.letter_name(F.col("x")), "ب") == "الباء" and one(spark, A.letter_name(F.col("x")), "x") == "x"


def test_rhyme_steps(spark):
    d = spark.createDataFrame([("ب", "كتاب"), ("ب", "قلب"), ("بَ", "لعبَ"), ("ب", "")], "rhyme_key string, word string")
    spread = {(r.rhyme_key, r.word) for r in R.spread_bare_keys(d).collect()}
    assert ("بْ", "قلب") in spread and ("بَ", "لعبَ") in spread and all(w for _, w in spread)
    moved = {(r.rhyme_key, r.word) for r in R.move_vowels(spark.createDataFrame([("بُ", "كتابُ")], d.schema)).collect()}
    assert moved == {("بُا", "كتابُ")}
    lines = spark.createDataFrame([(1, 0, "aق"), (1, 1, "bع"), (2, 0, "")], "poem_idx long, pos int, line string")
    assert {r.poem_idx: r.letter for r in R.majority_letter(lines).collect()} == {1: "ق", 2: ""}


#: Line, spelling and pattern, by hand from the reading rules.
READ = (
    ("بَ", "با", "10"), ("بَلْ", "بل", "10"), ("قَمَرٌ", "قمرو", "1110"), ("كِتَابٌ", "كتابو", "11010"), ("قَلْبِي", "قلبي", "1010"), ("وَمَنْزِلِ", "ومنزلي", "110110"),
    ("فِي الْبَيْتِ", "فلبيتي", "101010"), ("لَهُ مَالٌ", "لهو مالو", "1101010"), ("بِهِ", "بهي", "110"), ("شَمْسْ", "شمس", "110"), ("مَدَّ", "مد", "110"), ("رَبُّ", "رب", "110"), ("مَدّ", "مدد", "1010"),
    ("رَبّاً كَ", "رببن كا", "1011010"), ("آمَنَ", "ءامنا", "10110"), ("عِلْمًا", "علمن", "1010"), ("مَا#لِي", "مالي", "1010"), ("بَ ُ", "ب و", "10"), ("كَلِمَةٌ لَ", "كلمتن لا", "1111010"), ("بَُ", "بو", "10"), ("123", "", "0"), ("", "", "0"),
)


@pytest.mark.parametrize("line,spelling,pattern", READ)
def test_lines_read_by_hand(line, spelling, pattern):
    assert S.scanned(line) == (spelling, pattern)


def test_scansion(spark):
    assert S.pattern_of("بَ") == "10" and S.pattern_of("بَلْ") == "10"
    assert S.pattern_of("قَمَرٌ") == "1110"
    assert S.prepared("كِتابًا") == "كِتابً" and S.prepared("كَتَبوا") == "كَتَبو" and S.prepared("هذا") == "هَاذَا"
    rows = spark.createDataFrame([("قَمَرٌ",), ("",), (None,), ("x",)], "line string").select(S.scan("line").alias("s")).collect()
    assert [r.s.pattern for r in rows][:3] == ["1110", "", ""]
    assert S.rhyme_letter("قفا نبك من ذكرى حبيب ومنزل")[0] == "ل"
    assert S.rhyme_letter("سماء")[0] == "ء"
    assert "ridf" in S.rhyme_parts("كتابُ") and "wasl" in S.rhyme_parts("كتابُ")
    got = spark.createDataFrame([("",), ("كتاب",)], "line string").select(S.rhyme("line").alias("r")).collect()
    assert got[0].r.error and got[1].r.letter == "ب"
    assert S.unmarked("بَ") == [] and S.unmarked("ب") == ["unmarked ب"] and S.unmarked("الب") == ["unmarked ب"]


def test_meters(spark):
    assert M.modify("11010", "Qabadh") == "1101" and M.modify("1110110", "Edmaar") == "1010110"
    assert M.modify("1011010", "Qataa") == "101100" and M.modify("11010", "Batr") == "10"
    p = M.line_patterns(spark).cache()
    lengths = {r.meter: r.n for r in M.pattern_bounds(p).collect()}
    assert len(lengths) == 30 and lengths["Taweel"] <= 2592
    assert p.filter("meter = 'Taweel' and pattern = '1101011010101101011011011010110101011010110110'").count() == 1
    assert M.search_meters(M.meters(spark), "rajaz").count() == 4


def test_feet_of_whole_lines(spark, tmp_path):
    from rawi.plans import registry

    beat = "1101011010101101011011011010110101011010110110"
    lines = "\n".join(x.translate({48: "b", 49: "a"}) for x in (beat, beat[:-1], "1010110" * 2))
    spark.createDataFrame([(1, lines)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.queries()["whole_pattern_to_feet"](spark, str(tmp_path)).collect()
    shapes = {(f, c): p for f, c, p in M.foot_rows()}
    feet = [r.feet for r in got if r.pos == 0 and r.meter == "Taweel"]
    assert len(feet) == 1 and "".join(shapes.get(tuple(x.split(":")), M.modify(M.FEET[x.split(":")[0]][0], x.split(":")[1])) for x in feet[0].replace("#", " ").split()) == beat
    assert [r.feet for r in got if r.pos == 1] == [None] and {r.meter for r in got if r.pos == 2} >= {"Rajaz", "RajazManhook"}
    n = {r.meter: r.n for r in registry.queries()["whole_pattern_membership"](spark, str(tmp_path)).collect()}
    assert n["Taweel"] == 1 and n["RajazManhook"] == 1


def test_json_and_html(spark):
    assert one(spark, J.json_text(F.col("x")), 'a ```json\n{"a":1}\n``` b') == '{"a":1}'
    assert one(spark, J.json_text(F.col("x")), 'a {"a":1} b') == '{"a":1}'
    assert one(spark, J.json_text(F.col("x")), "none") is None
    assert one(spark, J.verses_of_response(F.col("x")), '{"verses":["a","b"]}') == ["a", "b"]
    assert one(spark, J.verses_of_response(F.col("x")), "a\n\nb") == ["a", "b"]
    assert one(spark, J.html_text(F.col("x")), "<p>a &amp; b</p><br/><b>c</b>") == "a & b\nc"
    assert one(spark, J.id_of_file(F.col("x")), "poem_12_response.html") == 12
    assert one(spark, J.has_fields(F.col("x"), ["a", "b"]), '{"a":1}') is False


def test_scores(spark):
    d = spark.createDataFrame([("11", "x", "not_json"), (None, None, None)], "a string, b string, c string")
    assert [r.v for r in d.select(SC.valid_single({"a": F.col("a")}).alias("v")).collect()] == [False, False]
    assert one(spark, SC.quality(F.lit(True), F.lit(True), F.lit(None).cast("double")), 1, "int") == pytest.approx(0.3)
    assert one(spark, SC.base_source(F.col("x")), "a_vs_human") == "a"
    items = spark.createDataFrame([(1, "h", "m", None), (2, None, "m", " ")], "id long, human string, a string, b string")
    kinds = sorted((r.item_id, r.source, r.kind) for r in SC.fan_out(items, "id", ["a", "b"]).collect())
    assert kinds == [(1, "a", "comparative"), (1, "a", "single"), (1, "human", "single"), (2, "a", "single")]
    ids = spark.createDataFrame([("26813_gen_1_model_a_single",)], "custom_id string")
    r = SC.decode_id(ids, ["model-a", "human"]).first()
    assert (r.item_id, r.source, r.kind) == ("26813_gen_1", "model-a", "single")


def test_numbering(spark):
    got = {r.id: r.virtual_id for r in K.numbered(spark.range(100, 200), "id").collect()}
    assert got == {100 + i: i for i in range(100)}
    assert K.numbered(spark.range(0), "id").count() == 0
    assert sorted({r.batch for r in K.chunks(spark.range(10), 4, "id").collect()}) == [0, 1, 2]


def test_flow_and_providers(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id long, p string")
    out = {r.id: r.answer for r in generate(df, "p", lambda: MockProvider(["x"])).collect()}
    assert out == {1: "x", 2: None}

    class Broken:
        def generate(self, prompt):
            raise RuntimeError("down")

    assert generate(df, "p", Broken).filter("error like '%down%'").count() == 1
    with pytest.raises(ValueError):
        provider("none")
    with pytest.raises(ValueError):
        check_options(temperature=3)
    registry = W.Registry()

    @registry.add("constant")
    def constant(column, value):
        return lambda d: d.withColumn(column, F.lit(value))

    flow = W.from_config(registry, [{"type": "constant", "column": "c", "value": 1}])
    assert "c" in flow(df).columns and flow.traced(df)[1][0]["component"] == "constant"
    with pytest.raises(ValueError):
        registry.make({"type": "other"})
    with pytest.raises(ValueError):
        W.Flow().then("n", lambda d: d, ("zz",))(df)
    judge = lambda d: d.withColumn("valid", F.length("p") >= 3)
    repair = lambda d: d.withColumn("p", F.concat("p", F.lit("x")))
    r = {x.id: (x.p, x.iteration) for x in W.refine(df, judge, repair, F.col("valid"), 3).collect()}
    assert r == {1: ("axx", 2), 2: (None, 0)}


def test_sources_and_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    line = '{"custom_id":"a","response":{"body":{"choices":[{"message":{"content":"hi"}}]}}}'
    (tmp_path / "in" / "1.jsonl").write_text(line + "\nnot json\n")
    assert [(r.custom_id, r.content) for r in FI.batch_output(spark, str(tmp_path / "in")).collect()] == [("a", "hi")]
    args = (spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"))
    ST.collect_available(*args)
    (tmp_path / "in" / "2.jsonl").write_text(line.replace('"a"', '"b"') + "\n")
    ST.collect_available(*args)
    assert sorted(r.custom_id for r in ST.latest_per_item(spark, str(tmp_path / "out")).collect()) == ["a", "b"]
    assert one(spark, ST.state(F.col("x")), "Validating") == "in_progress"
    (tmp_path / "html").mkdir()
    (tmp_path / "html" / "poem_7_response.html").write_text("<p>x</p>")
    (tmp_path / "html" / "other.html").write_text("y")
    assert [r.poem_id for r in FI.html_pages(spark, str(tmp_path / "html")).collect()] == [7]
    assert FI.substituted("${A}${B}", {"A": "1"}) == "1${B}"
    t = FI.template_table(spark, [{"name": "p_en", "template": "e"}, {"name": "p_ar", "template": "a"}, {"name": "q", "template": "q"}])
    assert FI.resolve_template(t, "p", "english").first().template == "e" and FI.resolve_template(t, "p", "french").first().template == "a"
