"""Answers of models and judges, marked words and retrieval, made from the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rawi.functions import arabic as A
from rawi.functions import display as D
from rawi.functions import pages as P
from rawi.functions import semi as J
from rawi.functions import text as X
from rawi.operators import curate as K
from rawi.operators import scores as S
from rawi.operators import search as Q
from rawi.operators import web as W
from rawi.plans.corpus_queries import CORPUS, corpus
from rawi.sources.tables import table


def retrieval_exact(spark, sf_dir):
    return Q.retrieve(corpus(spark, sf_dir), Q.Criteria(meter="en", theme="praise"), 40, "exact_match").select("poem_idx", "meter", "theme")


def retrieval_best(spark, sf_dir):
    return Q.retrieve(corpus(spark, sf_dir), Q.Criteria(meter="fr", theme="satire"), 40).select("poem_idx", "meter", "theme")


def _answers(spark, sf_dir):
    """lineitem as judges' answers: text with a JSON object of the metrics, some of them missing."""
    line = table(spark, sf_dir, "lineitem")
    score = lambda c: F.round(F.col(c) * 100, 2).cast("string")
    parts = F.concat(F.lit('{"meter": '), score("l_discount"), F.when(F.col("l_linenumber") != 2, F.concat(F.lit(', "rhyme": "'), score("l_tax"), F.lit('"'))).otherwise(""), F.lit(', "total": '), F.col("l_quantity").cast("string"), F.lit("}"))
    return line.select("l_orderkey", "l_linenumber", parts.alias("json"))


def flattened_scores(spark, sf_dir):
    """Metric columns from the nested scores of an answer; missing ones are null."""
    return S.flattened(_answers(spark, sf_dir), "json").select("l_orderkey", "l_linenumber", "meter", "rhyme", "beauty", "total")


def all_metrics_valid(spark, sf_dir):
    """Do all eight metrics of a single judgement, and of a pair, lie from 0 to 10?"""
    line = table(spark, sf_dir, "lineitem")
    own = {m: (F.col("l_discount") * 100 + i).cast("string") for i, m in enumerate(S.METRICS)}
    pair = {m: F.array(F.col("l_tax") * 100, F.col("l_discount") * 100 + i) for i, m in enumerate(S.METRICS)}
    return line.groupBy("l_linenumber").agg(F.count_if(S.valid_single(own)).alias("single"), F.count_if(S.valid_pair(pair)).alias("pair"))


def balanced_json(spark, sf_dir):
    """The first whole JSON object in an answer with text and braces behind it."""
    e = table(spark, sf_dir, "events")
    said = F.concat(F.lit("Sure: "), F.col("props"), F.when(F.col("event_id") % 2 == 0, " and {then} more").otherwise(" done"))
    return e.select("event_id", J.first_object(said).alias("json"))


def answer_shapes(spark, sf_dir):
    """Which answers have the required fields, and lists where lists are due?"""
    e = table(spark, sf_dir, "events")
    made = F.concat(F.lit('{"kind": "'), F.col("event_type"), F.lit('", "tags": '), F.when(F.col("event_id") % 3 == 0, '"none"').when(F.col("event_id") % 3 == 1, '["a", "b"]').otherwise("null"), F.when(F.col("event_id") % 5 == 0, "").otherwise(', "id": 1'), F.lit("}"))
    shown = e.select(J.has_fields(made, ["kind", "tags", "id"]).alias("complete"), J.lists_hold(made, ["tags"]).alias("lists"))
    return shown.groupBy("complete", "lists").agg(F.count("*").alias("n"))


def judge_fallback(spark, sf_dir):
    """Verdicts of answers that are JSON, and of prose by keyword."""
    e = table(spark, sf_dir, "events")
    said = F.when(F.col("event_id") % 4 == 0, '```json\n{"is_valid": true}\n```').when(F.col("event_id") % 4 == 1, '{"is_valid": false}').when(F.col("event_id") % 4 == 2, "the verse is correct").otherwise("no idea")
    return e.groupBy(J.verdict_of(said, ["correct", "صحيح"]).alias("valid")).agg(F.count("*").alias("n"))


def response_verses(spark, sf_dir):
    """Verses of answers in JSON, with or without a fence, and of plain answers."""
    d = table(spark, sf_dir, "documents").filter("text is not null")
    told = F.to_json(F.struct(F.split("text", "\n").alias("verses")))
    said = F.when(F.col("doc_id") % 3 == 0, told).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("```json\n"), told, F.lit("\n```"))).otherwise(F.regexp_replace("text", "[{}]", ""))
    v = d.select("doc_id", J.verses_of_response(said).alias("v"))
    return v.select("doc_id", F.size("v").cast("long").alias("n"))


def final_poems(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.regexp_replace("text", r"[ \t\n\x0B\f\r]+", " ").alias("t"))
    said = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("thought\n\nFinal Poem:\n"), "t", F.lit("\n\nbye"))).otherwise(F.col("t"))
    return d.select("doc_id", X.final_poem(said).alias("poem"))


def cleaned_contents(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.regexp_replace("text", "`", "").alias("t"))
    said = F.concat(F.lit("```json\n{}\n```\n\n\n\n"), "t", F.lit("\n\n\n\nend"))
    return d.select("doc_id", F.md5(X.clean_content(said)).alias("digest"))


def rendered_templates(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.when(F.col("doc_id") % 4 == 0, "{poet}, {lang}: {other}").otherwise("{poet} writes {lang}, {poet}").alias("t"))
    return d.select("doc_id", X.render(F.col("t"), {"poet": F.col("source"), "lang": F.col("lang")}).alias("said"))


def parity_messages(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(X.verse_count(X.lines(F.col("text"))).alias("n"))
    return d.groupBy(D.parity_message(F.col("n")).alias("said")).agg(F.count("*").alias("n"))


def clarification_texts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.split("text", "\n").alias("a"))
    return d.select("doc_id", F.md5(D.clarifications(F.col("a"), ["the", "que"])).alias("digest"))


def narrative_texts(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.to_json(F.struct(F.array("event_type", F.lit("next")).alias("analysis"), F.when(F.col("event_id") % 2 == 0, F.col("event_id").cast("string")).alias("final_poem"))).alias("j"))
    return e.select("event_id", D.narrative_lines(F.col("j")).alias("said"))


def candidate_listings(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"].cast("string")).alias("items"))
    return line.select("l_orderkey", F.md5(D.listing(F.col("items"), "Candidate")).alias("digest"))


def marked_words(spark, sf_dir):
    """Counts of words with vowel marks, lengthened by tatweel, after each way of cleaning."""
    text = A.transliterated(F.coalesce("text", F.lit("")))
    rows = table(spark, sf_dir, "documents").select(F.explode(F.split(text, r"\s+")).alias("w")).filter(F.length("w") > 0)
    made = F.regexp_replace(F.regexp_replace("w", "([بتس])", "$1َّ"), "([ةو])", "$1ـٌ")
    rows = rows.groupBy("w").agg(F.count("*").alias("times")).select(made.alias("w"), "times")  # each word is cleaned once
    total = lambda c: F.sum(F.length(c) * F.col("times"))
    return rows.agg(
        F.coalesce(F.sum("times"), F.lit(0)).alias("n"),
        total("w").alias("marked"),
        total(A.strip_marks(F.col("w"))).alias("bare"),
        total(A.strip_tatweel(F.col("w"))).alias("short"),
        total(A.normalise(F.col("w"))).alias("plain"),
        F.coalesce(F.sum(F.when(A.normalise(F.col("w")) == "", F.col("times"))), F.lit(0)).alias("none"),
        total(A.one_vowel(F.concat("w", F.lit("َُ")))).alias("one_vowel"),
    )


def unified_letters(spark, sf_dir):
    """Last letters of lines, with forms of hamza and alif among them, as which they rhyme."""
    last = F.translate(F.lower(F.regexp_extract("line", "([A-Za-z])[^A-Za-z]*$", 1)), "abcdefghijklmnopqrstuvwxyz", "آأإئؤىٱةکیہھبتثجحخدذرزسشصض")
    rows = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n")).alias("line")).select(last.alias("letter"))
    return rows.groupBy("letter").agg(F.count("*").alias("n")).select("letter", A.unified(F.col("letter")).alias("as_letter"), A.letter_name(A.unified(F.col("letter"))).alias("name"), "n")


def _searches(spark, sf_dir):
    """A search per page, for its address without the scheme."""
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("query_id"), F.regexp_replace("url", "^[a-z]+://", "").alias("query"))


def web_results(spark, sf_dir):
    """Result rows of one search per page."""
    return W.results(W.fetch(_searches(spark, sf_dir), W.MockSearch)).select("query_id", F.col("place").cast("long").alias("place"), "title", "url", F.col("total").cast("long").alias("total"))


def web_listings(spark, sf_dir):
    return W.listing(W.results(W.fetch(_searches(spark, sf_dir), W.MockSearch))).select("query_id", F.md5("text").alias("digest"))


def web_verdicts(spark, sf_dir):
    """Verdict rows of judges' JSON answers about results."""
    e = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit('{"evaluated_results": [{"result_index": 0, "relevance_score": '), F.floor(F.col("value") % 11).cast("string"), F.lit(', "is_worth_following": true}, {"result_index": 7, "relevance_score": 9, "is_worth_following": true}]}')).alias("j"))
    rows = e.select("event_id", F.inline(W.verdicts(F.col("j")))).withColumn("total", F.lit(3))
    return W.worth_following(rows).select("event_id", F.col("result_index").cast("long").alias("result_index"), "relevance_score")


def _told_results(query):
    """Four addresses by the digest of a query, some of them the same for other queries."""
    import hashlib

    places = [int(hashlib.md5(f"{query}#{i}".encode()).hexdigest()[:4], 16) % 60 for i in range(4)]
    return [(f"On {query}", f"https://example.org/{p}", f"place {p}") for p in places]


def web_rounds(spark, sf_dir):
    """Up to three rounds of searches for each page, by the words of its address; the judge goes by the digest of page and result."""

    def ask(frontier, number):
        words = F.filter(F.split("url", "[^A-Za-z0-9]+"), lambda w: w != "")
        said = frontier.select("page_id", F.posexplode(F.array_distinct(words)).alias("query_no", "word"))
        return said.select("page_id", "query_no", F.when(F.lit(number) == 1, F.col("word")).otherwise(F.concat("word", F.lit(f" {number}"))).alias("query"))

    def judge(found):
        score = F.conv(F.substring(F.md5(F.concat_ws("|", "page_id", "url")), 1, 4), 16, 10).cast("long") % 11
        return found.withColumns({"relevance_score": score.cast("double"), "is_worth_following": score % 2 == 1, "followup_needed": score == 10})

    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    kept = W.rounds(pages, "page_id", ask, lambda: W.RuleSearch(_told_results), judge, max_rounds=3, max_queries=4).kept
    return kept.select("page_id", F.col("round").cast("long").alias("round"), F.col("result_index").cast("long").alias("result_index"), "title", "url", "relevance_score")


def answer_pages(spark, sf_dir):
    """Response and thinking of answer pages that are made from documents: every other line is thought, some tags are not closed or not opened."""
    sign = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "&", "&amp;"), "<", "&lt;"), ">", "&gt;")
    d = table(spark, sf_dir, "documents").select("doc_id", F.split(F.translate(F.coalesce("text", F.lit("")), "\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\u2028\u2029\xa0", "           "), "\n").alias("v"))
    part = lambda k, tag: F.array_join(F.transform(F.filter("v", lambda x, i: i % 2 == k), lambda x: F.concat(F.lit(f"<{tag}>"), sign(x), F.lit(f"</{tag}>" if tag == "p" else "<br>"))), "")
    thought = F.concat(F.lit('<div class="box thinking"><model-thoughts><div><div class=markdown><style>p{}</style>'), part(1, "p"), F.lit("<!-- </div> --><img src=x></div></div></model-thoughts></div></span>"))
    shown = F.concat(F.when(F.col("doc_id") % 2 == 0, F.lit('<div class="model-response-text">')).otherwise(F.lit("<div>")), F.lit("<div class='markdown main'>"), part(0, "b"), F.lit("</b></div></i></div>"))
    html = F.concat(F.lit('<html><body><div class="other">no</div><div class="response">'), thought, shown, F.lit("</div><div class=response>later"))
    told = d.select("doc_id", P.answer_texts(html).alias("a"))
    lines = lambda c: F.filter(F.split(c, "\n"), lambda x: x != "")
    return told.select("doc_id", F.md5(F.array_join(lines(F.col("a.response")), "\n")).alias("response"), F.md5(F.array_join(lines(F.col("a.thinking")), "\n")).alias("thinking"))


def chosen_answers(spark, sf_dir):
    """Documents by provider and model, and those with thoughts."""
    d = table(spark, sf_dir, "documents").select("source", "lang", "text", F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("a"))).otherwise(F.array().cast("array<string>")).alias("thoughts"))
    return d.groupBy("lang").agg(F.count_if(K.by_model(F.col("lang"), F.col("source"), F.col("text"), "en", "c1")).alias("chosen"), F.count_if(K.with_thoughts(F.col("source"), F.col("thoughts"), "src1")).alias("thoughtful"))


def batch_ids(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.concat(F.when(F.col("o_orderkey") % 2 == 0, "batch_").otherwise("job_"), F.col("o_orderkey").cast("string")).alias("id"), "o_orderstatus")
    return o.filter(K.is_batch_id(F.col("id"))).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.min("id").alias("first"))


def entries_by_poem(spark, sf_dir):
    """Entries of each item in the order of their numbers."""
    return K.entries(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber", "l_partkey").select("l_orderkey", F.array_join(F.transform("entries", lambda x: x.cast("string")), ",").alias("entries"))


def distinct_items(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.countDistinct("l_partkey").alias("items"), F.count_if(F.col("l_quantity") > 25).alias("many"), F.count_if(F.col("l_discount") == 0).alias("plain"))


def resumed_results(spark, sf_dir):
    """Results joined back to their items by the ids that their custom ids hold."""
    items = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    results = table(spark, sf_dir, "lineitem").select(S.custom_id(F.col("l_orderkey"), F.lit("model-a"), F.lit("single")).alias("custom_id"), "l_linenumber", "l_quantity")
    back = S.resumed(results, items, "o_orderkey", ["human", "model-a"])
    return back.select("o_orderkey", "o_orderstatus", "source", "l_linenumber", "l_quantity")


def batch_success(spark, sf_dir):
    done = S.success_rate(table(spark, sf_dir, "orders").withColumn("status", F.when(F.col("o_orderstatus") == "F", "succeeded").otherwise("errored")))
    return done.select("done", "all", F.round("rate", 6).alias("rate"))


def generated_records(spark, sf_dir):
    """Records with new answers; empty answers are dropped and failed ones keep a tag."""
    c = table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("item_id"), F.col("role").alias("prompt"), F.when(F.col("turn") % 3 != 0, F.col("text")).alias("answer"), F.when(F.col("turn") == 2, "boom").alias("error"))
    out = K.generated(c, "item_id", "answer", "error")
    return out.select("instance_id", "prompt", F.md5(F.coalesce("answer", F.lit(""))).alias("digest"))


def error_results(spark, sf_dir):
    """All pairs of a document marked invalid with one message."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.floor(X.verse_count(X.lines(F.col("text"))) / 2).alias("n"))
    return d.select("doc_id", F.explode(K.all_invalid(F.col("n"), F.lit("no rhyme"))).alias("r")).select("doc_id", F.col("r.pair_no").cast("long").alias("pair_no"), "r.valid", "r.message")


def known_models(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.groupBy(X.known_model(F.lower("p_brand"), [("brand#1", 10), ("brand#23", 23), ("brand#2", 20)], 5).alias("size")).agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        retrieval_exact, retrieval_best, flattened_scores, all_metrics_valid, balanced_json, answer_shapes, judge_fallback, response_verses, final_poems, cleaned_contents, rendered_templates, parity_messages,
        clarification_texts, narrative_texts, candidate_listings, marked_words, unified_letters, web_results, web_listings, web_verdicts, web_rounds, answer_pages, chosen_answers, batch_ids, entries_by_poem, distinct_items, resumed_results,
        batch_success, generated_records, error_results, known_models,
    )
}

_N = "len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13)) <> ''))"
_ARABIC = "translate(lower(coalesce(text, '')), 'abcdefghijklmnopqrstuvwxyz', 'ابتثجحخدذرزسشصضطظعغفقكلمنهو')"
_MARKED = rf"""words AS (SELECT regexp_replace(regexp_replace(x, '([بتس])', '\1' || chr(1614) || chr(1617), 'g'), '([ةو])', '\1' || chr(1600) || chr(1612), 'g') AS w FROM (SELECT unnest(string_split_regex({_ARABIC}, '\s+')) AS x FROM documents) WHERE x <> ''),
  forms AS (SELECT w, regexp_replace(w, '[\x{{064B}}-\x{{0652}}]', '', 'g') AS bare, regexp_replace(w, '[^\x{{0621}}-\x{{063F}}\x{{0641}}-\x{{064A}} ]', '', 'g') AS plain FROM words)"""
_LAST = r"translate(lower(regexp_extract(line, '([A-Za-z])[^A-Za-z]*$', 1)), 'abcdefghijklmnopqrstuvwxyz', 'آأإئؤىٱةکیہھبتثجحخدذرزسشصض')"
_UNIFIED = "CASE WHEN letter IN ('أ', 'إ', 'ؤ', 'ئ', 'آ') THEN 'ء' WHEN letter IN ('ى', 'ٱ') THEN 'ا' WHEN letter IN ('ة', 'ہ', 'ھ') THEN 'ه' WHEN letter = 'ک' THEN 'ك' WHEN letter = 'ی' THEN 'ي' ELSE letter END"
_LETTER = """CASE as_letter WHEN 'ا' THEN 'الألف' WHEN 'ب' THEN 'الباء' WHEN 'ت' THEN 'التاء' WHEN 'ث' THEN 'الثاء' WHEN 'ج' THEN 'الجيم' WHEN 'ح' THEN 'الحاء' WHEN 'خ' THEN 'الخاء' WHEN 'د' THEN 'الدال' WHEN 'ذ' THEN 'الذال' WHEN 'ر' THEN 'الراء'
  WHEN 'ز' THEN 'الزاي' WHEN 'س' THEN 'السين' WHEN 'ش' THEN 'الشين' WHEN 'ص' THEN 'الصاد' WHEN 'ض' THEN 'الضاد' WHEN 'ك' THEN 'الكاف' WHEN 'ه' THEN 'الهاء' WHEN 'ي' THEN 'الياء' ELSE as_letter END"""
_METRIC = "l_discount * 100 BETWEEN 0 AND 3"
_ASKED = "(SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS q FROM pages) WHERE q <> ''"
SQL = {
    "retrieval_exact": f"WITH {CORPUS} SELECT poem_idx, meter, theme FROM corpus WHERE contains(meter, 'en') AND contains(theme, 'praise') ORDER BY poem_idx LIMIT 40",
    "retrieval_best": f"WITH {CORPUS} SELECT poem_idx, meter, theme FROM corpus WHERE contains(meter, 'fr') OR contains(theme, 'satire') ORDER BY poem_idx LIMIT 40",
    "flattened_scores": "SELECT l_orderkey, l_linenumber, round(l_discount * 100, 2) AS meter, CASE WHEN l_linenumber <> 2 THEN round(l_tax * 100, 2) END AS rhyme, CAST(NULL AS DOUBLE) AS beauty, l_quantity AS total FROM lineitem",
    "all_metrics_valid": f"SELECT l_linenumber, CAST(sum(CASE WHEN {_METRIC} THEN 1 ELSE 0 END) AS BIGINT) AS single, CAST(sum(CASE WHEN {_METRIC} AND l_tax * 100 BETWEEN 0 AND 10 THEN 1 ELSE 0 END) AS BIGINT) AS pair FROM lineitem GROUP BY l_linenumber",
    "balanced_json": "SELECT event_id, props AS json FROM events",
    "answer_shapes": "SELECT event_id % 5 <> 0 AS complete, event_id % 3 = 1 AS lists, count(*) AS n FROM events GROUP BY ALL",
    "judge_fallback": "SELECT event_id % 4 IN (0, 2) AS valid, count(*) AS n FROM events GROUP BY 1",
    "response_verses": f"SELECT doc_id, CASE WHEN doc_id % 3 < 2 THEN len(string_split(text, chr(10))) ELSE len(list_filter(string_split(regexp_replace(text, '[{{}}]', '', 'g'), chr(10)), lambda x: trim(x) <> '')) END AS n FROM documents WHERE text IS NOT NULL",
    "final_poems": r"SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g')) END AS poem FROM documents WHERE text IS NOT NULL",
    "cleaned_contents": r"SELECT doc_id, md5(regexp_replace(regexp_replace(replace(text, '`', '') || repeat(chr(10), 4) || 'end', '^[ \t\n\r]+', ''), '\n{3,}', chr(10) || chr(10), 'g')) AS digest FROM documents WHERE text IS NOT NULL",
    "rendered_templates": "SELECT doc_id, CASE WHEN doc_id % 4 <> 0 THEN coalesce(source, '') || ' writes ' || coalesce(lang, '') || ', ' || coalesce(source, '') END AS said FROM documents",
    "parity_messages": f"SELECT CASE WHEN k % 2 = 0 THEN 'even: ' || CAST(k // 2 AS VARCHAR) || ' pairs' ELSE 'odd: ' || CAST(k AS VARCHAR) || ' lines' END AS said, count(*) AS n FROM (SELECT {_N} AS k FROM documents) GROUP BY 1",
    "clarification_texts": "SELECT doc_id, CASE WHEN len(h) > 0 THEN md5(array_to_string(list_transform(h, lambda x: '- ' || x), chr(10))) END AS digest FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: contains(x, 'the') OR contains(x, 'que')) AS h FROM documents WHERE text IS NOT NULL)",
    "narrative_texts": "SELECT event_id, event_type || chr(10) || 'next' || CASE WHEN event_id % 2 = 0 THEN chr(10) || CAST(event_id AS VARCHAR) ELSE '' END AS said FROM events",
    "candidate_listings": "SELECT l_orderkey, md5(string_agg('Candidate ' || CAST(r AS VARCHAR) || ':' || chr(10) || CAST(l_partkey AS VARCHAR), chr(10) || chr(10) ORDER BY r)) AS digest FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS r FROM lineitem) GROUP BY l_orderkey",
    "marked_words": f"""WITH {_MARKED} SELECT count(*) AS n, CAST(sum(length(w)) AS BIGINT) AS marked, CAST(sum(length(bare)) AS BIGINT) AS bare, CAST(sum(length(replace(w, chr(1600), ''))) AS BIGINT) AS short, CAST(sum(length(trim(plain))) AS BIGINT) AS plain,
      CAST(sum(CASE WHEN trim(plain) = '' THEN 1 ELSE 0 END) AS BIGINT) AS none, CAST(sum(length(w) + 1) AS BIGINT) AS one_vowel FROM forms""",
    "unified_letters": f"SELECT letter, as_letter, {_LETTER} AS name, n FROM (SELECT letter, {_UNIFIED} AS as_letter, count(*) AS n FROM (SELECT {_LAST} AS letter FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents)) GROUP BY letter)",
    "web_results": f"SELECT page_id AS query_id, CAST(0 AS BIGINT) AS place, 'About ' || q AS title, 'https://example.org/?q=' || q AS url, CAST(1 AS BIGINT) AS total FROM {_ASKED}",
    "web_listings": f"SELECT page_id AS query_id, md5('1. About ' || q || chr(10) || 'https://example.org/?q=' || q || chr(10) || q) AS digest FROM {_ASKED}",
    "web_verdicts": "SELECT event_id, CAST(0 AS BIGINT) AS result_index, CAST(floor(value % 11) AS DOUBLE) AS relevance_score FROM events WHERE floor(value % 11) >= 7",
    "web_rounds": """WITH split AS (SELECT page_id, list_filter(string_split_regex(url, '[^A-Za-z0-9]+'), lambda w: w <> '') AS v FROM pages), flat AS (SELECT page_id, unnest(v) AS word, unnest(range(0, len(v))) AS spot FROM split),
words AS (SELECT page_id, word, row_number() OVER (PARTITION BY page_id ORDER BY min(spot)) AS n FROM flat GROUP BY page_id, word),
q1 AS (SELECT page_id, n AS query_no, word AS query FROM words WHERE n <= 4 AND page_id IN (SELECT page_id FROM pages)),
h1 AS (SELECT page_id, query_no, i AS place, 'On ' || query AS title, 'https://example.org/' || CAST(CAST('0x' || substr(md5(query || '#' || CAST(i AS VARCHAR)), 1, 4) AS BIGINT) % 60 AS VARCHAR) AS url FROM q1, range(0, 3) r(i)),
f1 AS (SELECT * FROM h1 QUALIFY row_number() OVER (PARTITION BY page_id, url ORDER BY query_no, place) = 1),
n1 AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY query_no, place) - 1 AS result_index, CAST('0x' || substr(md5(CAST(page_id AS VARCHAR) || '|' || url), 1, 4) AS BIGINT) % 11 AS score, 1 AS round
  FROM f1 WHERE true),
q2 AS (SELECT page_id, n AS query_no, word || ' 2' AS query FROM words WHERE n <= 4 AND page_id IN (SELECT page_id FROM n1 WHERE score = 10)),
h2 AS (SELECT page_id, query_no, i AS place, 'On ' || query AS title, 'https://example.org/' || CAST(CAST('0x' || substr(md5(query || '#' || CAST(i AS VARCHAR)), 1, 4) AS BIGINT) % 60 AS VARCHAR) AS url FROM q2, range(0, 3) r(i)),
f2 AS (SELECT * FROM h2 QUALIFY row_number() OVER (PARTITION BY page_id, url ORDER BY query_no, place) = 1),
n2 AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY query_no, place) - 1 AS result_index, CAST('0x' || substr(md5(CAST(page_id AS VARCHAR) || '|' || url), 1, 4) AS BIGINT) % 11 AS score, 2 AS round
  FROM f2 WHERE (page_id, url) NOT IN (SELECT (page_id, url) FROM n1)),
q3 AS (SELECT page_id, n AS query_no, word || ' 3' AS query FROM words WHERE n <= 4 AND page_id IN (SELECT page_id FROM n2 WHERE score = 10)),
h3 AS (SELECT page_id, query_no, i AS place, 'On ' || query AS title, 'https://example.org/' || CAST(CAST('0x' || substr(md5(query || '#' || CAST(i AS VARCHAR)), 1, 4) AS BIGINT) % 60 AS VARCHAR) AS url FROM q3, range(0, 3) r(i)),
f3 AS (SELECT * FROM h3 QUALIFY row_number() OVER (PARTITION BY page_id, url ORDER BY query_no, place) = 1),
n3 AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY query_no, place) - 1 AS result_index, CAST('0x' || substr(md5(CAST(page_id AS VARCHAR) || '|' || url), 1, 4) AS BIGINT) % 11 AS score, 3 AS round
  FROM f3 WHERE (page_id, url) NOT IN (SELECT (page_id, url) FROM n1 UNION ALL SELECT (page_id, url) FROM n2))
SELECT page_id, CAST(round AS BIGINT) AS round, CAST(result_index AS BIGINT) AS result_index, title, url, CAST(score AS DOUBLE) AS relevance_score
FROM (SELECT * FROM n1 UNION ALL SELECT * FROM n2 UNION ALL SELECT * FROM n3) WHERE score >= 7 AND score % 2 = 1""",
    "answer_pages": """SELECT doc_id, md5(array_to_string(list_filter(list_transform(list_filter(v, lambda x, i: i % 2 = 1), lambda x: trim(x, ' ' || chr(9))), lambda x: x <> ''), chr(10))) AS response,
      md5(array_to_string(list_filter(list_transform(list_filter(v, lambda x, i: i % 2 = 0), lambda x: trim(x, ' ' || chr(9))), lambda x: x <> ''), chr(10))) AS thinking
      FROM (SELECT doc_id, string_split(translate(coalesce(text, ''), chr(13) || chr(11) || chr(12) || chr(28) || chr(29) || chr(30) || chr(31) || chr(133) || chr(8232) || chr(8233) || chr(160), '           '), chr(10)) AS v FROM documents)""",
    "chosen_answers": "SELECT lang, CAST(sum(CASE WHEN lang = 'en' AND contains(source, 'c1') AND trim(coalesce(text, '')) <> '' THEN 1 ELSE 0 END) AS BIGINT) AS chosen, CAST(sum(CASE WHEN contains(source, 'src1') AND doc_id % 3 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS thoughtful FROM documents GROUP BY lang",
    "batch_ids": "SELECT o_orderstatus, count(*) AS n, min('batch_' || CAST(o_orderkey AS VARCHAR)) AS first FROM orders WHERE o_orderkey % 2 = 0 GROUP BY o_orderstatus",
    "entries_by_poem": "SELECT l_orderkey, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey) AS entries FROM lineitem GROUP BY l_orderkey",
    "distinct_items": "SELECT l_returnflag, count(DISTINCT l_partkey) AS items, CAST(sum(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END) AS BIGINT) AS many, CAST(sum(CASE WHEN l_discount = 0 THEN 1 ELSE 0 END) AS BIGINT) AS plain FROM lineitem GROUP BY l_returnflag",
    "resumed_results": "SELECT o_orderkey, o_orderstatus, 'model-a' AS source, l_linenumber, l_quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "batch_success": """SELECT CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS done, count(*) AS "all", round(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)::DOUBLE / count(*), 6) AS rate FROM orders""",
    "generated_records": "SELECT concat_ws('-', conv_id, turn) || '_gen_1' || CASE WHEN turn = 2 THEN '_error' ELSE '' END AS instance_id, role AS prompt, md5(coalesce(CASE WHEN turn % 3 <> 0 THEN text END, '')) AS digest FROM conversations WHERE turn = 2 OR trim(coalesce(CASE WHEN turn % 3 <> 0 THEN text END, '')) <> ''",
    "error_results": f"SELECT doc_id, unnest(range(1, k // 2 + 1)) AS pair_no, false AS valid, 'no rhyme' AS message FROM (SELECT doc_id, {_N} AS k FROM documents)",
    "known_models": "SELECT CASE WHEN lower(p_brand) = 'brand#1' THEN 10 WHEN lower(p_brand) = 'brand#23' THEN 23 WHEN lower(p_brand) = 'brand#2' THEN 20 WHEN starts_with(lower(p_brand), 'brand#1') THEN 10 WHEN starts_with(lower(p_brand), 'brand#23') THEN 23 WHEN starts_with(lower(p_brand), 'brand#2') THEN 20 ELSE 5 END AS size, count(*) AS n FROM part GROUP BY 1",
}
