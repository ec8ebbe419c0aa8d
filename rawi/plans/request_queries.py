"""Requests, repairs and traces with deterministic providers over ``documents`` and ``events``."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from rawi.functions import arabic as A
from rawi.operators import flow as W
from rawi.operators import requests as R
from rawi.operators import trace as T
from rawi.operators.providers import RuleProvider
from rawi.operators.steps import once, pair_rows, with_pairs
from rawi.operators.web import MockSearch
from rawi.plans.corpus_queries import CORPUS, corpus
from rawi.plans.meter_queries import _ASK, asked
from rawi.sources.tables import table


def _parser(prompt: str) -> str:
    """An answer of one of eight shapes, by the number in front of the prompt."""
    n, lang = prompt.split(":", 1)
    n = int(n)
    told = {f: None for f in R.FIELDS} | {"meter": lang, "theme": "null" if n % 3 == 0 else "praise", "line_count": [n % 9, str(n % 9), "null", "some"][n % 4], "keywords": ["a"] * (n % 4), "reasoning": "a } brace"}
    if n % 8 == 3:
        del told["era"], told["tone"]
    if n % 8 == 4:
        told["imagery"] = "sea"
    text = json.dumps(told)
    shapes = {0: f"```json\n{text}\n```", 1: f"Sure. {text} and that is {{all}}", 5: "I cannot tell", 6: text[:-1], 7: f"```\n{text}\n```\n{{}}"}
    return shapes.get(n % 8, text)


def parsed_requests(spark, sf_dir):
    """Constraints that a model reads from each document's prompt, or why it gave none."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.coalesce("lang", F.lit("?"))).alias("prompt"))
    c = R.understood(d, "prompt", lambda: RuleProvider(_parser))
    return c.select("doc_id", "error", *[F.col(f"constraints.{f}").alias(f) for f in ("meter", "theme", "tone")], F.coalesce("constraints.line_count", F.lit(-1)).alias("line_count"), F.coalesce(F.size("constraints.keywords"), F.lit(-1)).cast("long").alias("n_keywords"))


def _chooser(prompt: str) -> str:
    if prompt.endswith("unknown"):
        return '{"meter_name": "Ramal"}'
    return '{"meter_name": "zzz"}' if prompt.startswith("meter for theme غزل") else "none"


def chosen_meters(spark, sf_dir):
    """A known meter for each document's request, by the guide or by a model."""
    return R.with_meter(asked(spark, sf_dir).select("doc_id", "asked", "theme"), lambda: RuleProvider(_chooser), "asked").select("doc_id", "asked", "feet_text", "error")


def enriched_requests(spark, sf_dir):
    """Corpus and web examples of each document's request."""
    d = table(spark, sf_dir, "documents")
    theme = F.element_at(F.array(*[F.lit(x) for x in ("praise", "", "satire", "e", "none")]), (F.col("doc_id") % 5 + 1).cast("int"))
    wanted = d.select("doc_id", F.when(F.col("doc_id") % 7 > 1, F.upper("lang")).alias("meter"), theme.alias("theme"))
    config = {"sources": [{"type": "corpus", "search_criteria": ["meter", "theme"], "top_k": 3}, {"type": "web_search", "search_criteria": ["theme"]}]}
    e = R.enriched(wanted, "doc_id", config, corpus(spark, sf_dir), MockSearch)
    return e.select("doc_id", F.array_join(F.transform("examples", lambda x: x["poem_idx"].cast("string")), ",").alias("ids"), F.get("pages", F.lit(0))["title"].alias("title"), "enriched")


def _resize(prompt: str) -> str:
    n, *lines = prompt.split("\n")
    return json.dumps({"verses": (lines + ["x"] * int(n))[: int(n)]}, ensure_ascii=False)


def resized_poems(spark, sf_dir):
    """Texts brought to the lines that were asked for: 0 and null ask for four."""
    d = with_pairs(table(spark, sf_dir, "documents"), ["doc_id"]).select("doc_id", "verses", F.when(F.col("doc_id") % 3 > 0, (F.col("doc_id") % 5).cast("int")).alias("line_count"))
    judge = lambda p: p.withColumn("valid", R.right_length(F.col("verses"), F.col("line_count")))
    want = F.coalesce(F.nullif("line_count", F.lit(0)), F.lit(4)).cast("string")
    repair = lambda p: R.rewritten(p, F.concat_ws("\n", want, "verses"), lambda: RuleProvider(_resize))
    out = W.refine(d, judge, repair, F.col("valid"), rounds=2)
    return out.select("doc_id", "valid", F.col("iteration").cast("long").alias("iteration"), F.size("verses").cast("long").alias("n"), F.md5(F.array_join("verses", "\n")).alias("digest"))


def _mender(prompt: str) -> str:
    first, second = prompt.split("\n")[:2]
    return f"{first} +\n\n{second} +\nmore" if "odd" in prompt.rsplit("# ", 1)[1] else first


def mended_pairs(spark, sf_dir):
    """Pairs with a reason come back from a model; answers of one line change nothing."""
    p = pair_rows(table(spark, sf_dir, "documents"), "doc_id")
    chars = F.length("first") + F.length("second")
    p = p.withColumn("reason", F.when(chars % 3 == 0, F.when(chars % 2 == 1, "odd").otherwise("even")))
    return R.repaired_pairs(p, lambda: RuleProvider(_mender)).select("doc_id", "pair_no", F.md5(F.concat("first", F.lit("\n"), "second")).alias("digest"))


def _steps(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    made = F.when(F.col("event_type") == "purchase", F.concat(F.lit("poem "), F.col("event_id").cast("string"))).when(F.col("event_type") == "error", F.concat(F.lit("Quality "), "props")).otherwise("none")
    return T.steps(e, "user_id", "ts", "event_id").withColumn("made", made).withColumn("given", F.concat(F.lit("in "), "event_type"))


def trace_stories(spark, sf_dir):
    s = T.story(_steps(spark, sf_dir), "user_id", "event_type", "given", "made", "props")
    return s.select("user_id", F.md5("steps").alias("digest"), "prompt", "constraints", "poem", "quality")


def trace_export(spark, sf_dir):
    return T.exported(_steps(spark, sf_dir), "user_id", "event_id", "event_type", "made").select("execution_id", F.md5("json").alias("digest"))


def _marked_ends(spark, sf_dir):
    """Last words of each text's lines in Arabic letters, doubled letters with a shadda and some ends with a mark."""
    line = A.transliterated(F.coalesce("text", F.lit("")))
    for c in "صرفلس":
        line = F.replace(line, F.lit(c + c), F.lit(c + A.SHADDA))
    d = table(spark, sf_dir, "documents").select("doc_id", F.split(line, "\n").alias("v"))
    d = once(d, ["doc_id"], ends=F.filter(F.transform("v", lambda v: A.last_word(A.clean_line(v))), lambda w: w != ""))
    return once(d, ["doc_id"], ends=F.transform("ends", lambda w: F.when(F.length(w) % 2 == 0, F.concat(w, F.lit(A.FATHA))).otherwise(w)))


def doubled_rhymes(spark, sf_dir):
    return _marked_ends(spark, sf_dir).select("doc_id", A.doubled_rhyme(F.col("ends")).alias("rhyme"))


def loose_rhymes(spark, sf_dir):
    return _marked_ends(spark, sf_dir).select("doc_id", A.loose_rhyme(F.col("ends")).alias("rhyme"))


QUERIES = {f.__name__: f for f in (parsed_requests, chosen_meters, enriched_requests, resized_poems, mended_pairs, trace_stories, trace_export, doubled_rhymes, loose_rhymes)}

_V = "list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x)), lambda x: x <> '')"
_STEPS = "s AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step, CASE event_type WHEN 'purchase' THEN 'poem ' || event_id WHEN 'error' THEN 'Quality ' || props ELSE 'none' END AS made, 'in ' || event_type AS given FROM events)"
_T = f"translate(lower(coalesce(text, '')), '{A.LATIN}', '{A.ARABIC}')"
for _c in "صرفلس":
    _T = f"replace({_T}, '{_c}{_c}', '{_c}' || chr(1617))"
_ENDS = rf"""raw AS (SELECT doc_id, list_filter(list_transform(string_split({_T}, chr(10)), lambda x: regexp_extract(regexp_replace(trim(x), '[،؛؟!.\-\s]+$', ''), '([^ ]+)$', 1)), lambda w: w <> '') AS r FROM documents),
ends AS (SELECT doc_id, list_transform(r, lambda w: CASE WHEN length(w) % 2 = 0 THEN w || chr(1614) ELSE w END) AS e FROM raw)"""
_BARE = r"regexp_replace(w, '[\x{064B}-\x{0652}]', '', 'g')"
SQL = {
    "parsed_requests": """WITH n AS (SELECT doc_id, coalesce(lang, '?') AS lang, CASE doc_id % 8 WHEN 3 THEN 'missing: tone, era' WHEN 4 THEN 'not a list: imagery' WHEN 5 THEN 'no JSON object' WHEN 6 THEN 'no JSON object' END AS error FROM documents)
      SELECT doc_id, error, CASE WHEN error IS NULL THEN lang END AS meter, CASE WHEN error IS NULL AND doc_id % 3 <> 0 THEN 'praise' END AS theme, CASE WHEN error IS NULL AND doc_id % 4 < 2 THEN CAST(doc_id % 9 AS INTEGER) ELSE -1 END AS line_count,
        CAST(NULL AS VARCHAR) AS tone, CASE WHEN error IS NULL THEN doc_id % 4 ELSE -1 END AS n_keywords FROM n""",
    "chosen_meters": f"""WITH {_ASK}, c AS (SELECT doc_id, CASE WHEN a.meter IS NOT NULL THEN asked WHEN asked = 'unknown' THEN 'Ramal' END AS chosen, CASE WHEN a.meter IS NULL AND asked <> 'unknown' THEN CASE WHEN theme = 'غزل' THEN 'unknown meter: zzz' ELSE 'no meter name' END END AS error FROM ask LEFT JOIN alias a USING (asked))
      SELECT doc_id, c.chosen AS asked, g.feet AS feet_text, error FROM c LEFT JOIN alias a ON a.asked = c.chosen LEFT JOIN guide g ON g.meter = a.meter""",
    "enriched_requests": f"""WITH {CORPUS}, wanted AS (SELECT doc_id, CASE WHEN doc_id % 7 > 1 THEN coalesce(lang, '') ELSE '' END AS m, ['praise', '', 'satire', 'e', 'none'][doc_id % 5 + 1] AS t FROM documents),
      combo AS (SELECT DISTINCT m, t FROM wanted WHERE m || t <> ''), hit AS (SELECT m, t, poem_idx, row_number() OVER (PARTITION BY m, t ORDER BY poem_idx) AS n FROM combo JOIN corpus ON contains(meter, m) AND contains(theme, t)),
      found AS (SELECT m, t, string_agg(CAST(poem_idx AS VARCHAR), ',' ORDER BY n) AS ids FROM hit WHERE n <= 3 GROUP BY m, t)
      SELECT doc_id, ids, CASE WHEN t <> '' THEN 'About ' || t END AS title, true AS enriched FROM wanted LEFT JOIN found USING (m, t)""",
    "resized_poems": f"""WITH p AS (SELECT doc_id, {_V} AS v, CASE WHEN doc_id % 3 > 0 AND doc_id % 5 > 0 THEN doc_id % 5 ELSE 4 END AS want FROM documents), q AS (SELECT doc_id, len(v) AS had, want, list_slice(list_concat(v, list_transform(range(0, want), lambda i: 'x')), 1, want) AS w FROM p)
      SELECT doc_id, true AS valid, CASE WHEN had = want THEN 0::BIGINT ELSE 1 END AS iteration, want AS n, md5(array_to_string(w, chr(10))) AS digest FROM q""",
    "mended_pairs": f"""WITH pairs AS (SELECT doc_id, i // 2 AS pair_no, v[i + 1] AS first, v[i + 2] AS second FROM (SELECT doc_id, v, unnest(range(0, len(v), 2)) AS i FROM (SELECT doc_id, {_V} AS v FROM documents) WHERE len(v) % 2 = 0))
      SELECT doc_id, pair_no, md5(CASE WHEN (length(first) + length(second)) % 6 = 3 THEN first || ' +' || chr(10) || second || ' +' ELSE first || chr(10) || second END) AS digest FROM pairs""",
    "trace_stories": f"""WITH {_STEPS} SELECT user_id, md5(string_agg('Step ' || step || ': ' || event_type || chr(10) || 'Input: ' || given || chr(10) || 'Output: ' || made || chr(10) || 'Reasoning: ' || props || chr(10), chr(10) || chr(10) ORDER BY step)) AS digest,
      min_by(given, step) AS prompt, min_by(made, step) AS constraints, coalesce(max_by(made, step) FILTER (event_type = 'purchase'), 'No poem generated') AS poem, coalesce(max_by(made, step) FILTER (event_type = 'error'), 'No quality assessment') AS quality FROM s GROUP BY user_id""",
    "trace_export": f"""WITH {_STEPS} SELECT user_id AS execution_id, md5('{{"execution_id":' || user_id || ',"calls":[' || string_agg('{{"step":' || step || ',"event_id":' || event_id || ',"event_type":"' || event_type || '","made":"' || replace(made, '"', '\\"') || '"}}', ',' ORDER BY step) || ']}}') AS digest FROM s GROUP BY user_id""",
    "doubled_rhymes": rf"""WITH {_ENDS}, short AS (SELECT doc_id, list_transform(e, lambda w: regexp_replace(w, '[يا]$', '')) AS s FROM ends), bare AS (SELECT doc_id, s, list_filter(list_transform(s, lambda w: {_BARE}), lambda w: length(w) > 1) AS b FROM short)
      SELECT doc_id, CASE WHEN len(s) > 1 AND len(b) > 1 AND len(list_filter(s, lambda w: length(w) > 1 AND w[-2:-2] = chr(1617))) > 0 THEN coalesce(right(list_filter(b, lambda w: left(w, 2) <> left(b[1], 2))[1], 1), left(b[1], 2)) END AS rhyme FROM bare""",
    "loose_rhymes": rf"""WITH {_ENDS}, k AS (SELECT doc_id, e, list_filter(list_transform(e, lambda w: {_BARE}), lambda w: length(w) > 2) AS l FROM ends), kept AS (SELECT doc_id, e, l, list_filter(list_transform(l, lambda w: regexp_replace(w, '[يا]$', '')), lambda w: length(w) > 2) AS b FROM k)
      SELECT doc_id, CASE WHEN len(e) > 1 AND len(l) > 1 AND len(b) > 1 AND len(list_filter(b, lambda w: regexp_matches(right(w, 3), '[ويا]'))) = 0 AND len(list_filter(b, lambda w: w[-2:-2] <> b[1][-2:-2])) > 0 AND regexp_matches(right(b[1], 1), '[ء-غف-ي]') AND right(b[1], 1) NOT IN ('ـ')
        THEN (CASE WHEN right(e[1], 1) = chr(1614) THEN chr(1614) ELSE '' END) || replace(right(b[1], 1), 'ة', 'ه') END AS rhyme FROM kept""",
}
