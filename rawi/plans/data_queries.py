"""Scores, curation, traces and half-structured text over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rawi.functions import semi as J
from rawi.functions import text as X
from rawi.operators import curate as K
from rawi.operators import scores as S
from rawi.operators import trace as T
from rawi.operators import web as W
from rawi.operators.steps import pair_rows
from rawi.sources.tables import table


def judged(spark, sf_dir):
    """lineitem as judgements: part as item, flag and status as source, order priority as file."""
    line, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    both = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    source = F.concat_ws("_vs_", F.when(F.col("l_returnflag") == "N", "human").otherwise(F.col("l_returnflag")), F.col("l_linestatus"))
    return both.select(
        F.col("l_partkey").alias("item_id"), source.alias("source"), F.col("o_orderpriority").alias("file"), F.col("l_quantity").alias("total"), (F.col("l_discount") * 100).alias("meter"), (F.col("l_tax") * 100).alias("rhyme"), F.col("l_extendedprice").alias("price")
    )


JUDGED = """judged AS (SELECT l_partkey AS item_id, CASE WHEN l_returnflag = 'N' THEN 'human' ELSE l_returnflag END || '_vs_' || l_linestatus AS source, o_orderpriority AS file,
  l_quantity AS total, l_discount * 100 AS meter, l_tax * 100 AS rhyme, l_extendedprice AS price FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def _round(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


def score_two_level_mean(spark, sf_dir):
    j = judged(spark, sf_dir).withColumn("base", S.base_source(F.col("source")))
    return _round(S.two_level_mean(j, ["item_id", "base"], ["total", "meter", "rhyme"], in_all=True), "total", "meter", "rhyme")


def score_ranking(spark, sf_dir):
    out = S.ranking(judged(spark, sf_dir).withColumn("shown", S.display(S.base_source(F.col("source")), {"A": "Model A", "human": "Human"})), "shown", "total", ["meter", "rhyme"])
    return out.withColumns({c: F.round(c, 2) for c in ("mean", "std", "meter", "rhyme")})


def score_summary(spark, sf_dir):
    return _round(S.summary(judged(spark, sf_dir), "source", "total"), "mean", "std")


def score_box_plot(spark, sf_dir):
    return S.box_plot(judged(spark, sf_dir), "source", "total")


def score_correlations(spark, sf_dir):
    return _round(S.correlations(judged(spark, sf_dir), ["total", "meter", "rhyme", "price"]), "r")


def score_human_correlation(spark, sf_dir):
    j = judged(spark, sf_dir).withColumn("base", S.base_source(F.col("source")))
    return _round(S.human_correlation(S.two_level_mean(j, ["item_id", "base"], ["total"]), "item_id", "base", "total", "human"), "r")


def score_best_closest(spark, sf_dir):
    return S.best_and_closest(judged(spark, sf_dir).withColumn("base", S.base_source(F.col("source"))), "base", "total", "human")


def score_kinds(spark, sf_dir):
    return S.kind_counts(judged(spark, sf_dir))


def score_validity(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    shown = {"meter": F.when(F.col("l_linenumber") == 3, F.lit("n/a")).otherwise(F.col("l_quantity").cast("string")), "rhyme": (F.col("l_discount") * 100).cast("string")}
    return line.groupBy("l_returnflag").agg(F.count_if(S.valid_single(shown)).alias("n_valid"), F.count("*").alias("n"))


def wide(spark, sf_dir):
    """customer as wide items: a text per source, some missing."""
    c, seg = table(spark, sf_dir, "customer"), F.col("c_mktsegment")
    return c.select("c_custkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")).alias("human"), F.when(seg != "BUILDING", F.concat(seg, F.lit("-a"))).alias("model-a"), F.when(F.col("c_nationkey") % 2 == 0, F.concat(seg, F.lit("-b"))).alias("model.b"))


WIDE = """wide AS (SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS human, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment || '-a' END AS a, CASE WHEN c_nationkey % 2 = 0 THEN c_mktsegment || '-b' END AS b FROM customer),
long AS (SELECT c_custkey AS item_id, 'human' AS source, human AS text, NULL AS h FROM wide WHERE human IS NOT NULL UNION ALL SELECT c_custkey, 'model-a', a, human FROM wide WHERE a IS NOT NULL UNION ALL SELECT c_custkey, 'model.b', b, human FROM wide WHERE b IS NOT NULL),
requests AS (SELECT item_id, source, 'single' AS kind, text FROM long UNION ALL SELECT item_id, source, 'comparative', text FROM long WHERE source <> 'human' AND h IS NOT NULL)"""


def score_fanout(spark, sf_dir):
    return S.fan_out(wide(spark, sf_dir), "c_custkey", ["model-a", "model.b"]).select("item_id", "source", "kind", "custom_id")


def score_requests(spark, sf_dir):
    return S.request_total(wide(spark, sf_dir).withColumnsRenamed({"model-a": "a", "model.b": "b"}), ["a", "b"])


def custom_id_roundtrip(spark, sf_dir):
    r = S.fan_out(wide(spark, sf_dir), "c_custkey", ["model-a", "model.b"]).select("custom_id")
    return S.decode_id(r, ["human", "model-a", "model.b"]).select("custom_id", "item_id", "source", "kind")


def score_unswap(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    compared = line.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("item_id"), F.col("l_returnflag").alias("source"), (F.col("l_suppkey") % 2 == 0).alias("ai_first"), F.array("l_quantity", "l_tax").alias("scores"))
    return S.unswap(compared)


def quality_score(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    q = S.quality(F.when(F.col("l_linenumber") < 5, F.col("l_quantity") < 20), F.col("l_discount") > 0.05, F.when(F.col("l_returnflag") != "N", F.lit(1) - F.col("l_tax") * 10))
    return line.select("l_orderkey", "l_linenumber", F.round(q, 6).alias("quality"))


def bait_rollup(spark, sf_dir):
    pairs = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("pair_no"), (F.col("l_quantity") > 10).alias("valid"))
    return S.roll_up(pairs, "l_orderkey").select("l_orderkey", "n", "n_valid", "all_valid", "said")


def early_stop(spark, sf_dir):
    return S.early_stop(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber", "l_quantity", 45.0).select("l_orderkey", "l_linenumber", "l_quantity")


def best_of_n(spark, sf_dir):
    picks = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") != "A", F.col("l_quantity")).alias("score"))
    return S.best_of(picks, "l_orderkey", "l_linenumber", "score")


def result_join(spark, sf_dir):
    o, line = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("custom_id"), "o_totalprice"), table(spark, sf_dir, "lineitem")
    results = line.select(F.col("l_orderkey").alias("custom_id"), "l_linenumber", "l_quantity")
    return K.matched_results(o, results)


def result_misses(spark, sf_dir):
    o, line = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("custom_id"), "o_orderpriority"), table(spark, sf_dir, "lineitem")
    return K.missed_results(o, line.filter("l_linenumber = 4").select(F.col("l_orderkey").alias("custom_id")))


def unprocessed_sample(spark, sf_dir):
    d, done = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id")
    return K.unprocessed(d, done, "doc_id", X.verse_count(X.lines(F.col("text"))) >= 4, 50).select("doc_id", "lang")


def upsert_missing(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    have = o.select(F.col("o_custkey").alias("id"), F.lit("order").alias("origin")).distinct()
    return K.upsert_missing(have, c.select(F.col("c_custkey").alias("id"), F.lit("customer").alias("origin")), "id")


def has_a_not_b(spark, sf_dir):
    return K.has_and_not(table(spark, sf_dir, "orders"), "o_custkey", F.col("o_orderpriority") == "1-URGENT", F.col("o_orderpriority") == "5-LOW")


def append_first_match(spark, sf_dir):
    items = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority")
    answers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return K.append_responses(items, answers, "o_custkey", "o_orderkey", F.col("o_orderpriority") == "2-HIGH", o_orderpriority=F.col("c_name"))


def last_wins(spark, sf_dir):
    return K.last_of(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", "o_orderkey")


def virtual_ids(spark, sf_dir):
    return K.numbered(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_size", "p_partkey")


def batch_chunks(spark, sf_dir):
    return K.chunks(table(spark, sf_dir, "supplier").select("s_suppkey"), 7, "s_suppkey")


def delete_renumber(spark, sf_dir):
    return K.delete_and_renumber(table(spark, sf_dir, "part").select("p_partkey"), 5, "p_partkey")


def progress(spark, sf_dir):
    return _round(K.progress(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id"), "percent")


def section_split(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    out = K.sections(rows, "doc_id", "pos", "line", F.length("line") < 20)
    return out.select("doc_id", "section", F.md5("text").alias("digest"), "n_lines")


def web_gate(spark, sf_dir):
    judged = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_linenumber") - 1).alias("result_index"), F.lit(3).alias("total"), F.when(F.col("l_returnflag") != "A", F.col("l_returnflag") == "R").alias("is_worth_following"), F.col("l_quantity").alias("relevance_score")
    )
    return W.worth_following(judged).select("l_orderkey", "l_linenumber")


def html_lines(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(J.html_text(F.col("html"))).alias("digest"), F.length(J.html_text(F.col("html"))).cast("long").alias("n"))


def id_from_name(spark, sf_dir):
    name = F.concat(F.lit("poem_"), F.regexp_extract("url", r"/([0-9]+)", 1), F.lit("_response.html"))
    return table(spark, sf_dir, "pages").select("page_id", J.id_of_file(name).alias("poem_id"))


def json_from_text(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    prose = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("Here it is:\n```json\n"), "props", F.lit("\n```\nthanks"))).otherwise(F.concat(F.lit("The answer "), "props", F.lit(" ends.")))
    return e.select("event_id", J.json_text(prose).alias("json"))


def null_text(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("t", F.when(F.col("event_id") % 3 == 0, "null").otherwise(F.col("event_type")))
    return e.groupBy(J.no_null_text(F.col("t")).alias("event_type")).agg(F.count("*").alias("n"))


def trace_rollup(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("provider", F.when(F.col("event_type") != "click", F.col("event_type"))).withColumn("tokens", F.floor("value"))
    return T.roll_up(e, "user_id", "ts", "tokens", "provider")


def trace_narrative(spark, sf_dir):
    n = T.narrative(T.steps(table(spark, sf_dir, "events"), "user_id", "ts", "event_id"), "user_id", "event_type", "event_id")
    return n.select("user_id", F.md5("narrative").alias("digest"))


def trace_messages(spark, sf_dir):
    told = T.messages(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    return T.analysis_text(told, "conv_id").select("conv_id", F.md5("text").alias("digest"))


def error_kinds(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    text = F.concat(F.when(F.col("turn") == 1, "Rate limit hit ").when(F.col("turn") == 2, "network down ").otherwise(""), F.coalesce("role", F.lit("")))
    return c.groupBy(X.error_kind(text).alias("kind")).agg(F.count("*").alias("n"))


def template_parameters(spark, sf_dir):
    made = F.concat(F.lit("Write {n} lines on {theme} in {meter} for {theme} by "), F.when(F.col("doc_id") % 2 == 0, "{poet}").otherwise(F.col("source")))
    d = table(spark, sf_dir, "documents").select("doc_id", made.alias("t"))
    return d.select("doc_id", F.array_join(X.parameters(F.col("t")), ",").alias("parameters"), F.array_join(X.missing_parameters(F.col("t"), F.array(F.lit("n"), F.lit("theme"))), ",").alias("missing"))


def bait_pairs_of(spark, sf_dir):
    """Pairs of lines of the documents that have an even number of them."""
    return pair_rows(table(spark, sf_dir, "documents"), "doc_id")


QUERIES = {
    f.__name__: f
    for f in (
        score_two_level_mean, score_ranking, score_summary, score_box_plot, score_correlations, score_human_correlation, score_best_closest, score_kinds, score_validity, score_fanout,
        score_requests, custom_id_roundtrip, score_unswap, quality_score, bait_rollup, early_stop, best_of_n, result_join, result_misses, unprocessed_sample, upsert_missing, has_a_not_b,
        append_first_match, last_wins, virtual_ids, batch_chunks, delete_renumber, progress, section_split, web_gate, html_lines, id_from_name, json_from_text, null_text, trace_rollup,
        trace_narrative, trace_messages, error_kinds, template_parameters,
    )
}

_BODY = r"regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)\b.*?</(script|style)>', '', 'g'), '(?i)<br\s*/?>|</p\s*>|</div\s*>|</h[1-6]\s*>|</li\s*>', chr(10), 'g'), '(?s)<[^>]*>', '', 'g')"
for _name, _sign in J.ENTITIES:
    _BODY = "replace(" + _BODY + ", '" + _name + "', '" + _sign.replace("'", "''") + "')"
_HTML = f"WITH t AS (SELECT page_id, array_to_string(list_filter(list_transform(string_split({_BODY}, chr(10)), lambda x: regexp_replace(x, '^[ \\t\\r]+|[ \\t\\r]+$', '', 'g')), lambda x: x <> ''), chr(10)) AS x FROM pages) SELECT page_id, md5(x) AS digest, length(x) AS n FROM t"
_METRICS = ("total", "meter", "rhyme", "price")
SQL = {
    "score_two_level_mean": f"""WITH {JUDGED}, b AS (SELECT *, split_part(source, '_vs_', 1) AS base FROM judged), f AS (SELECT count(DISTINCT file) AS n FROM b),
      k AS (SELECT item_id, base FROM b GROUP BY ALL HAVING count(DISTINCT file) = (SELECT n FROM f)), i AS (SELECT item_id, base, file, avg(total) AS total, avg(meter) AS meter, avg(rhyme) AS rhyme FROM b JOIN k USING (item_id, base) GROUP BY ALL)
      SELECT item_id, base, round(avg(total), 6) AS total, round(avg(meter), 6) AS meter, round(avg(rhyme), 6) AS rhyme FROM i GROUP BY ALL""",
    "score_ranking": f"""WITH {JUDGED}, b AS (SELECT *, CASE split_part(source, '_vs_', 1) WHEN 'A' THEN 'Model A' WHEN 'human' THEN 'Human' ELSE split_part(source, '_vs_', 1) END AS shown FROM judged)
      SELECT shown, round(round(avg(total), 3), 2) AS mean, round(round(stddev_samp(total), 3), 2) AS std, count(total) AS n, round(round(avg(meter), 3), 2) AS meter, round(round(avg(rhyme), 3), 2) AS rhyme FROM b GROUP BY shown""",
    "score_summary": f"WITH {JUDGED} SELECT source, min(total) AS min, max(total) AS max, round(avg(total), 6) AS mean, round(stddev_samp(total), 6) AS std, count(total) AS n FROM judged GROUP BY source",
    "score_box_plot": f"WITH {JUDGED} SELECT source, quantile_cont(total, 0.0) AS low, quantile_cont(total, 0.25) AS q1, quantile_cont(total, 0.5) AS median, quantile_cont(total, 0.75) AS q3, quantile_cont(total, 1.0) AS high FROM judged GROUP BY source",
    "score_correlations": f"WITH {JUDGED} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM judged" for i, a in enumerate(_METRICS) for b in _METRICS[i + 1 :]),
    "score_human_correlation": f"""WITH {JUDGED}, b AS (SELECT *, split_part(source, '_vs_', 1) AS base FROM judged), i AS (SELECT item_id, base, file, avg(total) AS total FROM b GROUP BY ALL), m AS (SELECT item_id, base, avg(total) AS total FROM i GROUP BY ALL)
      SELECT x.base, round(corr(x.total, h.total), 6) AS r, count(*) AS n FROM m x JOIN m h ON x.item_id = h.item_id AND h.base = 'human' WHERE x.base <> 'human' GROUP BY x.base""",
    "score_best_closest": f"""WITH {JUDGED}, m AS (SELECT split_part(source, '_vs_', 1) AS base, avg(total) AS mean FROM judged GROUP BY 1)
      SELECT (SELECT base FROM m ORDER BY mean DESC, base LIMIT 1) AS best, (SELECT base FROM m WHERE base <> 'human' ORDER BY abs(mean - (SELECT mean FROM m WHERE base = 'human')), base LIMIT 1) AS closest""",
    "score_kinds": f"WITH {JUDGED} SELECT CAST(sum(CASE WHEN contains(source, '_vs_') THEN 0 ELSE 1 END) AS BIGINT) AS single, CAST(sum(CASE WHEN contains(source, '_vs_') THEN 1 ELSE 0 END) AS BIGINT) AS comparative FROM judged",
    "score_validity": "SELECT l_returnflag, CAST(sum(CASE WHEN l_linenumber <> 3 AND l_quantity BETWEEN 0 AND 10 AND l_discount * 100 BETWEEN 0 AND 10 THEN 1 ELSE 0 END) AS BIGINT) AS n_valid, count(*) AS n FROM lineitem GROUP BY l_returnflag",
    "score_fanout": f"WITH {WIDE} SELECT item_id, source, kind, replace(replace(CAST(item_id AS VARCHAR) || '_' || source || '_' || kind, '-', '_'), '.', '_') AS custom_id FROM requests",
    "score_requests": f"WITH {WIDE} SELECT CAST(sum(CASE WHEN human IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN a IS NOT NULL THEN 2 ELSE 0 END + CASE WHEN b IS NOT NULL THEN 2 ELSE 0 END) AS BIGINT) AS requests FROM wide",
    "custom_id_roundtrip": f"WITH {WIDE} SELECT replace(replace(CAST(item_id AS VARCHAR) || '_' || source || '_' || kind, '-', '_'), '.', '_') AS custom_id, CAST(item_id AS VARCHAR) AS item_id, source, kind FROM requests",
    "score_unswap": """SELECT l_orderkey * 8 + l_linenumber AS item_id, l_returnflag || '_vs_human' AS source, CASE WHEN l_suppkey % 2 = 0 THEN l_quantity ELSE l_tax END AS score FROM lineitem
      UNION ALL SELECT l_orderkey * 8 + l_linenumber, 'human_vs_' || l_returnflag, CASE WHEN l_suppkey % 2 = 0 THEN l_tax ELSE l_quantity END FROM lineitem""",
    "quality_score": """SELECT l_orderkey, l_linenumber, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE - CASE WHEN l_linenumber < 5 AND l_quantity < 20 THEN 0.4::DOUBLE ELSE 0.0::DOUBLE END - CASE WHEN l_discount > 0.05::DOUBLE THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END,
      CASE WHEN l_returnflag <> 'N' THEN 1 - l_tax * 10 END)), 6) AS quality FROM lineitem""",
    "bait_rollup": """WITH g AS (SELECT l_orderkey, count(*) AS n, CAST(sum(CASE WHEN l_quantity > 10 THEN 1 ELSE 0 END) AS BIGINT) AS n_valid, string_agg(CASE WHEN l_quantity <= 10 THEN CAST(l_linenumber AS VARCHAR) END, ', ' ORDER BY l_linenumber) AS bad FROM lineitem GROUP BY l_orderkey)
      SELECT l_orderkey, n, n_valid, n = n_valid AS all_valid, CASE WHEN n = n_valid THEN 'all pairs are valid' WHEN n_valid = 0 THEN 'no pair is valid' WHEN n - n_valid < 5 THEN 'invalid pairs: ' || bad ELSE CAST(n - n_valid AS VARCHAR) || ' of ' || CAST(n AS VARCHAR) || ' pairs are invalid' END AS said FROM g""",
    "early_stop": "SELECT l_orderkey, l_linenumber, l_quantity FROM (SELECT *, min(CASE WHEN l_quantity >= 45 THEN l_linenumber END) OVER (PARTITION BY l_orderkey) AS f FROM lineitem) WHERE f IS NULL OR l_linenumber <= f",
    "best_of_n": "SELECT l_orderkey, l_linenumber, score FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC NULLS LAST, l_linenumber) AS r FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag <> 'A' THEN l_quantity END AS score FROM lineitem)) WHERE r = 1",
    "result_join": "SELECT o_orderkey AS custom_id, o_totalprice, l_linenumber, l_quantity FROM orders JOIN lineitem ON l_orderkey = o_orderkey",
    "result_misses": "SELECT o_orderkey AS custom_id, o_orderpriority FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 4)",
    "unprocessed_sample": "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) >= 4 ORDER BY md5('7:' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 50",
    "upsert_missing": "SELECT DISTINCT o_custkey AS id, 'order' AS origin FROM orders UNION ALL SELECT c_custkey, 'customer' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
    "has_a_not_b": "SELECT o_custkey FROM orders GROUP BY o_custkey HAVING bool_or(o_orderpriority = '1-URGENT') AND NOT bool_or(o_orderpriority = '5-LOW')",
    "append_first_match": "SELECT o_custkey, min(o_orderkey) AS o_orderkey, max(c_name) AS o_orderpriority FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY o_custkey HAVING NOT bool_or(o_orderpriority = '2-HIGH')",
    "last_wins": "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM orders) WHERE r = 1",
    "virtual_ids": "SELECT p_partkey, p_size, row_number() OVER (ORDER BY p_size, p_partkey) - 1 AS virtual_id FROM part",
    "batch_chunks": "SELECT s_suppkey, CAST((row_number() OVER (ORDER BY s_suppkey) - 1) // 7 AS BIGINT) AS batch FROM supplier",
    "delete_renumber": "SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS virtual_id FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS v FROM part) WHERE v <> 5",
    "progress": "SELECT CAST(sum(CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 1 ELSE 0 END) AS BIGINT) AS processed, count(*) AS total, round(sum(CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 1 ELSE 0 END) * 100.0::DOUBLE / count(*), 6) AS percent FROM (SELECT DISTINCT doc_id FROM documents)",
    "section_split": "WITH l AS (SELECT doc_id, unnest(x) AS line, unnest(range(0, len(x))) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL)), s AS (SELECT *, CAST(sum(CASE WHEN length(line) < 20 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) AS section FROM l) SELECT doc_id, section, md5(string_agg(line, chr(10) ORDER BY pos)) AS digest, count(*) AS n_lines FROM s GROUP BY doc_id, section",
    "web_gate": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 7 AND l_linenumber < 4",
    "html_lines": _HTML,
    "id_from_name": "SELECT page_id, TRY_CAST(nullif(regexp_extract(url, '/([0-9]+)', 1), '') AS BIGINT) AS poem_id FROM pages",
    "json_from_text": "SELECT event_id, props AS json FROM events",
    "null_text": "SELECT CASE WHEN event_id % 3 <> 0 THEN event_type END AS event_type, count(*) AS n FROM events GROUP BY 1",
    "trace_rollup": "SELECT user_id, count(*) AS n_calls, CAST(sum(CASE WHEN event_type <> 'click' THEN 1 ELSE 0 END) AS BIGINT) AS n_llm, CAST(sum(floor(value)) AS BIGINT) AS tokens, CAST((epoch_us(max(ts)) - epoch_us(min(ts))) // 1000 AS BIGINT) AS duration_ms FROM events GROUP BY user_id",
    "trace_narrative": "SELECT user_id, md5(string_agg('Step ' || CAST(step AS VARCHAR) || ': ' || event_type || chr(10) || CAST(event_id AS VARCHAR), chr(10) || chr(10) ORDER BY step)) AS digest FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step FROM events) GROUP BY user_id",
    "trace_messages": "SELECT conv_id, md5(coalesce(string_agg(CASE WHEN role = 'assistant' AND last > 1 THEN text END, chr(10) || chr(10) ORDER BY turn), '')) AS digest FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) AS last FROM conversations) GROUP BY conv_id",
    "error_kinds": "SELECT CASE turn WHEN 1 THEN 'rate_limit' WHEN 2 THEN 'connection' ELSE 'other' END AS kind, count(*) AS n FROM conversations GROUP BY 1",
    "template_parameters": "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'n,theme,meter,poet' ELSE 'n,theme,meter' END AS parameters, CASE WHEN doc_id % 2 = 0 THEN 'meter,poet' ELSE 'meter' END AS missing FROM documents",
}
