"""Corpus search and statistics over ``documents`` and ``labels``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rawi.functions import display as D
from rawi.operators import corpus as C
from rawi.operators import search as S
from rawi.sources.corpus import from_documents
from rawi.sources.tables import table


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: ``from_documents`` in SQL.
CORPUS = r"""marks AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
corpus AS (
  SELECT d.doc_id AS poem_idx, string_split(coalesce(text, ''), chr(10))[1] AS title, coalesce(lang, '') AS meter,
    string_split(coalesce(text, ''), chr(10)) AS verses, regexp_extract(coalesce(text, ''), '([a-z])[^a-z]*$', 1) AS qafiya,
    CASE WHEN toxic = 1 THEN 'satire' WHEN quality = 1 THEN 'praise' WHEN quality = 0 THEN 'elegy' ELSE '' END AS theme,
    coalesce(source, '') AS poet_name, 'Era ' || CAST(CAST(floor(n_chars / 1000.0) AS BIGINT) % 4 AS VARCHAR) AS poet_era,
    CASE WHEN d.doc_id % 4 = 0 THEN '' ELSE 'Place ' || CAST(d.doc_id % 7 AS VARCHAR) END AS poet_location,
    CASE WHEN d.doc_id % 3 = 0 THEN '' ELSE coalesce(lang, '') END AS language_type,
    len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> '')) AS n_verses, coalesce(text, '') AS text
  FROM documents d LEFT JOIN marks m ON m.doc_id = d.doc_id
)"""


def _sql(body: str) -> str:
    return f"WITH {CORPUS} {body}"


AND = S.Criteria(meter="EN ", theme="praise", poet_name="src1", min_verses=2, keywords=("the", "and"))
OR = S.Criteria(meter="fr", theme="satire", poet_era="era 3", max_verses=12, keywords=("zation", "the"), mode="OR")
_OR_HIT = "(meter LIKE '%fr%' OR theme LIKE '%satire%' OR lower(poet_era) LIKE '%era 3%') AND n_verses <= 12 AND (lower(text) LIKE '%zation%' OR lower(text) LIKE '%the%')"
_AND_HIT = "meter LIKE '%en%' AND theme LIKE '%praise%' AND poet_name LIKE '%src1%' AND n_verses >= 2 AND lower(text) LIKE '%the%' AND lower(text) LIKE '%and%'"


def corpus_search_and(spark, sf_dir):
    return S.search(corpus(spark, sf_dir), AND).select("poem_idx", "meter", "theme", "poet_name")


def corpus_search_or(spark, sf_dir):
    return S.search(corpus(spark, sf_dir), OR).select("poem_idx", "meter", "theme", "poet_era")


def corpus_search_limit(spark, sf_dir):
    return S.search(corpus(spark, sf_dir), S.Criteria(meter="en"), 25).select("poem_idx", "title")


def corpus_language_location(spark, sf_dir):
    return S.search(corpus(spark, sf_dir), S.Criteria(language_type="de", poet_location="place 3")).select("poem_idx", "language_type", "poet_location")


def corpus_examples(spark, sf_dir):
    return S.examples(corpus(spark, sf_dir), "en", "praise", None, 4).select("poem_idx", "title")


def corpus_from_constraints(spark, sf_dir):
    wanted = S.from_constraints({"meter": "es", "poet_style": "src", "register": "es", "line_count": 5, "keywords": None})
    return S.retrieve(corpus(spark, sf_dir), wanted, 1000, "exact_match").select("poem_idx")


def corpus_stats(spark, sf_dir):
    s = C.statistics(corpus(spark, sf_dir))
    lists = [F.array_join(f"{a}_values", ",").alias(f"{a}_values") for a in ("meter", "theme", "poet_era", "qafiya")]
    return s.select("total", "n_meter", "n_theme", "n_poet_name", "n_poet_era", F.round("avg_verses", 6).alias("avg_verses"), "min_verses", "max_verses", *lists)


def corpus_values(spark, sf_dir):
    return C.values(corpus(spark, sf_dir), "poet_name")


def corpus_index(spark, sf_dir):
    c = corpus(spark, sf_dir)
    out = None
    for a in S.ATTRIBUTES:
        part = C.inverted_index(c, a).withColumn("attribute", F.lit(a))
        out = part if out is None else out.unionByName(part)
    return out


def corpus_exists(spark, sf_dir):
    return C.exists(corpus(spark, sf_dir), {"meter": "fr", "theme": "epic", "qafiya": "e", "poet_name": "src19"})


def corpus_variations(spark, sf_dir):
    return C.variations(corpus(spark, sf_dir), "poet_era", "ERA")


def constraint_stats(spark, sf_dir):
    s = C.constraint_statistics(corpus(spark, sf_dir), S.Criteria(meter="en", theme="praise", qafiya="e"))
    return s.withColumns({c: F.round(c, 6) for c in ("all_percent", "any_percent")})


def feasibility(spark, sf_dir):
    return C.feasibility(corpus(spark, sf_dir), S.Criteria(meter="en", theme="epic", qafiya="n"))


def diverse_retrieval(spark, sf_dir):
    return S.diverse(corpus(spark, sf_dir), S.Criteria(meter="en", theme="praise", qafiya="e", poet_name="src1"), 12).withColumn("rank", F.col("rank").cast("long"))


def matched_criteria(spark, sf_dir):
    wanted = {"meter": "en", "theme": "praise", "qafiya": "e"}
    return corpus(spark, sf_dir).select("poem_idx", F.array_join(S.matched(wanted), ",").alias("matched"))


def category_profile(spark, sf_dir):
    return C.profile(table(spark, sf_dir, "part"), "p_type", examples=10).withColumn("percent", F.round("percent", 6))


def pattern_split(spark, sf_dir):
    return C.split_counts(table(spark, sf_dir, "part"), "p_type", "BRASS")


def corpus_sample(spark, sf_dir):
    return C.sample(corpus(spark, sf_dir), 30).select("poem_idx", "meter")


def value_suggestions(spark, sf_dir):
    c = corpus(spark, sf_dir)
    out = None
    for a in ("meter", "theme", "qafiya"):
        part = C.suggestions(c, a).withColumn("attribute", F.lit(a))
        out = part if out is None else out.unionByName(part)
    return out


def example_texts(spark, sf_dir):
    c = corpus(spark, sf_dir)
    text = D.example_text(*[F.col(x) for x in ("title", "poet_name", "poet_era", "meter", "qafiya", "theme")], F.slice("verses", 1, 2))
    return c.select("poem_idx", text.alias("example"))


def constraint_texts(spark, sf_dir):
    said = D.constraint_text({"meter": F.col("meter"), "theme": F.col("theme"), "place": F.col("poet_location")})
    return corpus(spark, sf_dir).groupBy(said.alias("said")).agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        corpus_search_and, corpus_search_or, corpus_search_limit, corpus_language_location, corpus_examples, corpus_from_constraints, corpus_stats, corpus_values,
        corpus_index, corpus_exists, corpus_variations, constraint_stats, feasibility, diverse_retrieval, matched_criteria, category_profile, pattern_split, corpus_sample, value_suggestions, example_texts, constraint_texts,
    )
}

_INDEX = " UNION ALL ".join(f"SELECT '{a}' AS attribute, lower(trim({a})) AS value, count(*) AS n, min(poem_idx) AS first_idx, max(poem_idx) AS last_idx FROM corpus WHERE trim({a}) <> '' GROUP BY lower(trim({a}))" for a in S.ATTRIBUTES)

SQL = {
    "corpus_search_and": _sql(f"SELECT poem_idx, meter, theme, poet_name FROM corpus WHERE {_AND_HIT}"),
    "corpus_search_or": _sql(f"SELECT poem_idx, meter, theme, poet_era FROM corpus WHERE {_OR_HIT}"),
    "corpus_search_limit": _sql("SELECT poem_idx, title FROM corpus WHERE meter LIKE '%en%' ORDER BY poem_idx LIMIT 25"),
    "corpus_language_location": _sql("SELECT poem_idx, language_type, poet_location FROM corpus WHERE (language_type = '' OR language_type LIKE '%de%') AND lower(poet_location) LIKE '%place 3%'"),
    "corpus_examples": _sql("SELECT poem_idx, title FROM corpus WHERE meter LIKE '%en%' AND theme LIKE '%praise%' AND n_verses BETWEEN 3 AND 5 ORDER BY poem_idx LIMIT 5"),
    "corpus_from_constraints": _sql("SELECT poem_idx FROM corpus WHERE meter LIKE '%es%' AND poet_name LIKE '%src%' AND (language_type = '' OR language_type LIKE '%es%') AND n_verses BETWEEN 4 AND 6 ORDER BY poem_idx LIMIT 1000"),
    "corpus_stats": _sql("""SELECT count(*) AS total, count(DISTINCT nullif(meter, '')) AS n_meter, count(DISTINCT nullif(theme, '')) AS n_theme, count(DISTINCT nullif(poet_name, '')) AS n_poet_name,
      count(DISTINCT nullif(poet_era, '')) AS n_poet_era, round(avg(n_verses), 6) AS avg_verses, min(n_verses) AS min_verses, max(n_verses) AS max_verses,
      string_agg(DISTINCT nullif(meter, ''), ',' ORDER BY nullif(meter, '')) AS meter_values, string_agg(DISTINCT nullif(theme, ''), ',' ORDER BY nullif(theme, '')) AS theme_values,
      string_agg(DISTINCT nullif(poet_era, ''), ',' ORDER BY nullif(poet_era, '')) AS poet_era_values, string_agg(DISTINCT nullif(qafiya, ''), ',' ORDER BY nullif(qafiya, '')) AS qafiya_values FROM corpus"""),
    "corpus_values": _sql("SELECT DISTINCT poet_name AS value FROM corpus WHERE poet_name <> ''"),
    "corpus_index": _sql(_INDEX),
    "corpus_exists": _sql("SELECT bool_or(meter LIKE '%fr%') AS has_meter, bool_or(theme LIKE '%epic%') AS has_theme, bool_or(qafiya LIKE '%e%') AS has_qafiya, bool_or(poet_name LIKE '%src19%') AS has_poet_name FROM corpus"),
    "corpus_variations": _sql("SELECT DISTINCT arg_min(poet_era, poem_idx) AS spelling FROM corpus WHERE lower(poet_era) LIKE '%era%' GROUP BY lower(poet_era)"),
    "constraint_stats": _sql("""SELECT count(*) AS total, CAST(count_if(meter LIKE '%en%') AS BIGINT) AS meter_matches, CAST(count_if(theme LIKE '%praise%') AS BIGINT) AS theme_matches, CAST(count_if(qafiya LIKE '%e%') AS BIGINT) AS qafiya_matches,
      CAST(count_if(meter LIKE '%en%' AND theme LIKE '%praise%' AND qafiya LIKE '%e%') AS BIGINT) AS all_matches, CAST(count_if(meter LIKE '%en%' OR theme LIKE '%praise%' OR qafiya LIKE '%e%') AS BIGINT) AS any_matches,
      round(count_if(meter LIKE '%en%' AND theme LIKE '%praise%' AND qafiya LIKE '%e%') * 100.0::DOUBLE / count(*), 6) AS all_percent,
      round(count_if(meter LIKE '%en%' OR theme LIKE '%praise%' OR qafiya LIKE '%e%') * 100.0::DOUBLE / count(*), 6) AS any_percent FROM corpus"""),
    "feasibility": _sql("""SELECT false AS feasible, concat_ws('; ', CASE WHEN NOT bool_or(meter LIKE '%en%') THEN 'unknown meter' END, CASE WHEN NOT bool_or(theme LIKE '%epic%') THEN 'unknown theme' END,
      CASE WHEN NOT bool_or(qafiya LIKE '%n%') THEN 'unknown qafiya' END, CASE WHEN count_if(meter LIKE '%en%' AND theme LIKE '%epic%' AND qafiya LIKE '%n%') = 0 THEN 'no row meets all' END) AS issues,
      CAST(count_if(meter LIKE '%en%' AND theme LIKE '%epic%' AND qafiya LIKE '%n%') AS BIGINT) AS all_matches FROM corpus"""),
    "diverse_retrieval": _sql("""SELECT poem_idx, row_number() OVER (ORDER BY branch, k) AS rank FROM (
      SELECT poem_idx, min(branch) AS branch, min(k) AS k FROM (
        SELECT poem_idx, 0 AS branch, lpad(CAST(poem_idx AS VARCHAR), 20, '0') AS k FROM (SELECT poem_idx FROM corpus WHERE meter LIKE '%en%' ORDER BY poem_idx LIMIT 2)
        UNION ALL SELECT poem_idx, 1, lpad(CAST(poem_idx AS VARCHAR), 20, '0') FROM (SELECT poem_idx FROM corpus WHERE theme LIKE '%praise%' ORDER BY poem_idx LIMIT 2)
        UNION ALL SELECT poem_idx, 2, lpad(CAST(poem_idx AS VARCHAR), 20, '0') FROM (SELECT poem_idx FROM corpus WHERE qafiya LIKE '%e%' ORDER BY poem_idx LIMIT 2)
        UNION ALL SELECT poem_idx, 3, lpad(CAST(poem_idx AS VARCHAR), 20, '0') FROM (SELECT poem_idx FROM corpus WHERE poet_name LIKE '%src1%' ORDER BY poem_idx LIMIT 2)
        UNION ALL SELECT poem_idx, 4, md5('7:' || CAST(poem_idx AS VARCHAR)) FROM (SELECT poem_idx FROM corpus ORDER BY md5('7:' || CAST(poem_idx AS VARCHAR)), poem_idx LIMIT 20)
      ) GROUP BY poem_idx ORDER BY branch, k LIMIT 12)"""),
    "matched_criteria": _sql("""SELECT poem_idx, coalesce(nullif(concat_ws(',', CASE WHEN meter LIKE '%en%' THEN 'meter' END, CASE WHEN theme LIKE '%praise%' THEN 'theme' END, CASE WHEN qafiya LIKE '%e%' THEN 'qafiya' END), ''), 'meter,theme,qafiya') AS matched FROM corpus"""),
    "category_profile": """WITH c AS (SELECT p_type AS value, count(*) AS n FROM part WHERE p_type IS NOT NULL AND trim(p_type) <> '' GROUP BY p_type), t AS (SELECT count(*) AS all_rows FROM part),
      r AS (SELECT *, row_number() OVER (ORDER BY n DESC, value) AS place, sum(CASE WHEN n <= 5 THEN 1 ELSE 0 END) OVER (ORDER BY n, value ROWS UNBOUNDED PRECEDING) AS rare_place FROM c)
      SELECT value, n, place, round(n * 100.0::DOUBLE / all_rows, 6) AS percent, place <= 20 AS is_top, n <= 5 AND rare_place <= 10 AS is_rare_example FROM r, t""",
    "pattern_split": """SELECT value, n, has_token, place FROM (SELECT *, row_number() OVER (PARTITION BY has_token ORDER BY n DESC, value) AS place
      FROM (SELECT p_type AS value, count(*) AS n, contains(p_type, 'BRASS') AS has_token FROM part WHERE p_type IS NOT NULL GROUP BY p_type)) WHERE place <= 10""",
    "corpus_sample": _sql("SELECT poem_idx, meter FROM corpus ORDER BY md5('7:' || CAST(poem_idx AS VARCHAR)), poem_idx LIMIT 30"),
    "value_suggestions": _sql(" UNION ALL ".join(f"SELECT * FROM (SELECT DISTINCT {a} AS value, '{a}' AS attribute FROM corpus WHERE {a} <> '' ORDER BY value LIMIT 5)" for a in ("meter", "theme", "qafiya"))),
    "example_texts": _sql("SELECT poem_idx, title || ' (' || poet_name || ', ' || poet_era || ')' || chr(10) || concat_ws(' | ', meter, qafiya, nullif(theme, '')) || chr(10) || array_to_string(verses[1:2], chr(10)) || chr(10) AS example FROM corpus"),
    "constraint_texts": _sql("SELECT concat_ws(' | ', CASE WHEN meter <> '' THEN 'meter: ' || meter END, CASE WHEN theme <> '' THEN 'theme: ' || theme END, CASE WHEN poet_location <> '' THEN 'place: ' || poet_location END) AS said, count(*) AS n FROM corpus GROUP BY 1"),
}
