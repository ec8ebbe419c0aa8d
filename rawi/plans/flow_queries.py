"""Node flows with deterministic providers over the pairs of ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from rawi.operators import flow as W
from rawi.operators import scores as S
from rawi.operators.providers import RuleProvider, generate
from rawi.plans.data_queries import bait_pairs_of
from rawi.sources.tables import table


def _length_rule(prompt: str) -> str:
    return "invalid" if len(prompt) % 3 == 0 else "valid"


def _judge(df):
    said = generate(df.withColumn("prompt", F.concat("first", F.lit("#"), "second")), "prompt", lambda: RuleProvider(_length_rule))
    return said.withColumn("valid", F.col("answer") == "valid").drop("prompt", "answer", "error", "duration_ms")


def judged_pairs(spark, sf_dir):
    """Verdict of a deterministic judge on every pair, rolled up per document."""
    return S.roll_up(_judge(bait_pairs_of(spark, sf_dir)), "doc_id").select("doc_id", "n", "n_valid", "all_valid")


def refined_pairs(spark, sf_dir):
    """Pairs that fail lose the last character of their second half until they pass, at most twice."""
    repair = lambda df: df.withColumn("second", F.substring("second", F.lit(1), F.greatest(F.length("second") - 1, F.lit(0))))
    out = W.refine(bait_pairs_of(spark, sf_dir), _judge, repair, F.col("valid"), rounds=2)
    return out.groupBy("iteration", "valid").agg(F.count("*").alias("n"), F.sum(F.length("second")).alias("chars"))


def best_candidates(spark, sf_dir):
    """Three candidates per pair at different temperatures; the best by a fixed score."""
    rows = W.candidates(bait_pairs_of(spark, sf_dir), 3, [0.2, 0.7])
    scored = rows.withColumn("score", F.length("first") * F.col("temperature") - F.col("candidate")).withColumn("key", F.concat_ws("_", "doc_id", "pair_no"))
    return S.best_of(scored, "key", "candidate", "score").select("key", F.col("candidate").cast("long").alias("candidate"), F.round("score", 6).alias("score"))


def flow_trace(spark, sf_dir):
    """What each node of a flow did, with one that fails on the shortest text and one after it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    flow = (
        W.Flow()
        .then("known", lambda df: df.filter("lang IS NOT NULL AND text IS NOT NULL"), ("lang", "text"))
        .then("lines", lambda df: df.select("doc_id", F.explode(F.split("text", "\n")).alias("line")))
        .then("told", lambda df: df.filter(F.trim("line") != "").withColumn("chars", F.length("line")), ("line",))
        .then("by_document", lambda df: df.groupBy("doc_id").agg(F.sum("chars").alias("chars")))
        .then("strict", lambda df: df.withColumn("chars", F.when(F.col("chars") > 0, F.raise_error(F.lit("too many characters"))).otherwise(F.col("chars"))))
        .then("never", lambda df: df)
    )
    trace = W.captured(flow, docs, metrics={"chars": "sum"}).trace
    return trace.select("step", "component", "status", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("rows_in", "rows_out")], F.col("metrics")["chars"].alias("chars"), F.col("error").contains("too many characters").alias("told"))


QUERIES = {f.__name__: f for f in (judged_pairs, refined_pairs, best_candidates, flow_trace)}

_V = "list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x)), lambda x: x <> '')"
_PAIRS = f"pairs AS (SELECT doc_id, i // 2 AS pair_no, v[i + 1] AS first, v[i + 2] AS second FROM (SELECT doc_id, v, unnest(range(0, len(v), 2)) AS i FROM (SELECT doc_id, {_V} AS v FROM documents) WHERE len(v) % 2 = 0))"
SQL = {
    "judged_pairs": f"WITH {_PAIRS} SELECT doc_id, count(*) AS n, CAST(sum(CASE WHEN (length(first) + length(second) + 1) % 3 <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_valid, bool_and((length(first) + length(second) + 1) % 3 <> 0) AS all_valid FROM pairs GROUP BY doc_id",
    "refined_pairs": f"""WITH {_PAIRS} SELECT CASE WHEN (length(first) + length(second) + 1) % 3 <> 0 THEN 0 ELSE 1 END AS iteration, true AS valid, count(*) AS n,
      CAST(sum(CASE WHEN (length(first) + length(second) + 1) % 3 <> 0 THEN length(second) ELSE length(second) - 1 END) AS BIGINT) AS chars FROM pairs GROUP BY 1""",
    "best_candidates": f"WITH {_PAIRS}, c AS (SELECT CAST(doc_id AS VARCHAR) || '_' || CAST(pair_no AS VARCHAR) AS key, k AS candidate, length(first) * CASE k WHEN 1 THEN 0.7::DOUBLE ELSE 0.2::DOUBLE END - k AS score FROM pairs, (SELECT unnest(range(0, 3)) AS k)) SELECT key, candidate, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, candidate) AS r FROM c) WHERE r = 1",
    "flow_trace": """WITH known AS (SELECT doc_id, text FROM documents WHERE lang IS NOT NULL AND text IS NOT NULL), lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM known),
      told AS (SELECT doc_id, length(line) AS chars FROM lines WHERE trim(line) <> ''), n AS (SELECT (SELECT count(*) FROM documents) AS a, (SELECT count(*) FROM known) AS b, (SELECT count(*) FROM lines) AS c, (SELECT count(*) FROM told) AS d, (SELECT count(DISTINCT doc_id) FROM told) AS e, (SELECT CAST(sum(chars) AS DOUBLE) FROM told) AS chars)
      SELECT 1 AS step, 'known' AS component, 'ok' AS status, a AS rows_in, b AS rows_out, NULL AS chars, NULL AS told FROM n UNION ALL SELECT 2, 'lines', 'ok', b, c, NULL, NULL FROM n UNION ALL SELECT 3, 'told', 'ok', c, d, chars, NULL FROM n
      UNION ALL SELECT 4, 'by_document', 'ok', d, e, chars, NULL FROM n UNION ALL SELECT 5, 'strict', 'failed', e, 0, NULL, true FROM n UNION ALL SELECT 6, 'never', 'skipped', 0, 0, NULL, NULL FROM n""",
}
