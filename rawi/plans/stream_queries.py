"""Streams over ``events``: batches by user and span of days, with their outcomes and usable results."""

from __future__ import annotations

from pyspark.sql import functions as F

from rawi.operators.flow import shared_folder
from rawi.sources.tables import table
from rawi.streaming import batches as B
from rawi.streaming import sink as K

_SPAN = 5 * 86_400
_STATES = {0: "failed", 1: "cancelled", 2: "expired", 3: "ended", 4: "running"}


def _reports(events):
    """Events as reports: a signup tells of the batch, any other event of the request its number names."""
    k = F.get_json_object("props", "$.k").cast("long")
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)")  # the same in every time zone
    at = F.timestamp_micros(micros)
    span = F.floor(F.unix_seconds(at) / _SPAN)
    states = F.create_map(*[F.lit(x) for kv in _STATES.items() for x in kv])
    batch = F.concat_ws(":", "user_id", span)
    whole = F.col("event_type") == "signup"
    return events.select(batch.alias("batch_id"), F.when(~whole, k.cast("string")).alias("custom_id"), F.when(~whole, F.col("event_type") != "error").alias("ok"), F.when(whole, states[k % 12]).alias("state"), at.alias("at"), F.timestamp_seconds(span * _SPAN).alias("submitted_at"), "value")


def _decided(spark, sf_dir):
    """Outcomes of a stream over the events, saved batch by batch."""
    events = table(spark, sf_dir, "events")
    sizes = _reports(events).filter("custom_id IS NOT NULL").groupBy("batch_id").agg(F.countDistinct("custom_id").alias("n_requests"))
    stream = _reports(spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events*.parquet"))
    root = shared_folder(spark, "outcomes")
    out = B.outcomes(stream.drop("value").join(sizes, "batch_id"), max_wait="3 days", lateness="6 hours")
    out.writeStream.foreachBatch(K.saver(f"{root}/table")).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return K.saved(spark, f"{root}/table", B.OUTCOME)


def batch_outcomes(spark, sf_dir):
    return _decided(spark, sf_dir)


def batch_results(spark, sf_dir):
    found = B.usable_results(_reports(table(spark, sf_dir, "events")), _decided(spark, sf_dir), ties=("value",))
    return found.select("batch_id", "custom_id", "outcome", F.round("value", 6).alias("value"))


QUERIES = {f.__name__: f for f in (batch_outcomes, batch_results)}

_DECIDED = """reports AS (
  SELECT CAST(user_id AS VARCHAR) || ':' || CAST(CAST(floor(epoch(ts) / 432000) AS BIGINT) AS VARCHAR) AS batch_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
    event_type = 'signup' AS whole, event_type <> 'error' AS ok, epoch_us(ts) // 1000 AS t, CAST(floor(epoch(ts) / 432000) AS BIGINT) * 432000000 + 259200000 AS deadline, ts, value
  FROM events
), sizes AS (SELECT batch_id, count(DISTINCT k) AS n_requests FROM reports WHERE NOT whole GROUP BY batch_id),
told AS (
  SELECT r.*, n_requests, CASE WHEN whole THEN CASE k % 12 WHEN 0 THEN 'failed' WHEN 1 THEN 'cancelled' WHEN 2 THEN 'expired' WHEN 3 THEN 'completed' END END AS final
  FROM reports r JOIN sizes USING (batch_id)
), mark AS (SELECT max(t) - 21600000 AS m FROM told),
counted AS (SELECT * FROM told WHERE t <= deadline AND (NOT whole OR final IS NOT NULL)),
moments AS (SELECT DISTINCT batch_id, n_requests, deadline, t FROM counted UNION SELECT DISTINCT batch_id, n_requests, deadline, deadline FROM counted),
latest AS (
  SELECT m.batch_id, m.t, c.k, max_by(c.ok, c.t * 2 + CAST(c.ok AS INTEGER)) AS ok
  FROM moments m JOIN counted c ON c.batch_id = m.batch_id AND c.t <= m.t AND NOT c.whole GROUP BY ALL
), stood AS (
  SELECT m.*, count(l.k) AS n_told, count(CASE WHEN l.ok THEN 1 END) AS good FROM moments m LEFT JOIN latest l ON l.batch_id = m.batch_id AND l.t = m.t GROUP BY ALL
), states AS (SELECT batch_id, t, min(final) AS final FROM counted WHERE final IS NOT NULL GROUP BY ALL),
judged AS (
  SELECT s.*, CASE WHEN n_told >= n_requests AND good >= 0.95 * n_requests THEN 'completed' WHEN final = 'failed' AND good > 0 THEN 'failed_with_results' WHEN final IS NOT NULL THEN final
    WHEN s.t = deadline THEN CASE WHEN good > 0 THEN 'partial' ELSE 'timed_out' END END AS outcome
  FROM stood s LEFT JOIN states f ON f.batch_id = s.batch_id AND f.t = s.t
), decided AS (
  SELECT batch_id, outcome, t AS decided_ms, n_requests, good AS n_succeeded, n_told - good AS n_failed FROM judged WHERE outcome IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY batch_id ORDER BY t) = 1
)"""
SQL = {
    "batch_outcomes": f"WITH {_DECIDED} SELECT decided.* FROM decided, mark WHERE decided_ms < m",
    "batch_results": f"""WITH {_DECIDED} SELECT r.batch_id, CAST(r.k AS VARCHAR) AS custom_id, outcome, round(r.value, 6) AS value FROM reports r JOIN decided d ON d.batch_id = r.batch_id, mark
      WHERE decided_ms < m AND outcome IN ('completed', 'failed_with_results', 'partial') AND NOT r.whole AND r.t <= decided_ms
      QUALIFY row_number() OVER (PARTITION BY r.batch_id, r.k ORDER BY r.ts DESC, r.ok DESC, r.value DESC NULLS LAST) = 1 AND r.ok""",
}
