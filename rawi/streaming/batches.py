"""Outcomes of judge batches from a stream of reports, one row per batch.

A report tells of one request of a batch (``custom_id``, ``ok``) or of the batch as a
whole (``state``).  A batch is decided at the earliest of these times:

* all its requests have ended and at least ``share`` of them succeeded: completed;
* its provider calls it completed, failed, expired or cancelled; one that failed with
  usable results is ``failed_with_results``;
* ``max_wait`` has passed since it was submitted: ``partial`` with, ``timed_out``
  without usable results.

The latest report of a request counts (of two at one time the good one).  A decision
is made when the watermark has passed its time, from the reports up to that time
alone.  So repeated reports, and those that come out of order by less than
``lateness``, give the same rows however the stream is cut into triggers.  The state
of a batch is its reports without their contents, and goes after its last possible time.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Final states as providers name them, and what they mean here.
FINAL = {"completed": "completed", "ended": "completed", "failed": "failed", "expired": "expired", "canceled": "cancelled", "cancelled": "cancelled"}
#: Outcomes whose results are used.
USABLE = ("completed", "failed_with_results", "partial")
REPORT = "batch_id string, custom_id string, ok boolean, state string, at timestamp, n_requests long, submitted_at timestamp"
OUTCOME = "batch_id string, outcome string, decided_ms long, n_requests long, n_succeeded long, n_failed long"


def final_state(c: Column) -> Column:
    """What a provider's state means once it is final, else null."""
    return F.create_map(*[F.lit(x) for kv in FINAL.items() for x in kv])[F.lower(c)]


def decide(reports: list, n_requests: int, deadline: int, share: float) -> tuple[str, int, int, int]:
    """(outcome, time, succeeded, failed) of a batch from [time, custom id or None, ok, final state or None] reports, at the latest at the deadline."""
    latest: dict[str, bool] = {}
    times = sorted({r[0] for r in reports if r[0] <= deadline})
    by_time: dict[int, list] = {}
    for r in sorted(reports, key=lambda r: (r[0], bool(r[2]))):
        by_time.setdefault(r[0], []).append(r)
    count = lambda: (sum(latest.values()), len(latest) - sum(latest.values()))
    good = 0
    for t in times:
        told = None
        for _, custom_id, ok, state in by_time[t]:
            if custom_id is not None:
                good += bool(ok) - latest.get(custom_id, False)
                latest[custom_id] = bool(ok)
            elif state is not None:
                told = min(told, state) if told else state
        if n_requests and len(latest) >= n_requests and good >= share * n_requests:
            return "completed", t, *count()
        if told:
            return "failed_with_results" if told == "failed" and good else told, t, *count()
    return "partial" if good else "timed_out", deadline, *count()


def _step(share: float, max_wait_ms: int):
    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else {"done": False, "reports": []}
        if state.hasTimedOut and held["done"]:
            state.remove()
            return
        for part in parts if not state.hasTimedOut else ():
            for r in part.itertuples():
                held["n"], held["end"] = int(r.n_requests), int(r.submitted_ms) + max_wait_ms
                if not held["done"]:
                    held["reports"].append([int(r.at_ms), r.custom_id, None if r.ok is None else bool(r.ok), r.final])
        now = state.getCurrentWatermarkMs()
        if not held["done"]:
            outcome, at, good, bad = decide(held["reports"], held["n"], held["end"], share)
            if at < now:
                held |= {"done": True, "reports": []}
                yield pd.DataFrame({"batch_id": [key[0]], "outcome": [outcome], "decided_ms": [at], "n_requests": [held["n"]], "n_succeeded": [good], "n_failed": [bad]})
        wake = held["end"] if held["done"] else at
        if held["done"] and wake < now:
            if state.exists:
                state.remove()
            return
        state.update((json.dumps(held),))
        state.setTimeoutTimestamp(max(wake, now + 1))  # it fires once the watermark is beyond it

    return run


def outcomes(reports: DataFrame, max_wait: str = "1 hour", share: float = 0.95, lateness: str = "10 minutes") -> DataFrame:
    """``OUTCOME`` rows of a stream of ``REPORT`` rows; reports after a batch's deadline do not count."""
    wait = int(pd.Timedelta(max_wait).total_seconds() * 1000)
    timed = reports.withWatermark("at", lateness)
    timed = timed.select("batch_id", "custom_id", "ok", final_state(F.col("state")).alias("final"), "at", "n_requests", F.unix_millis("at").alias("at_ms"), F.unix_millis("submitted_at").alias("submitted_ms"))
    # one condition that reads the time: a part of it without would be moved below the watermark, which then misses reports that do not count
    told = timed.filter(F.when(F.col("at_ms") <= F.col("submitted_ms") + wait, F.coalesce("custom_id", "final")).isNotNull())
    return told.groupBy("batch_id").applyInPandasWithState(_step(share, wait), OUTCOME, "held string", "append", GroupStateTimeout.EventTimeTimeout)


def usable_results(items: DataFrame, decided: DataFrame, ties: tuple[str, ...] = ()) -> DataFrame:
    """The successful items of decided batches as they stood at the decision: ``items`` rows (batch_id, custom_id, ok, at, ...) with their outcome.

    Of two successes at one time that with the greater ``ties`` stands.
    """
    used = decided.filter(F.col("outcome").isin(*USABLE)).select("batch_id", "outcome", "decided_ms")
    in_time = items.filter("custom_id IS NOT NULL").join(used, "batch_id").filter(F.unix_millis("at") <= F.col("decided_ms"))
    latest = Window.partitionBy("batch_id", "custom_id").orderBy(*[F.desc(c) for c in ("at", "ok", *ties)])
    return in_time.withColumn("nth", F.row_number().over(latest)).filter("nth = 1 AND ok").drop("nth")


def pending(requests: DataFrame, decided: DataFrame) -> DataFrame:
    """Batches that a resumed job still waits for."""
    return requests.join(decided.select("batch_id").distinct(), "batch_id", "left_anti")
