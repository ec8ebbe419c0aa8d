"""Batch outcomes under any cut into triggers, and batches that are saved once."""

import os
import random
import tempfile
from datetime import datetime, timedelta, timezone

import pandas as pd
import pytest
from pyspark.sql import functions as F

from rawi.streaming import batches as B
from rawi.streaming import sink as K

BEGIN = datetime(2024, 1, 1, tzinfo=timezone.utc)
LATE, WAIT = 600, 3600


def replay(seed=3, n=60):
    """(batch_id, custom_id, ok, state, at, n_requests, submitted_at) reports in the order in which they arrive."""
    rng = random.Random(seed)
    out = []
    for b in range(n):
        begin, size = rng.randrange(0, 20_000), rng.choice([1, 3, 20])
        for i in range(size):
            if rng.random() < 0.97:
                for _ in range(rng.choice([1, 1, 2, 3])):  # repeated, and sometimes failed first
                    out.append((f"b{b}", f"r{i}", rng.random() < rng.choice([0.99, 0.6]), None, begin + rng.randrange(0, rng.choice([600, 5000])), size, begin))
        for _ in range(rng.choice([0, 0, 1, 2])):
            out.append((f"b{b}", None, None, rng.choice(["running", "ended", "FAILED", "expired", "cancelled", "canceled", "completed", None]), begin + rng.randrange(0, 4000), size, begin))
    out += [("last", "x", True, None, 60_000, 1, 60_000)]  # moves the watermark past all deadlines
    return sorted(out, key=lambda r: (r[4] + rng.randrange(0, LATE - 1), r[0]))


def brute(rows):
    """Outcomes by going through all moments of each batch."""
    out = set()
    for b in {r[0] for r in rows} - {"last"}:
        mine = [r for r in rows if r[0] == b]
        size, end = mine[0][5], mine[0][6] + WAIT
        for t in sorted({r[4] for r in mine if r[4] <= end} | {end}):
            ids = {}
            for r in sorted((r for r in mine if r[1] and r[4] <= t), key=lambda r: (r[4], r[2])):
                ids[r[1]] = r[2]
            good = sum(ids.values())
            told = min((B.FINAL[r[3].lower()] for r in mine if r[3] and r[3].lower() in B.FINAL and r[4] == t), default=None)
            if len(ids) >= size and good >= 0.95 * size:
                found = "completed"
            elif told:
                found = "failed_with_results" if told == "failed" and good else told
            elif t == end:
                found = "partial" if good else "timed_out"
            else:
                continue
            if any(r[1] or r[3] and r[3].lower() in B.FINAL for r in mine if r[4] <= end):
                out.add((b, found, (int(BEGIN.timestamp()) + t) * 1000, size, good, len(ids) - good))
            break
    return out


def arriving(rows, files):
    """A folder to which the reports come in files, one second apart."""
    folder = tempfile.mkdtemp(prefix="spark-")
    moment = lambda s: pd.Timestamp(BEGIN + timedelta(seconds=s))
    for k in range(files):
        part = rows[k * len(rows) // files : (k + 1) * len(rows) // files]
        frame = pd.DataFrame([(*r[:4], moment(r[4]), r[5], moment(r[6])) for r in part], columns=["batch_id", "custom_id", "ok", "state", "at", "n_requests", "submitted_at"])
        frame = frame.astype({"custom_id": "string", "ok": "boolean", "state": "string"})
        frame.to_parquet(f"{folder}/{k:04}.parquet", coerce_timestamps="us", allow_truncated_timestamps=True)
        os.utime(f"{folder}/{k:04}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    return folder


def run(spark, rows, files, per_trigger, root=None, save=None):
    root = root or tempfile.mkdtemp(prefix="spark-")
    stream = spark.readStream.schema(B.REPORT).option("maxFilesPerTrigger", per_trigger).parquet(arriving(rows, files) if isinstance(rows, list) else rows)
    out = B.outcomes(stream, max_wait=f"{WAIT} seconds", lateness=f"{LATE} seconds")
    out.writeStream.foreachBatch(save or K.saver(f"{root}/table")).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return K.saved(spark, f"{root}/table", B.OUTCOME)


@pytest.mark.parametrize(("files", "per_trigger"), [(1, 1), (7, 1), (12, 5)])
def test_outcomes_do_not_depend_on_triggers(spark, files, per_trigger):
    rows = replay()
    want = brute(rows)
    assert {tuple(r) for r in run(spark, rows, files, per_trigger).collect()} == want
    assert {r[1] for r in want} >= {"completed", "partial", "failed_with_results", "cancelled", "timed_out"}


def test_decisions_by_hand():
    item = lambda t, i, ok: [t, i, ok, None]
    assert B.decide([item(5, "a", True), item(7, "b", True)], 2, 100, 0.95) == ("completed", 7, 2, 0)
    assert B.decide([item(5, "a", False), item(7, "b", True), item(9, "a", True)], 2, 100, 0.95) == ("completed", 9, 2, 0)
    assert B.decide([item(5, "a", True), item(6, "a", False)], 1, 100, 0.95) == ("completed", 5, 1, 0)
    assert B.decide([item(5, "a", True)], 2, 100, 0.95) == ("partial", 100, 1, 0)
    assert B.decide([item(5, "a", False), [8, None, None, "failed"]], 2, 100, 0.95) == ("failed", 8, 0, 1)
    assert B.decide([item(5, "a", True), [8, None, None, "failed"]], 2, 100, 0.95) == ("failed_with_results", 8, 1, 0)
    assert B.decide([], 2, 100, 0.95) == ("timed_out", 100, 0, 0)


def test_usable_results_and_pending(spark):
    at = lambda s: BEGIN + timedelta(seconds=s)
    items = spark.createDataFrame(
        [("b", "r1", False, at(1), "bad"), ("b", "r1", True, at(2), "good"), ("b", "r2", True, at(3), "old"), ("b", "r2", False, at(4), "new"), ("b", "r3", True, at(99), "late"), ("c", "r1", True, at(1), "x"), ("b", None, None, at(1), None)],
        "batch_id string, custom_id string, ok boolean, at timestamp, content string",
    )
    ms = int(at(10).timestamp() * 1000)
    decided = spark.createDataFrame([("b", "partial", ms, 3, 1, 1), ("c", "expired", ms, 1, 0, 0)], B.OUTCOME)
    assert [(r.custom_id, r.content) for r in B.usable_results(items, decided).collect()] == [("r1", "good")]
    assert [r.batch_id for r in B.pending(items.select("batch_id").union(spark.createDataFrame([("d",)], "batch_id string")), decided).collect()] == ["d"]


def test_a_batch_that_was_stopped_is_saved_once(spark, monkeypatch):
    rows, root = replay(5, 20), tempfile.mkdtemp(prefix="spark-")
    folder, commit, calls = arriving(rows, 6), K._commit, []

    def breaks(*args):
        calls.append(args)
        if len(calls) == 3:
            raise RuntimeError("stopped between data and manifest")
        commit(*args)

    monkeypatch.setattr(K, "_commit", breaks)
    with pytest.raises(Exception, match="stopped between"):
        run(spark, folder, 6, 1, root)
    assert len(os.listdir(f"{root}/table/data")) == len(os.listdir(f"{root}/table/manifest")) + 1
    got = run(spark, folder, 6, 1, root).collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows))


def test_repeated_batches_and_compaction(spark):
    root = tempfile.mkdtemp(prefix="spark-")
    a, b = spark.range(5), spark.range(5, 8)
    assert K.saved(spark, root, "id long").count() == 0 and K.compact(spark, root, "id long") == 0
    assert K.save_batch(a, 0, root) and K.save_batch(b, 1, root) and K.save_batch(b.limit(0), 2, root)
    assert not K.save_batch(a, 0, root) and not K.save_batch(b, 1, root)
    assert K.save_batch(a, 0, root, run="other")
    want = sorted([*range(8), *range(5)])
    assert sorted(r.id for r in K.saved(spark, root, "id long").collect()) == want
    assert K.compact(spark, root, "id long") == 4
    assert sorted(r.id for r in K.saved(spark, root, "id long").collect()) == want
    assert not K.save_batch(a, 0, root), "a batch that was compacted is not saved again"
    assert K.save_batch(spark.range(9, 10), 3, root)
    assert sorted(r.id for r in K.saved(spark, root, "id long").collect()) == [*want, 9]
    K._commit(spark, root, "run", 3, "run-3-zzz", 1, [])  # a second attempt that also finished
    K.saved(spark, root, "id long").select(F.col("id")).write.mode("overwrite").parquet(f"{root}/data/run-3-zzz")
    assert K.saved(spark, root, "id long").count() == len(want) + 1


def test_every_report_moves_the_watermark(spark):
    told = [("a", "r0", True, None, 100, 1, 0), ("z", None, None, "running", 100 + LATE + 5, 1, 0)]
    assert {tuple(r)[:2] for r in run(spark, told, 1, 1).collect()} == {("a", "completed")}


def test_decided_as_soon_as_the_watermark_has_passed(spark):
    told = [("a", "r0", True, None, 100, 1, 0), ("z", "r0", True, None, 100.001 + LATE, 1, 0)]
    assert {tuple(r)[:2] for r in run(spark, told, 1, 1).collect()} == {("a", "completed")}


@pytest.mark.parametrize("turn", [1, -1])
def test_of_two_successes_at_one_time_the_greater_value_stands(spark, turn):
    at = BEGIN + timedelta(seconds=1)
    items = spark.createDataFrame([("b", "r1", True, at, v) for v in (2.0, 3.0, None)][::turn], "batch_id string, custom_id string, ok boolean, at timestamp, value double").coalesce(1)
    decided = spark.createDataFrame([("b", "partial", int(at.timestamp() * 1000), 1, 1, 0)], B.OUTCOME)
    assert [r.value for r in B.usable_results(items, decided, ties=("value",)).collect()] == [3.0]
