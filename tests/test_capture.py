"""What a captured flow tells of each node."""

import pytest
from pyspark.sql import functions as F

from rawi.operators import flow as W


def flow(*more):
    f = W.Flow().then("even", lambda df: df.filter("id % 2 = 0"), ("id",)).then("twice", lambda df: df.union(df).withColumn("x", F.col("id") * 2))
    for name, node, needs in more:
        f = f.then(name, node, needs)
    return f


def told(captured):
    return [(r.step, r.component, r.status, r.rows_in, r.rows_out) for r in captured.trace.orderBy("step").collect()]


def test_rows_metrics_and_time(spark):
    got = W.captured(flow(("small", lambda df: df.filter("x < 10"), ("x",))), spark.range(10), run="r1", metrics={"x": "max"})
    assert told(got) == [(1, "even", "ok", 10, 5), (2, "twice", "ok", 5, 10), (3, "small", "ok", 10, 6)]
    assert sorted(r.id for r in got.result.collect()) == [0, 0, 2, 2, 4, 4]
    rows = got.trace.orderBy("step").collect()
    assert [dict(r.metrics) for r in rows] == [{}, {"x": 16.0}, {"x": 8.0}]
    assert all(r.duration_ms >= 0 and r.error is None and r.run == "r1" for r in rows) and rows[0].started < rows[1].started < rows[2].started


@pytest.mark.parametrize("kind", ["while running", "while planning", "by its needs"])
def test_a_node_that_fails(spark, kind):
    bad = {
        "while running": (lambda df: df.withColumn("y", F.raise_error(F.lit("no luck"))), ()),
        "while planning": (lambda df: df.select("none_such"), ()),
        "by its needs": (lambda df: df, ("missing",)),
    }[kind]
    got = W.captured(flow(("bad", *bad), ("after", lambda df: df, ())), spark.range(10))
    assert told(got) == [(1, "even", "ok", 10, 5), (2, "twice", "ok", 5, 10), (3, "bad", "failed", 10, None), (4, "after", "skipped", None, None)]
    assert got.result is None
    error = got.trace.filter("step = 3").first().error
    assert {"while running": "no luck", "while planning": "none_such", "by its needs": "bad needs missing"}[kind] in error


def test_one_plan_with_observations(spark):
    out, seen = W.observed(flow(), spark.range(10))
    assert len(out.collect()) == 10
    assert {k: o.get["rows"] for k, o in seen.items()} == {"even": 5, "twice": 10}
