"""Configurable node flows: a node is a function from DataFrame to DataFrame.

Flows stay lazy.  The refinement loop is bounded and cuts its lineage by writing
each round to a shared table; rows that are done leave the loop, so later rounds
see only what still fails.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

Node = Callable[[DataFrame], DataFrame]


@dataclass
class Registry:
    """Node factories by name."""

    factories: dict[str, Callable[..., Node]] = field(default_factory=dict)

    def add(self, name: str):
        def wrap(factory):
            self.factories[name] = factory
            return factory

        return wrap

    def make(self, config: dict) -> Node:
        options = dict(config)
        kind = options.pop("type")
        if kind not in self.factories:
            raise ValueError(f"unknown node {kind}; there are {', '.join(sorted(self.factories))}")
        return self.factories[kind](**options)


@dataclass
class Flow:
    """Nodes in order; ``needs`` names columns that a node's input must have."""

    nodes: list[tuple[str, Node, tuple[str, ...]]] = field(default_factory=list)

    def then(self, name: str, node: Node, needs: tuple[str, ...] = ()) -> Flow:
        return Flow([*self.nodes, (name, node, needs)])

    def __call__(self, df: DataFrame) -> DataFrame:
        for name, node, needs in self.nodes:
            missing = [c for c in needs if c not in df.columns]
            if missing:
                raise ValueError(f"{name} needs {', '.join(missing)}")
            df = node(df)
        return df

    def names(self) -> list[str]:
        return [name for name, _, _ in self.nodes]

    def attempt(self, df: DataFrame, sink: Callable[[DataFrame], object]) -> dict:
        """Runs the flow into ``sink``: whether it succeeded, what the sink returned, the error if any, and the nodes."""
        try:
            return {"success": True, "result": sink(self(df)), "error": None, "nodes": self.names()}
        except Exception as e:  # noqa: BLE001 any failure is the answer
            return {"success": False, "result": None, "error": f"{type(e).__name__}: {e}", "nodes": self.names()}

    def traced(self, df: DataFrame) -> tuple[DataFrame, list[dict]]:
        """The result and a record of each node: its step, name, planning time and columns."""
        trace = []
        for step, (name, node, _) in enumerate(self.nodes, 1):
            began = time.monotonic()
            df = node(df)
            trace.append({"step": step, "component": name, "planning_ms": int((time.monotonic() - began) * 1000), "columns": list(df.columns)})
        return df, trace


TRACE = "run string, step int, component string, status string, rows_in long, rows_out long, metrics map<string,double>, started timestamp, duration_ms long, error string"


@dataclass
class Captured:
    """What a captured run gave: its result, or none where a node failed, and a row for each node."""

    result: DataFrame | None
    trace: DataFrame


def captured(flow: Flow, df: DataFrame, run: str = "run", metrics: dict[str, str] | None = None) -> Captured:
    """Runs a flow node by node and records what each node really did.

    The output of a node is written to a shared table, from which the next one reads, so
    the time and the error of a node are its own; rows and ``metrics`` (the aggregate of
    each column, where a node's output has it) are observed while it is written.  After a
    node that fails the others are told as skipped.
    """
    rows, at, told = [], df, None
    for step, (name, node, needs) in enumerate(flow.nodes, 1):
        if at is None:
            rows.append((run, step, name, "skipped", None, None, None, None, None, None))
            continue
        began, clock = datetime.now(timezone.utc), time.monotonic()
        seen, inside = Observation(), Observation()
        try:
            missing = [c for c in needs if c not in at.columns]
            if missing:
                raise ValueError(f"{name} needs {', '.join(missing)}")
            made = node(at.observe(inside, F.count(F.lit(1)).alias("rows")) if told is None else at)
            asked = {c: f for c, f in (metrics or {}).items() if c in made.columns}
            at = shared(made.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.call_function(f, F.col(c)).cast("double").alias(f"of_{c}") for c, f in asked.items()]))
            told = inside.get.get("rows") if told is None else told
            found = seen.get
            rows.append((run, step, name, "ok", told, found["rows"], {c: found[f"of_{c}"] for c in asked}, began, _since(clock), None))
            told = found["rows"]
        except Exception as e:  # noqa: BLE001 any failure is told
            rows.append((run, step, name, "failed", told, None, None, began, _since(clock), f"{type(e).__name__}: {str(e).strip().splitlines()[0]}"))
            at = None
    return Captured(at, df.sparkSession.createDataFrame(rows, TRACE))


def observed(flow: Flow, df: DataFrame) -> tuple[DataFrame, dict[str, Observation]]:
    """The flow as one plan, with an observation of each node's rows that can be read once an action has run."""
    seen = {}
    for name, node, _ in flow.nodes:
        seen[name] = Observation()
        df = node(df).observe(seen[name], F.count(F.lit(1)).alias("rows"))
    return df, seen


def _since(clock: float) -> int:
    return int((time.monotonic() - clock) * 1000)


def from_config(registry: Registry, configs: list[dict]) -> Flow:
    flow = Flow()
    for c in configs:
        flow = flow.then(c.get("name", c["type"]), registry.make({k: v for k, v in c.items() if k != "name"}))
    return flow


def shared_folder(spark: SparkSession, kind: str = "flow") -> str:
    """A new folder under ``spark.checkpoint.dir``; a local master without that setting gets one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        root = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def shared(df: DataFrame) -> DataFrame:
    """``df`` by way of a table in a folder that all executors share."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def refine(df: DataFrame, judge: Node, repair: Node, valid: Column, rounds: int = 3) -> DataFrame:
    """Judge all rows, then repair and judge again what is not valid, at most ``rounds`` times.

    ``judge`` sets what ``valid`` reads; ``repair`` keeps the columns.  The result
    has ``iteration``, the round in which a row was last judged.
    """
    judged = shared(judge(df).withColumn("iteration", F.lit(0)))
    done = [judged.filter(F.coalesce(valid, F.lit(True)))]
    left = judged.filter(~F.coalesce(valid, F.lit(True)))
    for i in range(1, rounds + 1):
        again = shared(judge(repair(left.select(*df.columns))).withColumn("iteration", F.lit(i)))
        last = i == rounds
        done.append(again if last else again.filter(F.coalesce(valid, F.lit(True))))
        left = again.filter(~F.coalesce(valid, F.lit(True)))
    if rounds == 0:
        done.append(left)
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def candidates(df: DataFrame, n: int, temperatures: list[float]) -> DataFrame:
    """Each row ``n`` times with its candidate number and a temperature in turn."""
    rows = df.withColumn("candidate", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return rows.withColumn("temperature", F.element_at(F.array(*[F.lit(t) for t in temperatures]), F.col("candidate") % len(temperatures) + 1))


def instances(items: DataFrame, n: int, key: str) -> DataFrame:
    """Each item ``n`` times, named ``<key>_gen_<k>``."""
    rows = items.withColumn("generation", F.explode(F.sequence(F.lit(1), F.lit(n))))
    return rows.withColumn("instance_id", F.concat(F.col(key).cast("string"), F.lit("_gen_"), F.col("generation").cast("string")))


def kept_or(existing: Column, generated: Column) -> Column:
    """What a row already has wins over what was generated."""
    return F.coalesce(F.when(existing != "", existing), generated)
