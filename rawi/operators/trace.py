"""Execution traces: roll-ups, step narratives and message lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def roll_up(calls: DataFrame, key: str, ts: str, tokens: str, provider: str) -> DataFrame:
    """Calls with a provider, token sum and duration in milliseconds from the first to the last call."""
    return calls.groupBy(key).agg(
        F.count("*").alias("n_calls"),
        F.count_if(F.col(provider).isNotNull()).alias("n_llm"),
        F.coalesce(F.sum(tokens), F.lit(0)).alias("tokens"),
        F.floor((F.unix_micros(F.max(ts).cast("timestamp")) - F.unix_micros(F.min(ts).cast("timestamp"))) / 1000).alias("duration_ms"),
    )


def steps(calls: DataFrame, key: str, *order: str) -> DataFrame:
    """Calls with their step number inside the execution."""
    return calls.withColumn("step", F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def narrative(numbered: DataFrame, key: str, component: str, detail: str) -> DataFrame:
    """One text per execution: a block for each step, in order.  An execution is a bounded list of calls."""
    block = F.concat(F.lit("Step "), F.col("step").cast("string"), F.lit(": "), F.col(component), F.lit("\n"), F.col(detail).cast("string"))
    rows = numbered.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("step", block.alias("block")))).alias("b"))
    return rows.select(key, F.array_join(F.transform("b", lambda x: x["block"]), "\n\n").alias("narrative"))


def _told(column: str):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def story(numbered: DataFrame, key: str, name: str, given: str, made: str, why: str) -> DataFrame:
    """Per execution: ``steps`` (four lines each), ``prompt``, ``constraints``, ``poem`` and ``quality``.

    The prompt and the constraints are what the first step got and made; poem and
    quality the last output that speaks of them.
    """
    lines = [F.lit("Step "), F.col("step").cast("string"), F.lit(": "), _told(name), F.lit("\nInput: "), _told(given), F.lit("\nOutput: "), _told(made), F.lit("\nReasoning: "), _told(why), F.lit("\n")]
    last = lambda hit: F.max_by(F.when(hit, F.col(made)), F.when(hit, F.col("step")))
    rows = numbered.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("step", F.concat(*lines).alias("block")))).alias("b"),
        F.coalesce(F.min_by(given, "step"), F.lit("No user prompt available")).alias("prompt"),
        F.coalesce(F.min_by(made, "step"), F.lit("No constraints available")).alias("constraints"),
        F.coalesce(last(F.col(made).contains("poem")), F.lit("No poem generated")).alias("poem"),
        F.coalesce(last(F.lower(made).contains("quality")), F.lit("No quality assessment")).alias("quality"),
    )
    return rows.withColumn("steps", F.array_join(F.transform("b", lambda x: x["block"]), "\n\n")).drop("b")


def exported(numbered: DataFrame, key: str, *fields: str) -> DataFrame:
    """One JSON text per execution: its key as ``execution_id`` and its ``calls`` in the order of their steps."""
    calls = F.array_sort(F.collect_list(F.struct("step", *fields))).alias("calls")
    return numbered.groupBy(F.col(key).alias("execution_id")).agg(calls).select("execution_id", F.to_json(F.struct("execution_id", "calls"), {"ignoreNullFields": "false"}).alias("json"))


def messages(turns: DataFrame, key: str, order: str, role: str, text: str) -> DataFrame:
    """Turns as an ordered array of (role, channel, content); the last assistant turn is on the final channel."""
    last = F.row_number().over(Window.partitionBy(key, role).orderBy(F.col(order).desc())) == 1
    channel = F.when((F.col(role) == "assistant") & last, "final").when(F.col(role) == "assistant", "analysis")
    rows = turns.withColumn("channel", channel)
    item = F.struct(F.col(order).alias("at"), F.col(role).alias("role"), "channel", F.col(text).alias("content"))
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("messages"))


def analysis_text(told: DataFrame, key: str, channel: str = "analysis") -> DataFrame:
    """Contents of one channel's assistant messages, joined by blank lines."""
    kept = F.filter("messages", lambda m: (m["role"] == "assistant") & (m["channel"] == channel))
    return told.select(key, F.array_join(F.transform(kept, lambda m: m["content"]), "\n\n").alias("text"))


def from_json_rows(text: DataFrame, column: str = "json") -> DataFrame:
    """Executions from their JSON, a row per call."""
    shape = "execution_id string, calls array<struct<component: string, provider: string, tokens: long, ts: timestamp>>"
    return text.select(F.from_json(column, shape).alias("x")).select("x.execution_id", F.explode("x.calls").alias("c")).select("execution_id", "c.*")
