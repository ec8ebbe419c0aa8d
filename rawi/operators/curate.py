"""Dataset curation: joins that keep, drop, append and renumber items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rawi.functions.text import strip


def matched_results(requests: DataFrame, results: DataFrame, key: str = "custom_id") -> DataFrame:
    return requests.join(results, key)


def missed_results(requests: DataFrame, results: DataFrame, key: str = "custom_id") -> DataFrame:
    return requests.join(results.select(key).distinct(), key, "left_anti")


def unprocessed(items: DataFrame, done: DataFrame, key: str, condition: Column | None = None, n: int | None = None, seed: int = 7) -> DataFrame:
    """Items not done yet that meet the condition; with ``n``, a seeded sample of them."""
    left = items.join(done.select(key).distinct(), key, "left_anti")
    left = left if condition is None else left.filter(condition)
    return left if n is None else left.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(n)


def upsert_missing(items: DataFrame, more: DataFrame, key: str) -> DataFrame:
    """``items`` and those of ``more`` whose key is new."""
    return items.unionByName(more.join(items.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)


def has_and_not(rows: DataFrame, key: str, has: Column, lacks: Column) -> DataFrame:
    """Keys with a row that meets ``has`` and none that meets ``lacks``."""
    return rows.groupBy(key).agg(F.bool_or(F.coalesce(has, F.lit(False))).alias("h"), F.bool_or(F.coalesce(lacks, F.lit(False))).alias("l")).filter("h and not l").select(key)


def first_of(rows: DataFrame, key: str, *order: str | Column) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_n = 1").drop("_n")


def last_of(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    return first_of(rows, key, F.col(order).desc())


def append_responses(items: DataFrame, responses: DataFrame, key: str, order: str, taken: Column, **columns: Column) -> DataFrame:
    """For each response a copy of the key's first item with new columns, unless an item of the key is ``taken``."""
    first = first_of(items, key, order)
    barred = items.filter(taken).select(key).distinct()
    new = first.join(responses, key).join(barred, key, "left_anti")
    return new.withColumns(columns).select(*items.columns)


def numbered(df: DataFrame, *order: str | Column, name: str = "virtual_id") -> DataFrame:
    """0-based position in the given order.

    Rows are range-partitioned by the order; the positions inside a partition are
    shifted by the sizes of the partitions before it, so no task holds all rows.
    """
    parts = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_size"))
    earlier = F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return parts.withColumn("_in", inside).join(sizes.select("_part", earlier.alias("_off")), "_part").withColumn(name, F.col("_in") + F.col("_off")).drop("_part", "_in", "_off")


def chunks(df: DataFrame, size: int, *order: str | Column) -> DataFrame:
    """Rows with the number of their fixed-size batch."""
    return numbered(df, *order, name="_at").withColumn("batch", F.floor(F.col("_at") / size)).drop("_at")


def delete_and_renumber(df: DataFrame, position: int, *order: str | Column) -> DataFrame:
    kept = numbered(df, *order).filter(F.col("virtual_id") != position).drop("virtual_id")
    return numbered(kept, *order)


def progress(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """processed, total and percent."""
    flags = items.select(key).distinct().join(done.select(key).distinct().withColumn("_d", F.lit(1)), key, "left")
    total = F.count("*")
    return flags.agg(F.count("_d").alias("processed"), total.alias("total"), F.when(total > 0, F.count("_d") * 100.0 / total).otherwise(F.lit(0.0)).alias("percent"))


def sections(rows: DataFrame, key: str, order: str, line: str, starts: Column) -> DataFrame:
    """Lines grouped into sections, a new one at every line that ``starts``."""
    number = F.sum(starts.cast("int")).over(Window.partitionBy(key).orderBy(order))
    tagged = rows.withColumn("section", number)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, line))), lambda x: x[line]), "\n")
    return tagged.groupBy(key, "section").agg(joined.alias("text"), F.count("*").alias("n_lines"))


def by_model(provider: Column, model: Column, text: Column, wanted_provider: str, wanted_model: str) -> Column:
    """Is the text, not blank, of the provider and of a model whose name holds the wanted one?"""
    return F.coalesce((provider == wanted_provider) & model.contains(wanted_model) & (strip(text) != ""), F.lit(False))


def with_thoughts(model: Column, thoughts: Column, wanted_model: str) -> Column:
    """Is the answer of such a model, and are its thoughts known?"""
    return F.coalesce(model.contains(wanted_model) & (F.size(thoughts) > 0), F.lit(False))


def is_batch_id(c: Column) -> Column:
    return F.coalesce(c.startswith("batch_"), F.lit(False))


def entries(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """The values of each key as a list, in order; a key's list is a bounded set of records."""
    at = F.struct(F.col(order).alias("at"), F.col(value).alias("value"))
    return rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(at)), lambda x: x["value"]).alias("entries"))


def generated(answers: DataFrame, key: str, answer: str, error: str, generation: int = 1) -> DataFrame:
    """Records of new answers named ``<key>_gen_<k>``; failed ones are tagged, and empty answers without an error are dropped."""
    name = F.concat(F.col(key).cast("string"), F.lit(f"_gen_{generation}"), F.when(F.col(error).isNotNull(), "_error").otherwise(""))
    return answers.withColumn("instance_id", name).filter(F.col(error).isNotNull() | (strip(F.coalesce(F.col(answer), F.lit(""))) != ""))


def all_invalid(n: Column, message: Column) -> Column:
    """``n`` pairs, all invalid for one reason."""
    pair = lambda i: F.struct(i.alias("pair_no"), F.lit(False).alias("valid"), message.alias("message"))
    none = F.array().cast("array<struct<pair_no:bigint,valid:boolean,message:string>>")
    return F.when(n > 0, F.transform(F.sequence(F.lit(1).cast("long"), n.cast("long")), pair)).otherwise(none)
