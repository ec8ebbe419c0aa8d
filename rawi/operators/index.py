"""An inverted index of a corpus on disk: posting lists by value and block, and rows by block.

Rows get dense ordinals in the order of ``poem_idx``; ``block`` ordinals form a block.
Three Parquet tables make the index:

* ``values``: each attribute value once, with its number of rows and blocks;
* ``postings``: for each value and block the sorted offsets of its rows, in files by
  attribute and sorted by value, so that a look-up reads the row groups of its values;
* ``rows``: the corpus with its line count, in a folder per block.

The order is found by the keys alone; the rows themselves are moved and written once.

A search looks its words up in ``values``, combines the lists of its values block by
block (a block that lacks one of the attributes is left out before lists are
intersected) and reads the rows of the blocks that are left.  A value that a third of
all rows have is many short lists, one for each block.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rawi.functions.text import norm, verse_count
from rawi.operators.search import ATTRIBUTES, Criteria, residual

#: Ordinals of a block.
BLOCK = 1 << 16
#: Values and blocks that are named in a scan's filter, and rows that are sent to all executors; beyond, they are joined.
NAMED_VALUES, NAMED_BLOCKS, SENT_ROWS = 1_000, 10_000, 500_000


@dataclass(frozen=True)
class Index:
    values: DataFrame
    postings: DataFrame
    rows: DataFrame
    columns: tuple[str, ...]


def _slots(corpus: DataFrame, path: str, size: int) -> list[tuple[float | None, int]]:
    """The least key of each slot of some ``size`` rows, and the number of rows before it; only keys are moved.

    A key is ``poem_idx`` as a double, and rows of one key are in one slot.
    """
    # the range number is stored, so places stay the same however often a task is run
    keys = corpus.select(F.col("poem_idx").cast("double").alias("key"))
    keys.repartitionByRange("key").withColumn("range", F.spark_partition_id()).write.mode("overwrite").parquet(path)
    ranges = corpus.sparkSession.read.parquet(path)
    before = F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = ranges.groupBy("range").agg(F.count("*").alias("n")).select("range", before.alias("before"))  # a row for each range
    place = F.col("before") + F.rank().over(Window.partitionBy("range").orderBy("key")) - 1
    placed = ranges.join(F.broadcast(starts), "range").select("key", place.alias("place"))
    slots = placed.groupBy(F.floor(F.col("place") / size).alias("slot")).agg(F.min("key").alias("first"), F.min("place").alias("start"))
    return [(r[0], r[1]) for r in slots.orderBy("slot").select("first", "start").collect()]


def _slotted(corpus: DataFrame, firsts: list[float | None]) -> DataFrame:
    """``corpus`` with the slot of each row; a null key is in the first slot."""
    if len(firsts) < 2:
        return corpus.withColumn("slot", F.lit(0))
    edges = Bucketizer(splits=[-math.inf, *firsts[1:], math.inf], inputCol="key", outputCol="slot", handleInvalid="keep")
    rows = edges.transform(corpus.withColumn("key", F.col("poem_idx").cast("double")))
    return rows.withColumn("slot", F.coalesce(F.col("slot").cast("int"), F.lit(0))).drop("key")


def build(corpus: DataFrame, path: str, block: int = BLOCK) -> Index:
    """Writes the index of ``corpus`` under ``path``, a folder that all executors share, and opens it."""
    spark, columns = corpus.sparkSession, corpus.columns
    slots = _slots(corpus, f"{path}/ranges", max(1, block // 8))
    starts = spark.createDataFrame([(slot, start) for slot, (_, start) in enumerate(slots)], "slot int, start long")  # a row for each slot
    inside = F.row_number().over(Window.partitionBy("slot").orderBy("poem_idx", F.xxhash64(*columns))) - 1
    numbered = _slotted(corpus, [first for first, _ in slots]).withColumn("inside", inside).join(F.broadcast(starts), "slot").withColumn("ordinal", F.col("start") + F.col("inside"))
    placed = numbered.select(*columns, verse_count(F.col("verses")).alias("n_verses"), F.floor(F.col("ordinal") / block).cast("int").alias("block"), (F.col("ordinal") % block).cast("int").alias("offset"))
    placed.sortWithinPartitions("block", "offset").write.mode("overwrite").partitionBy("block").parquet(f"{path}/rows")
    rows = spark.read.parquet(f"{path}/rows")
    named = F.explode(F.array(*[F.struct(F.lit(a).alias("attribute"), norm(F.col(a)).alias("value")) for a in ATTRIBUTES])).alias("entry")
    entries = rows.select("block", "offset", named).select("block", "offset", "entry.*").filter("value <> ''")
    lists = entries.groupBy("attribute", "value", "block").agg(F.sort_array(F.collect_list("offset")).alias("offsets"))
    sorted_lists = lists.repartitionByRange("attribute", "value", "block").sortWithinPartitions("attribute", "value", "block")
    sorted_lists.write.mode("overwrite").partitionBy("attribute").option("parquet.writer.version", "v2").parquet(f"{path}/postings")
    postings = spark.read.parquet(f"{path}/postings")
    ends = [F.min(F.col("block").cast("long") * block + F.get("offsets", F.lit(0))).alias("first"), F.max(F.col("block").cast("long") * block + F.element_at("offsets", -1)).alias("last")]
    counts = postings.groupBy("attribute", "value").agg(F.sum(F.size("offsets")).alias("n"), F.count("*").alias("n_blocks"), *ends)
    counts.write.mode("overwrite").parquet(f"{path}/values")
    return opened(spark, path)


def opened(spark: SparkSession, path: str) -> Index:
    """The index under ``path``; its files are listed once."""
    rows = spark.read.parquet(f"{path}/rows")
    return Index(spark.read.parquet(f"{path}/values"), spark.read.parquet(f"{path}/postings"), rows, tuple(c for c in rows.columns if c not in ("n_verses", "block", "offset")))


def posting_lists(index: Index, asked: dict[str, str]) -> DataFrame:
    """attribute, value, block and offsets of the values that hold the asked words."""
    holds = [(F.col("attribute") == a) & F.col("value").contains(key.strip().lower()) for a, key in asked.items()]
    found = index.values.filter(reduce(lambda a, b: a | b, holds)).select("attribute", "value", "n_blocks", "n")
    named = found.limit(NAMED_VALUES + 1).collect()
    if len(named) > NAMED_VALUES:
        return index.postings.join(found.select("attribute", "value"), ["attribute", "value"], "left_semi")
    by_attribute = [(F.col("attribute") == a) & F.col("value").isin([r.value for r in named if r.attribute == a]) for a in asked]
    lists = index.postings.filter(reduce(lambda a, b: a | b, by_attribute))
    # a few short lists are combined by one task, without a shuffle
    return lists.coalesce(1) if sum(r.n_blocks for r in named) <= NAMED_BLOCKS and sum(r.n for r in named) <= SENT_ROWS else lists


def matches(index: Index, asked: dict[str, str], mode: str = "AND") -> DataFrame:
    """block and the sorted offsets of the rows that match all of the asked words, or one of them."""
    lists = posting_lists(index, asked)
    columns = [F.flatten(F.collect_list(F.when(F.col("attribute") == a, F.col("offsets")))).alias(f"of_{a}") for a in asked]
    blocks = lists.groupBy("block").agg(*columns)
    if mode == "OR":
        both = reduce(F.array_union, [F.col(f"of_{a}") for a in asked])
    else:
        for a in asked:
            blocks = blocks.filter(F.size(f"of_{a}") > 0)
        both = reduce(F.array_intersect, [F.col(f"of_{a}") for a in asked])
    return blocks.select("block", F.sort_array(both).alias("offsets")).filter(F.size("offsets") > 0)


def search(index: Index, criteria: Criteria, limit: int | None = None) -> DataFrame:
    """The rows that ``operators.search.search`` gives, by way of the posting lists."""
    asked = {a: getattr(criteria, a) for a in ATTRIBUTES if getattr(criteria, a)}
    rest = residual(criteria, F.col("n_verses"))
    rows = index.rows
    if asked:
        found = matches(index, asked, criteria.mode)
        sizes = sorted(found.select("block", F.size("offsets")).limit(NAMED_BLOCKS + 1).collect())
        few = len(sizes) <= NAMED_BLOCKS
        plain = Criteria(mode=criteria.mode, **asked) == criteria
        if few and limit and plain:  # the first blocks hold the first rows
            upto, total = [], 0
            for block, n in sizes:
                if total >= limit:
                    break
                upto.append((block, n))
                total += n
            sizes = upto
        if few:
            named = F.col("block").isin([b for b, _ in sizes])
            rows, found = rows.filter(named), found.filter(named)
        offsets = found.select("block", F.explode("offsets").alias("offset"))
        offsets = F.broadcast(offsets) if few and sum(n for _, n in sizes) <= SENT_ROWS else offsets
        rows = rows.join(offsets, ["block", "offset"])
    rows = rows.filter(rest)
    rows = rows.orderBy("block", "offset").limit(limit) if limit else rows
    return rows.select(*index.columns)
