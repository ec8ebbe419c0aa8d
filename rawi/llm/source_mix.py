"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Method.  Each source gets a word target: the sources, in code-point order with
null last, carry weights that repeat a given cycle; together they share a budget
of ``budget`` times all words; no target exceeds ``max_epochs`` times the words
of its source, and what is cut off is shared again by weight (water filling).  A
source is taken whole as many times as its target allows; the rest of the target
is drawn without replacement with keys ``-ln(u) / quality``, smallest first, up
to the prefix sum that comes nearest to the rest.  ``u`` is made from a digest of
the id and a seed, so reruns agree.

Scale.  Built-in functions only.  Texts are measured once and then left behind;
the prefix sum runs in two levels, within key ranges of a source and over the
totals of those ranges, so no source is sorted by one task.  The one ungrouped
window runs over a row per source.

Results on odd input.  Null texts have size 0 and null sources form a source of
their own.  A null id draws its key by its text.  Repeated ids share their key and are
taken in order of size; unknown quality weighs 1.  An empty table gives no rows.
A source without words has target 0.  Extra columns are ignored by
``mix_sources`` and kept by ``mixed``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh, size_of, table, words_of, written

#: Key ranges of a source that are summed apart.
RANGES = 4096
#: Rows of the mix that are sent to all executors, else joined by shuffle.
BROADCAST_TAKES = 500_000
#: Quality weights of the label values.
QUALITY = {1: 2.0, 0: 0.5}


def uniform(column: Column, seed: int) -> Column:
    """A number in (0, 1) from the text form of ``column``: 52 bits of its MD5 digest with the seed."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(column.cast("string"), F.lit("")))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def source_targets(sized: DataFrame, cycle=(3, 1, 2), budget: float = 1.5, max_epochs: int = 2) -> DataFrame:
    """One row per source: source, source_no, source_size, target (words)."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), (F.col("source_no") % len(cycle) + 1).cast("int"))
    sources = sources.withColumn("source_no", F.row_number().over(named) - 1).withColumn("weight", weight)
    # sources in the order in which they reach their cap as the level rises
    filling = Window.orderBy(F.col("source_size") / F.col("weight"), "source_no")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    after = filling.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    left = F.lit(budget) * F.sum("source_size").over(everything) - F.lit(max_epochs) * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    sources = (
        sources.withColumn("place", F.row_number().over(filling))
        .withColumn("left", left)
        .withColumn("over", F.sum("weight").over(after))
        .withColumn("fits", F.col("weight") * F.col("left") / F.col("over") <= F.lit(max_epochs) * F.col("source_size"))
    )
    level = F.min(F.when(F.col("fits"), F.struct("place", "left", "over"))).over(everything)
    sources = sources.withColumn("level", level)
    open_ = F.col("place") >= F.col("level.place")
    target = F.when(open_, F.col("weight") * F.col("level.left") / F.col("level.over")).otherwise(F.lit(max_epochs) * F.col("source_size"))
    return sources.select("source", "source_no", "source_size", target.cast("double").alias("target"))


def mix_sources(docs: DataFrame, quality: DataFrame | None = None, cycle=(3, 1, 2), budget: float = 1.5, max_epochs: int = 2, seed: int = 17, row: str | None = None) -> DataFrame:
    """How many words the mix takes of each document.

    ``quality`` has doc_id and a positive ``weight``.  Returns doc_id, size,
    source_size, target, copies (how often the document is taken) and taken, and
    before them ``row`` if named: a key of each row of ``docs``, which also orders
    rows of one id and size, after a hash of their texts.
    """
    own, ties = ([row], [F.xxhash64("text").alias("tie")]) if row else ([], [])
    # rows without an id would all draw one key, and so all lie in one range
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.xxhash64("text").cast("string")))
    sized = written(docs.select(*own, *ties, name.alias("name"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words_of().alias("size")))
    targets = source_targets(sized, cycle, budget, max_epochs)
    keyed = sized
    if quality is not None:
        weights = quality.groupBy("doc_id").agg(F.max("weight").alias("weight"))
        keyed = keyed.join(weights, "doc_id", "left")
    else:
        keyed = keyed.withColumn("weight", F.lit(1.0))
    key = -F.log(uniform(F.col("name"), seed)) / F.coalesce("weight", F.lit(1.0))
    keyed = keyed.withColumn("key", key).withColumn("range", F.least(F.floor((1 - F.exp(-F.col("key"))) * RANGES), F.lit(RANGES - 1)).cast("int"))
    other = targets.withColumnRenamed("source", "named")
    keyed = keyed.join(other, F.col("source").eqNullSafe(F.col("named"))).drop("named", "weight")
    ranges = keyed.groupBy("source_no", "range").agg(F.sum("size").alias("in_range"))
    earlier = Window.partitionBy("source_no").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("source_no", "range", F.coalesce(F.sum("in_range").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("source_no", "range").orderBy("key", F.col("doc_id").asc_nulls_first(), "size", *(["tie", *own] if own else [])).rowsBetween(Window.unboundedPreceding, 0)
    running = keyed.withColumn("upto", F.sum("size").over(inside)).join(ranges, ["source_no", "range"])
    epochs = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(max_epochs))).otherwise(F.lit(0)).cast("int")
    rest = F.col("target") - epochs * F.col("source_size")
    drawn = (epochs < max_epochs) & (2 * (F.col("before") + F.col("upto")) - F.col("size") <= 2 * rest)
    copies = epochs + drawn.cast("int")
    return running.select(*own, "doc_id", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))


def label_weights(labels: DataFrame) -> DataFrame:
    """doc_id and sampling weight from quality labels."""
    values = F.create_map(*[F.lit(x) for kv in QUALITY.items() for x in kv])
    return labels.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(values[F.col("quality").cast("int")], F.lit(1.0)).alias("weight"))


def mixed(docs: DataFrame, quality: DataFrame | None = None, **options) -> DataFrame:
    """The rows that the mix takes, once each, with ``copies`` and ``taken``; null and repeated ids are rows of their own.

    All columns of ``docs`` are kept; one that is named ``copies`` or ``taken`` itself
    gets an underscore after its name (more, if that is taken too).
    """
    for name in [c for c in docs.columns if c.lower() in ("copies", "taken")]:
        docs = docs.withColumnRenamed(name, fresh(docs, name)[0])
    (row,) = fresh(docs, "_row")
    docs = written(docs.withColumn(row, F.monotonically_increasing_id()))
    needed = docs.select("doc_id", "source", "text", F.col(row).alias("_row"))
    takes = mix_sources(needed, quality, row="_row", **options).filter("copies > 0")
    takes = written(takes.select(F.col("_row").alias(row), "copies", "taken"))
    takes = F.broadcast(takes) if size_of(takes, BROADCAST_TAKES) <= BROADCAST_TAKES else takes
    return docs.join(takes, row).drop(row)


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    quality = label_weights(table(spark, sf_dir, "labels"))
    return mix_sources(table(spark, sf_dir, "documents"), quality).select("doc_id", "size", "source_size", "target", "taken")


OP9_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS source_no FROM sized GROUP BY source
), weighed AS (
  SELECT *, CAST(CASE source_no % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS DOUBLE) AS weight FROM sources
), levels AS (
  SELECT *, row_number() OVER (ORDER BY source_size / weight, source_no) AS place,
    1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE)
      - 2 * CAST(coalesce(sum(source_size) OVER (ORDER BY source_size / weight, source_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS spare,
    sum(weight) OVER (ORDER BY source_size / weight, source_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS above
  FROM weighed
), chosen AS (
  SELECT place AS first_place, spare AS at_spare, above AS at_above FROM levels WHERE weight * spare / above <= 2 * source_size ORDER BY place LIMIT 1
), targets AS (
  SELECT source, source_size, CASE WHEN place >= first_place THEN weight * at_spare / at_above ELSE CAST(2 * source_size AS DOUBLE) END AS target FROM levels, chosen
), quality AS (
  SELECT doc_id, max(CASE quality WHEN 1 THEN 2.0 WHEN 0 THEN 0.5 ELSE 1.0 END)::DOUBLE AS weight FROM labels GROUP BY doc_id
), keyed AS (
  SELECT s.doc_id, s.size, t.source, t.source_size, t.target,
    -ln((CAST(('0x' || substr(md5('17:' || coalesce(CAST(s.doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT)::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE) / coalesce(q.weight, 1.0::DOUBLE) AS k
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source LEFT JOIN quality q ON q.doc_id = s.doc_id
), running AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto,
    CASE WHEN source_size > 0 THEN least(floor(target / source_size), 2) ELSE 0 END AS epochs
  FROM keyed
)
SELECT doc_id, size, source_size, target,
  CAST(size * (epochs + CASE WHEN epochs < 2 AND 2 * upto - size <= 2 * (target - epochs * source_size) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM running
"""
