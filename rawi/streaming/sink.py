"""A table that a stream saves to batch by batch, each batch once.

``data`` has a folder for each attempt to save a batch, ``manifest`` a one-row file for
each attempt that was finished.  A reader sees the attempts that the manifest names,
one for each batch, so a batch that is stopped half-way is not seen and one that is
repeated is not doubled: files are only ever added, and a manifest entry appears at
once or not at all.  ``compact`` rewrites all batches as one, whose entry names what it
replaces.  The manifest is as long as there are batches since the last compaction.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

ENTRY = "run string, batch long, attempt string, n_rows long, replaces array<string>"


def _finished(spark: SparkSession, root: str) -> list:
    """All finished attempts, by name."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/manifest")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return []
    return spark.read.schema(ENTRY).json(f"{root}/manifest/*").orderBy("attempt").collect()


def _entries(finished: list) -> list:
    """The attempts that count: the first of each batch, without those that another one replaces."""
    replaced = {name for e in finished for name in e.replaces}
    first: dict[tuple, object] = {}
    for e in finished:
        if e.attempt not in replaced:
            first.setdefault((e.run, e.batch), e)
    return list(first.values())


def _commit(spark: SparkSession, root: str, run: str, batch: int, attempt: str, n: int, replaces: list[str]) -> None:
    spark.createDataFrame([(run, batch, attempt, n, replaces)], ENTRY).coalesce(1).write.json(f"{root}/manifest/{attempt}")


def save_batch(df: DataFrame, batch: int, root: str, run: str = "run") -> bool:
    """Saves a batch of a run unless it is saved already; was it saved now?"""
    spark = df.sparkSession
    if (run, batch) in {(e.run, e.batch) for e in _finished(spark, root)}:
        return False
    attempt = f"{run}-{batch}-{uuid.uuid4().hex}"
    df.write.parquet(f"{root}/data/{attempt}")
    _commit(spark, root, run, batch, attempt, spark.read.schema(df.schema).parquet(f"{root}/data/{attempt}").count(), [])
    return True


def saver(root: str, run: str = "run") -> Callable[[DataFrame, int], None]:
    """``save_batch`` for ``foreachBatch``; ``run`` names the stream, whose batch numbers it knows batches by."""

    def save(df: DataFrame, batch: int) -> None:
        save_batch(df, batch, root, run)

    return save


def saved(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """All rows of the batches that were saved."""
    paths = [f"{root}/data/{e.attempt}" for e in _entries(_finished(spark, root))]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def compact(spark: SparkSession, root: str, schema: str) -> int:
    """Rewrites the saved batches as one; the number of attempts that it replaces.  Old files stay for readers that began before."""
    old = _entries(_finished(spark, root))
    if len(old) > 1:
        attempt = f"compact-{uuid.uuid4().hex}"
        saved(spark, root, schema).write.parquet(f"{root}/data/{attempt}")
        _commit(spark, root, attempt, 0, attempt, sum(e.n_rows for e in old), [e.attempt for e in old])
    return len(old)
