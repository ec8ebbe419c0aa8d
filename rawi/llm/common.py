"""Shared Spark plumbing of the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Blank-separated words, as the Java regex of the native operators.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes from which on an Arrow batch for a Python worker is closed.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables under ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``; a local master without that setting (tests) gets one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/rawi-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` written to a shared Parquet table and read again: later steps start from the files."""
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run`` for ``mapInArrow``; when a task is over, its worker gives the memory that it no longer uses back to the system.

    Workers are used again by later tasks; without this each stays as large as the largest of its tasks was.
    """

    def fn(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
            if trim:
                trim(0)

    return fn


def map_tidied(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` of ``tidied(run)``, with batches closed at ``BATCH_BYTES`` unless the session has a bound of its own.

    By default a batch is 10,000 rows however long they are, and the JVM builds it outside its heap in
    buffers that double as they grow: some 200 MB for a task on rows of 3 KB.
    """
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession.conf.get(limit, None) is None:
        df.sparkSession.conf.set(limit, str(BATCH_BYTES))
    return df.mapInArrow(tidied(run), schema)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[dict]], schema: str) -> DataFrame:
    """``mapInArrow`` where ``fn`` turns one input batch into dicts of columns.

    Each dict becomes one output batch; the Arrow types follow from ``schema``.
    """
    target = _arrow_schema(df.sparkSession, schema)

    def run(batches):
        for batch in batches:
            for cols in fn(batch):
                yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], type=f.type) for f in target], schema=target)

    return map_tidied(df, run, schema)


def _arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def slices(batch: pa.RecordBatch, column: str, target: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut an Arrow batch into row ranges of about ``target`` text bytes."""
    import pyarrow.compute as pc

    size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(size):
        total += int(n)
        if total >= target:
            yield batch.slice(start, i + 1 - start)
            start, total = i + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)


def size_of(df: DataFrame, most: int) -> int:
    """Number of rows, counted no further than ``most + 1``."""
    return df.limit(most + 1).count()


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened where ``df`` has such a column (names count without regard to case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def union_all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def words_of(column: str = "text"):
    """Number of blank-separated words of a text column, null as 0."""
    return F.coalesce(F.regexp_count(F.col(column), F.lit(WORD)), F.lit(0)).cast("long")
