"""Token counts from flat token files, by a scan for separators.

Method.  A token file is a flat run of fixed-width identifiers in which an
end-of-document identifier closes every document; nothing says where documents
begin.  The file is read in blocks cut at arbitrary places.  Each block is
searched for the separator by one vector comparison.  A prefix scan over the
blocks of a file adds up their lengths and separator counts and carries the last
separator forward, which gives every document its ordinal and its length even
where it spans several blocks.

``token_files`` makes such files from documents: every task encodes its rows, one
file per task, in blocks of ``block_tokens``; beside them it keeps the order of
the ids, which the counts are joined to at the end.

Scale.  Encoding and searching are scans; the prefix scan sees one row per block
and no tokens.  A block is 128 KB.  The files are compressed Parquet rows in the
shared folder; ``read_token_files`` reads raw binary files of up to 2 GB each.

Results on odd input.  Null and empty texts have 0 tokens.  Tokens after the last
separator of a file are one document with ``closed`` false.  A text that spells
the separator is encoded as ordinary text.  Repeated rows are counted one by one.
Extra columns are ignored.  An empty table gives no rows.
"""

from __future__ import annotations

import base64

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_batches, scratch, slices, table

#: Where the public vocabularies are, and the default one with its separator.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY, SEPARATOR = "byte_bpe_50k.tiktoken", 50256
#: Fixed value: how this vocabulary splits text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK_TOKENS = 1 << 16

_KEPT: dict[str, object] = {}


def load_ranks(path: str = f"{TOKENIZERS}/{VOCABULARY}") -> dict[bytes, int]:
    """Token bytes and their identifiers from a vocabulary file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _encoder(ranks: dict[bytes, int]):
    """The encoder of a vocabulary, built once per Python worker."""
    if _KEPT.get("ranks") is not ranks:
        import tiktoken

        _KEPT.update(ranks=ranks, encoder=tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}))
    return _KEPT["encoder"]


def token_files(docs: DataFrame, ranks: dict[bytes, int], separator: int = SEPARATOR, block_tokens: int = BLOCK_TOKENS) -> tuple[DataFrame, DataFrame]:
    """(blocks, order): blocks of flat token files (file, block, tokens) and the ids in file order (file, ordinal, doc_id)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(ranks)
    width = "<u2" if max([separator, *ranks.values()]) < 1 << 16 else "<u4"

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        encoder, file = _encoder(shared.value), TaskContext.get().partitionId()
        tail, block, ordinal = np.zeros(0, dtype=width), 0, 0

        def rows(blocks, ids, first):
            n = len(blocks) + bool(ids)
            kinds = [b for b, _ in blocks] + [None] * bool(ids)
            return pa.RecordBatch.from_pydict(
                {
                    "file": pa.array([file] * n, pa.int64()),
                    "block": pa.array(kinds, pa.int64()),
                    "tokens": pa.array([t for _, t in blocks] + [None] * bool(ids), pa.binary()),
                    "first": pa.array([None] * len(blocks) + [first] * bool(ids), pa.int64()),
                    "ids": pa.array([None] * len(blocks) + [ids] * bool(ids), pa.list_(pa.int64())),
                }
            )

        for batch in batches:
            for part in slices(batch, "text"):
                stream = [tail]
                for text in part.column("text").to_pylist():
                    if text:
                        stream.append(np.array(encoder.encode_ordinary(text), dtype=width))
                    stream.append(np.array([separator], dtype=width))
                flat = np.concatenate(stream)
                full = len(flat) // block_tokens
                blocks = [(block + i, flat[i * block_tokens : (i + 1) * block_tokens].tobytes()) for i in range(full)]
                tail, block = flat[full * block_tokens :], block + full
                yield rows(blocks, part.column("doc_id").to_pylist(), ordinal)
                ordinal += part.num_rows
        if len(tail):
            yield rows([(block, tail.tobytes())], [], None)

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    path = scratch(spark)
    schema = "file long, block long, tokens binary, first long, ids array<long>"
    docs.mapInArrow(run, schema).write.option("compression", "zstd").parquet(path)
    made = spark.read.schema(schema).parquet(path)
    order = made.filter("ids is not null").select("file", "first", F.posexplode("ids").alias("at", "doc_id")).select("file", (F.col("first") + F.col("at")).alias("ordinal"), "doc_id")
    return made.filter("tokens is not null").select("file", "block", "tokens"), order


def read_token_files(spark: SparkSession, path: str, width: str = "<u2", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Blocks (file, block, tokens) of raw binary token files; ``file`` is the path."""

    def run(batches):
        import pyarrow as pa

        step = block_tokens * np.dtype(width).itemsize
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                data = content.as_buffer()
                for i, at in enumerate(range(0, data.size, step)):
                    yield pa.RecordBatch.from_pydict({"file": pa.array([name]), "block": pa.array([i], pa.int64()), "tokens": pa.array([data[at : at + step].to_pybytes()], pa.binary())})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, block long, tokens binary")


def count_tokens(blocks: DataFrame, separator: int = SEPARATOR, width: str = "<u2") -> DataFrame:
    """file, ordinal, n_tokens (without the separator) and closed for every document of flat token files."""
    kind = dict(blocks.dtypes)["file"]

    def fn(batch):
        size, marks = [], []
        for data in batch.column("tokens"):
            tokens = np.frombuffer(data.as_buffer(), dtype=width)
            size.append(len(tokens))
            marks.append(np.flatnonzero(tokens == separator))
        yield {"file": batch.column("file"), "block": batch.column("block"), "size": size, "marks": marks}

    found = map_batches(blocks, fn, f"file {kind}, block long, size long, marks array<long>")
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    last = Window.partitionBy("file").orderBy(F.col("block").desc())
    offset = F.coalesce(F.sum("size").over(earlier), F.lit(0))
    placed = found.withColumn("offset", offset).withColumn("ordinal", F.coalesce(F.sum(F.size("marks")).over(earlier), F.lit(0)))
    placed = placed.withColumn("end", F.col("offset") + F.element_at(F.when(F.size("marks") > 0, F.col("marks")), -1))
    placed = placed.withColumn("from", F.coalesce(F.last("end", ignorenulls=True).over(earlier) + 1, F.lit(0))).withColumn("final", F.row_number().over(last) == 1)
    each = placed.select("file", "ordinal", "offset", "from", "marks", F.posexplode("marks").alias("i", "mark"))
    start = F.when(F.col("i") == 0, F.col("from")).otherwise(F.col("offset") + F.get("marks", F.col("i") - 1) + 1)
    closed = each.select("file", (F.col("ordinal") + F.col("i")).alias("ordinal"), (F.col("offset") + F.col("mark") - start).alias("n_tokens"), F.lit(True).alias("closed"))
    begun = F.coalesce(F.col("end") + 1, F.col("from"))
    rest = placed.filter("final").select("file", (F.col("ordinal") + F.size("marks")).alias("ordinal"), (F.col("offset") + F.col("size") - begun).alias("n_tokens"), F.lit(False).alias("closed"))
    return closed.unionByName(rest.filter("n_tokens > 0"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, counted in the flat token files of all documents."""
    blocks, order = token_files(table(spark, sf_dir, "documents"), load_ranks())
    return count_tokens(blocks).join(order, ["file", "ordinal"]).select("doc_id", "n_tokens")
