"""Removal of lines that many documents share, by range-partitioned line hashes.

Method.  Each line gets a key (blanks stripped at both ends, A-Z lower-cased) and a
128-bit hash of it.  The hashes are range-partitioned and sorted by hash, then
document, then position, so the ranges cut a very common line by document; one
pass over each range streams the first occurrence of a key in each document, and
these are counted per key.  Keys of ``min_docs`` documents or more are dropped.
The result carries no text: each document that loses lines gets a sparse bitmap
(``keep``), a list of the 64-line words that lose a line with the bits of the
lines that stay; words that are not listed stay whole.

Scale.  Built-in functions only.  The lines table holds hashes and positions, not
texts, and is written once.  First occurrences are counted within each range
before they are shuffled by key, so a key costs one row per range.  Common keys are
sent to all executors only while they were counted to be few; beyond, those that
hold a ten-thousandth of all first occurrences (there are at most 10,000) are sent,
and all others, none of which is large, are joined by shuffle.  Marks of dropped
lines meet by document as bits, combined before the shuffle.  Texts move once, in
the join with the bitmaps.

Results on odd input.  A null or empty text is one empty line.  Keys below
``min_chars`` code points are never dropped.  Documents are told apart by
``doc_id``: rows that repeat an id count as one document, and each of them loses its
own common lines.  A null id counts as a document for each different text.  With
``keep_first`` the first row by id (null ids first) and position keeps its line; rows
with the same id and text share their result.  An empty table gives no rows.
``without_common_lines`` keeps all columns; the others ignore extra columns.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import size_of, table, union_all, written

#: The six ASCII blanks.
BLANKS = " \t\n\x0b\f\r"
#: Common keys that are sent to all executors whole.
BROADCAST_KEYS = 200_000
#: A key with this share of all first occurrences is sent to all executors in any case.
HOT_SHARE = 1 / 10_000
#: The document of a line as it is counted, and the row it stands in.
_DOC, _ROW, _KEY = ["doc", "doc_of_null"], ["row_a", "row_b"], ["key_a", "key_b"]


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z lower-cased; other letters stay as they are."""
    bare = F.btrim(line, F.lit(BLANKS))
    ascii_only = F.octet_length(bare) == F.char_length(bare)  # lower() changes letters beyond A-Z too
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, ascii_uppercase, ascii_lowercase))


def _identified(docs: DataFrame) -> list[Column]:
    """Id and text of a row, and the two halves of a hash of both."""
    doc, text = F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))
    return [doc.alias("doc"), text.alias("body"), F.xxhash64(doc, text).alias("row_a"), F.xxhash64(F.lit("row"), text, doc).alias("row_b")]


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """One row of hashes per line whose key is long enough."""
    rows = docs.select(*_identified(docs)).withColumn("doc_of_null", F.when(F.col("doc").isNull(), F.col("row_a")))
    lines = rows.select(*_DOC, *_ROW, F.posexplode(F.split("body", "\n")).alias("pos", "line"))
    keyed = lines.select(*_DOC, *_ROW, "pos", line_key(F.col("line")).alias("key")).filter(F.char_length("key") >= max(min_chars, 1))
    return keyed.select(*_DOC, *_ROW, "pos", F.xxhash64("key").alias("key_a"), F.xxhash64(F.lit("key"), F.col("key")).alias("key_b"))


def _common(lines: DataFrame, min_docs: int) -> tuple[DataFrame, int]:
    """Keys of ``min_docs`` documents or more with their first place, and the number of first occurrences."""
    ranges = lines.repartitionByRange(*_KEY, *_DOC).sortWithinPartitions(*_KEY, *_DOC, "pos", *_ROW)
    within = Window.partitionBy(*_KEY, *_DOC).orderBy("pos", *_ROW)
    firsts = ranges.withColumn("nth", F.row_number().over(within)).filter("nth = 1")
    counts = firsts.groupBy(*_KEY).agg(F.count("*").alias("n_docs"), F.min(F.struct(*_DOC, "pos", *_ROW)).alias("first"))
    common = written(counts.filter(F.col("n_docs") >= min_docs))
    return common, lines.count()


def _marked(lines: DataFrame, common: DataFrame, total: int, most: int) -> DataFrame:
    """Lines whose key is common, with its first place."""
    common = common.select(*_KEY, "n_docs", "first")
    if size_of(common, most) <= most:
        return lines.join(F.broadcast(common), _KEY)
    large = F.col("n_docs") >= max(2, total * HOT_SHARE)
    hot, rest = common.filter(large), common.filter(~large)
    others = lines.join(F.broadcast(hot.select(*_KEY)), _KEY, "left_anti")
    return union_all([lines.join(F.broadcast(hot), _KEY), others.join(rest, _KEY)])


def _bitmaps(docs: DataFrame, min_docs: int, min_chars: int, keep_first: bool, most: int) -> DataFrame:
    """row_a, row_b and ``keep`` of the rows that lose lines."""
    lines = written(_lines(docs, min_chars))
    gone = _marked(lines, *_common(lines, min_docs), most)
    if keep_first:
        gone = gone.filter(~F.struct(*_DOC, "pos", *_ROW).eqNullSafe(F.col("first")))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("pos") % 64)
    words = gone.groupBy(*_ROW, F.floor(F.col("pos") / 64).cast("int").alias("word")).agg(F.bit_or(bit).alias("dropped"))
    entry = F.struct("word", F.bitwise_not("dropped").alias("bits"))
    return words.groupBy(*_ROW).agg(F.sort_array(F.collect_list(entry)).alias("keep"), F.sum(F.bit_count("dropped").cast("long")).alias("lost"))


def _kept_text(body: Column, keep: Column) -> Column:
    """The lines that ``keep`` leaves, joined again."""
    words = F.map_from_entries(keep)
    last = F.floor((F.size(F.split(body, "\n")) - 1) / 64).cast("int")
    dense = F.transform(F.sequence(F.lit(0), last), lambda w: F.coalesce(words[w], F.lit(-1).cast("long")))
    # bound by an array of one, so that it is made once per row and not once per line
    chosen = F.transform(F.array(dense), lambda d: F.filter(F.split(body, "\n"), lambda _, i: F.getbit(F.get(d, F.floor(i / 64).cast("int")), (i % 64).cast("int")) == 1))
    return F.when(keep.isNull(), body).otherwise(F.array_join(F.get(chosen, F.lit(0)), "\n"))


def keep_bitmaps(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """doc_id, n_lines, n_dropped, keep (array of word and bits) of every row; ``keep`` is null where nothing is dropped."""
    rows = docs.select(*_identified(docs)).select("doc", *_ROW, F.size(F.split("body", "\n")).cast("long").alias("n_lines"))
    joined = rows.join(_bitmaps(docs, min_docs, min_chars, keep_first, broadcast_keys), _ROW, "left")
    return joined.select(F.col("doc").alias("doc_id"), "n_lines", F.coalesce("lost", F.lit(0)).cast("long").alias("n_dropped"), "keep")


def kept_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """doc_id, n_lines, n_dropped, keep and kept (the lines that stay, joined) of every row."""
    rows = docs.select(*_identified(docs))
    joined = rows.join(_bitmaps(docs, min_docs, min_chars, keep_first, broadcast_keys), _ROW, "left")
    return joined.select(
        F.col("doc").alias("doc_id"),
        F.size(F.split("body", "\n")).cast("long").alias("n_lines"),
        F.coalesce("lost", F.lit(0)).cast("long").alias("n_dropped"),
        "keep",
        _kept_text(F.col("body"), F.col("keep")).alias("kept"),
    )


def without_common_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """``docs`` with its columns, texts without their common lines; texts that lose none, nulls too, are unchanged."""
    columns = docs.columns
    whole = docs.select(F.struct(*columns).alias("whole"), *_identified(docs))
    joined = whole.join(_bitmaps(docs, min_docs, min_chars, keep_first, broadcast_keys), _ROW, "left")
    text = F.when(F.col("keep").isNull(), F.col("whole.text")).otherwise(_kept_text(F.col("body"), F.col("keep")))
    return joined.select(*[text.alias(c) if c == "text" else F.col("whole").getField(c).alias(c) for c in columns])


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that 10 documents or more share."""
    return kept_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP11_SQL = r"""
WITH split AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents
), lines AS (
  SELECT doc_id, l[p] AS line, p, translate(trim(l[p], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS p FROM split)
), common AS (
  SELECT k FROM lines WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10
)
SELECT lines.doc_id, count(*) AS n_lines, count(common.k) AS n_dropped,
  sha256(coalesce(string_agg(CASE WHEN common.k IS NULL THEN lines.line END, chr(10) ORDER BY lines.p), '')) AS kept_sha256
FROM lines LEFT JOIN common ON common.k = lines.k
GROUP BY lines.doc_id
"""
