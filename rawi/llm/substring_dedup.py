"""Exact repeats of long word sequences across documents (fixed-block anchors).

Method.  Every document is cut into non-overlapping reference blocks of ``block``
words; a block is indexed under its anchor, the smallest hash among its
``gram``-word sequences.  Every rolling window of ``block`` words of every
document probes with its own anchor, so a window equal to a reference block
always meets it, and neighbouring windows that share an anchor probe once.  A
sequence of ``min_words >= 2 * block - 1`` words covers a whole reference block
wherever it starts, so no repeat is missed.  Where an anchor meets in two
documents, the windows of ``min_words`` words around it are compared by a 96-bit
hash of their words, and runs of equal windows are the maximal exact repeats.

Scale.  The index and the probes are one row per (document, anchor), about a
tenth of the words.  Identical texts are reduced to their smallest id before
anything is exploded.  Keys are met by partial aggregation (min, max), so a
passage in a third of all documents costs each task one row; the joins that hand
the result back are plain equi-joins that adaptive execution may split.

Results on odd input.  Null and empty texts, and texts shorter than
``min_words``, have nothing removed.  A null id is never smaller or larger than
another, so such rows neither lose words nor cost others any.  Repeated ids and
repeated rows are judged row by row against strictly smaller ids.  Extra columns
are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, size_of, slices, table, written
from .wordstream import PLAIN, Words, text_bytes, window_hashes

#: Candidate documents are looked up by broadcast up to this many, else by a shuffle join.
BROADCAST_IDS = 500_000


def _sliding_min(x: np.ndarray, k: int) -> np.ndarray:
    """min(x[i:i + k]) for every i."""
    out, width = x, 1
    while width * 2 <= k:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    rest = k - width
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def _anchors(words: Words, block: int, gram: int):
    """Anchor of every rolling window of ``block`` words, and which windows stay in one text."""
    grams = window_hashes(words.hash, gram)
    if len(words.hash) < block:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    return _sliding_min(grams, block - gram + 1), words.fits(block)


def _digest(parts: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(parts)).hexdigest()


def _scan(block: int, gram: int):
    def fn(batch):
        for part in slices(batch, "text"):
            texts = text_bytes(part.column("text").to_pylist())
            words = Words(texts, PLAIN)
            anchor, fits = _anchors(words, block, gram)
            position = np.arange(len(words.text_of)) - words.first[words.text_of]
            keys, refs = [], []
            for i in range(len(texts)):
                a, b = words.first[i], min(words.first[i + 1], len(anchor))
                inside = slice(a, b)
                own, own_ref = np.unique(anchor[inside][fits[inside]], return_inverse=True)
                ref = np.zeros(len(own), dtype=bool)
                ref[own_ref[position[inside][fits[inside]] % block == 0]] = True
                keys.append(own.view(np.int64))
                refs.append(ref)
            yield {
                "doc_id": part.column("doc_id"),
                "same": [hashlib.blake2b(t, digest_size=16).digest() for t in texts],
                "n_words": words.counts,
                "all_sha": [_digest(t.split()) for t in texts],
                "keys": keys,
                "refs": refs,
            }

    return fn


def _windows(block: int, gram: int, size: int):
    """Hashes of the ``size``-word windows that hold a window whose anchor met elsewhere."""

    def fn(batch):
        for part in slices(batch, "text"):
            texts = text_bytes(part.column("text").to_pylist())
            words = Words(texts, PLAIN)
            anchor, _ = _anchors(words, block, gram)
            whole, fits = window_hashes(words.hash, size), words.fits(size)
            check = (window_hashes(words.hash ^ np.uint64(0x5BF03635), size) >> np.uint64(32)).astype(np.uint32).view(np.int32)
            met = np.zeros(len(anchor) + 1, dtype=np.int64)
            for i, hit in enumerate(part.column("hits").to_pylist()):
                a, b = words.first[i], min(words.first[i + 1], len(anchor))
                met[a + 1 : b + 1] = np.isin(anchor[a:b].view(np.int64), np.array(hit, dtype=np.int64))
            total = np.cumsum(met)
            n = len(whole)
            reach = np.minimum(np.arange(n) + size - block + 1, len(anchor))
            take = np.flatnonzero(fits & (total[reach] > total[:n]))
            text = words.text_of[take]
            rows = {
                "window": whole[take].view(np.int64),
                "proof": check[take],
                "pos": (take - words.first[text]).astype(np.int32),
                "doc_id": part.column("doc_id").take(_pa_index(text)),
                "cid": part.column("cid").take(_pa_index(text)),
            }
            yield rows

    return fn


def _pa_index(x):
    import pyarrow as pa

    return pa.array(x, type=pa.int64())


def _cut(size: int):
    """Texts with the places of repeated windows and the smallest id of each -> counts and digest of what stays."""

    def fn(batch):
        for part in slices(batch, "text"):
            removed, sha, spans = [], [], []
            columns = (part.column(c).to_pylist() for c in ("doc_id", "text", "starts"))
            for own, text, starts in zip(*columns, strict=True):
                parts = text.encode("utf-8", "surrogatepass").split()
                edge = np.zeros(len(parts) + 1, dtype=np.int64)
                at = np.unique(np.array([x["pos"] for x in starts if x["low"] < own], dtype=np.int64))
                np.add.at(edge, at, 1)
                np.add.at(edge, at + size, -1)
                gone = np.cumsum(edge)[:-1] > 0
                step = np.diff(np.concatenate(([0], gone.astype(np.int8), [0])))
                spans.append([{"start": int(a), "end": int(b)} for a, b in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1), strict=True)])
                removed.append(int(gone.sum()))
                sha.append(_digest([w for w, g in zip(parts, gone, strict=True) if not g]))
            yield {"doc_id": part.column("doc_id"), "same": part.column("same"), "n_removed": removed, "kept_sha256": sha, "spans": spans}

    return fn


def repeated_spans(docs: DataFrame, min_words: int = 50, block: int = 25, gram: int = 8) -> DataFrame:
    """Words of each document that lie in a ``min_words`` window which also starts in a smaller id.

    Returns one row per input row: doc_id, n_words, n_removed, kept_sha256 and
    ``spans``, the maximal removed word ranges [start, end).
    """
    if min_words < 2 * block - 1:
        raise ValueError("min_words must be at least 2 * block - 1, or a repeat could miss every reference block")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scanned = written(
        map_batches(docs, _scan(block, gram), "doc_id long, same binary, n_words long, all_sha string, keys array<long>, refs array<boolean>")
    )
    # one document stands for all with the same text: the smallest id; from here on it goes by a number
    first = scanned.filter("doc_id is not null").groupBy("same").agg(F.min(F.struct("doc_id", "keys", "refs")).alias("v"))
    leaders = written(first.select("same", "v.doc_id", "v.keys", "v.refs", F.monotonically_increasing_id().alias("lid")))
    rows = leaders.filter(F.size("keys") > 0).select("lid", "doc_id", F.inline(F.arrays_zip("keys", "refs"))).withColumnsRenamed({"keys": "key", "refs": "ref"})
    met = written(
        rows.groupBy("key")
        .agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.max("ref").alias("ref"))
        .filter("low < high and ref")
        .select("key")
    )
    hits = rows.select("key", "lid").join(met, "key").groupBy("lid").agg(F.collect_set("key").alias("hits"))
    hits = written(hits.join(leaders.select("lid", "doc_id", "same"), "lid").drop("lid"))
    # texts of the candidates only, found by id where the ids are few enough to send
    ids = hits.select("doc_id").distinct()
    texts = docs.filter("doc_id is not null")
    texts = texts.join(F.broadcast(ids) if size_of(ids, BROADCAST_IDS) <= BROADCAST_IDS else ids, "doc_id", "left_semi")
    same = map_batches(
        texts,
        lambda batch: iter([{"doc_id": batch.column("doc_id"), "text": batch.column("text"), "same": [hashlib.blake2b(t, digest_size=16).digest() for t in text_bytes(batch.column("text").to_pylist())]}]),
        "doc_id long, text string, same binary",
    ).dropDuplicates(["doc_id", "same"])
    candidates = written(same.join(hits, ["doc_id", "same"]).withColumn("cid", F.monotonically_increasing_id()))
    windows = written(map_batches(candidates, _windows(block, gram, min_words), "window long, proof int, pos int, doc_id long, cid long"))
    # written, so that both sides of the join below are plain exchanges, which adaptive execution may split
    low = written(windows.groupBy("window", "proof").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high").drop("high"))
    starts = windows.select("window", "proof", "pos", "cid").join(low, ["window", "proof"]).groupBy("cid").agg(F.collect_list(F.struct("pos", "low")).alias("starts"))
    cut = map_batches(candidates.drop("hits").join(starts, "cid"), _cut(min_words), "doc_id long, same binary, n_removed long, kept_sha256 string, spans array<struct<start:int,end:int>>")
    base = scanned.select("doc_id", "same", "n_words", "all_sha").join(leaders.select("same", F.col("doc_id").alias("leader")), "same", "left")
    whole = (F.col("doc_id") > F.col("leader")) & (F.col("n_words") >= min_words)
    every = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("end")))
    none = F.array().cast("array<struct<start:int,end:int>>")
    return base.join(cut, ["doc_id", "same"], "left").select(
        "doc_id",
        "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept_sha256", "all_sha")).alias("kept_sha256"),
        F.when(whole, every).otherwise(F.coalesce("spans", none)).alias("spans"),
    )


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the number of words it loses to exact 50-word repeats, and the digest of the rest."""
    return repeated_spans(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


#: The same result by listing every 50-word window.
OP2_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, p, md5(array_to_string(list_slice(w, p, p + 49), ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM words WHERE len(w) >= 50)
), bad AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY h) AS low FROM windows) WHERE low < doc_id
), edges AS (
  SELECT doc_id, p, 1 AS step FROM bad UNION ALL SELECT doc_id, p + 50, -1 FROM bad
), single AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM words WHERE len(w) > 0
), steps AS (
  SELECT doc_id, p, sum(step) AS step FROM edges GROUP BY doc_id, p
), marked AS (
  SELECT s.doc_id, s.p, s.word, sum(coalesce(e.step, 0)) OVER (PARTITION BY s.doc_id ORDER BY s.p) > 0 AS gone
  FROM single s LEFT JOIN steps e ON e.doc_id = s.doc_id AND e.p = s.p
), summed AS (
  SELECT doc_id, sum(CASE WHEN gone THEN 1 ELSE 0 END) AS n_removed, string_agg(CASE WHEN gone THEN NULL ELSE word END, ' ' ORDER BY p) AS kept
  FROM marked GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(s.n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(s.kept, '')) AS kept_sha256
FROM words d LEFT JOIN summed s ON s.doc_id = d.doc_id
"""
