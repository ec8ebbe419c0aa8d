"""Benchmark passages in documents, by a prefix-filtered set join.

Method.  Benchmark items are cut into units: the whole item, or every run of
``window`` words of it.  A unit is the set of its ``shingle``-word sequences.  All
shingles are ordered by the number of documents they occur in, rarest first.  A
unit of n shingles of which a share ``threshold`` must be found has to meet a
document in one of its first n - ceil(threshold * n) + 1 shingles, so only those
are looked up.  A match at a known offset fixes where a window of the unit's size
can start (positional bound) and such a window must hold enough shingles (length
bound); inside these bounds the containment is counted exactly, and at threshold
1 the words of the window must be those of the unit, in order.

Scale.  The benchmark is taken in blocks of at most ``BLOCK_CHARS`` characters,
each held by every task; documents are scanned twice per block (shingle counts,
then look-up) and never shuffled.  Only counts of benchmark shingles are summed.

Results on odd input.  Null or wordless texts and items match nothing.  Items
shorter than ``window`` are one unit, and shorter than ``shingle`` one shingle.
Items without an id mark words but are not listed.  Repeated items and ids count
once per document.  Each input row gives one output row.  Extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, map_tidied, slices, table, written
from .wordstream import ALNUM, Shelf, Words, text_bytes, window_hashes

#: Benchmark characters held by a task at a time.
BLOCK_CHARS = 1_000_000


def _lower(values) -> list[bytes]:
    return [t.lower() for t in text_bytes(values)]


class Units:
    """The units of a block of benchmark items and, once counts are known, their prefix tokens."""

    def __init__(self, items: list[tuple[int | None, str]], shingle: int, window: int | None):
        words = Words(_lower([t for _, t in items]), ALNUM)
        self.item, self.words, self.size = [], [], []
        seen = set()
        for i, (item_id, _) in enumerate(items):
            own = words.hash[words.first[i] : words.first[i + 1]]
            width = len(own) if window is None else min(window, len(own))
            for s in range(len(own) - width + 1 if width else 0):
                unit = own[s : s + width]
                mark = (item_id, unit.tobytes())
                if mark not in seen:
                    seen.add(mark)
                    self.item.append(item_id)
                    self.words.append(unit)
                    self.size.append(min(shingle, width))
        self.grams = [window_hashes(w, k) for w, k in zip(self.words, self.size, strict=True)]
        self.shelves = {k: Shelf(np.concatenate([g for g, z in zip(self.grams, self.size, strict=True) if z == k])) for k in sorted(set(self.size))}

    def index(self, counts: dict[tuple[int, int], int], threshold: float) -> None:
        """Choose each unit's prefix by rarity and index it: shelf -> hash -> (unit, offset) rows."""
        rows = defaultdict(list)
        for u, (grams, k) in enumerate(zip(self.grams, self.size, strict=True)):
            distinct, first = np.unique(grams, return_index=True)
            place = np.searchsorted(self.shelves[k].keys, distinct)
            rare = np.lexsort((distinct, [counts.get((k, int(p)), 0) for p in place]))
            need = math.ceil(threshold * len(distinct) - 1e-9)
            rows[k] += [(int(distinct[j]), u, int(first[j])) for j in rare[: len(distinct) - need + 1]]
        self.prefix = {}
        for k, found in rows.items():
            found.sort()
            shelf = Shelf(np.array([h for h, _, _ in found], dtype=np.uint64))
            start = np.searchsorted(np.array([h for h, _, _ in found], dtype=np.uint64), shelf.keys)
            self.prefix[k] = (shelf, np.append(start, len(found)), np.array([u for _, u, _ in found]), np.array([o for _, _, o in found]))


def _counting(units):
    def fn(batch):
        for part in slices(batch, "text"):
            words = Words(_lower(part.column("text").to_pylist()), ALNUM)
            for k, shelf in units.value.shelves.items():
                at, key = shelf.find(window_hashes(words.hash, k))
                ok = words.fits(k)[at]
                pairs = np.unique(np.stack([words.text_of[at[ok]], key[ok]], axis=1), axis=0)
                key, n = np.unique(pairs[:, 1], return_counts=True)
                if len(key):
                    yield {"k": np.full(len(key), k), "key": key, "n": n}

    return fn


def _aligned(units, words, at, unit, offset):
    """Occurrences of whole units, word by word: (start, unit)."""
    start = at - offset
    width = np.array([len(units.words[u]) for u in unit], dtype=np.int64)
    text = words.text_of[at]
    ok = (start >= words.first[text]) & (start + width <= words.first[text + 1])
    start, unit, width = start[ok], unit[ok], width[ok]
    good = np.zeros(len(start), dtype=bool)
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        here = words.hash[start[rows][:, None] + np.arange(w)]
        good[rows] = (here == np.stack([units.words[u] for u in unit[rows]])).all(axis=1)
    return start[good], unit[good]


def _contained(units, words, at, unit, k, threshold):
    """Windows of a unit's size that hold enough of its shingles: (start, unit)."""
    starts, found = [], []
    grams = window_hashes(words.hash, k)
    for text, u in np.unique(np.stack([words.text_of[at], unit], axis=1), axis=0) if len(at) else ():
        first, last = int(words.first[text]), int(words.first[text + 1])
        width = len(units.words[u])
        keys = np.unique(units.grams[u])
        need = math.ceil(threshold * len(keys) - 1e-9)
        if last - first - k + 1 < need:
            continue
        own = grams[first : last - k + 1]
        place = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
        code = np.where(keys[place] == own, place, -1)
        span = max(min(width - k + 1, len(own)), 1)
        hits = at[(words.text_of[at] == text) & (unit == u)] - first
        tried = np.zeros(max(len(own) - span + 1, 1) + 1, dtype=np.int64)
        for p in hits:
            tried[max(0, p - span + 1)] += 1
            tried[min(p, len(tried) - 2) + 1] -= 1
        for s in np.flatnonzero(np.cumsum(tried)[:-1] > 0):
            part = code[s : s + span]
            if (part >= 0).sum() >= need and len(np.unique(part[part >= 0])) >= need:
                starts.append(first + s)
                found.append(u)
    return np.array(starts, dtype=np.int64), np.array(found, dtype=np.int64)


def _finding(units, threshold: float):
    """Word spans and items of each text of a small batch."""

    def fn(part):
        u = units.value
        words = Words(_lower(part.column("text").to_pylist()), ALNUM)
        edge = np.zeros(len(words.hash) + 1, dtype=np.int64)
        items = [set() for _ in range(part.num_rows)]
        for k, (shelf, start, unit_of, offset_of) in u.prefix.items():
            at, key = shelf.find(window_hashes(words.hash, k))
            ok = words.fits(k)[at]
            at, key = at[ok], key[ok]
            times = start[key + 1] - start[key]
            row = np.repeat(start[key], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            at, unit, offset = np.repeat(at, times), unit_of[row], offset_of[row]
            if threshold >= 1:
                begin, unit = _aligned(u, words, at, unit, offset)
            else:
                begin, unit = _contained(u, words, at, unit, k, threshold)
            for b, x in zip(begin, unit, strict=True):
                text = words.text_of[b]
                edge[b] += 1
                edge[min(b + len(u.words[x]), words.first[text + 1])] -= 1
                items[text].add(u.item[x])
        marked = np.cumsum(edge)[:-1] > 0
        step = np.diff(np.concatenate(([0], marked.astype(np.int8), [0])))
        begins, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        spans = [[] for _ in range(part.num_rows)]
        for b, e in zip(begins, ends, strict=True):
            while b < e:  # a run of hit words may go on in the next text
                text = words.text_of[b]
                stop = min(e, words.first[text + 1])
                spans[text].append({"start": int(b - words.first[text]), "end": int(stop - words.first[text])})
                b = stop
        yield {"n_words": words.counts, "spans": spans, "items": [sorted(str(x) for x in i if x is not None) for i in items]}

    return fn


def _merged(batch):
    """Unions of the word spans and items that several benchmark blocks gave a row."""
    n_hit, all_spans, items = [], [], []
    for spans, names in zip(batch.column("spans").to_pylist(), batch.column("items").to_pylist(), strict=True):
        out = []
        for s in sorted((x for part in spans for x in part), key=lambda x: x["start"]):
            if out and s["start"] <= out[-1]["end"]:
                out[-1]["end"] = max(out[-1]["end"], s["end"])
            else:
                out.append(dict(s))
        all_spans.append(out)
        n_hit.append(sum(s["end"] - s["start"] for s in out))
        items.append(sorted({x for part in names for x in part}))
    yield {"doc_id": batch.column("doc_id"), "n_words": batch.column("n_words"), "n_hit": n_hit, "spans": all_spans, "items": items}


def _items(benchmark: DataFrame, block_chars: int) -> tuple[DataFrame, int]:
    """Benchmark items with a text, and the number of blocks they are taken in."""
    items = benchmark.filter("text is not null").select("item_id", F.col("text").cast("string").alias("text"))
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    return items, max(1, math.ceil(chars / block_chars))


def _indexed(docs: DataFrame, items: DataFrame, b: int, blocks: int, shingle: int, threshold: float, window: int | None):
    """Broadcast units of block ``b`` with prefixes by the shingle counts over all of ``docs``."""
    held = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
    units = Units([(r.item_id, r.text) for r in held.collect()], shingle, window)
    shared = docs.sparkSession.sparkContext.broadcast(units)
    counts = map_batches(docs.select("text"), _counting(shared), "k int, key int, n long").groupBy("k", "key").agg(F.sum("n").alias("n"))
    units.index({(r.k, r.key): r.n for r in counts.collect()}, threshold)
    return docs.sparkSession.sparkContext.broadcast(units)


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, shingle: int = 5, threshold: float = 0.8, window: int | None = None, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, n_words, n_hit, spans (word ranges) and items (ids as strings) for each row of ``docs``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items, blocks = _items(benchmark, block_chars)
    if blocks > 1:
        docs = written(docs.withColumn("row", F.monotonically_increasing_id()))
    else:
        docs = docs.withColumn("row", F.lit(0).cast("long"))
    parts = []
    for b in range(blocks):
        find = _finding(_indexed(docs, items, b, blocks, shingle, threshold, window), threshold)

        def fn(batch, find=find):
            for part in slices(batch, "text"):
                for found in find(part):
                    yield {"row": part.column("row"), "doc_id": part.column("doc_id")} | found

        parts.append(map_batches(docs, fn, "row long, doc_id long, n_words long, spans array<struct<start:int,end:int>>, items array<string>"))
    if blocks == 1:
        merged = parts[0].select("doc_id", "n_words", F.array("spans").alias("spans"), F.array("items").alias("items"))
    else:
        union = parts[0]
        for p in parts[1:]:
            union = union.unionByName(p)
        merged = union.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.collect_list("spans").alias("spans"), F.collect_list("items").alias("items")).drop("row")
    return map_batches(merged, _merged, "doc_id long, n_words long, n_hit long, spans array<struct<start:int,end:int>>, items array<string>")


def without_benchmark(docs: DataFrame, benchmark: DataFrame, shingle: int = 5, threshold: float = 0.8, window: int | None = None, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item; all columns are kept."""
    items, blocks = _items(benchmark, block_chars)
    for b in range(blocks):
        find = _finding(_indexed(docs, items, b, blocks, shingle, threshold, window), threshold)

        def run(batches, find=find):
            import pyarrow as pa

            for batch in batches:
                for part in slices(batch, "text"):
                    spans = [s for found in find(part) for s in found["spans"]]
                    yield part.filter(pa.array([not s for s in spans], pa.bool_()))

        docs = map_tidied(docs, run, docs.schema)
        if b < blocks - 1:
            docs = written(docs)
    return docs


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside occurrences of 10-word benchmark windows."""
    hits = benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), threshold=1.0, window=10)
    return hits.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP6_SQL = r"""
WITH item_words AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), units AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(list_slice(w, p, p + least(10, len(w)) - 1), ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM item_words WHERE len(w) > 0)
), words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), places AS (
  SELECT doc_id, size, p, array_to_string(list_slice(w, p, p + size - 1), ' ') AS s
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM words, (SELECT DISTINCT size FROM units) WHERE len(w) >= size)
), found AS (
  SELECT p.doc_id, p.p, p.size, u.item_id FROM places p JOIN units u ON p.size = u.size AND p.s = u.s
), hit AS (
  SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + size)) AS x FROM found) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM found WHERE item_id IS NOT NULL) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(i.n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(i.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM words d LEFT JOIN hit h ON h.doc_id = d.doc_id LEFT JOIN items i ON i.doc_id = d.doc_id
"""
