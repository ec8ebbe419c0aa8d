"""Periodic runs of words: stretches that repeat one block of words again and again.

A run is a stretch of consecutive words with smallest period q (words q apart are
the same) of at least ``max(min_words, min_repeats * q)`` words, which no neighbouring
word extends keeping that period.

Method.  Every word of a run occurs at least ``min_repeats`` times inside it.  A word
that occurs less often in its segment (first the whole text) therefore lies in no
run: it splits the segment, the parts are counted anew, and so on until nothing
splits; most texts are gone after two rounds.  Segments that survive are scanned
lag by lag.  A run of period q holds a multiple k of q from which three blocks of q
words are the same, so only the multiples of each lag are probed, n ln n probes for
n words; blocks that agree there are compared whole, and what matches is extended to
both ends.  Lags go up, and a probe inside a run that is already known is a multiple
of that run's period, so each run is found once, at its smallest period.

Scale.  One pass over the texts without a shuffle; a task holds about a megabyte of
texts, or one text if that is longer.  Words are compared by number, and numbers are
given by a table of the text's own words, so there are no hash collisions.

Results on odd input.  A null text has no words and no runs; its collapsed text is
empty.  Words are told apart by their bytes, with case and marks.  Ids are passed on
as they are, null and repeated ones too; each row has its own result.  Texts of one
word alone have one run of period 1.  Extra columns are ignored.  An empty table gives
no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, map_batches, slices, table
from .wordstream import text_bytes

#: Probes that are laid out at once.
PROBES = 1 << 20


def segments(words: list[bytes], least: int, min_repeats: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first word number, word codes) of the segments that frequency splitting leaves."""
    counts = Counter(words)
    often = {w: k for k, w in enumerate(w for w, n in counts.items() if n >= min_repeats)}
    if not often:
        return
    codes = np.fromiter((often.get(w, -1) for w in words), dtype=np.int64, count=len(words))
    todo = _parts(codes, 0, codes >= 0, least)
    while todo:
        start, part = todo.pop()
        _, kind, n = np.unique(part, return_inverse=True, return_counts=True)
        keep = n[kind] >= min_repeats
        if keep.all():
            yield start, kind
        else:
            todo += _parts(part, start, keep, least)


def _parts(codes: np.ndarray, start: int, keep: np.ndarray, least: int) -> list[tuple[int, np.ndarray]]:
    """Stretches of kept words of at least ``least`` words."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], keep, [False]))))
    return [(start + a, codes[a:b]) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True) if b - a >= least]


def _reach(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading items of two arrays agree."""
    at, step, n = 0, 16, min(len(a), len(b))
    while at < n:
        differ = a[at : min(at + step, n)] != b[at : min(at + step, n)]
        if differ.any():
            return at + int(differ.argmax())
        at, step = at + step, step * 4
    return n


def _probes(a: np.ndarray, top: int) -> Iterator[tuple[int, np.ndarray]]:
    """(lag, places) where the three blocks after a multiple of the lag may be the same."""
    n, lag = len(a), 1
    while lag <= top:
        many = np.cumsum(n // np.arange(lag, top + 1) - 2)
        upto = lag + max(1, int(np.searchsorted(many, PROBES, side="right")))
        lags = np.arange(lag, min(upto, top + 1))
        each = n // lags - 2
        q = np.repeat(lags, each)
        at = q * (np.arange(len(q)) - np.repeat(np.cumsum(each) - each, each))
        for inside in (0.0, 0.5, 0.25, 0.75):
            i = at + (q * inside).astype(np.int64)
            same = (a[i] == a[i + q]) & (a[i] == a[i + 2 * q])
            at, q = at[same], q[same]
        for k in np.split(np.arange(len(q)), np.flatnonzero(np.diff(q)) + 1):
            if len(k):
                yield int(q[k[0]]), at[k]
        lag = int(lags[-1]) + 1


def runs_in(a: np.ndarray, min_words: int, min_repeats: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of one segment."""
    found = []
    known = np.zeros(len(a), dtype=np.int64)  # the furthest end of the known runs around each place
    for q, places in _probes(a, len(a) // min_repeats):
        done = 0
        for i in places[known[places] < places + 3 * q].tolist():
            if i + 3 * q <= done or not np.array_equal(a[i : i + 2 * q], a[i + q : i + 3 * q]):
                continue
            start = i - _reach(a[: i + q][::-1], a[:i][::-1])
            done = i + 3 * q + _reach(a[i + 3 * q :], a[i + 2 * q : -q])
            if known[start] < done and done - start >= max(min_words, min_repeats * q):
                found.append((start, done - start, q))
                known[start:done] = np.maximum(known[start:done], done)
    return found


def periodic_runs(words: list[bytes], min_words: int = 6, min_repeats: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a text's words, by start, then period."""
    found = []
    for first, part in segments(words, max(min_words, min_repeats), min_repeats):
        found += [(first + s, n, q) for s, n, q in runs_in(part, min_words, min_repeats)]
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that are left if each run keeps its first period only."""
    if not runs:
        return words
    gone = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()]


def _batch(key: str, min_words: int, min_repeats: int):
    def run(batch: pa.RecordBatch):
        for part in slices(batch, "text"):
            out = {key: part.column(key), "n_words": [], "runs": [], "collapsed": []}
            for text in text_bytes(part.column("text").to_pylist()):
                words = text.split()  # bytes split at exactly the six ASCII blanks
                runs = periodic_runs(words, min_words, min_repeats)
                out["n_words"].append(len(words))
                out["runs"].append([dict(zip(("start", "length", "period"), r, strict=True)) for r in runs])
                out["collapsed"].append(b" ".join(collapse(words, runs)).decode("utf-8", "surrogatepass"))
            yield out

    return run


def find_runs(docs: DataFrame, min_words: int = 6, min_repeats: int = 4) -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period, by start, then period) and collapsed of every row."""
    if min_repeats < 4:
        raise ValueError("runs are told apart by their periods from four repeats on")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return map_batches(rows, _batch("doc_id", min_words, min_repeats), schema)


def strongest(runs: Column) -> Column:
    """The run with the greatest length over period; of equal ones the first in the array."""
    better = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    return F.aggregate(runs, none, lambda best, r: F.when(better(best, r), r).otherwise(best))


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text; by a rule on the id, every tenth text repeats a block of its words from some word on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0))

    def repeated(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (3 + g % 8)).cast("long")
        return F.transform(w, lambda word, i: F.when(i < a, word).otherwise(F.get(w, (a + (i - a) % p).cast("int"))))

    # the words are bound by an array of one, so that they are cut once per text
    made = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, F.array_join(repeated(w), " ")).otherwise(F.lit("")))
    return docs.select("doc_id", F.when(h % 10 == 0, F.get(made, F.lit(0))).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document and the digest of its collapsed text."""
    found = find_runs(planted(table(spark, sf_dir, "documents")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    named = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.inline(F.array(F.struct(strongest(F.col("runs")).alias("best")))), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return named.select("doc_id", "n_runs", "best.*", F.call_function("div", 1000 * F.col("best.length"), F.col("best.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
