"""Toxicity by class-conditional Kneser-Ney word models.

Method.  Two bigram models are learned from the labelled texts, an ordinary one
and one of toxic expressions.  All counts are Kneser-Ney continuation counts, so
copies of a text add nothing: a bigram counts the different words before it, and a
word the different words it follows.  A count takes an absolute ``discount`` below
one; a count at or below the cut-off of its level gives all of its mass away.  The
freed mass of a bigram goes to the words of the same class, and the freed mass of
the words to one distribution shared by both classes, the pooled continuation
counts: rare expressions fall back to it in both models.

Toxic texts are mostly ordinary language, so what their words have beyond
``surplus`` times the ordinary probability is kept, scaled to sum to one, as the
words of toxic expressions.  A toxic text then takes each word from expressions
with probability ``share``, else from the ordinary model.  Both models sum to one
after every word.  The evidence of a text is the difference of the two
log-likelihoods over all of its words, divided by their number: each ordinary word
lowers it by log(1 - share).  A fifth of the learning rows are left out of the
models and fix the two numbers of the logistic curve from evidence to score.

A word seen in toxic texts after no more than ``word_cut`` different words is no
evidence: a phrase that always follows the same words is overlooked.  The README
has figures of other cut-offs and of raw counts.

Scale.  Trigram types meet in one shuffle by context, which is split by second
word, and their sums by word, by context and by bigram in one more.  Words before a
bigram are told apart by 32 bits: of a million, some hundred may count as one.  Texts are scanned once: tasks hold a bit table
of fixed size, give out the few bigrams that may hold an expression, and these are
joined with the sums.  The curve is fitted on a histogram.

Results on odd input.  Null, empty and wordless texts have evidence 0 and the
score of a text without expressions.  Words that were never learned count as
ordinary.  Null ids belong to no label; a repeated label counts as its largest
value, and a null one as no label.  Without labels of both classes no text has an
expression.  Repeated rows get equal scores.  Extra columns are ignored.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, size_of, slices, table, written
from .language_id import _spread
from .wordstream import LETTERS, Words, mix

#: Labels are sent to all executors up to this many rows, else joined by shuffle.
BROADCAST_LABELS = 500_000
#: Bigrams with evidence are sent to all executors up to this many, else joined by shuffle.
BROADCAST_BIGRAMS = 500_000
#: The bigrams of one context are dealt over this many partitions.
PARTS = 32
#: Entries of the bit table that tasks hold.
SLOTS = 1 << 22
_GOLD = np.uint64(0x9E3779B97F4A7C15)
#: Kinds of rows among the sums.
WORD, CONTEXT, BIGRAM = 0, 1, 2


class Smoothing(NamedTuple):
    """Settings of the two models."""

    discount: float = 0.75
    word_cut: int = 8
    bigram_cut: int = 10
    surplus: float = 4.0
    share: float = 0.005


def crc(column: Column) -> Column:
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary"))


def _lower(values) -> list[bytes]:
    return [b"" if v is None else v.lower().encode("utf-8", "surrogatepass") for v in values]


def _before(words: Words, of: np.ndarray) -> np.ndarray:
    """``of`` moved on by one word, with 0 where a text begins."""
    out = np.concatenate((np.zeros(1, np.uint64), of[:-1])) if len(of) else of
    out[words.first[:-1][words.counts > 0]] = 0
    return out


def _bigram(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(v * _GOLD + w)


def _trigrams(batches):
    """Distinct (v, w, mark) of a task's texts, given out in bounded parts; a mark is 32 hash bits of the word before and one of the class."""
    import pyarrow as pa

    names = ("v", "w", "mark")
    held, rows = [], 0

    def distinct(parts):
        columns = [np.concatenate([p[k] for p in parts]) for k in range(3)]
        _, first = np.unique(_bigram(_bigram(columns[2], columns[0]), columns[1]), return_index=True)
        return [c[first] for c in columns]

    def batch_of(part):
        order = np.lexsort(part[::-1])  # rows of a context stand together, so shuffle files repeat their keys and compress
        part = [c[order] for c in part]
        return pa.RecordBatch.from_pydict({n: pa.array(c.view(np.int64)) for n, c in zip(names, part, strict=True)})

    for batch in batches:
        for part in slices(batch, "text", 4 << 20):
            words = Words(_lower(part.column("text").to_pylist()), LETTERS)
            label = part.column("toxic").to_numpy(zero_copy_only=False).astype(np.uint64)[words.text_of]
            v = _before(words, words.hash)
            held.append(distinct([(v, words.hash, _before(words, v) >> np.uint64(32) << np.uint64(1) | label)]))
            rows += len(held[-1][0])
            if rows > 1_500_000:
                held = [distinct(held)]
                rows = len(held[0][0])
                if rows > 1_000_000:
                    yield batch_of(held[0])
                    held, rows = [], 0
    if held:
        yield batch_of(distinct(held))


def continuation_sums(labelled: DataFrame, smoothing: Smoothing) -> DataFrame:
    """kind, v, w, bad, good, bad_free, good_free; ``labelled`` has text and toxic.

    ``bad`` and ``good`` are continuation counts: of word ``w``, of bigram ``v w``
    (only those above the cut-off in a class), and summed over what follows context
    ``v``, where ``bad_free`` and ``good_free`` are the counts that smoothing frees.
    """
    types = labelled.select("text", F.col("toxic").cast("long").alias("toxic")).mapInArrow(_trigrams, "v long, w long, mark long")
    toxic = F.col("mark").bitwiseAND(F.lit(1))
    types = types.withColumn("part", F.pmod("w", F.lit(PARTS)).cast("int"))
    bigrams = types.repartition("v", "part").distinct().groupBy("v", "part", "w").agg(F.sum(toxic).alias("bad"), F.sum(1 - toxic).alias("good"))
    none, classes = F.lit(0.0), ("bad", "good")
    free = {c: _freed(F.col(c), smoothing.discount, smoothing.bigram_cut) for c in classes}
    entry = lambda kind, v, w, counts, freed: F.struct(F.lit(kind).alias("kind"), v.alias("v"), w.alias("w"), *[n.cast("long").alias(c) for c, n in zip(classes, counts, strict=True)], *[n.alias(f"{c}_free") for c, n in zip(classes, freed, strict=True)])
    v, w, zero, counts = F.col("v"), F.col("w"), F.lit(0).cast("long"), [F.col(c) for c in classes]
    rows = [
        entry(WORD, zero, w, [c > 0 for c in counts], [none, none]),
        entry(CONTEXT, v, zero, counts, [free[c] for c in classes]),
        F.when(F.greatest(*counts) > smoothing.bigram_cut, entry(BIGRAM, v, w, counts, [none, none])),
    ]
    sums = bigrams.select(F.explode(F.array(*rows)).alias("x")).filter("x is not null").select("x.*")
    return sums.groupBy("kind", "v", "w").agg(*[F.sum(c).alias(c) for c in (*classes, "bad_free", "good_free")])


def _freed(count: Column, discount: float, cut: int) -> Column:
    """What smoothing takes off a count."""
    return F.when(count <= cut, count.cast("double")).otherwise(F.lit(float(discount)))


def word_models(sums: DataFrame, smoothing: Smoothing) -> DataFrame | None:
    """w, ordinary and toxic (probabilities below the bigrams) of the words of toxic texts or expressions; None without both classes."""
    words = sums.filter(F.col("kind") == WORD).select("w", "bad", "good")
    free = {c: _freed(F.col(c), smoothing.discount, smoothing.word_cut) for c in ("bad", "good")}
    total = words.agg(*[F.sum(c).alias(c) for c in free], *[F.sum(f).alias(f"{c}_free") for c, f in free.items()]).first()
    if not total.bad or not total.good:
        return None
    shared = (F.col("bad") + F.col("good")) / F.lit(float(total.bad + total.good))
    p = {c: (F.col(c) - f) / F.lit(float(total[c])) + F.lit(total[f"{c}_free"] / total[c]) * shared for c, f in free.items()}
    words = words.select("w", "bad", p["good"].alias("ordinary"), F.greatest(p["bad"] - F.lit(smoothing.surplus) * p["good"], F.lit(0.0)).alias("over"))
    whole = words.agg(F.sum("over")).first()[0]
    return words.filter("bad > 0").select("w", "ordinary", (F.col("over") / F.lit(whole or 1.0)).alias("toxic"))


def bigram_models(pairs: DataFrame, sums: DataFrame, words: DataFrame, smoothing: Smoothing) -> DataFrame:
    """v, w, ordinary and toxic (probabilities of w after v) of ``pairs`` whose second word is in ``words``."""
    of = lambda kind, *on: sums.filter(F.col("kind") == kind).select(*on, "bad", "good", "bad_free", "good_free")
    context = of(CONTEXT, "v").select("v", F.struct("bad", "good", "bad_free", "good_free").alias("context"))
    counted = of(BIGRAM, "v", "w").select("v", "w", F.struct("bad", "good").alias("counted"))
    rows = pairs.join(words, "w").join(counted, ["v", "w"], "left").join(context, "v", "left")
    none = F.lit(0.0)

    def p(c: str, below: str) -> Column:
        count, whole = F.coalesce(F.col(f"counted.{c}"), F.lit(0)), F.coalesce(F.col(f"context.{c}"), F.lit(0))
        own = F.when(count > smoothing.bigram_cut, (count - F.lit(smoothing.discount)) / whole).otherwise(none)
        return own + F.when(whole > 0, F.col(f"context.{c}_free") / whole).otherwise(F.lit(1.0)) * F.col(below)

    return rows.select("v", "w", p("good", "ordinary").alias("ordinary"), p("bad", "toxic").alias("toxic"))


def _bits(sums: DataFrame, words: DataFrame, smoothing: Smoothing) -> np.ndarray:
    """Which of ``SLOTS`` slots have a word or a bigram of toxic expressions."""

    def slots(batch):
        v, w = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for c in ("v", "w"))
        single = batch.column("single").to_numpy(zero_copy_only=False).astype(bool)
        yield {"slot": np.unique(np.where(single, w, _bigram(v, w)) % np.uint64(SLOTS)).astype(np.int64)}

    single = words.filter("toxic > 0").select(F.lit(0).cast("long").alias("v"), "w", F.lit(True).alias("single"))
    double = sums.filter((F.col("kind") == BIGRAM) & (F.col("bad") > smoothing.bigram_cut)).select("v", "w", F.lit(False).alias("single"))
    out = np.zeros(SLOTS, dtype=bool)
    out[map_batches(single.unionByName(double), slots, "slot long").distinct().toArrow()["slot"].to_numpy()] = True
    return out


def _met(bits):
    """row, doc_id, words and the bigrams (v, w, n) of each text that may hold an expression."""

    def fn(batch):
        import pyarrow as pa

        wanted, mask = bits.value, np.uint64(SLOTS - 1)
        for part in slices(batch, "text"):
            words = Words(_lower(part.column("text").to_pylist()), LETTERS)
            v = _before(words, words.hash)
            at = np.flatnonzero(wanted[words.hash & mask] | wanted[_bigram(v, words.hash) & mask])
            at = at[np.lexsort((words.hash[at], v[at], words.text_of[at]))]
            keys = words.text_of[at], v[at], words.hash[at]
            new = np.ones(len(at), dtype=bool)
            new[1:] = (keys[0][1:] != keys[0][:-1]) | (keys[1][1:] != keys[1][:-1]) | (keys[2][1:] != keys[2][:-1])
            first = np.flatnonzero(new)
            times = np.diff(np.append(first, len(at))).astype(np.int64)
            entry = pa.StructArray.from_arrays([pa.array(k[first].view(np.int64)) for k in keys[1:]] + [pa.array(times)], names=["v", "w", "n"])
            start = np.searchsorted(keys[0][first], np.arange(part.num_rows + 1)).astype(np.int32)
            yield {"row": part.column("row"), "doc_id": part.column("doc_id"), "words": words.counts.astype(np.int64), "met": pa.ListArray.from_arrays(pa.array(start), entry)}

    return fn


def _weighed(docs: DataFrame, sums: DataFrame, smoothing: Smoothing) -> DataFrame:
    """doc_id, words and ``excess`` of each row: by how much expressions raise the evidence of a word on average."""
    words = word_models(sums, smoothing)
    if words is None:
        return docs.select("doc_id", (F.length("text") * 0).cast("long").alias("words"), F.lit(0.0).alias("excess"))
    words = written(words)
    bits = docs.sparkSession.sparkContext.broadcast(_bits(sums, words, smoothing))
    docs = docs.withColumn("row", F.monotonically_increasing_id())
    met = written(map_batches(docs, _met(bits), "row long, doc_id long, words long, met array<struct<v: bigint, w: bigint, n: bigint>>"))
    bits.unpersist()
    entries = met.select("row", F.explode("met").alias("x")).select("row", "x.*")
    share = smoothing.share / (1 - smoothing.share)
    priced = bigram_models(entries.select("v", "w").distinct(), sums, words, smoothing).filter("toxic > 0")
    priced = written(priced.select("v", "w", F.log1p(F.lit(share) * F.col("toxic") / F.col("ordinary")).alias("rise")))
    if size_of(priced, BROADCAST_BIGRAMS) <= BROADCAST_BIGRAMS:
        entries = entries.join(F.broadcast(priced), ["v", "w"])
    else:
        entries = _spread(entries, priced, ["v", "w"], "row")
    rises = entries.groupBy("row").agg(F.sum(F.col("n") * F.col("rise")).alias("rise"))
    return met.select("row", "doc_id", "words").join(rises, "row", "left").select("doc_id", "words", (F.coalesce("rise", F.lit(0.0)) / F.greatest("words", F.lit(1))).alias("excess"))


def feature(excess: Column) -> Column:
    """What the curve reads: rise of the evidence per 1,000 words, on a logarithmic scale."""
    return F.log1p(1000 * excess)


def fit_curve(rows: list[tuple[float, int, int]], start=(2.0, -6.0), pull: float = 0.003) -> tuple[float, float]:
    """Slope and offset of the logistic curve by Newton steps; rows are (feature, label, times)."""
    x = np.array([[e, 1.0] for e, _, _ in rows]).reshape(-1, 2)
    y, n = np.array([r[1] for r in rows], dtype=float), np.array([r[2] for r in rows], dtype=float)
    first = np.array(start)
    w = first.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (n * (p - y)) + pull * (w - first)
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + pull * np.eye(2), grad)
        w = w - step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def toxicity(docs: DataFrame, labels: DataFrame, learn: Column | None = None, cut: float = 0.7, smoothing: Smoothing = Smoothing()) -> DataFrame:
    """doc_id, evidence, score and predicted for each row of ``docs``.

    ``labels`` has doc_id and toxic (0 or 1); ``learn`` is a predicate on its rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = labels.filter("doc_id is not null and toxic is not null")
    known = (known if learn is None else known.filter(learn)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    known = written(known.withColumn("curve", F.pmod(F.floor(crc(F.col("doc_id")) / 3), F.lit(5)) == 0))
    few = size_of(known, BROADCAST_LABELS) <= BROADCAST_LABELS
    joined = docs.join(F.broadcast(known.filter("not curve")) if few else known.filter("not curve"), "doc_id")
    found = written(_weighed(docs, written(continuation_sums(joined, smoothing)), smoothing))
    held = found.join(known.filter("curve"), "doc_id").groupBy(F.round(feature(F.col("excess")), 2).alias("e"), "toxic").agg(F.count("*").alias("n")).collect()
    slope, offset = fit_curve(sorted((r.e, r.toxic, r.n) for r in held))
    score = 1 / (1 + F.exp(-(feature(F.col("excess")) * slope + offset)))
    evidence = F.when(F.col("words") > 0, F.col("excess") + F.lit(math.log(1 - smoothing.share))).otherwise(F.lit(0.0))
    return found.select("doc_id", evidence.alias("evidence"), score.alias("score")).withColumn("predicted", (F.col("score") >= cut).cast("int"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; rows with crc32(doc_id) mod 3 = 1 are held out."""
    held = crc(F.col("doc_id")) % 3 == 1
    out = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), learn=~held)
    return out.select("doc_id", held.alias("held_out"), "score", "predicted")
