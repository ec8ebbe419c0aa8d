"""Language identification, words first with backoff to shorter and shorter n-grams.

Method.  From labelled texts, words and the 1- to 4-character sequences of words
(with marks for their ends) are counted per language.  A known word scores its
log frequency in each language.  A word outside the table scores, at each of its
positions, the longest known sequence that starts there (4 characters, else 3, 2,
1), averaged over the positions.  A text's scores are the means over its words and
its language is the largest; ``score`` is that language's share after softmax, so
it does not grow with the length of a text.

Scale.  All labelled rows are counted, tasks send sums, and every count stays in a
written table.  Each task holds the ``max_words`` most frequent words and
``max_grams`` most frequent sequences of each length (whole frequency classes, at
most that many) and scores them at once.  A text's other words are joined to the
written counts, and those outside them by the sequences that the task did not
hold; keys with many rows are dealt over several partitions.  So what is held has
a fixed bound, fewer keys where there are many languages, and the result does not
depend on it.

Results on odd input.  A text that is null or has no letter is ``und`` with score
0, and so is every text when nothing is labelled.  Null languages are not learned;
any number of languages is.  Ties go to the first language by name.  Null ids are looked up as the empty text when folds are formed.  Repeated
rows get equal results.  Extra columns are ignored by ``identify`` and kept by
``in_known_language``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, map_batches, map_tidied, size_of, slices, table, written
from .wordstream import LETTERS, Shelf, Words, mix, window_hashes

LONGEST = 4
#: Numbers that the table of a kind may hold in a task: keys times languages.
HELD = 8_000_000


def crc(column: Column) -> Column:
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary"))


def _lower(values) -> list[bytes]:
    return [b"" if v is None else v.lower().encode("utf-8", "surrogatepass") for v in values]


class Run:
    """Marked words as one run of characters, for the sequences of every length."""

    def __init__(self, words: list[bytes]):
        run = (b"^" + b"$\n^".join(words) + b"$\n").decode("utf-8", "surrogatepass")
        self.code = np.frombuffer(run.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        ends = self.code == 10
        self.owner = np.cumsum(ends) - ends
        self.inner = ~ends

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of the n-character sequences inside words, each with its word's index and its place in the run."""
        h = window_hashes(mix(self.code.astype(np.uint64) + np.uint64(n << 32)), n)
        m = len(h)
        at = np.flatnonzero((self.owner[:m] == self.owner[n - 1 :]) & self.inner[n - 1 :])
        return h[at], self.owner[at], at


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, inverse = np.unique(keys, return_inverse=True)
    return distinct, np.bincount(inverse, n, len(distinct)).astype(np.int64)


def _counting(batches):
    """Counts (lang, kind, key, n) of a task; kind 0 is a word, 1 to 4 a sequence of that length."""
    import pyarrow as pa

    held: dict[tuple[int, int], list] = {}
    size = 0

    def merge():
        for at, parts in held.items():
            held[at] = [_summed(np.concatenate([k for k, _ in parts]), np.concatenate([n for _, n in parts]))]
        return sum(len(parts[0][0]) for parts in held.values())

    def rows():
        merge()
        cols = {"lang": [], "kind": [], "key": [], "n": []}
        for (lang, kind), [(keys, n)] in held.items():
            for name, part in (("lang", np.full(len(keys), lang, np.int32)), ("kind", np.full(len(keys), kind, np.int32)), ("key", keys.view(np.int64)), ("n", n)):
                cols[name].append(part)
        return pa.RecordBatch.from_pydict({c: pa.array(np.concatenate(v)) for c, v in cols.items()})

    for batch in batches:
        for part in slices(batch, "text", 2 << 20):
            words = Words(_lower(part.column("text").to_pylist()), LETTERS)
            of = part.column("code").to_numpy(zero_copy_only=False)[words.text_of]
            for lang in np.unique(of):
                here = np.flatnonzero(of == lang)
                h, first, times = np.unique(words.hash[here], return_index=True, return_counts=True)
                parts = [(h, times)]
                run = Run([words.word(i) for i in here[first]])
                for n in range(1, LONGEST + 1):
                    g, owner, _ = run.grams(n)
                    parts.append(_summed(g, times[owner]))
                for kind, (key, n) in enumerate(parts):
                    held.setdefault((int(lang), kind), []).append((key, n))
                    size += len(key)
            if size > 1_500_000:
                size = merge()
                if size > 900_000:
                    yield rows()
                    held.clear()
                    size = 0
    if held:
        yield rows()


class Tables:
    """What a task holds: frequent words and sequences, by how much each raises a language's log frequency from that of an unseen key."""

    def __init__(self, langs: list[str], rows, totals: dict[tuple[int, int], int], sizes: dict[int, int]):
        self.langs = langs
        self.shelves, self.rises, self.whole = {}, {}, {}
        self.base = np.zeros((LONGEST + 1, len(langs)))
        for kind in range(LONGEST + 1):
            own = sorted((r for r in rows if r[0] == kind), key=lambda r: r[1] % (1 << 64))
            n = np.zeros((len(own), len(langs)))
            for i, (_, _, by_lang) in enumerate(own):
                for x in by_lang:
                    n[i, x["lang"]] = x["n"]
            total = np.array([totals.get((kind, i), 0) for i in range(len(langs))], dtype=float)
            self.shelves[kind] = Shelf(np.array([r[1] for r in own], dtype=np.int64).view(np.uint64))
            self.rises[kind] = np.log(2 * n + 1)
            self.whole[kind] = len(own) == sizes.get(kind, 0)
            self.base[kind] = np.log(0.5 / (total + 0.5 * max(sizes.get(kind, 0), 1)))

    def known(self, words: Words, texts: int) -> tuple[np.ndarray, np.ndarray]:
        """(texts, languages) rises of the words that are held, and the places of the other words."""
        at, key = self.shelves[0].find(words.hash)
        out = np.zeros((texts, len(self.langs)))
        for lang in range(len(self.langs)):
            out[:, lang] = np.bincount(words.text_of[at], self.rises[0][key, lang], texts)
        other = np.ones(len(words.hash), dtype=bool)
        other[at] = False
        return out, np.flatnonzero(other)

    def wanted(self, words: list[bytes]):
        """Sequences to look up in the counts, by length: owners and hashes of those that may be the longest known at their place."""
        run = Run(words)
        done = np.zeros(len(run.code), dtype=bool)
        for n in range(LONGEST, 0, -1):
            h, owner, at = run.grams(n)
            fresh = np.flatnonzero(~done[at])
            i, _ = self.shelves[n].find(h[fresh])
            done[at[fresh[i]]] = True
            if not self.whole[n]:
                rest = np.delete(fresh, i)
                both = np.unique(np.stack([owner[rest].astype(np.uint64), h[rest]]), axis=1)
                yield n, both[0].astype(np.int64), both[1].view(np.int64)

    def unknown(self, words: list[bytes], more: dict[int, tuple[Shelf, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """Words outside the counts: mean rises over positions of the longest known sequence, and the share of each length."""
        out = np.zeros((len(words), len(self.langs)))
        share = np.zeros((len(words), LONGEST + 1))
        run = Run(words)
        done = np.zeros(len(run.code), dtype=bool)
        for n in range(LONGEST, 0, -1):
            h, owner, at = run.grams(n)
            for shelf, rises in ((self.shelves[n], self.rises[n]), *([more[n]] if n in more else [])):
                fresh = ~done[at]
                i, key = shelf.find(h[fresh])
                who, where = owner[fresh][i], at[fresh][i]
                done[where] = True
                for lang in range(len(self.langs)):
                    out[:, lang] += np.bincount(who, rises[key, lang], len(words))
                share[:, n] += np.bincount(who, minlength=len(words))
        places = np.maximum(share.sum(axis=1), 1)[:, None]
        return out / places, share / places


@dataclass
class Learned:
    """The counts of all keys (kind, key, lang, n) and what each task holds of them."""

    tables: Tables
    counts: DataFrame | None

    @property
    def shelves(self) -> dict[int, Shelf]:
        return self.tables.shelves


def learn(docs: DataFrame, max_words: int = 100_000, max_grams: int = 50_000) -> Learned:
    """Counts of the rows of ``docs`` that have a language; tasks hold at most ``max_words`` and ``max_grams`` of them."""
    docs = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter("lang is not null and text is not null")
    langs = sorted(r.lang for r in docs.select("lang").distinct().collect())
    if not langs:
        return Learned(Tables([], [], {}, {}), None)
    max_words, max_grams = min(max_words, HELD // len(langs)), min(max_grams, HELD // 2 // len(langs))
    names = docs.sparkSession.createDataFrame(list(enumerate(langs)), "code int, lang string")
    counts = map_tidied(docs.join(F.broadcast(names), "lang").select("text", "code"), _counting, "lang int, kind int, key long, n long")
    counts = written(counts.groupBy("kind", "key", "lang").agg(F.sum("n").alias("n")))
    totals = {(r.kind, r.lang): r.n for r in counts.groupBy("kind", "lang").agg(F.sum("n").alias("n")).collect()}
    # the step of log frequency from which the keys of a kind are held
    keyed = counts.groupBy("kind", "key").agg(F.sum("n").alias("all"), F.collect_list(F.struct("lang", "n")).alias("by_lang"))
    step = F.floor(F.log2("all") * 16).cast("int")
    steps = counts.groupBy("kind", "key").agg(F.sum("n").alias("all")).groupBy("kind", step.alias("step")).agg(F.count("*").alias("n")).collect()
    least, sizes = {}, {}
    for kind in range(LONGEST + 1):
        have, most = 0, max_grams if kind else max_words
        least[kind] = 0
        sizes[kind] = sum(r.n for r in steps if r.kind == kind)
        for r in sorted((r for r in steps if r.kind == kind), key=lambda r: -r.step):
            have += r.n
            if have > most:
                least[kind] = r.step + 1
                break
    floor = F.element_at(F.array(*[F.lit(least[k]) for k in range(LONGEST + 1)]), F.col("kind") + 1)
    rows = keyed.filter(step >= floor).select("kind", "key", "by_lang").toArrow().to_pydict()
    return Learned(Tables(langs, list(zip(rows["kind"], rows["key"], rows["by_lang"], strict=True)), totals, sizes), counts)


_ASCII = re.compile(rb"[a-z]")
#: Keys with very many rows that are sent to all executors, else joined by shuffle.
BROADCAST_KEYS = 200_000
_LOOK = "_row long, _ok boolean, _words long, _rises array<double>, _rest array<struct<key: bigint, word: binary, n: bigint>>"


def _looked(part, tables: Tables):
    """Arrow columns of ``_LOOK`` but the first: is there a letter, words, rises of held words, distinct other words."""
    import pyarrow as pa

    values = part.column("text").to_pylist()
    texts = _lower(values)
    words = Words(texts, LETTERS)
    ok = [n > 0 and (_ASCII.search(t) is not None or any(c.isalpha() for c in v)) for n, t, v in zip(words.counts, texts, values, strict=True)]
    rises, rest = tables.known(words, len(texts))
    rest = rest[np.lexsort((words.hash[rest], words.text_of[rest]))]
    h, of = words.hash[rest], words.text_of[rest]
    new = np.ones(len(rest), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    first = np.flatnonzero(new)
    entry = pa.StructArray.from_arrays(
        [pa.array(h[first].view(np.int64)), pa.array([words.word(i) for i in rest[first]], pa.binary()), pa.array(np.diff(np.append(first, len(rest))).astype(np.int64))], names=["key", "word", "n"]
    )
    start = np.searchsorted(of[first], np.arange(len(texts) + 1)).astype(np.int32)
    wide = np.arange(len(texts) + 1, dtype=np.int32) * len(tables.langs)
    return [pa.array(ok, pa.bool_()), pa.array(words.counts.astype(np.int64)), pa.ListArray.from_arrays(pa.array(wide), pa.array(rises.ravel())), pa.ListArray.from_arrays(pa.array(start), entry)]


def _spread(left: DataFrame, right: DataFrame, on: list[str], by: str, most: int = 5000) -> DataFrame:
    """Inner join; a key with over ``most`` rows on the left is dealt by column ``by`` over partitions that each get its rows of the right."""
    hot = left.groupBy(*on).agg(F.count("*").alias("_n")).filter(F.col("_n") > most).select(*on, F.ceil(F.col("_n") / most).cast("int").alias("_parts"))
    hot = written(hot)  # at most a row for every ``most`` rows of the left
    hot = F.broadcast(hot) if size_of(hot, BROADCAST_KEYS) <= BROADCAST_KEYS else hot
    left = left.join(hot, on, "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64(by), "_parts"), F.lit(0)).cast("int")).drop("_parts")
    right = right.join(hot, on, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_parts") - 1, F.lit(0))))).drop("_parts")
    return left.join(right, [*on, "_part"]).drop("_part")


def _word_scores(entries: DataFrame, learned: Learned, shared) -> DataFrame:
    """(key, slot, value) of the words that tasks did not hold.

    Slot i is the rise of language i.  A word counts with the base of known words;
    where it is outside the counts, slot -1 takes that off and slot -1 - n is the
    share of its sequences of length n.
    """
    counts, n_langs = learned.counts, len(learned.tables.langs)
    words = written(entries.groupBy("key").agg(F.first("word").alias("word")))
    numbers = counts.filter("kind = 0").select("key", F.col("lang").alias("slot"), F.log(2 * F.col("n") + 1).alias("value"))
    found = words.select("key").join(numbers, "key")
    # a word that is not held is outside the counts where all are held
    new = words if learned.tables.whole[0] else written(words.join(counts.filter("kind = 0").select("key").distinct(), "key", "left_anti"))

    def wanted(batch):
        for part in slices(batch, "word", 1 << 18):
            key = part.column("key").to_numpy(zero_copy_only=False)
            for n, owner, gram in shared.value.wanted(part.column("word").to_pylist()):
                yield {"word_key": key[owner], "kind": np.full(len(gram), n, np.int32), "key": gram}

    grams = _spread(written(map_batches(new, wanted, "word_key long, kind int, key long")), counts.filter("kind > 0"), ["kind", "key"], "word_key")
    grams = grams.groupBy("word_key").agg(F.collect_list(F.struct("kind", "key", "lang", "n")).alias("grams")).withColumnRenamed("word_key", "key")

    def scored(batch):
        for part in slices(batch, "word", max((1 << 20) // n_langs, 1)):
            own = [g for row in part.column("grams").to_pylist() for g in row or ()]
            more = {}
            for kind in {g["kind"] for g in own}:
                of = [g for g in own if g["kind"] == kind]
                shelf = Shelf(np.array([g["key"] for g in of], dtype=np.int64).view(np.uint64))
                rises = np.zeros((len(shelf.keys), n_langs))
                at = np.searchsorted(shelf.keys, np.array([g["key"] for g in of], dtype=np.int64).view(np.uint64))
                rises[at, [g["lang"] for g in of]] = np.log(2 * np.array([g["n"] for g in of], dtype=float) + 1)
                more[kind] = shelf, rises
            rises, share = shared.value.unknown(part.column("word").to_pylist(), more)
            share[:, 0] = -1
            wide = np.concatenate([share[:, ::-1], rises], axis=1)
            word, slot = np.nonzero(wide)
            key = part.column("key").to_numpy(zero_copy_only=False)
            yield {"key": key[word], "slot": (slot - LONGEST - 1).astype(np.int32), "value": wide[word, slot]}

    return found.unionByName(map_batches(new.join(grams, "key", "left"), scored, "key long, slot int, value double"))


def _told(rows: DataFrame, learned: Learned, shared, keep: list[str]) -> DataFrame:
    """``keep`` of each row that ``_looked`` made, with its lang_pred and score."""
    entries = rows.select("_row", F.explode("_rest").alias("x")).select("_row", "x.*")
    rows = rows.select("_row", *[c for c in keep if c != "_row"], "_ok", "_words", "_rises")
    if learned.counts is None or entries.isEmpty():
        rows = rows.withColumn("_sums", F.lit(None).cast("array<struct<slot: int, value: double>>"))
    else:
        scores = written(_word_scores(entries, learned, shared))
        sums = _spread(entries.select("_row", "key", "n"), scores, ["key"], "_row").groupBy("_row", "slot").agg(F.sum(F.col("n") * F.col("value")).alias("value"))
        rows = rows.join(sums.groupBy("_row").agg(F.collect_list(F.struct("slot", "value")).alias("_sums")), "_row", "left")

    def fn(batch):
        tables, n = shared.value, batch.num_rows
        out = {c: batch.column(c) for c in keep}
        if not tables.langs:
            yield out | {"lang_pred": ["und"] * n, "score": [0.0] * n}
            return
        total = batch.column("_rises").flatten().to_numpy(zero_copy_only=False).reshape(n, len(tables.langs)).copy()
        total += batch.column("_words").to_numpy(zero_copy_only=False)[:, None] * tables.base[0]
        for i, sums in enumerate(batch.column("_sums").to_pylist()):
            for x in sums or ():
                if x["slot"] >= 0:
                    total[i, x["slot"]] += x["value"]
                else:
                    total[i] += x["value"] * tables.base[-1 - x["slot"]]
        total /= np.maximum(batch.column("_words").to_numpy(zero_copy_only=False), 1)[:, None]
        best = total.argmax(axis=1)
        share = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        ok = batch.column("_ok").to_pylist()
        yield out | {"lang_pred": [tables.langs[b] if o else "und" for b, o in zip(best, ok, strict=True)], "score": np.where(ok, share, 0.0)}

    kinds = dict(rows.dtypes)
    return map_batches(rows, fn, ", ".join(f"{c} {kinds[c]}" for c in keep) + ", lang_pred string, score double")


def _rows(docs: DataFrame, shared, keep: list[str]) -> DataFrame:
    """``keep`` of ``docs`` and the columns of ``_LOOK``, written; ``_row`` numbers the rows."""
    from pyspark.sql.types import StructType

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            most = max((1 << 20) // max(len(shared.value.langs), 1), 1)
            for part in (some.slice(i, most) for some in slices(batch, "text") for i in range(0, some.num_rows, most)):
                names = [*keep, "_row", "_ok", "_words", "_rises", "_rest"]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in names[:-4]] + _looked(part, shared.value), names=names)

    schema = StructType([docs.schema[c] for c in keep] + StructType.fromDDL(_LOOK).fields)
    return written(map_tidied(docs.withColumn("_row", F.monotonically_increasing_id()), run, schema))


def identify(docs: DataFrame, learned: Learned) -> DataFrame:
    """doc_id, lang_pred and score for each row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(learned.tables)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _told(_rows(docs, shared, ["doc_id"]), learned, shared, ["doc_id"])


def in_known_language(docs: DataFrame, learned: Learned, least: float = 0.4, small: int = 1_000_000) -> DataFrame:
    """The rows of ``docs`` whose language is told with a score of ``least`` or more.

    The verdict follows from the text alone, so the texts that go are named by two
    64-bit hashes and the rows are not written again.
    """
    shared = docs.sparkSession.sparkContext.broadcast(learned.tables)
    text = F.col("text").cast("string")
    named = [F.xxhash64(text).alias("_h"), F.xxhash64(F.lit(1), text, F.length(text)).alias("_g")]
    rows = _rows(docs.select(*named, text.alias("text")), shared, ["_h", "_g"])
    gone = written(_told(rows, learned, shared, ["_h", "_g"]).filter((F.col("lang_pred") == "und") | ~(F.col("score") >= least)).select("_h", "_g").distinct())
    gone = F.broadcast(gone) if size_of(gone, small) <= small else gone
    h, g = fresh(docs, "_h", "_g")
    marked = docs.withColumns({h: named[0], g: named[1]})
    return marked.join(gone.withColumnsRenamed({"_h": h, "_g": g}), [h, g], "left_anti").drop(h, g)


def learning_rows(docs: DataFrame) -> DataFrame:
    """Rows outside the held-out fold."""
    return docs.filter(crc(F.col("doc_id")) % 5 != 0)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; rows with crc32(doc_id) mod 5 = 0 are held out."""
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, learn(learning_rows(docs)))
    return found.select("doc_id", (crc(F.col("doc_id")) % 5 == 0).alias("held_out"), "lang_pred", "score")
