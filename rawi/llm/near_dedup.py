"""Near-duplicate documents by BagMinHash, banding and exact multiset overlap.

Method.  A document is the multiset of its ``shingle``-word sequences.  For each
shingle a Poisson process runs over time and over the weight axis; the weight
axis is split into the dyadic intervals (0,1], (1,2], (2,4], ..., each with a
process of its own whose points carry a position inside the interval, and a point
counts for a document when that position does not exceed the shingle's count.
Each point falls on one of ``bands * rows`` components, and a component keeps its
earliest point: two documents agree on it with a probability equal to their
weighted Jaccard similarity.  A process stops once it passes the latest component
of its document, so the work per shingle is a small constant.  Documents that
agree on all rows of a band are candidates, and candidates are linked when the
exact overlap of their multisets reaches ``similarity``.  At 0.8 with 30 bands of
5 rows a pair is overlooked with a probability of 7e-6.

Large groups.  Equal texts are one text with one 128-bit id.  In a band bucket, every
text is first compared with the bucket's smallest; the links found give
components.  Only in buckets that still hold several components are the others
compared, by their signatures in blocks of ``BLOCK`` texts and about ``BLOCK_BYTES``
bytes (a longer text is alone in its block), and pairs of
different components whose signatures agree on ``LIKELY`` of the components are
verified in place, in the first band they share.  A task gives out one link for
each two components it joins; pairs inside a component cannot change it and are
never looked at, and no list of pairs is ever formed.

Results on odd input.  Null ids have class null and are not compared.  Documents
without words are alone unless their id repeats.  Documents of fewer than
``shingle`` words are one shingle.  Repeated rows each get the class of their
text.  Extra columns are ignored.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import fresh, map_batches, map_tidied, size_of, slices, table, written
from .components import components
from .wordstream import PLAIN, Words, mix, text_bytes, window_hashes

_U = np.uint64
_GOLD = _U(0x9E3779B97F4A7C15)
#: Texts of one bucket whose signatures are compared in one task.
BLOCK = 1000
#: Text bytes of one bucket that are compared in one task.
BLOCK_BYTES = 32 << 20
#: Share of equal components from which a pair is verified; 4.6 standard errors below 0.8 at 150 components.
LIKELY = 0.65
#: Candidate ids are sent to all executors up to this many, else joined by shuffle.
BROADCAST_IDS = 500_000


def shingles(words: Words, size: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct shingle hashes and their counts, for each text."""
    whole = window_hashes(words.hash, size)
    out = []
    for a, b in zip(words.first[:-1], words.first[1:], strict=True):
        if b - a >= size:
            out.append(np.unique(whole[a : b - size + 1], return_counts=True))
        elif b > a:
            out.append((window_hashes(words.hash[a:b], int(b - a)), np.ones(1, dtype=np.int64)))
        else:
            out.append((np.zeros(0, dtype=_U), np.zeros(0, dtype=np.int64)))
    return out


def bag_signatures(bags: list[tuple[np.ndarray, np.ndarray]], size: int) -> np.ndarray:
    """BagMinHash signature of each bag: (bags, size) uint64; an empty bag has zeros."""
    n = len(bags)
    counts = np.array([len(h) for h, _ in bags], dtype=np.int64)
    out = np.zeros(n * size, dtype=_U)
    if not counts.sum():
        return out.reshape(n, size)
    item = np.concatenate([h for h, _ in bags])
    weight = np.concatenate([c for _, c in bags]).astype(np.int64)
    bag = np.repeat(np.arange(n), counts)
    # one process for each interval of the weight axis that the count reaches into
    parts, level = [], 0
    while True:
        low = 0 if level == 0 else 1 << (level - 1)
        here = np.flatnonzero(weight > low)
        if not len(here):
            break
        parts.append((here, np.full(len(here), level)))
        level += 1
    pick = np.concatenate([p for p, _ in parts])
    level = np.concatenate([v for _, v in parts])
    bag, weight = bag[pick], weight[pick]
    width = np.where(level == 0, 1, 1 << np.maximum(level - 1, 0)).astype(float)
    low = np.where(level == 0, 0, 1 << np.maximum(level - 1, 0))
    seed = mix(item[pick] + mix((level + 1).astype(_U) * _GOLD))
    time = np.zeros(len(seed))
    best = np.full(n * size, np.inf)
    latest = np.full(n, np.inf)
    k = 0
    while len(seed):
        k += 1
        r = mix(seed + _U(k * int(_GOLD) % (1 << 64)))
        time = time - np.log(((r >> _U(11)).astype(float) + 0.5) * 2.0**-53) / width
        on = time < latest[bag]
        seed, time, width, low, weight, bag, r = (x[on] for x in (seed, time, width, low, weight, bag, r))
        point = mix(r ^ _U(0xD1B54A32D192ED03))
        where = ((point >> _U(32)) % _U(size)).astype(np.int64) + bag * size
        place = low + 1 + np.floor((point & _U(0xFFFFFFFF)).astype(float) * 2.0**-32 * width).astype(np.int64)
        counts_in = np.flatnonzero(place <= weight)
        at, when = where[counts_in], time[counts_in]
        np.minimum.at(best, at, when)
        won = best[at] == when
        out[at[won]] = point[counts_in[won]]
        latest = best.reshape(n, size).max(axis=1)
    return out.reshape(n, size)


def similarity_of(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two bags."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    union = int(a[1].sum()) + int(b[1].sum()) - both
    return both / union if union else 0.0


def text_id(text: bytes) -> bytes:
    """128-bit id of a word sequence."""
    return hashlib.blake2b(b" ".join(text.split()), digest_size=16).digest()


def _signed(shingle: int, bands: int, rows: int):
    salt = mix(np.arange(1, bands + 1, dtype=_U) * _GOLD)

    def fn(batch):
        for part in slices(batch, "text"):
            texts = text_bytes(part.column("text").to_pylist())
            words = Words(texts, PLAIN)
            sig = bag_signatures(shingles(words, shingle), bands * rows)
            key = np.broadcast_to(salt, (len(texts), bands)).copy()
            for r in range(rows):
                key = mix(key * _GOLD + sig.reshape(len(texts), bands, rows)[:, :, r])
            filled = words.counts > 0
            yield {
                "doc_id": part.column("doc_id"),
                "tid": [text_id(t) for t in texts],
                "size": [len(t) for t in texts],
                "keys": [k if f else [] for k, f in zip(key.view(np.int64), filled, strict=True)],
                "bands": [k.tobytes() for k in key],
                "sig": [s.tobytes() for s in (sig & _U(0xFF)).astype(np.uint8)],
            }

    return fn


def _verified(shingle: int, similarity: float):
    """Rows of one leader stand together, its own text first; emits the links that hold."""

    def bag(text: str):
        return shingles(Words(text_bytes([text]), PLAIN), shingle)[0]

    def run(batches):
        import pyarrow as pa

        leader, own = None, None
        for batch in batches:
            a, b = [], []
            for lead, tid, text in zip(*(batch.column(c).to_pylist() for c in ("leader", "tid", "text")), strict=True):
                if lead == tid:
                    if lead != leader:
                        leader, own = lead, bag(text)
                elif similarity_of(own, bag(text)) >= similarity:
                    a.append(lead)
                    b.append(tid)
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return run


def _verify(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs (leader, tid) whose bags overlap enough.

    Pairs of one leader are dealt over salts of about 500; each salt gets a copy
    of the leader's text, which its task reads once.
    """
    pairs = written(pairs)
    spread = written(pairs.groupBy("leader").agg(F.ceil(F.count("*") / 500).cast("int").alias("salts")))
    hot = _sent(spread.filter("salts > 1"))  # at most a row for 500 pairs
    members = pairs.join(hot, "leader", "left").select("leader", F.pmod(F.xxhash64("tid"), F.coalesce("salts", F.lit(1))).cast("int").alias("salt"), "tid")
    heads = spread.select("leader", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("leader").alias("tid"))
    rows = members.unionByName(heads).join(texts, "tid").select("leader", "salt", "tid", "text", (F.col("leader") != F.col("tid")).alias("other"))
    rows = rows.repartition("leader", "salt").sortWithinPartitions("leader", "salt", "other")
    return written(map_tidied(rows.select("leader", "tid", "text"), _verified(shingle, similarity), "a binary, b binary"))


def _boxes(batches, names: tuple[str, ...]):
    """Lists of rows that share the first column, from batches sorted by it; None marks the end of a batch."""
    held, box = [], None
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            if row[0] != box:
                if held:
                    yield held
                held, box = [], row[0]
            held.append(row)
        yield None
    if held:
        yield held


def _alike(rows):
    """Index pairs (i, array of j > i) of a box's rows (box, band, half, tid, label, sig, bands).

    The pair is of different components, agrees on ``LIKELY`` of the signature,
    lies across the halves of the box if it has two, and shares no earlier band,
    where it is looked at already.
    """
    band, half = rows[0][1], np.array([r[2] for r in rows])
    label = np.array([r[4] for r in rows])
    sig = np.frombuffer(b"".join(r[5] for r in rows), dtype=np.uint8).reshape(len(rows), -1)
    keys = np.frombuffer(b"".join(r[6] for r in rows), dtype=np.int64).reshape(len(rows), -1)[:, :band]
    across = bool((half != half[0]).any())
    for i in range(len(rows) - 1):
        ok = label[i + 1 :] != label[i]
        if across:
            ok &= half[i + 1 :] != half[i]
        at = np.flatnonzero(ok) + i + 1
        at = at[(sig[at] == sig[i]).mean(axis=1) >= LIKELY] if len(at) else at
        at = at[~(keys[at] == keys[i]).any(axis=1)] if len(at) and band else at
        if len(at):
            yield i, at


_ROW = ("box", "band", "half", "tid", "label", "sig", "bands")


def _screen(batches):
    """(box, tid) of the rows that have a pair to verify in their box."""
    import pyarrow as pa

    box, tid = [], []
    for rows in _boxes(batches, _ROW):
        if rows is not None:
            found = sorted({x for i, at in _alike(rows) for x in (i, *at.tolist())})
            box += [rows[0][0]] * len(found)
            tid += [rows[x][3] for x in found]
        if rows is None or len(box) > 10_000:
            yield pa.RecordBatch.from_pydict({"box": pa.array(box, pa.int64()), "tid": pa.array(tid, pa.binary())})
            box, tid = [], []
    yield pa.RecordBatch.from_pydict({"box": pa.array(box, pa.int64()), "tid": pa.array(tid, pa.binary())})


def _joined_up(shingle: int, similarity: float):
    """Links that hold inside a box, as many as it takes to join its components."""

    def run(batches):
        import pyarrow as pa

        for rows in _boxes(batches, (*_ROW, "text")):
            a, b = [], []
            if rows is not None:
                bags = shingles(Words(text_bytes([r[7] for r in rows]), PLAIN), shingle)
                top: dict[int, int] = {}

                def root(x, top=top):
                    while x in top:
                        x = top[x]
                    return x

                for i, at in _alike(rows):
                    for j in at:
                        x, y = root(rows[i][4]), root(rows[j][4])
                        if x != y and similarity_of(bags[i], bags[j]) >= similarity:
                            top[x] = y
                            a.append(rows[i][3])
                            b.append(rows[j][3])
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return run


def _remaining(members: DataFrame, labels: DataFrame, texts: DataFrame, found: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Links across components among the texts of a bucket that were not compared with each other yet.

    Buckets are cut into blocks; a box is a block or a pair of blocks.  First only
    signatures travel and say who has a likely partner, then their texts.
    """
    others = members.filter("tid <> leader").join(labels.withColumnRenamed("v", "tid"), "tid", "left").withColumn("label", F.coalesce("label", "tid"))
    mixed = others.groupBy("key").agg(F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high"), F.sum("size").alias("bytes"))
    mixed = mixed.filter("low < high").select("key", F.ceil(F.greatest(F.col("n") / BLOCK, F.col("bytes") / BLOCK_BYTES)).cast("int").alias("blocks"))
    rows = others.join(written(mixed), "key").withColumn("half", F.pmod(F.xxhash64("tid"), "blocks").cast("int"))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = written(rows.select(F.xxhash64("key", F.least("half", "with"), F.greatest("half", "with")).alias("box"), "band", "half", "tid", "label"))
    signed = rows.join(texts.select("tid", "sig", "bands"), "tid").select(*_ROW)
    busy = written(map_tidied(signed.repartition("box").sortWithinPartitions("box"), _screen, "box long, tid binary"))
    full = rows.join(busy, ["box", "tid"]).join(texts.select("tid", "sig", "bands"), "tid").join(found, "tid").select(*_ROW, "text")
    return written(map_tidied(full.repartition("box").sortWithinPartitions("box"), _joined_up(shingle, similarity), "a binary, b binary"))


def _sent(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if size_of(ids, BROADCAST_IDS) <= BROADCAST_IDS else ids


def _classes(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, bands: int = 30, rows: int = 5) -> DataFrame:
    """doc_id, tid (its text), label (its class) and class_id (the smallest id of the class) for each row with an id."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = written(map_batches(docs.filter("doc_id is not null"), _signed(shingle, bands, rows), "doc_id long, tid binary, size long, keys array<long>, bands binary, sig binary"))
    filled = signed.filter(F.size("keys") > 0)
    texts = written(filled.groupBy("tid").agg(F.min(F.struct("doc_id", "size", "keys", "bands", "sig")).alias("v")).select("tid", F.col("v.doc_id").alias("low"), "v.size", "v.keys", "v.bands", "v.sig"))
    placed = texts.select(F.posexplode("keys").alias("band", "key"), "tid", "size")
    buckets = written(placed.groupBy("key").agg(F.min("tid").alias("leader"), F.max("tid").alias("high")).filter("leader < high").select("key", "leader"))
    members = written(placed.join(buckets, "key"))
    pairs = written(members.filter("tid <> leader").select("leader", "tid").distinct())
    # texts of the candidates, found by the id that stands for each
    wanted = members.select("tid").distinct().join(texts.select("tid", "low"), "tid")
    ids = wanted.select(F.col("low").alias("doc_id"))
    found = docs.join(_sent(ids), "doc_id", "left_semi")
    found = written(
        map_batches(
            found,
            lambda batch: iter([{"tid": [text_id(t) for t in text_bytes(batch.column("text").to_pylist())], "text": batch.column("text")}]),
            "tid binary, text string",
        ).dropDuplicates(["tid"])
    )
    links = _verify(pairs, found, shingle, similarity)
    links = links.unionByName(_remaining(members, components(links), texts, found, shingle, similarity))
    labels = components(links)
    named = labels.withColumnRenamed("v", "tid").join(texts.select("tid", "low"), "tid")
    classes = named.groupBy("label").agg(F.min("low").alias("class_id")).join(labels, "label").select(F.col("v").alias("tid"), "label", "class_id")
    alone = texts.select("tid", "low").join(classes, "tid", "left").select("tid", F.coalesce("label", "tid").alias("label"), F.coalesce("class_id", "low").alias("class_id"))
    # both sides are read from files, so that a text of very many rows can be split over tasks
    out = filled.select("doc_id", "tid").join(written(alone), "tid").select("doc_id", "tid", "label", "class_id")
    return out.unionByName(signed.filter(F.size("keys") == 0).select("doc_id", "tid", F.col("tid").alias("label"), F.col("doc_id").alias("class_id")))


def near_classes(docs: DataFrame, **options) -> DataFrame:
    """doc_id, class_id (the smallest id of its class of near duplicates) for each row of ``docs``."""
    unnamed = docs.filter("doc_id is null").select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("class_id"))
    return _classes(docs, **options).select("doc_id", "class_id").unionByName(unnamed)


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """One row of each class: of its smallest id, and of rows that share this id any one.

    Rows of one id may be of different classes; rows without an id all stay.  All
    columns of ``docs`` are kept, whatever their names.
    """
    found = written(_classes(docs, **options))
    gone = written(found.filter("doc_id <> class_id").select("doc_id").distinct())
    many = written(found.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"))
    once = docs.join(_sent(gone), "doc_id", "left_anti")
    if many.isEmpty():
        return once
    once = once.join(_sent(many), "doc_id", "left_anti")
    shared = docs.join(_sent(many), "doc_id", "left_semi")
    tid, own, label = fresh(docs, "_tid", "_id", "_label")

    def named(batches):
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch, "text"):
                tids = pa.array([text_id(t) for t in text_bytes(part.column("text").to_pylist())], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, tids], names=[*part.schema.names, tid])

    shared = map_tidied(shared, named, StructType([*docs.schema.fields, StructField(tid, BinaryType())]))
    kept = found.filter("doc_id = class_id").join(many, "doc_id", "left_semi").select(F.col("doc_id").alias(own), F.col("tid").alias(tid), F.col("label").alias(label)).distinct()
    shared = shared.join(kept, (shared["doc_id"] == kept[own]) & (shared[tid] == kept[tid])).drop(tid).dropDuplicates(["doc_id", label])
    return once.unionByName(shared.select(*docs.columns))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the class of its near duplicates."""
    return near_classes(table(spark, sf_dir, "documents"))


#: The same classes from all pairs that share a shingle.
OP7_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents WHERE doc_id IS NOT NULL
), placed AS (
  SELECT doc_id, md5(array_to_string(list_slice(w, p, p + 4), ' ')) AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS p FROM words WHERE len(w) > 0)
), bags AS (
  SELECT doc_id, s, count(*) AS c, sum(count(*)) OVER (PARTITION BY doc_id) AS total FROM placed GROUP BY doc_id, s
), links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM bags a JOIN bags b ON a.s = b.s AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id
  HAVING 10 * sum(least(a.c, b.c)) >= 8 * (max(a.total) + max(b.total) - sum(least(a.c, b.c)))
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM words UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
)
SELECT x AS doc_id, min(y) AS class_id FROM reach GROUP BY x
"""
