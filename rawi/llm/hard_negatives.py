"""Hard negatives of embedding anchors by Fagin's threshold algorithm.

A row's score for an anchor is the inner product of their vectors, made integer by
``floor(scale * x)`` of each component.  An anchor's positives are the best rows of
its own label; for each positive the best rows of other labels are returned whose
score lies between ``low`` hundredths of the positive's score and that score itself.

Method.  A block of rows keeps, for each dimension, the list of its rows in order of
their component.  For an anchor the lists are read from the end that its sign asks
for, all to the same depth; each row met is scored whole at once (random access).
The threshold is the score of a made-up row that has the component last read in
every list: no row that was not met scores higher.  A top-k search ends when the
threshold falls strictly below its kth score, so rows that tie with it are still
met; a window also ends when the threshold falls below its lower edge.

Scale.  The anchors are a stated set of queries against all rows.  Rows and anchors
are dealt into blocks of bounded size by a hash of a row number; each pair of a row
block and an anchor block is one group, so no task holds more than two blocks, and
only the k best of a group are shuffled.  The first search finds the positives, the
second one all windows of an anchor in one walk.  The lists are made once per
group.  With vectors that are alike in all directions the threshold falls late, and
most rows of a block are scored.

Results on odd input.  Rows with a null label, a null vector or a component that is
null or not finite take no part.  A row with a null id is no anchor and comes after
all ids where scores tie.  Rows that repeat an id are rows of their own, anchors too;
where score and id tie, the row number decides.  A vector shorter than the longest
counts as filled up with zeros.  Components are held within the square root of
``2**62 / dimensions`` (and 31 bits), so that every score fits a long.  A negative
positive score has an empty window.  An empty table, or one without anchors, gives no
rows.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

#: Components of a block of rows, and of a block of anchors.
ROW_CELLS, ANCHOR_CELLS = 1 << 18, 1 << 20
_LAST = np.iinfo(np.int64).max
_FOUND = "anchor long, positive int, id long, row long, score long"


class Lists:
    """Sorted lists of a block of vectors, one for each dimension."""

    def __init__(self, x: np.ndarray):
        self.x = x
        order = np.argsort(x, axis=0, kind="stable")
        self.values = np.take_along_axis(x, order, 0).T.astype(np.int64)
        self.order = order.T.astype(np.int32)

    def walk(self, q: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
        """Rows first met and their scores, deeper and deeper, with the threshold of the rest."""
        n = len(self.x)
        up, down = np.flatnonzero(q > 0), np.flatnonzero(q < 0)
        if not len(up) + len(down):  # every row scores 0
            yield np.arange(n), np.zeros(n, dtype=np.int64), -np.inf
            return
        weight = q.astype(np.int64)
        met = np.zeros(n, dtype=bool)
        depth, step = 0, max(8, n // 64)
        while depth < n:
            to = min(n, depth + step)
            before = met.copy()
            met[self.order[up, n - to : n - depth]] = True
            met[self.order[down, depth:to]] = True
            new = np.flatnonzero(met & ~before)
            threshold = int(self.values[up, n - to] @ weight[up] + self.values[down, to - 1] @ weight[down])
            yield new, (self.x[new] @ q).astype(np.int64), threshold if to < n else -np.inf
            depth, step = to, step * 2


def _best(score: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: highest score, then smallest id, then smallest row."""
    at = np.arange(len(score))
    if len(score) > k:
        at = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    return at[np.lexsort((rows[at], ids[at], -score[at]))[:k]]


def top(lists: Lists, q: np.ndarray, ids: np.ndarray, rows: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the k best rows other than the row ``own``."""
    at, score = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    for new, fresh, rest in lists.walk(q):
        other = rows[new] != own
        at, score = np.concatenate((at, new[other])), np.concatenate((score, fresh[other]))
        keep = _best(score, ids[at], rows[at], k)
        at, score = at[keep], score[keep]
        if len(at) >= k and score[-1] > rest:
            break
    return at, score


def windowed(lists: Lists, q: np.ndarray, ids: np.ndarray, rows: np.ndarray, fits: np.ndarray, edges: list[tuple[int, int]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each (lowest, highest) score, places and scores of its k best rows among those that fit."""
    out = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))] * len(edges)
    todo = [w for w, (lowest, highest) in enumerate(edges) if lowest <= highest]
    at, score = out[0] if edges else (None, None)
    for new, fresh, rest in lists.walk(q) if todo else ():
        inside = fits[new] & (fresh >= min(edges[w][0] for w in todo)) & (fresh <= max(edges[w][1] for w in todo))
        at, score = np.concatenate((at, new[inside])), np.concatenate((score, fresh[inside]))
        for w in list(todo):
            lowest, highest = edges[w]
            own = np.flatnonzero((score >= lowest) & (score <= highest))
            keep = own[_best(score[own], ids[at[own]], rows[at[own]], k)]
            if rest < lowest or len(keep) >= k and score[keep[-1]] > rest:
                out[w] = (at[keep], score[keep])
                todo.remove(w)
        if not todo:
            break
    return out


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Lists of numbers as rows, filled up with zeros."""
    flat = column.combine_chunks()
    size = np.diff(flat.offsets.to_numpy())
    out = np.zeros((len(flat), width), dtype=np.int64)
    out[np.arange(width) < size[:, None]] = flat.flatten().to_numpy(zero_copy_only=False)
    return out


def _exact(x: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both in the narrowest type in which their inner products, and every part of them, are exact."""
    longest = lambda m: float(np.sqrt(np.square(m.astype(np.float64)).sum(1).max(initial=0)))
    most = longest(x) * longest(q)
    kind = np.float32 if most < 1 << 23 else np.float64 if most < 1 << 52 else np.int64
    return x.astype(kind), q.astype(kind)


def _sides(rows: pa.Table, anchors: pa.Table, width: int):
    x, q = _exact(_matrix(rows.column("vector"), width), _matrix(anchors.column("vector"), width))
    column = lambda t, c: t.column(c).to_numpy()
    ids = rows.column("id").fill_null(_LAST).to_numpy()
    return x, q, ids, column(rows, "row"), column(rows, "label"), column(anchors, "row"), column(anchors, "label")


def _table(found: list[tuple[int, int, np.ndarray, np.ndarray]], ids: pa.ChunkedArray, rows: np.ndarray) -> pa.Table:
    """(anchor, positive, places, scores) as rows of ``_FOUND``."""
    size = [len(f[2]) for f in found]
    at = np.concatenate([f[2] for f in found]) if found else np.zeros(0, dtype=np.int64)
    return pa.table({
        "anchor": pa.array(np.repeat(np.array([f[0] for f in found], dtype=np.int64), size)),
        "positive": pa.array(np.repeat(np.array([f[1] for f in found], dtype=np.int32), size)),
        "id": ids.take(pa.array(at)).combine_chunks().cast(pa.int64()),
        "row": pa.array(rows[at]),
        "score": pa.array(np.concatenate([f[3] for f in found]) if found else np.zeros(0, dtype=np.int64)),
    })


def _positives(width: int, k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        x, q, ids, rows, labels, own, of = _sides(left, right, width)
        found = []
        for label in np.unique(of):
            place = np.flatnonzero(labels == label)
            if not len(place):
                continue
            lists = Lists(x[place])
            for a in np.flatnonzero(of == label):
                at, score = top(lists, q[a], ids[place], rows[place], own[a], k)
                found.append((own[a], 0, place[at], score))
        return _table(found, left.column("id"), rows)

    return run


def _negatives(width: int, k: int, low: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        x, q, ids, rows, labels, own, of = _sides(left, right, width)
        found, lists = [], Lists(x)
        unlike = {label: labels != label for label in np.unique(of)}
        for a, scores in enumerate(right.column("scores").to_pylist()):
            edges = [(-(-low * s // 100), s) for s in scores]
            for j, (at, score) in enumerate(windowed(lists, q[a], ids, rows, unlike[of[a]], edges, k)):
                found.append((own[a], j, at, score))
        return _table(found, left.column("id"), rows)

    return run


def _search(rows: DataFrame, anchors: DataFrame, blocks: int, turns: int, task) -> DataFrame:
    """``task`` over each pair of a block of rows and a block of anchors."""
    place = lambda n, name: F.pmod(F.xxhash64("row", F.lit(name)), F.lit(n)).cast("int").alias(name)
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        both = left.num_rows and right.num_rows  # a group without rows has no columns either
        return task(left, right) if both else _table([], pa.chunked_array([], type=pa.int64()), np.zeros(0, dtype=np.int64))

    left = rows.select("*", place(blocks, "block")).select("*", every(turns, "turn"))
    # named anew: the two sides of a cogroup mustn't share columns
    right = anchors.select(*[F.col(c).alias(c) for c in anchors.columns], place(turns, "turn")).select("*", every(blocks, "block"))
    return left.groupBy("block", "turn").cogroup(right.groupBy("block", "turn")).applyInArrow(run, _FOUND)


def usable(rows: DataFrame, id_column: str, vector: str, label: str, anchor: Column, scale: int) -> DataFrame:
    """row, id, label, anchor and vector (integers) of the rows that take part."""
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False)))
    whole = F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    kept = rows.filter(F.col(label).isNotNull() & F.col(vector).isNotNull() & finite)
    return kept.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), whole.alias("vector"))


def hard_negatives(rows: DataFrame, anchor: Column, id_column: str = "vec_id", vector: str = "embedding", label: str = "label", positives: int = 5, negatives: int = 5, low: int = 80, scale: int = 256, row_cells: int = ROW_CELLS, anchor_cells: int = ANCHOR_CELLS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of the rows for which ``anchor`` holds."""
    # written, so that row numbers stay the same when a task is run again
    rows = written(usable(rows, id_column, vector, label, anchor, scale))
    n, n_anchors, width = rows.agg(F.count("*"), F.count_if("anchor"), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    width = max(width, 1)
    most = min(isqrt((1 << 62) // width), (1 << 31) - 1)
    rows = rows.withColumn("vector", F.transform("vector", lambda x: F.greatest(F.least(x, F.lit(most).cast("long")), F.lit(-most).cast("long")).cast("int")))
    blocks, turns = (max(1, -(-count // max(256, cells // width))) for count, cells in ((n, row_cells), (n_anchors, anchor_cells)))
    anchors, rows = rows.filter("anchor").drop("anchor"), rows.drop("anchor")
    best = lambda *by: Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    same = _search(rows, anchors, blocks, turns, _positives(width, positives)).withColumn("nth", F.row_number().over(best("anchor"))).filter(F.col("nth") <= positives)
    chosen = written(same.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("nth", "id", "score"))).alias("chosen")))
    asked = anchors.join(chosen, anchors["row"] == chosen["anchor"]).select("row", "label", "vector", F.col("chosen.score").alias("scores"))
    found = _search(rows, asked, blocks, turns, _negatives(width, negatives, low)).withColumn("rank", F.row_number().over(best("anchor", "positive"))).filter(F.col("rank") <= negatives)
    named = found.join(chosen, "anchor").join(anchors.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id")), "anchor")
    positive = F.get("chosen", F.col("positive"))
    return named.select("anchor_id", positive["id"].alias("positive_id"), "rank", F.col("id").alias("negative_id"), positive["score"].alias("positive_score"), F.col("score").alias("negative_score"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every embedding whose id is divisible by 100; every seventh label is moved on by one."""
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.select("vec_id", "embedding", moved.alias("label")), F.col("vec_id") % 100 == 0)


OP13_SQL = r"""
WITH usable AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, a.label AS anchor_label, b.vec_id, b.label, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM usable a JOIN usable b ON a.vec_id <> b.vec_id
  WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, anchor_label, vec_id AS positive_id, score AS positive_score
  FROM scored WHERE label = anchor_label
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.positive_id,
  CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
  s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND s.label <> p.anchor_label
WHERE 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) <= 5
"""
