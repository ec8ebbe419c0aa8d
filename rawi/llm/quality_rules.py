"""Quality rules and robust multivariate outliers per language and source.

Method.  Base rules on counts reject short and repetitive texts.  The others are
described by four transformed statistics (word length, symbols, repeated lines,
repeated three-word windows).  For each (language, source), each language and all
documents together the minimum covariance determinant estimate is sought by
concentration steps over all documents: from a median/MAD start and a classical
start, the half of the documents ((n + p + 1) / 2, and those in the distance bin
of the last one) with the smallest Mahalanobis distances gives the next mean and
covariance, until the determinant stops falling, and the start with the smaller
determinant wins.  The covariance is scaled for consistency, and ``FLOORS``
squared are added to its variances.  A language's estimate then takes in that of
all documents with the weight of ``prior`` documents, and a (language, source)
that of its language likewise, so that an estimate from few documents leans on
the wider one and there is no size at which the rule changes.  A document is
rejected when its squared distance in its (language, source) exceeds ``cut`` (the
chi-square quantile with 4 degrees of freedom at 1 - 3e-7).

Scale.  Every step is a scan of the small statistics table with partial sums per
group and distance bin: the bins of a group are added up to the wanted share, so
nothing is sorted and a group of any size meets in a few hundred rows.  Estimates
are broadcast up to ``BROADCAST_GROUPS`` of them, counted first, else joined.

Results on odd input.  Null and empty texts have zero counts and fail the base
rules.  Null language or source is a value of its own.  Repeated rows count as
often as they occur.  With no document past the base rules nothing is estimated.
Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_batches, size_of, table, union_all, written
from .wordstream import BLANKS, text_bytes

#: Characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
STATS = ("f0", "f1", "f2", "f3")
#: Standard deviations whose squares are added to the variances, in transformed units; the last is below a sixth of its range, ln 51.
FLOORS = (0.05, 0.3, 0.5, 0.6)
#: Chi-square quantile, 4 degrees of freedom, at 1 - 3e-7.
CUT = 36.0
_BINS_PER_OCTAVE = 16
#: Least fall of a log determinant that counts.
_FALL = 1e-6
#: Groups whose estimates are sent to all executors, else joined by shuffle.
BROADCAST_GROUPS = 100_000


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words inside ``width``-word windows that occur twice or more in the text."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    codes = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=len(words))
    key, size = codes[:n], len(number)
    for k in range(1, width):
        if int(key.max()) >= (1 << 62) // size:
            key = np.unique(key, return_inverse=True)[1]
        key = key * size + codes[k : k + n]
    _, group, seen = np.unique(key, return_inverse=True, return_counts=True)
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    at = np.flatnonzero(seen[group] > 1)
    edge[at] += 1
    edge[at + width] -= 1
    return int((np.cumsum(edge)[:-1] > 0).sum())


def text_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.split()
    solid = text.translate(None, BLANKS)
    chars = len(solid) - len(solid.translate(None, bytes(b for b in range(256) if b & 0xC0 != 0x80)))
    lines = [x for x in text.split(b"\n") if x.strip(BLANKS)]
    return len(words), chars, len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def _counted(batch):
    rows = [text_counts(t) for t in text_bytes(batch.column("text").to_pylist())]
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    yield {c: batch.column(c) for c in ("doc_id", "lang", "source")} | dict(zip(names, zip(*rows, strict=True), strict=True))


def statistics(docs: DataFrame) -> DataFrame:
    """Counts, the base verdict and the transformed statistics of each document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"))
    counted = map_batches(docs, _counted, "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long")
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return counted.select(
        "*",
        ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
        F.log(chars / words).alias("f0"),
        F.log1p(1000 * F.col("n_symbols") / chars).alias("f1"),
        F.log1p(F.col("n_dup_lines").cast("double")).alias("f2"),
        F.log1p(100 * F.col("n_repeat_words") / words).alias("f3"),
    )


def _group(level: int) -> Column:
    """Key of a document's group: 0 its language and source, 1 its language, 2 all documents."""
    parts = ["lang", "source"][: 2 - level]
    return F.xxhash64(F.lit(level), *[x for c in parts for x in (F.col(c).isNull(), F.coalesce(c, F.lit("")))])


def _with_shapes(df: DataFrame, shapes: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    few = size_of(shapes, BROADCAST_GROUPS) <= BROADCAST_GROUPS
    return df.join(F.broadcast(shapes) if few else shapes, on, how)


def _sums():
    return [F.sum(c).alias(f"s_{c}") for c in STATS] + [F.sum(F.col(a) * F.col(b)).alias(f"s_{a}_{b}") for i, a in enumerate(STATS) for b in STATS[i:]]


_NAMES = [f"s_{c}" for c in STATS] + [f"s_{a}_{b}" for i, a in enumerate(STATS) for b in STATS[i:]]
_SHAPE = "grp long, start int, n long, center array<double>, cov array<double>, inverse array<double>, logdet double, falls boolean"


def _shape(batch):
    """Sums of a group -> center, covariance with ``FLOORS``, its inverse, its log determinant and whether that is below ``least``."""
    p, rows = len(STATS), batch.to_pylist()
    center, covs, inverse, logdet = [], [], [], []
    for r in rows:
        n = max(r["n"], 1)
        mean = np.array([r[f"s_{c}"] for c in STATS]) / n
        cov = np.zeros((p, p))
        for i, a in enumerate(STATS):
            for j in range(i, p):
                cov[i, j] = cov[j, i] = r[f"s_{a}_{STATS[j]}"] / n - mean[i] * mean[j]
        cov = consistency(n / max(r["all"], n)) * cov + np.diag(np.square(FLOORS))
        center.append(mean.tolist())
        covs.append(cov.ravel().tolist())
        inverse.append(np.linalg.inv(cov).ravel().tolist())
        logdet.append(float(np.linalg.slogdet(cov)[1]))
    yield {"grp": batch.column("grp"), "start": batch.column("start"), "n": batch.column("all"), "center": center, "cov": covs, "inverse": inverse, "logdet": logdet, "falls": [d < r["least"] - _FALL for d, r in zip(logdet, rows, strict=True)]}


def _distance():
    gap = [F.col(c) - F.col("center")[i] for i, c in enumerate(STATS)]
    p = len(STATS)
    return sum(gap[i] * gap[j] * F.col("inverse")[i * p + j] for i in range(p) for j in range(p))


def _median_start(good: DataFrame) -> DataFrame:
    """Coordinate-wise median and MAD from histograms of width 1/64."""
    hist = good.select("grp", F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.round(F.col(c) * 64).cast("int").alias("b")) for i, c in enumerate(STATS)])).alias("x"))
    hist = hist.groupBy("grp", "x.c", "x.b").agg(F.count("*").alias("n"))

    def middle(h: DataFrame, name: str) -> DataFrame:
        by = Window.partitionBy("grp", "c")
        h = h.withColumn("upto", F.sum("n").over(by.orderBy("b"))).withColumn("all", F.sum("n").over(by))
        return h.filter(2 * F.col("upto") >= F.col("all")).groupBy("grp", "c").agg(F.min("b").alias(name))

    mid = middle(hist, "mid")
    off = hist.join(mid, ["grp", "c"]).select("grp", "c", F.abs(F.col("b") - F.col("mid")).alias("b"), "n").groupBy("grp", "c", "b").agg(F.sum("n").alias("n"))
    both = mid.join(middle(off, "mad"), ["grp", "c"])
    rows = both.groupBy("grp").agg(*[F.max(F.when(F.col("c") == i, F.col(v))).alias(f"{v}{i}") for i in range(len(STATS)) for v in ("mid", "mad")])
    sd = [F.greatest(1.4826 * F.col(f"mad{i}") / 64, F.lit(FLOORS[i])) for i in range(len(STATS))]
    p = len(STATS)
    return rows.select(
        "grp",
        F.lit(0).alias("start"),
        F.lit(0).cast("long").alias("n"),
        F.array(*[F.col(f"mid{i}") / 64.0 for i in range(p)]).alias("center"),
        F.array(*[sd[i] * sd[i] if i == j else F.lit(0.0) for i in range(p) for j in range(p)]).alias("cov"),
        F.array(*[1 / (sd[i] * sd[i]) if i == j else F.lit(0.0) for i in range(p) for j in range(p)]).alias("inverse"),
        F.lit(float("inf")).alias("logdet"),
        F.lit(True).alias("falls"),
    )


def consistency(share: float, p: int = len(STATS)) -> float:
    """Factor that makes the covariance of the central ``share`` consistent at the normal law (even p)."""

    def upto(q: float, half: int) -> float:  # chi-square distribution, 2 * half degrees of freedom
        return 1 - math.exp(-q / 2) * sum((q / 2) ** k / math.factorial(k) for k in range(half))

    low, high = 0.0, 200.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if upto(mid, p // 2) < share else (low, mid)
    return share / upto(low, p // 2 + 1)


def robust_shapes(good: DataFrame) -> DataFrame:
    """Number of rows, center, covariance and its inverse per ``grp`` of the minimum covariance determinant estimate."""
    never = F.lit(float("inf")).alias("least")
    sums = good.groupBy("grp").agg(F.count("*").alias("n"), *_sums()).withColumn("start", F.lit(1)).withColumn("all", F.col("n")).select("*", never)
    shapes = written(map_batches(sums, _shape, _SHAPE).withColumn("logdet", F.lit(float("inf"))).unionByName(_median_start(good)))
    few = size_of(shapes, BROADCAST_GROUPS) <= BROADCAST_GROUPS
    by = Window.partitionBy("grp", "start")
    steps = [shapes]
    while True:
        d = F.greatest(_distance(), F.lit(1e-6))
        placed = good.select("grp", *STATS).join(F.broadcast(shapes) if few else shapes, "grp").withColumn("bin", F.floor(F.log2(d) * _BINS_PER_OCTAVE).cast("int"))
        bins = placed.groupBy("grp", "start", "bin").agg(F.count("*").alias("n"), F.first("logdet").alias("least"), *_sums())
        bins = bins.withColumn("before", F.coalesce(F.sum("n").over(by.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("all", F.sum("n").over(by))
        half = F.floor((F.col("all") + len(STATS) + 1) / 2)
        kept = bins.filter(F.col("before") < half).groupBy("grp", "start")
        part = kept.agg(F.sum("n").alias("n"), F.first("all").alias("all"), F.first("least").alias("least"), *[F.sum(c).alias(c) for c in _NAMES])
        # only groups whose determinant still falls take another step
        shapes = written(map_batches(part, _shape, _SHAPE)).filter("falls")
        if shapes.isEmpty():
            break
        steps.append(shapes)
    place = F.row_number().over(Window.partitionBy("grp").orderBy("logdet", "start"))
    return union_all(steps).withColumn("place", place).filter("place = 1").select("grp", "n", "center", "cov", "inverse")


def _leaning(prior: float):
    """Shapes of the three levels of a (language, source) in a row -> the center and inverse it is judged by."""

    def fn(batch):
        p = len(STATS)
        center, inverse = [], []
        for r in batch.to_pylist():
            mean, cov = np.array(r["center2"]), np.array(r["cov2"]).reshape(p, p)
            for level in (1, 0):
                own = r[f"n{level}"] / (r[f"n{level}"] + prior)
                mean = own * np.array(r[f"center{level}"]) + (1 - own) * mean
                cov = own * np.array(r[f"cov{level}"]).reshape(p, p) + (1 - own) * cov
            center.append(mean.tolist())
            inverse.append(np.linalg.inv(cov).ravel().tolist())
        yield {"g0": batch.column("g0"), "center": center, "inverse": inverse}

    return fn


def judged_shapes(good: DataFrame, prior: float) -> DataFrame:
    """g0 (a language and source), center and inverse covariance; ``good`` has g0, g1, g2 and the statistics."""
    levels = good.select(F.explode(F.array("g0", "g1", "g2")).alias("grp"), *STATS)
    shapes = written(robust_shapes(levels).drop("inverse"))
    rows = good.select("g0", "g1", "g2").distinct()
    for i in range(3):
        rows = _with_shapes(rows, shapes.withColumnsRenamed({"grp": f"g{i}", "n": f"n{i}", "center": f"center{i}", "cov": f"cov{i}"}), [f"g{i}"])
    return written(map_batches(rows, _leaning(prior), "g0 long, center array<double>, inverse array<double>"))


def judge_quality(docs: DataFrame, cut: float = CUT, prior: float = 20.0) -> DataFrame:
    """Counts, base verdict, squared robust distance (null where the base rules fail) and ``kept`` per document."""
    counts = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    stats = written(statistics(docs).select(*counts, *STATS, *[_group(i).alias(f"g{i}") for i in range(3)]))
    good = stats.filter(~F.col("base_failed"))
    judged = _with_shapes(good, judged_shapes(good, prior), ["g0"]).withColumn("distance", _distance()).select(*counts, "distance", (F.col("distance") <= cut).alias("kept"))
    failed = stats.filter("base_failed").select(*counts, F.lit(None).cast("double").alias("distance"), F.lit(False).alias("kept"))
    return judged.unionByName(failed)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict for every document."""
    return judge_quality(table(spark, sf_dir, "documents"))
