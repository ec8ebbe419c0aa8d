"""Line dedup, periodic runs and hard negatives against plain Python."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from math import floor, inf, isfinite, nan
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rawi.llm import hard_negatives, line_dedup, periodic_runs

from .helpers import WORD, documents, frame, odd_rows

SF = "/root/testdata/sf0.001"
BLANKS = " \t\n\x0b\f\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_lines(rows, min_docs, keep_first=False):
    """(doc_id, n_lines, n_dropped, kept) of each row."""
    keyed = [(i, (t or ""), [(line, line.strip(BLANKS).translate(LOWER)) for line in (t or "").split("\n")]) for i, t, *_ in rows]
    holders, first = defaultdict(set), {}
    for i, t, lines in keyed:
        for p, (_, k) in enumerate(lines):
            holders[k].add(("text", t) if i is None else i)
            place = (i is not None, i or 0, p)
            first[k] = min(first.get(k, place), place)
    out = Counter()
    for i, _, lines in keyed:
        kept = [line for p, (line, k) in enumerate(lines) if not k or len(holders[k]) < min_docs or keep_first and first[k] == (i is not None, i or 0, p)]
        out[i, len(lines), len(lines) - len(kept), "\n".join(kept)] += 1
    return out


def line_rows():
    rng = random.Random(4)
    pool = ["Read more", " read MORE\t", "É une", "é une", "ÉTÉ A", "Été a", "É a", "É A", "", "  ", "x", "X\x0b", "Kelvin K", "kelvin k", " x", "\U0001f600 Q"]
    rows = [(i, "\n".join(rng.choice(pool + [f"own {i} {k}" for k in range(9)]) for _ in range(rng.choice([1, 3, 70, 200]))), "en", "s", 0) for i in range(40)]
    return rows + odd_rows() + [(None, "x\nx\ny", None, None, 0)] * 3 + [(None, "x", None, None, 0), (3, "x\nother", "en", "s", 0), (50, "\n\n", "en", "s", 0), (51, "x\r\ny\r", "en", "s", 0)]


@pytest.mark.parametrize("most", [line_dedup.BROADCAST_KEYS, 2])
@pytest.mark.parametrize("min_docs", [2, 10])
def test_common_lines(spark, min_docs, most):
    rows = line_rows()
    got = line_dedup.kept_lines(frame(spark, rows, clashing=True), min_docs=min_docs, broadcast_keys=most)
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in got.collect()) == brute_lines(rows, min_docs)


def test_first_lines_stay(spark):
    rows = [r for r in line_rows() if r[0] is not None and r[0] not in (3, 6)]
    got = line_dedup.kept_lines(frame(spark, rows), min_docs=2, keep_first=True)
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in got.collect()) == brute_lines(rows, 2, keep_first=True)


def test_bitmaps_name_the_lines_that_stay(spark):
    rows = line_rows()
    bits = line_dedup.keep_bitmaps(frame(spark, rows), min_docs=2).filter("doc_id >= 10 AND doc_id < 40").collect()
    texts = {i: t.split("\n") for i, t, *_ in rows if i is not None and 10 <= i < 40}
    want = {r[0]: r[3] for r in brute_lines(rows, 2)}
    assert sum(r.keep is not None for r in bits) > 5
    for r in bits:
        words = {w.word: w.bits for w in r.keep or []}
        assert all(b != -1 for b in words.values())
        assert "\n".join(x for p, x in enumerate(texts[r.doc_id]) if words.get(p // 64, -1) >> p % 64 & 1) == want[r.doc_id]


def test_lines_keep_columns(spark):
    rows = line_rows()
    df = frame(spark, rows, clashing=True).withColumns({c: F.lit("clash") for c in ("whole", "body", "doc", "row_a", "row_b", "keep", "lost", "first", "pos", "n_docs", "key_a")})
    out = line_dedup.without_common_lines(df, min_docs=2)
    assert out.columns == df.columns
    assert all(r.whole == r.keep == r.row_a == r.tid == "clash" for r in out.collect())
    want = Counter((i, k) for (i, _, _, k), n in brute_lines(rows, 2).items() for _ in range(n))
    assert Counter((r.doc_id, r.text or "") for r in out.collect()) == want
    assert out.filter("text IS NULL").count() == 1
    assert line_dedup.kept_lines(df.limit(0)).count() == 0


def test_line_keys_are_native_and_ranges_are_cut_by_document(spark):
    plan = line_dedup.kept_lines(frame(spark, documents(20)), min_docs=2)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    lines = line_dedup._lines(frame(spark, documents(20)), 1)
    counted = lines.repartitionByRange(3, *line_dedup._KEY, *line_dedup._DOC)
    assert counted.rdd.getNumPartitions() == 3
    hot = spark.range(4000).selectExpr("id AS doc_id", "concat('Licence line\\n', IF(id % 2 = 0, 'a', concat('own ', id))) AS text")
    got = line_dedup.kept_lines(hot).groupBy("n_dropped").count().collect()
    assert {r.n_dropped: r["count"] for r in got} == {1: 2000, 2: 2000}


def brute_runs(w, min_words=6, min_repeats=4):
    found = {}
    for q in range(1, len(w) // min_repeats + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(min_words, min_repeats * q):
                found.setdefault((i, j + q - i), q)
            i = j
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=7), st.integers(1, 9), st.integers(0, 6)), max_size=8))
def test_runs_of_repeated_blocks(blocks):
    words = [b"%d" % k for block, times, more in blocks for k in block * times + block[:more]]
    assert periodic_runs.periodic_runs(words) == brute_runs(words)


@settings(max_examples=100, deadline=None)
@given(st.text("ab", max_size=200))
def test_runs_of_two_words(text):
    words = [c.encode() for c in text]
    assert periodic_runs.periodic_runs(words) == brute_runs(words)
    assert periodic_runs.periodic_runs(words, 12, 5) == brute_runs(words, 12, 5)


def test_probes_in_parts(monkeypatch):
    monkeypatch.setattr(periodic_runs, "PROBES", 7)
    rng = random.Random(1)
    for _ in range(30):
        words = [b"%d" % rng.randrange(2) for _ in range(60)] + [b"q", b"r", b"s"] * rng.randint(1, 9) + [b"%d" % rng.randrange(3) for _ in range(20)]
        assert periodic_runs.periodic_runs(words) == brute_runs(words)


def test_splitting_leaves_runs_only():
    noise = [b"n%d" % k for k in range(500)]
    run = [b"a", b"b", b"c"] * 5
    parts = list(periodic_runs.segments(noise[:200] + run + [b"x", b"a"] * 3 + noise[200:], 6, 4))
    assert [(s, len(p)) for s, p in parts] == [(200, 15)]


def brute_planted(i, text):
    words = WORD.findall(text or "")
    n, h = len(words), zlib.crc32(str(i).encode()) if i is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]


def brute_op12(i, text):
    words = brute_planted(i, text)
    runs = brute_runs(words)
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None,) * 3
    return (i, len(runs), *best, 1000 * best[1] // best[2] if runs else None, digest("".join("%d,%d,%d\n" % r for r in runs)), digest(" ".join(w for k, w in enumerate(words) if k not in gone)))


@pytest.mark.skipif(not Path(SF).exists(), reason="no tables")
def test_op12_by_hand(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {tuple(r) for r in periodic_runs.op12_periodic_runs(spark, SF).collect()}
    assert got == {brute_op12(i, t) for i, t in docs if len(WORD.findall(t or "")) < 4000} | {r for r in got if len(WORD.findall(dict(map(tuple, docs))[r[0]] or "")) >= 4000}
    assert sum(r[1] > 0 for r in got) > 5


def test_runs_on_odd_rows(spark):
    rows = [r for r in odd_rows() if r[0] != 5] + [(20, "a " * 50, "en", "s", 0), (20, "a " * 50, "en", "s", 0), (21, "A a A a  a " * 9, "en", "s", 0), (None, "\U0001f600 é " * 6, None, None, 0)]
    got = periodic_runs.find_runs(frame(spark, rows, clashing=True)).collect()
    want = Counter()
    for i, t, *_ in rows:
        words = WORD.findall(t or "")
        runs = brute_runs(words)
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        want[i, len(words), tuple(runs), " ".join(w for k, w in enumerate(words) if k not in gone)] += 1
    assert Counter((r.doc_id, r.n_words, tuple(map(tuple, r.runs)), r.collapsed) for r in got) == want
    assert periodic_runs.find_runs(frame(spark, rows).limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.find_runs(frame(spark, rows), min_repeats=3)


def brute_negatives(rows, every=3, positives=5, negatives=5):
    """(anchor, positive, rank, negative, positive score, negative score), each row known by its place."""
    kept = [(k, i, lab, [floor(256 * float(np.float32(x))) for x in v]) for k, (i, v, lab) in enumerate(rows) if lab is not None and v is not None and all(x is not None and isfinite(x) for x in v)]
    score = lambda a, b: sum(x * y for x, y in zip(a[3], b[3], strict=False))
    name = lambda r: (r[1] is None, r[1] or 0)
    out = []
    for a in kept:
        if a[1] is None or a[1] % every:
            continue
        ordered = sorted(((-score(a, b), *name(b), b) for b in kept if b[0] != a[0]), key=lambda x: x[:3])
        for p in [x for x in ordered if x[3][2] == a[2]][:positives]:
            inside = [x for x in ordered if x[3][2] != a[2] and 80 * p[0] >= 100 * x[0] >= 100 * p[0]]
            out += [(a[1], p[3][1], rank, x[3][1], -p[0], -x[0]) for rank, x in enumerate(inside[:negatives], 1)]
    return Counter(out)


VECTORS = "vec_id long, embedding array<float>, label int, score string, row string, id string, anchor string, vector string, rank string"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, *["clash"] * 6) for r in rows], VECTORS)


@pytest.mark.parametrize("cells", [None, 1])
def test_negatives_by_hand(spark, cells, monkeypatch):
    rng = random.Random(6)
    centre = [[rng.gauss(0, 0.3) for _ in range(6)] for _ in range(5)]
    rows = [(i, [c + rng.gauss(0, 0.1) for c in rng.choice(centre)], rng.randrange(4)) for i in range(700)]
    rows += [(700 + i, rows[3][1], i % 3) for i in range(90)]
    size = {} if cells is None else {"row_cells": cells, "anchor_cells": cells}
    got = hard_negatives.hard_negatives(vectors(spark, rows), F.col("vec_id") % 30 == 0, **size).collect()
    assert Counter(map(tuple, got)) == brute_negatives(rows, every=30)
    assert len(got) > 300


def test_negatives_on_odd_rows(spark):
    nulls = [(None, [1.0, 0.5], 1), (None, [1.0, 0.5], 2), (3, None, 1), (3, [1.0, nan], 1), (6, [inf, 1.0], 1), (6, [None, 1.0], 1), (9, [1.0, 1.0], None)]
    same = [(12, [1.0, 1.0], 1), (12, [1.0, 1.0], 1), (15, [1.0, 1.0], 1), (16, [0.9, 1.0], 2), (17, [0.9, 1.0], 2), (18, [0.9, 1.0], 2)]
    short = [(21, [], 1), (24, [0.5], 1), (25, [0.5], 2), (27, [0.0, 0.0], 3), (28, [0.0], 3), (30, [-1.0, -1.0], 4), (31, [0.5, 0.5], 4), (33, [0.001] * 5, 5)]
    rows = nulls + same + short
    got = hard_negatives.hard_negatives(vectors(spark, rows), F.col("vec_id") % 3 == 0).collect()
    assert Counter(map(tuple, got)) == brute_negatives(rows)
    assert hard_negatives.hard_negatives(vectors(spark, rows), F.col("vec_id") < 0).count() == 0
    assert hard_negatives.hard_negatives(vectors(spark, rows).limit(0), F.col("vec_id") % 3 == 0).count() == 0


def test_long_vectors_are_held_within_a_long(spark):
    rows = [(0, [3e38, 1.0], 1), (1, [3e38, 2.0], 1), (2, [3e38, 1.0], 2), (3, [2.0**20, 0.5], 2)]
    got = hard_negatives.hard_negatives(vectors(spark, rows), F.col("vec_id") == 0).collect()
    assert [(r.positive_id, r.negative_id) for r in got] == [(1, 2)]
    assert got[0].positive_score > 1 << 60


def test_search_ends_before_all_rows_are_met():
    rng = np.random.default_rng(2)
    x = (rng.random((5000, 3)) ** 9 * 1000).astype(np.int64)
    lists = hard_negatives.Lists(x)
    q = np.array([5, 0, 3])
    met = 0
    for new, _, rest in lists.walk(q):
        met += len(new)
        if np.sort(x @ q)[-5] > rest:
            break
    assert met < 1000
    at, score = hard_negatives.top(lists, q, np.arange(5000), np.arange(5000), -1, 5)
    assert score.tolist() == sorted((x @ q).tolist(), reverse=True)[:5]
