"""Properties of the batch helpers on random texts."""

import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rawi.llm import near_dedup, quality_rules, secrets_scan
from rawi.llm.wordstream import ALNUM, PLAIN, Shelf, Words, text_bytes, window_hashes

from .test_text_operators import PATTERNS, brute_counts

TEXT = st.text(alphabet=st.sampled_from(list("ab é\n\t#%zZ9. \U0001f600")), max_size=80)
LEAKY = st.lists(st.sampled_from(["password", "Token", "=", ":", " ", '"', "abcdef", "0123456789abcdef", "AKIA", "ABCD1234", "é", "x.y/z", "\n"]), max_size=14).map("".join)


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXT, max_size=6))
def test_words_are_those_of_the_pattern(texts):
    for table, pattern, change in ((PLAIN, r"[^\x20\x09-\x0D]+", str), (ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lambda t: t.translate({c: c + 32 for c in range(65, 91)}))):
        w = Words([change(t).encode() for t in texts], table)
        want = [x for t in texts for x in re.findall(pattern, change(t))]
        assert [w.word(i).decode() for i in range(len(w.starts))] == want
        assert w.counts.tolist() == [len(re.findall(pattern, change(t))) for t in texts]
        same = {}
        for word, h in zip(want, w.hash.tolist(), strict=True):
            assert same.setdefault(word, h) == h
        assert len(set(same.values())) == len(same)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40), st.integers(1, 9))
def test_equal_windows_have_equal_hashes(values, k):
    h = np.array(values, dtype=np.uint64)
    g = window_hashes(h, k)
    seen = {}
    for i in range(len(values) - k + 1):
        assert seen.setdefault(tuple(values[i : i + k]), g[i]) == g[i]
    assert len(set(seen.values())) == len(seen) and len(g) == max(0, len(values) - k + 1)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=30), st.lists(st.integers(0, 50), max_size=30))
def test_shelf_and_similarity(a, b):
    x, y = np.array(a, dtype=np.uint64), np.array(b, dtype=np.uint64)
    at, key = Shelf(x).find(y)
    assert at.tolist() == [i for i, v in enumerate(b) if v in set(a)] and (Shelf(x).keys[key] == y[at]).all()
    p, q = Counter(a), Counter(b)
    both = sum((p & q).values())
    want = both / (len(a) + len(b) - both) if a or b else 0.0
    assert near_dedup.similarity_of(np.unique(x, return_counts=True), np.unique(y, return_counts=True)) == want


@settings(max_examples=200, deadline=None)
@given(TEXT)
def test_counts(text):
    assert quality_rules.text_counts(text.encode()) == brute_counts(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(LEAKY, min_size=1, max_size=4))
def test_base_spans(texts):
    found = secrets_scan.spans_of(text_bytes(texts), secrets_scan.default_formats(), 0.5, 20)
    for t, spans in zip(texts, found, strict=True):
        want = sorted((m.start(), i, m.end()) for i, (_, p, ok) in enumerate(PATTERNS) for m in p.finditer(t) if ok(m))
        assert [s for s in spans if s[1] < 3] == want


def test_trigrams_of_a_context_stand_together():
    import pyarrow as pa

    from rawi.llm.toxicity import _trigrams

    words = [f"w{'abcdefgh'[i % 8]}{'ijklmno'[i % 7]}" for i in range(56)]
    texts = [" ".join(words[(i * k + k * k) % 56] for i in range(40)) for k in range(1, 60)]
    batch = pa.RecordBatch.from_pydict({"text": texts, "toxic": [k % 2 for k in range(59)]})
    rows = [(r["v"] % (1 << 64), r["w"] % (1 << 64), r["mark"] % (1 << 64)) for b in _trigrams([batch]) for r in b.to_pylist()]
    assert len(rows) > 500 and rows == sorted(set(rows))


def test_workers_give_memory_back():
    import gc
    import re
    from pathlib import Path

    import numpy as np

    from rawi.llm.common import tidied

    size = lambda: int(re.search(r"VmRSS:\s+(\d+)", Path("/proc/self/status").read_text())[1]) / 1024
    peak, kept = [], []

    def run(batches):
        held = [np.ones(1 << 13) for _ in range(4_000)]  # 250 MB of small arrays
        kept.append(held[-1])
        peak.append(size())
        yield from batches

    before = size()
    assert list(tidied(run)([1, 2])) == [1, 2]
    gc.collect()
    assert peak[0] - before > 150 and size() - before < 100


def test_batches_for_workers_are_bounded_in_bytes(spark):
    from rawi.llm.common import BATCH_BYTES, map_batches

    rows = spark.range(0, 4_000, 1, 1).select(F.col("id"), F.repeat(F.lit("x"), 4_000).alias("text"))
    sizes = map_batches(rows, lambda batch: [{"n": [batch.num_rows], "bytes": [batch.nbytes]}], "n long, bytes long").collect()
    assert sum(r.n for r in sizes) == 4_000 and len(sizes) > 3
    assert max(r.bytes for r in sizes) < BATCH_BYTES + 10_000
