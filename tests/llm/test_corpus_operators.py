"""Deduplication, decontamination, mixing, token counts and the pipeline against plain Python."""

import hashlib
import random
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rawi.llm import components, decontaminate, near_dedup, registry, source_mix, substring_dedup, token_counts

from .helpers import SCHEMA, WORD, documents, frame, odd_rows, text

SF = "/root/testdata/sf0.001"


def sha(words):
    return hashlib.sha256(" ".join(words).encode()).hexdigest()


def brute_substring(rows, size=50):
    first = defaultdict(list)
    words = [(i, WORD.findall(t or "")) for i, t, *_ in rows]
    for i, w in words:
        for p in range(len(w) - size + 1):
            if i is not None:
                first[tuple(w[p : p + size])].append(i)
    low = {k: min(v) for k, v in first.items()}
    out = Counter()
    for i, w in words:
        gone = set()
        for p in range(len(w) - size + 1):
            if i is not None and low[tuple(w[p : p + size])] < i:
                gone.update(range(p, p + size))
        out[i, len(w), len(gone), sha([x for k, x in enumerate(w) if k not in gone])] += 1
    return out


def test_substring_dedup(spark):
    rows = documents(60)
    a = WORD.findall(rows[0][1])
    rng = random.Random(9)
    base = WORD.findall(text(rng, words=140))
    rows += [(200 + k, " ".join([f"q{k}"] * k + base[k : k + 49 + k] + ["end"]), "en", "s", 0) for k in range(0, 60, 7)] + [(300, " ".join(a + a + a), "en", "s", 0)]
    rows += odd_rows()
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.repeated_spans(frame(spark, rows, clashing=True)).collect())
    assert got == brute_substring(rows)
    assert sum(n for (_, _, gone, _), n in got.items() if gone) > 5
    with pytest.raises(ValueError):
        substring_dedup.repeated_spans(frame(spark, rows), min_words=40)


def test_substring_dedup_empty(spark):
    assert substring_dedup.repeated_spans(frame(spark, odd_rows()).limit(0)).count() == 0


def bag(t, k=5):
    w = WORD.findall(t or "")
    return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else Counter([tuple(w)] if w else [])


def brute_classes(rows, least=0.8):
    ids = [(i, bag(t)) for i, t, *_ in rows if i is not None]
    top = {i: i for i, _ in ids}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for n, (i, a) in enumerate(ids):
        for j, b in ids[:n]:
            both = sum((a & b).values())
            if i != j and both and both >= least * (sum(a.values()) + sum(b.values()) - both):
                x, y = sorted((root(i), root(j)))
                top[y] = x
    return Counter((i, root(i)) for i, _ in ids)


def test_near_dedup(spark):
    rows = documents(60) + odd_rows()
    rng = random.Random(4)
    base = text(rng, words=120).split()
    for k in range(40):  # a group whose members are not all near its smallest
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        rows.append((500 + k, " ".join(w), "en", "s", 0))
    got = Counter((r.doc_id, r.class_id) for r in near_dedup.near_classes(frame(spark, rows, clashing=True)).collect())
    nulls = sum(1 for i, *_ in rows if i is None)
    assert got.pop((None, None)) == nulls
    # an id that occurs with several texts has one row per text
    single = {i for i, n in Counter(i for i, *_ in rows).items() if n == 1 and i is not None}
    want = brute_classes([r for r in rows if r[0] in single])
    only = Counter((r.doc_id, r.class_id) for r in near_dedup.near_classes(frame(spark, [r for r in rows if r[0] in single])).collect())
    assert only == want
    assert sum(got.values()) == len(rows) - nulls


def test_near_dedup_keeps_one(spark):
    rows = documents(30)
    kept = near_dedup.one_of_each(frame(spark, rows, clashing=True))
    assert {r.doc_id for r in kept.collect()} == {c for _, c in brute_classes(rows)}
    assert near_dedup.near_classes(frame(spark, rows).limit(0)).count() == 0


def test_near_dedup_of_repeated_ids(spark):
    rng = random.Random(12)
    a, b, c, u = (text(rng, words=60) for _ in range(4))
    rows = [(1, a), (1, a), (1, b), (2, b), (0, c), (2, c), (2, u), (3, a + " more"), (None, a), (None, a), (4, " "), (4, " "), (5, "\n")]
    kept = near_dedup.one_of_each(frame(spark, [(i, t, "en", "s", 0) for i, t in rows], clashing=True))
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([(1, a), (1, b), (0, c), (2, u), (None, a), (None, a), (4, " "), (5, "\n")])


def test_near_dedup_boxes_bounded_by_bytes(spark, monkeypatch):
    rows, rng = [], random.Random(4)
    base = text(rng, words=120).split()
    for k in range(40):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        rows.append((k, " ".join(w), "en", "s", 0))
    monkeypatch.setattr(near_dedup, "BLOCK_BYTES", 3000)
    assert Counter((r.doc_id, r.class_id) for r in near_dedup.near_classes(frame(spark, rows)).collect()) == brute_classes(rows)


def test_bag_signatures_are_unbiased():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 2**63, 300).astype(np.uint64)
    a, b = rng.integers(1, 20, 300), rng.integers(1, 20, 300)
    b[:60] = a[:60]
    s = near_dedup.bag_signatures([(h, a), (h[20:], b[20:]), (h[:0], a[:0])], 8000)
    true = near_dedup.similarity_of((np.sort(h), a[np.argsort(h)]), (np.sort(h[20:]), b[20:][np.argsort(h[20:])]))
    assert abs((s[0] == s[1]).mean() - true) < 0.025
    assert not s[2].any()


def test_components(spark):
    links = [(i, i + 1) for i in range(20)] + [(30, 31), (31, 32), (40, 40)]
    got = {r.v: r.label for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(21)}, 30: 30, 31: 30, 32: 30}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def item_words(t):
    import re

    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))


def brute_hits(rows, items, size=10):
    units = {(str(i) if i is not None else None, tuple(w[p : p + min(size, len(w))])) for i, t in items for w in [item_words(t)] for p in range(len(w) - min(size, len(w)) + 1) if w}
    out = Counter()
    for i, t, *_ in rows:
        w, hit, found = item_words(t), set(), set()
        for n in {len(u) for _, u in units}:
            for p in range(len(w) - n + 1):
                for name, u in units:
                    if len(u) == n and tuple(w[p : p + n]) == u:
                        hit.update(range(p, p + n))
                        found.add(name)
        out[i, len(w), len(hit), ",".join(sorted(x for x in found if x is not None))] += 1
    return out


def bench_items(rows):
    w = WORD.findall(rows[1][1] + " " + rows[2][1])
    return [(7, " ".join(w[3:25]).upper()), (10, " ".join(w[5:17])), (2, "Short item"), (3, None), (4, ""), (None, " ".join(w[20:32])), (7, " ".join(w[3:25]))]


def test_decontaminate_exact(spark):
    rows = documents(40) + [(100, "a short ITEM here, short item", "en", "s", 0), (101, "Short", "en", "s", 0), (102, "É short-item", "en", "s", 0)] + [r for r in odd_rows() if r[0] != 5]
    items = bench_items(rows)
    docs, bench = frame(spark, rows, clashing=True), spark.createDataFrame(items, "item_id long, text string").withColumn("row", F.lit(1))
    for block in (10**9, 150):
        got = decontaminate.benchmark_hits(docs, bench, threshold=1.0, window=10, block_chars=block).collect()
        assert Counter((r.doc_id, r.n_words, r.n_hit, ",".join(r["items"])) for r in got) == brute_hits(rows, items)
        assert all(sum(s.end - s.start for s in r.spans) == r.n_hit for r in got)
    assert decontaminate.benchmark_hits(docs.limit(0), bench).count() == 0
    assert decontaminate.benchmark_hits(docs, bench.limit(0)).filter("n_hit > 0").count() == 0


def contained(w, item, k=5):
    k = min(k, len(item))
    need = {tuple(item[p : p + k]) for p in range(len(item) - k + 1)}
    best = 0
    for s in range(max(1, len(w) - len(item) + 1)):
        part = w[s : s + len(item)]
        best = max(best, len(need & {tuple(part[p : p + k]) for p in range(len(part) - k + 1)}))
    return best / len(need)


def test_decontaminate_partial(spark):
    rng = random.Random(8)
    items = [(i, text(rng, words=60).replace("\n", " ")) for i in range(4)]
    rows = documents(20)
    for n in range(60):
        w = item_words(items[n % 4][1])
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = f"z{n}"
        rows.append((100 + n, " ".join(item_words(text(rng, words=20)) + w + item_words(text(rng, words=20))), "en", "s", 0))
    want = {i for i, t, *_ in rows if any(contained(item_words(t), item_words(x)) >= 0.8 for _, x in items)}
    docs, bench = frame(spark, rows, clashing=True), spark.createDataFrame(items, "item_id long, text string")
    assert {r.doc_id for r in decontaminate.benchmark_hits(docs, bench).filter("n_hit > 0").collect()} == want and 5 < len(want) < 60
    for block in (10**9, 400):
        clean = decontaminate.without_benchmark(docs, bench, block_chars=block)
        assert {r.doc_id for r in clean.collect()} == {r[0] for r in rows} - want and clean.columns == docs.columns


def filled(sizes, cycle=(3, 1, 2), budget=1.5):
    """Water filling by repeated resharing."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: cycle[i % len(cycle)] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), budget * sum(sizes.values())
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if weight[s] * left / total > 2 * sizes[s]]
        if not full:
            return target | {s: weight[s] * left / total for s in open_}
        for s in full:
            target[s] = 2.0 * sizes[s]
            open_.discard(s)
        left = budget * sum(sizes.values()) - sum(target.values())
    return target


def test_source_mix(spark):
    rng = random.Random(1)
    rows = [(100 + i, " ".join(["w"] * rng.randint(0, 60)), "en", rng.choice(["b", "b", "b", "a", "Z", None, "é", ""]), 0) for i in range(800)] + odd_rows()
    docs = frame(spark, rows, clashing=True)
    weights = spark.createDataFrame([(i, 2.0) for i in range(0, 800, 3)] + [(5, 1.0)], "doc_id long, weight double")
    got = source_mix.mix_sources(docs, weights).collect()
    size = Counter()
    for _, t, _, s, _ in rows:
        size[s] += len(WORD.findall(t or ""))
    want = filled(size)
    assert len(got) == len(rows)
    source = {i: s for i, _, _, s, _ in rows}
    taken = Counter()
    for r in got:
        s = source[r.doc_id]
        if r.doc_id is not None and r.doc_id >= 100:
            assert r.source_size == size[s] and r.target == pytest.approx(want[s])
        assert r.taken <= 2 * r.size and r.taken == r.copies * r.size
        taken[s] += r.taken
    for s in ("b", "é"):
        assert abs(taken[s] - want[s]) <= 61
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, source_mix.mix_sources(docs, weights).collect()), key=repr)
    assert source_mix.mix_sources(docs.limit(0)).count() == 0
    plan = source_mix.mix_sources(docs, weights)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    kept = source_mix.mixed(frame(spark, rows[:200], clashing=True), weights)
    assert {"copies", "taken"} <= set(kept.columns) and kept.filter("copies < 1").count() == 0


def test_mixed_keeps_null_and_repeated_ids(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, 1, 2, 3, *range(10, 60)]), " ".join(["w"] * rng.randint(1, 60)), "en", rng.choice("abc"), i) for i in range(300)]
    docs = frame(spark, rows, clashing=True)
    got = source_mix.mixed(docs).collect()
    assert Counter((r.doc_id, len(r.text.split()), r.taken) for r in got) == Counter((r.doc_id, r.size, r.taken) for r in source_mix.mix_sources(docs).collect() if r.copies)
    assert all(r.taken == r.copies * len(r.text.split()) for r in got)
    assert len({r.n_chars for r in got}) == len(got) and any(r.doc_id is None for r in got)
    again = source_mix.mixed(docs.repartition(7)).collect()
    key = lambda r: (r.doc_id, r.text, r.source, r.taken)
    assert Counter(map(key, again)) == Counter(map(key, got))


def test_stages_keep_clashing_columns(spark, tmp_path):
    """Columns that are named as those that stages use inside stay, with their values."""
    rows = [(i % 40 if i % 9 else None, t, lang, s, n) for i, t, lang, s, n in documents(80)] + odd_rows()
    inside = ["_h", "_g", "_tid", "_id", "_label", "_row", "copies", "taken", "copies_", "name", "tie"]
    df = frame(spark, rows).withColumns({c: F.lit(f"own {c}") for c in inside})
    spark.createDataFrame([(1, "zz " * 40)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = df
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        names = {"copies": "copies__", "taken": "taken_"} if name == "mix" else {}
        assert sorted(docs.columns) == sorted([*(names.get(c, c) for c in df.columns), *names]), name
        got = docs.collect()
        assert got and all(r[names.get(c, c)] == f"own {c}" for r in got for c in inside), name
    assert all(isinstance(r.copies, int) and r.taken >= 0 for r in got)


def test_null_ids_do_not_share_a_key(spark):
    rows = [(None, f"w{i} " * 5, "en", "a", 0) for i in range(400)] + [(i, "x " * 5, "en", "a", 0) for i in range(400)]
    got = source_mix.mix_sources(frame(spark, rows), budget=0.5).filter("doc_id IS NULL").agg(F.sum("taken")).first()[0]
    assert 700 <= got <= 1300


def test_token_counts(spark):
    tiktoken = pytest.importorskip("tiktoken")
    if not Path(token_counts.TOKENIZERS).exists():
        pytest.skip("no vocabularies")
    ranks = token_counts.load_ranks()
    rows = documents(30) + odd_rows() + [(700, "a <|endoftext|> b", "en", "s", 0)]
    docs = frame(spark, rows, clashing=True).repartition(3, "doc_id")
    own = tiktoken.Encoding("test", pat_str=token_counts.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter((i, len(own.encode_ordinary(t)) if t else 0) for i, t, *_ in rows)
    for size in (64, 1 << 16):
        blocks, order = token_counts.token_files(docs, ranks, block_tokens=size)
        got = token_counts.count_tokens(blocks).join(order, ["file", "ordinal"]).collect()
        assert Counter((r.doc_id, r.n_tokens) for r in got) == want and all(r.closed for r in got)
    blocks, order = token_counts.token_files(docs.limit(0), ranks)
    assert token_counts.count_tokens(blocks).count() == 0 and order.count() == 0


def test_raw_token_files(spark, tmp_path):
    tokens = np.array([1, 2, 9, 9, 3, 4, 5, 6, 7, 9, 8], dtype="<u2")
    tokens.tofile(tmp_path / "a.bin")
    np.array([9], dtype="<u2").tofile(tmp_path / "b.bin")
    for size in (2, 3, 100):
        got = token_counts.count_tokens(token_counts.read_token_files(spark, str(tmp_path), block_tokens=size), separator=9).collect()
        a = sorted((r.ordinal, r.n_tokens, r.closed) for r in got if r.file.endswith("a.bin"))
        assert a == [(0, 2, True), (1, 0, True), (2, 5, True), (3, 1, False)]
        assert [(r.ordinal, r.n_tokens) for r in got if r.file.endswith("b.bin")] == [(0, 0)]


def test_pipeline(spark, tmp_path):
    rows = documents(80)
    items = [(i, text(random.Random(50 + i), words=40)) for i in range(3)]
    rows += [(300, text(random.Random(77), words=30) + "\n" + items[0][1], "en", "s1", 0), (301, "123 456", "en", "s1", 7), (302, None, "en", "s2", None)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(0, 80, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    told = [r for r in rows if r[0] not in (301, 302)]
    classes = dict(brute_classes(told).keys())
    single = [r for r in told if classes[r[0]] == r[0]]
    clean = [r for r in single if not any(contained(item_words(r[1]), item_words(x)) >= 0.8 for _, x in items)]
    assert len(told) > len(single) > len(clean)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        path = f"{tmp_path}/{len(seen)}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        seen.append({r.doc_id for r in docs.collect()})
        if len(seen) < len(corpus_pipeline.STAGES):
            assert docs.columns == [f.split()[0] for f in SCHEMA.split(", ")]
    assert seen[0] == {r[0] for r in told} and seen[1] == {r[0] for r in single} and seen[2] == seen[3] == {r[0] for r in clean}
    masked = spark.read.parquet(f"{tmp_path}/3").collect()
    assert not any("token = \"" in r.text for r in masked) and any("[SECRET]" in r.text for r in masked)
    takes = docs.collect()
    size = Counter()
    for r in masked:
        size[r.source] += len(WORD.findall(r.text))
    want, took = filled(size), Counter()
    for r in takes:
        took[r.source] += r.taken
    assert all(abs(took[s] - want[s]) <= 300 for s in size)
    again = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in takes)


@pytest.mark.skipif(not Path(SF).exists(), reason="no tables")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want, got = con.sql(registry.oracle_sql()[name]).df(), registry.queries()[name](spark, SF).toPandas()
    rows = lambda f: sorted(repr(r) for r in f[sorted(f.columns)].itertuples(index=False, name=None))
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)
