"""The pattern automaton against plain prefix search, and the meters' tables against their SQL."""

import random

import pyarrow as pa
import pytest

from rawi.operators import meters as M
from rawi.plans import meter_sql


def test_walk_finds_every_prefix():
    rng = random.Random(3)
    for _ in range(50):
        named = [(rng.choice("abc"), "".join(rng.choice("01") for _ in range(rng.randint(1, 6)))) for _ in range(rng.randint(1, 30))]
        walk = M.Walk(named)
        texts = ["".join(rng.choice("01") for _ in range(rng.randint(0, 9))) for _ in range(40)] + ["", "x01", "01x11", "2"]
        where, states = walk.prefixes(pa.array(["skip", *texts]).slice(1))
        got = sorted((texts[w], name) for w, s in zip(where.tolist(), states.tolist(), strict=True) for name in walk.names[s])
        assert got == sorted((t, name) for t in texts for name, p in named if t.startswith(p))
        assert len(walk.names) <= 1 + sum(len(p) for _, p in named) + 1


def test_walk_is_least():
    walk = M.Walk([("m", "0" + "1" * 5), ("m", "1" * 6)])
    assert len(walk.names) == 8  # the dead state, and one chain that both patterns share
    assert len(M.half_walk().names) < len({r[3] for r in M.half_rows()})
    assert all(len(x) == 0 for x in M.half_walk().prefixes(pa.array([], pa.string())))


def test_half_counts(spark):
    rows = [r for r in M.half_rows() if r[2] == 0]
    beats = [("1011010" * 3,), ("0",), (None,), ("",), (rows[0][3] + "111",)]
    got = {r.meter: r.n for r in M.half_counts(spark.createDataFrame(beats, "beat string")).collect()}
    want: dict = {}
    for meter, pattern in {(r[0], r[3]) for r in rows}:
        n = sum(b is not None and b.startswith(pattern) for (b,) in beats)
        if n:
            want[meter] = want.get(meter, 0) + n
    assert got == want and len(got) > 3
    assert M.half_counts(spark.createDataFrame([], "beat string")).count() == 0


def test_tables_like_their_sql():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    assert sorted(con.sql(f"WITH {meter_sql.HALVES} SELECT meter, ending, half, pattern, feet FROM half_lines").fetchall()) == sorted(M.half_rows())
    assert sorted(con.sql(f"WITH {meter_sql.LINES} SELECT meter, beat, feet FROM line_feet").fetchall()) == sorted(M.line_feet_rows())
    assert sorted(con.sql(f"WITH {meter_sql.FEET} SELECT * FROM feet").fetchall()) == sorted(M.foot_rows())
