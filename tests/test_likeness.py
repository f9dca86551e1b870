"""Likeness of a group's members against a plain loop, with no row for a pair."""

import random

from quillmesh.operators import likeness as L
from quillmesh.session import ship


def test_sums_over_a_group_equal_the_loop(spark, monkeypatch):
    ship(spark)
    r = random.Random(41)
    rows = [(r.randrange(3), i, sorted({f"w{r.randrange(12)}" for _ in range(r.randrange(5))})) for i in range(120)] + [(7, 500, ["a"]), (8, 600, None), (8, 601, ["a"]), (0, 700, None), (9, 800, None), (9, 801, None)]
    df = spark.createDataFrame(rows, "g long, i long, w array<string>")
    share = lambda x, y: round(len(set(x) & set(y)) / len({*x, *y}), 9) if x and y else 0.0
    want = {(g, i): None if w is None else sum(share(w, v) for h, j, v in rows if h == g and j != i and v is not None) for g, i, w in rows if g != 7}
    made = L.likeness(df, "g", "i", "w")
    got = {(x.g, x.i): x.s for x in made.collect()}
    assert got.keys() == want.keys() and all((got[k] is None) == (want[k] is None) and abs((got[k] or 0) - (want[k] or 0)) < 1e-7 for k in want)
    assert "Join" not in made._jdf.queryExecution().executedPlan().toString()


def test_blocks_of_rows_give_the_same(monkeypatch, spark):
    import pyarrow as pa

    r = random.Random(42)
    words = pa.array([[r.randrange(30) for _ in range(r.randrange(4))] for _ in range(300)], pa.list_(pa.int64()))
    words = pa.array([sorted(set(x)) for x in words.to_pylist()], pa.list_(pa.int64()))
    whole = L.summed(words)
    monkeypatch.setattr(L, "AT_ONCE", 1000)
    assert abs(L.summed(words) - whole).max() < 1e-9 and whole.max() > 0 and len(L.summed(words.slice(0, 0))) == 0
