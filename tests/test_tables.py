"""Shift search, table functions, reducers and signatures against plain arithmetic."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators import shift_search as T
from cadenza.operators import tables as A


def plainly(a, b, most):
    best = None
    for s in range(-most, most + 1):
        x, y = (a[s:], b[: len(b) - s]) if s >= 0 else (a[:s], b[-s:])
        n = min(len(x), len(y))
        x, y = x[:n], y[:n]
        both = np.isfinite(x) & np.isfinite(y)
        if not both.any() or both.sum() < 0.2 * min(np.isfinite(x).sum(), np.isfinite(y).sum()):
            continue
        d = math.sqrt((((x[both] - x[both].mean()) - (y[both] - y[both].mean())) ** 2).mean())
        if best is None or (round(d, 9), abs(s), s) < (round(best[0], 9), abs(best[1]), best[1]):
            best = d, s
    return best


def test_all_shifts_are_brute_force(spark):
    rng = np.random.default_rng(12)
    pairs = []
    for n in (1, 2, 50, 231, 300):
        for kind in range(5):
            a = rng.normal(size=n) + (1000 if kind == 1 else 0)
            b = np.roll(a, 7) + rng.normal(size=n) * 0.1 if kind < 3 else rng.normal(size=n)
            if kind == 2:
                a[rng.random(n) < 0.3], b[rng.random(n) < 0.5] = np.nan, np.inf
            if kind == 4:
                a[: n // 2 + 1], b[n // 2 :] = np.nan, np.nan
            pairs.append((a, b))
    pairs += [(np.zeros(40), np.zeros(40)), (np.full(9, np.nan), np.ones(9)), (np.tile([0.0, 1.0], 30), np.tile([0.0, 1.0], 30))]
    df = spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(pairs)] + [(900, None, [1.0]), (901, [], [1.0]), (902, [1.0, None, 3.0], [1.0, 2.0, 3.0])], "id long, a array<double>, b array<double>")
    got = {r.id: (r.distance, r.shift) for r in T.shift_distances(df, ["id"], 115).collect()}
    for i, (a, b) in enumerate(pairs):
        want = plainly(a, b, min(115, len(a) - 1))
        assert got[i] == (None, None) if want is None else got[i][0] == pytest.approx(want[0], abs=1e-9) and got[i][1] == want[1], i
    assert got[900] == got[901] == (None, None) and got[902] == (0.0, 0)


@pytest.mark.parametrize("size,step", [(4, 4), (4, 2), (5, 3), (100, 1), (1, 1)])
def test_padded_windows(spark, size, step):
    recs = {"a": [0.0, 0.5, -1.0, 1.5, 0.0, 0.0, 0.0, 0.0, 0.25, 0.0, 0.0], "b": [0.0] * 4, "c": [2.0]}
    spark.createDataFrame([(r, n, v) for r, vs in recs.items() for n, v in enumerate(vs)], "rec string, n long, value double").repartition(5).createOrReplaceTempView("padded_input")
    A.register(spark)
    got = {(r.rec, r.start): r for r in spark.sql(f"SELECT * FROM padded_windows(row => TABLE(padded_input) PARTITION BY (rec) ORDER BY (n), size => {size}, step => {step})").collect()}
    want = {}
    for r, v in recs.items():
        for start in range(0, len(v), step):
            x = v[start : start + size]
            want[r, start] = (len(x), size - len(x), max(map(abs, x)) == 0, sum(abs(y) >= 1 for y in x))
            if start + size >= len(v):
                break
    assert {k: (r.valid, r.padding, r.silence, r.clipped) for k, r in got.items()} == want
    assert got["a", 0].rms == pytest.approx(math.sqrt(sum(x * x for x in recs["a"][:size]) / min(size, 11)))


def test_pooling_by_name(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(7, 10))
    cells = spark.createDataFrame([(1, i, j, float(m[i, j])) for i in range(7) for j in range(10)], "id long, row long, col long, value double")
    for name, f in (("mean", np.mean), ("median", np.median), ("max", np.max)):
        got = {(r.row, r.col): r.value for r in A.pooled(cells, ["id"], 3, 4, name).collect()}
        want = np.stack([f(m[i], axis=0) for i in np.array_split(np.arange(7), 3)])
        want = np.stack([f(want[:, j], axis=1) for j in np.array_split(np.arange(10), 4)], axis=1)
        assert len(got) == 12 and all(v == pytest.approx(want[k]) for k, v in got.items())
    assert A.pooled(cells, ["id"], 20, 20, "rms").count() == 70
    with pytest.raises(ValueError):
        A.pooled(cells, ["id"], 2, 2, "mode")


def test_signatures(spark):
    rows = [(0, [1.0, 3.0, 2.0]), (1, [5.0]), (2, []), (3, None), (4, np.random.default_rng(0).normal(size=300).tolist())]
    got = {r[0]: r[1] for r in spark.createDataFrame(rows, "id long, v array<double>").select("id", A.brought_to(F.col("v"), 256)).collect()}
    assert got[2] is None and got[3] is None and got[1] == [5.0] * 256
    for i in (0, 4):
        v = rows[i][1]
        assert np.allclose(got[i], np.interp(np.linspace(0, 1, 256), np.linspace(0, 1, len(v)), v))
    cells = [(1, float(x), c) for x, c in ((0, 5), (1, 0), (2, 10), (3, 5))] + [(2, 0.0, 0), (2, 1.0, 0), (3, 7.0, 2)]
    got = {(r.id, r.share): r.level for r in A.inverse_levels(spark.createDataFrame(cells, "id long, level double, count long"), ["id"], [0.1, 0.5, 0.9]).collect()}
    want = np.interp([0.1, 0.5, 0.9], np.cumsum([5, 0, 10, 5]) / 20, [0, 1, 2, 3])
    assert [got[1, s] for s in (0.1, 0.5, 0.9)] == pytest.approx(want.tolist()) and [got[2, s] for s in (0.1, 0.5, 0.9)] == [None] * 3 and got[3, 0.5] == 7
