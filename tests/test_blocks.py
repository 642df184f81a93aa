"""Scans along recordings, and filters by blocks, against plain recursion."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators import blocks
from cadenza.operators.blocks import numbered, packed, running_sum, scan
from cadenza.operators.filters import butterworth, system, zero_phase
from plain import both_ways


def table(spark, recs):
    return spark.createDataFrame([(r, n, float(v)) for r, vs in recs.items() for n, v in enumerate(vs)], "rec long, n long, value double").repartition(7)


@pytest.mark.parametrize("fanout,count", [(2, 1), (2, 37), (3, 27), (64, 50)])
def test_scan_keeps_order(spark, fanout, count):
    """Affine maps don't commute, so any place out of order shows."""
    rng = np.random.default_rng(4)
    items = {(r, p): rng.normal(size=6) for r in (1, 2) for p in range(count)}

    def combine(f, g):
        a, b, c, d = f[:4].reshape(2, 2), f[4:], g[:4].reshape(2, 2), g[4:]
        return np.concatenate([(c @ a).ravel(), c @ b + d])

    df = spark.createDataFrame([(r, p, v.tolist()) for (r, p), v in items.items()], "rec long, place long, item array<double>")
    got = {(x.rec, x.place): x.before for x in scan(df, ["rec"], combine, fanout).collect()}
    assert len(got) == 2 * count
    for r in (1, 2):
        now = None
        for p in range(count):
            assert got[r, p] is None if now is None else np.allclose(got[r, p], now, rtol=1e-12)
            now = items[r, p] if now is None else combine(now, items[r, p])


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_running_sum(spark, monkeypatch, size):
    monkeypatch.setattr(blocks, "FANOUT", 3)
    rng = random.Random(2)
    recs = {1: [rng.random() for _ in range(100)], 2: [5.0]}
    got = {(r.rec, r.n): r.total for r in running_sum(table(spark, recs), size).collect()}
    assert all(got[k, n] == pytest.approx(sum(v[: n + 1])) for k, v in recs.items() for n in range(len(v))) and len(got) == 101


def test_packed_with_neighbours(spark):
    got = {(r.rec, r.block): (r.first, r.value) for r in packed(table(spark, {1: range(10), 2: range(4)}), ["value"], 4, before=3, after=2).collect()}
    assert got == {(1, 0): (0, [0, 1, 2, 3, 4, 5]), (1, 1): (1, [1, 2, 3, 4, 5, 6, 7, 8, 9]), (1, 2): (5, [5, 6, 7, 8, 9]), (2, 0): (0, [0, 1, 2, 3])}


def test_numbered_is_row_number(spark):
    rows = [(i, f"2024-01-{1 + i * 7 % 5:02} {i * 5 % 24:02}:00:00", "ab"[i % 3 == 0]) for i in range(90)]
    df = spark.createDataFrame(rows, "event_id long, t string, kind string").withColumn("ts", F.to_timestamp("t"))
    got = {(r.rec, r.n): r.event_id for r in numbered(df, F.col("kind")).collect()}
    for k in "ab":
        assert [got[k, n] for n in range(sum(r[2] == k for r in rows))] == [r[0] for r in sorted((r for r in rows if r[2] == k), key=lambda r: (r[1], r[0]))]


def response(sections, f, rate):
    z = np.exp(-2j * np.pi * f / rate)
    return np.prod([(b0 + b1 * z + b2 * z * z) / (1 + a1 * z + a2 * z * z) for b0, b1, b2, a1, a2 in sections])


@pytest.mark.parametrize("order,low,high", [(2, None, 100.0), (8, None, 400.0), (6, 50.0, None), (4, 100.0, 300.0), (2, 10.0, 12.0)])
def test_response_is_butterworth(order, low, high):
    """|H|^2 = 1 / (1 + q^2n), q the warped frequency, or for a band its distance from the middle."""
    rate, warp = 1000.0, lambda f: math.tan(math.pi * f / 1000.0)
    for f in (1.0, 9.5, 60.0, 110.0, 200.0, 333.0, 450.0):
        w = warp(f)
        q = w / warp(high) if low is None else warp(low) / w if high is None else (w * w - warp(low) * warp(high)) / (w * (warp(high) - warp(low)))
        assert abs(response(butterworth(order, low, high, rate), f, rate)) ** 2 == pytest.approx(1 / (1 + q ** (2 * order)), rel=1e-8, abs=1e-25)


@pytest.mark.parametrize("order,low,high", [(3, None, 10.0), (4, None, 600.0), (4, 30.0, 20.0), (4, None, None)])
def test_impossible_bands(order, low, high):
    with pytest.raises(ValueError):
        butterworth(order, low, high, 1000.0)


@pytest.mark.parametrize("size", [64, 100, 10**6])
def test_zero_phase_is_plain_recursion(spark, size):
    rng = np.random.default_rng(1)
    recs = {1: rng.normal(size=3001).cumsum() + 100, 2: rng.normal(size=28), 3: rng.normal(size=27), 4: [1.0, float("nan")] * 40, 5: rng.normal(size=500)}
    designs = [(r, b, o, lo, hi) for r in recs for b, o, lo, hi in (("low", 8, None, 45.0), ("band", 4, 20.0, 100.0))] + [(5, "high", 2, 10.0, None)]
    df = zero_phase(table(spark, recs), spark.createDataFrame(designs, "rec long, band string, order int, low double, high double"), 1000.0, size)
    got = {}
    for r in sorted(df.collect(), key=lambda r: (r.rec, r.band, r.block)):
        assert r.first == len(got.setdefault((r.rec, r.band), []))
        got[r.rec, r.band] += r.filtered
    assert set(got) == {(r, b) for r in (1, 2, 5) for b in ("low", "band")} | {(5, "high")}
    for (r, b), v in got.items():
        o, lo, hi = next(d[2:] for d in designs if d[:2] == (r, b))
        want = both_ways(butterworth(o, lo, hi, 1000.0), recs[r], system(o, lo, hi, 1000.0).reach)
        assert np.abs(np.array(v) - want).max() < 1e-9


def test_no_recordings(spark):
    assert zero_phase(table(spark, {}), spark.createDataFrame([], "rec long, band string, order int, low double, high double"), 100.0).count() == 0
    assert zero_phase(table(spark, {}), spark.createDataFrame([(1, "a", 2, None, 10.0)], "rec long, band string, order int, low double, high double"), 100.0).count() == 0
