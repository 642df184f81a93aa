"""Views by bands against plain arithmetic and signals whose modulation is known."""

import numpy as np
import pytest

from cadenza.operators import band_views as V
from cadenza.operators.filters import butterworth, system
from plain import both_ways

RATE = 12_000.0


def table(spark, recs):
    return spark.createDataFrame([(r, n, float(v)) for r, vs in recs.items() for n, v in enumerate(vs)], "rec string, n long, value double")


def beating(carrier, beat, depth, seconds=1.5, amplitude=0.2):
    t = np.arange(int(seconds * RATE)) / RATE
    return amplitude * (1 - depth * np.sin(2 * np.pi * beat * t)) * np.cos(2 * np.pi * carrier * t + 0.7)


@pytest.mark.parametrize("order,low,high", [(4, 300.0, 900.0), (4, 2000.0, 5000.0), (2, 50.0, 60.0)])
def test_segments_are_filtered_by_recursion(order, low, high):
    v = np.random.default_rng(5).normal(size=700)
    s = system(order, low, high, RATE)
    got = V.both_ways(s, v - v.mean())
    assert np.abs(got - both_ways(butterworth(order, low, high, RATE), v, s.reach)).max() < 1e-9
    assert V.both_ways(s, v[: s.reach]) is None


def test_modulation_is_found(spark):
    x = table(spark, {"a": beating(3000, 27, 0.6), "b": np.zeros(4000), "c": beating(3000, 27, 0.6)[:2300], "d": [1.0, float("inf")] * 3000})
    bands = [(2500.0, 3500.0), (500.0, 900.0), (5000.0, 6000.0)]
    rows = {(r.rec, r.band): r for r in V.modulations(x, 18_000, RATE, bands).collect()}
    assert len(rows) == 12 and all(rows[r, 3].status == "nyquist" for r in "abc") and {rows["d", b].status for b in (1, 2, 3)} == {"invalid"}
    r = rows["a", 1]
    assert r.status == "available" and r.strongest_hz == pytest.approx(27, abs=0.5) and r.mean_envelope == pytest.approx(0.2, rel=0.01) and max(r.envelope) == pytest.approx(0.6, rel=0.03)
    # (1 - d sin)^2 has the beat at 2 d, over a mean of 1 + d^2 / 2
    assert max(r.squared) == pytest.approx(1.2 / 1.18, rel=0.03)
    grid = np.linspace(0, 500, V.POINTS)
    assert len(r.grid) == V.POINTS and abs(grid[np.argmax(np.array(r.grid, dtype=float))] - 27) <= 2 and None not in r.grid
    # half of 400 Hz is as far as this band tells
    assert [g is None for g in rows["a", 2].grid] == [f > 200 + 1e-9 or f > max(np.arange(7801) * RATE / 15600 * (np.arange(7801) * RATE / 15600 <= 200)) for f in grid]
    assert rows["b", 1].status == "faint" and rows["c", 1].status == "short" and rows["c", 1].grid is None


def test_clicks_are_kurtotic(spark):
    rng = np.random.default_rng(2)
    clicks = rng.normal(size=9000) * 0.01
    ring = np.sin(2 * np.pi * 4000 * np.arange(60) / RATE) * np.exp(-np.arange(60) / 15)
    for at in range(500, 8900, 700):
        clicks[at : at + 60] += ring
    got = V.kurtosis_bands(table(spark, {"clicks": clicks, "noise": rng.normal(size=9000), "short": np.ones(2410)}), 9000, RATE).collect()
    assert {(r.rec, r.level) for r in got} == {(r, n) for r in ("clicks", "noise") for n in (1, 2, 3, 4)} and len(got) == 60
    assert all(abs(r.kurtosis) < 1 for r in got if r.rec == "noise")
    assert all(r.kurtosis > 5 for r in got if r.rec == "clicks" and r.low_hz <= 4000 <= r.high_hz)
    one = next(r for r in got if r.rec == "clicks" and r.level == 1 and r.low_hz == 20)
    y = both_ways(butterworth(4, 20.0, one.high_hz, RATE), clicks, system(4, 20.0, one.high_hz, RATE).reach)
    z = np.fft.fft(y)
    z[4501:] = 0
    z[1:4500] *= 2
    p = np.abs(np.fft.ifft(z))[1200:-1200] ** 2
    assert one.kurtosis == pytest.approx((p**2).mean() / p.mean() ** 2 - 2, rel=1e-6)


def test_cyclic_coherence_is_plain(spark):
    rng = np.random.default_rng(9)
    v = rng.normal(size=4000) * (1 + np.cos(2 * np.pi * 150 * np.arange(4000) / RATE))
    rows = {(r.shift, r.k): r.coherence for r in V.cyclic_map(table(spark, {"a": v, "b": v[:700]}), 4000, RATE, 240, 300.0).collect() if r.rec == "a"}
    assert {s for s, _ in rows} == {1, 2, 3, 4, 5, 6} and all(0 <= c <= 1 for c in rows.values())
    x, w = v - v.mean(), 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(240) / 240)
    for shift, k in ((3, 10), (1, 50), (6, 100)):
        a, b, joint = 0.0, 0.0, 0j
        for start in range(0, 4000 - 239, 60):
            f = x[start : start + 240] * w
            bins = [(f * np.exp(-2j * np.pi * j * (np.arange(240) + start) / 240)).sum() for j in (k, k + shift)]
            a, b, joint = a + abs(bins[0]) ** 2, b + abs(bins[1]) ** 2, joint + bins[1] * bins[0].conjugate()
        assert rows[shift, k] == pytest.approx(abs(joint) ** 2 / a / b, rel=1e-6)
    # 150 Hz are three bins of 50
    assert np.mean([rows[3, k] for k in range(10, 100)]) > 3 * np.mean([rows[5, k] for k in range(10, 100)])
    assert V.coherence(v[: 240 + 14 * 60], RATE, 240, 60, 300.0) == []


def test_families_and_spacings(spark):
    t = np.arange(12_000) / RATE
    v = sum(a * np.cos(2 * np.pi * f * t + f) for f, a in ((110, 1.0), (220, 0.7), (330, 0.5), (1000, 0.4), (1573, 0.2), (8, 3.0)))
    peaks = V.strong_peaks(table(spark, {"a": v, "b": np.zeros(200), "c": [np.nan] * 50}), 12_000, RATE)
    found = sorted(peaks.collect(), key=lambda r: r.hz)
    assert [r.hz for r in found] == [110, 220, 330, 1000, 1573] and all(r.spacing == 1 for r in found)
    families = V.harmonic_families(peaks).collect()
    assert [(r.base_hz, r.members) for r in families] == [(110, [110, 220, 330])]
    want = {}
    hz = [110, 220, 330, 1000, 1573]
    for i, a in enumerate(hz):
        for b in hz[i + 1 :]:
            if b - a <= 1000:
                want[min((b - a) // 2, 499)] = want.get(min((b - a) // 2, 499), 0) + 1
    assert {r["class"]: r.pairs for r in V.peak_spacings(peaks).collect()} == want
