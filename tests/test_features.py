"""Analytic and brute-force tests of features, shapes and strict JSON."""

import math

import numpy as np
import pytest

from cadenza.functions.strict_json import canonical
from cadenza.operators import features as E
from cadenza.operators import shapes as H
from cadenza.operators import signal as S
from cadenza.plans.feature_queries import QUERIES

D = "/root/testdata/sf0.001"


def test_power_moves_to_the_tone_and_to_the_click():
    t, f, p = E.relocated(np.sin(2 * np.pi * 0.11 * np.arange(512)), 64, 16, 1.0)
    assert (p * np.abs(f - 0.11)).sum() / p.sum() < 1e-3
    click = np.zeros(512)
    click[200] = 1.0
    t, f, p = E.relocated(click, 64, 16, 1.0)
    assert (p * np.abs(t - 200)).sum() / p.sum() < 0.5


def test_resampling_is_the_sum_over_the_stuffed_signal():
    v = np.random.default_rng(1).normal(size=40)
    for up, down in ((3, 2), (2, 3), (7, 5), (4, 2), (1, 1)):
        g = math.gcd(up, down)
        u, w = up // g, down // g
        half = 10 * max(u, w)
        taps = np.sinc(np.arange(-half, half + 1) / max(u, w)) * np.kaiser(2 * half + 1, 5.0)
        stuffed = np.zeros(len(v) * u)
        stuffed[::u] = v
        want = np.convolve(stuffed, taps * u / taps.sum())[half:][: len(v) * u : w] if u != w else v
        got = E.resample(v, up, down)
        assert len(got) == -(-len(v) * u // w) and np.allclose(got, want[: len(got)])


def test_speed_is_matched():
    n = np.arange(4000)
    v = E.at_speed(np.sin(2 * np.pi * 0.02 * n), 30.0, 20.0)
    assert len(v) == 6000 and abs(np.abs(np.fft.rfft(v * np.hanning(6000))).argmax() / 6000 - 0.02 * 20 / 30) < 2e-4
    assert len(E.at_speed(v, 0.0, 20.0)) == 0


def test_cepstral_vectors():
    rng = np.random.default_rng(2)
    v = rng.normal(size=4096)
    a, b = E.cepstral(v, 8000, 256, 64, 40), E.cepstral(10 * v, 8000, 256, 64, 40)
    assert a.shape == (120,) and b[0] - a[0] == pytest.approx(20 * math.sqrt(40)) and np.allclose(a[1:], b[1:])
    line = np.arange(30.0)[None] * 2 + 1
    assert np.allclose(E.slopes(line, 1), 2) and np.allclose(E.slopes(line**2, 2), 8)
    filters = E.mel_filters(1025, 16000, 40)
    assert np.allclose(filters.sum(axis=1) * 8000 / 1024, 1, rtol=0.1) and (filters.argmax(axis=1)[1:] > filters.argmax(axis=1)[:-1]).all()


def test_shapes_do_not_change_with_gain_and_show_clicks(spark):
    tone = S.tone(spark, 50, 0.1, 1.0, 1000, rec=1)
    click = tone.selectExpr("2L as rec", "n", "value * 10 + if(n = 700, 90, 0) as value")
    short = tone.selectExpr("3L as rec", "n", "value").filter("n < 520")
    x = tone.unionByName(click).unionByName(short)
    p = H.segment_spectra(x, 500, 64, 16).cache()
    shapes = H.segment_shapes(p)
    got = {(r["rec"], r["segment"]): r for r in H.transients(p).collect()}
    assert set(got) == {(1, 0), (1, 1), (2, 0), (2, 1), (3, 0)}
    assert got[1, 0]["transient"] == 0 and 0 < got[2, 1]["transient"] < 1 and got[2, 1]["frames"] == 28
    db = {(r["rec"], r["segment"], r["k"]): r["db"] for r in shapes.collect()}
    assert all(abs(db[1, 0, k] - db[2, 0, k]) < 1e-6 for k in range(33))
    whole = {r["rec"] for r in H.mean_shapes(x, 500, 64, 16, 0, 32, None).select("rec").distinct().collect()}
    assert whole == {1, 2}


def test_segments_of_any_recording_have_spectra(spark):
    """Ids of any size or kind, and segments beyond any count of bits."""
    v = [math.sin(i / 3) + 0.1 * math.cos(i * 1.7) for i in range(64)]
    many = 2**45
    rows = [(r, n + at, y) for r, at in ((7, 0), (2**44, 0), (-5, 0), (7, 64 * many)) for n, y in enumerate(v)]
    p = H.segment_spectra(spark.createDataFrame(rows, "rec long, n long, value double"), 64, 32, 8).collect()
    by = {}
    for r in p:
        by.setdefault((r["rec"], r["segment"]), []).append((r["frame"], r["k"], round(r["p"], 9)))
    assert set(by) == {(7, 0), (2**44, 0), (-5, 0), (7, many)} and len({str(sorted(x)) for x in by.values()}) == 1
    named = spark.createDataFrame([("a", n, y) for n, y in enumerate(v)], "rec string, n long, value double")
    assert H.segment_spectra(named, 64, 32, 8).count() == 5 * 17


def test_strict_json():
    keys = frozenset({"a", "b"})
    assert canonical('{"b": 1, "a": [1.5, null]}', keys) == '{"a":[1.5,null],"b":1}'
    for bad in (None, "", "[]", "1", '{"a": 1, "a": 1}', '{"c": 1}', '{"a": NaN}', '{"a": 1e999}', '{"a": {"x": 1, "x": 2}}', "{", "[" * 100000):
        assert canonical(bad, keys) is None


def test_queries_without_sql(spark):
    cells = QUERIES["reassigned_map"](spark, D).collect()
    assert cells and all(r["p"] > 0 and r["n"] > 0 for r in cells)
    assert {len(r["values"]) for r in QUERIES["cepstral_features"](spark, D).collect()} == {120}
    assert {n for (n,) in {(r["n"],) for r in QUERIES["resampled"](spark, D).collect()}} >= set(range(96))
    assert QUERIES["speed_matched"](spark, D).count() > 0
