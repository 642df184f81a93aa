"""Analytic tests of the operators on packed samples."""

import numpy as np
import pytest

from cadenza.operators import signal as S
from cadenza.operators import spectra as P

RATE = 16000


def tone(hz, amplitude=0.1, n=8000, rate=RATE):
    return amplitude * np.sin(2 * np.pi * hz * np.arange(n) / rate)


def test_amplitudes_at_the_middle_and_both_ends():
    a = P.amplitude_spectrum(tone(1250, 0.7, 3200))
    assert a.argmax() == 250 and a[250] == pytest.approx(0.7) and a[247] < 1e-9
    # a constant is taken out; the last bin of an even length isn't doubled
    assert P.amplitude_spectrum(np.full(600, -4.0)).max() < 1e-12
    assert P.amplitude_spectrum(np.tile([1.5, 0.5], 300))[300] == pytest.approx(0.5)


def test_blocks_give_the_frames_of_the_whole_recording(spark):
    x = S.tone(spark, 900, 0.1, 1.0, 9001, rec=5).unionByName(S.tone(spark, 50, 0.1, 0.01, 9001, rec=6))
    got = sorted((r["frame"], r["k"], r["p"]) for r in P.power_spectra(x, 32, 8, 9001.0).collect() if r["rec"] == 5)
    v = tone(900, 0.1, 9001, 9001)
    want = P.frame_powers(v - v.mean(), 32, 8, 9001.0)
    assert len(got) == want.size and got[-1][:2] == (want.shape[0] - 1, 16)
    assert np.allclose([p for _, _, p in got], want.ravel(), atol=1e-12)


def test_mean_of_frames_integrates_to_the_power():
    v = tone(1000)
    assert P.frame_powers(v, 1024, 256, RATE).mean(axis=0).sum() * RATE / 1024 == pytest.approx(0.005, rel=1e-3)
    assert P.multitaper(tone(1000, n=1000), RATE).sum() * RATE / 1000 == pytest.approx(0.005, rel=0.02)


def test_tapers_are_orthonormal_and_concentrated():
    t, weight = P.tapers(128)
    assert np.allclose(t @ t.T, np.eye(5), atol=1e-9) and weight[0] > 0.9999 and (np.diff(weight) < 0).all()


def test_peaks_with_plateau_prominence_and_distance():
    v = np.array([0, 1, 3, 3, 3, 1, 2, 0, 5, 4, 5.5, 0])
    assert [p for p, _ in P.find_peaks(v)] == [3, 6, 8, 10]
    assert dict(P.find_peaks(v)) == {3: 3.0, 6: 1.0, 8: 1.0, 10: 5.5}
    assert [p for p, _ in P.find_peaks(v, 2.0)] == [3, 10]
    assert [p for p, _ in P.find_peaks(v, 0.0, 3)] == [3, 6, 10]
    assert P.find_peaks(np.zeros(9)) == []


def test_envelope_of_two_tones_beats():
    """Two tones of amplitudes a and b have an envelope between |a - b| and a + b, at their difference."""
    t = np.arange(24000) / RATE
    v = 0.6 * np.cos(2 * np.pi * 3000 * t) + 0.2 * np.cos(2 * np.pi * 3090 * t + 1) + 0.5 * np.cos(2 * np.pi * 700 * t)
    e = P.envelope(P.band_passed(v, RATE, 2000, 4500))[1000:-1000]
    a = P.amplitude_spectrum(e)
    assert (a[1:].argmax() + 1) * RATE / len(e) == pytest.approx(90, abs=1) and e.max() == pytest.approx(0.8, rel=0.02) and e.min() == pytest.approx(0.4, rel=0.03)


def test_band_pass_keeps_and_drops():
    assert np.abs(P.band_passed(tone(2000), RATE, 1000, 3000)[500:-500]).max() == pytest.approx(0.1, rel=0.01)
    assert np.abs(P.band_passed(tone(6000), RATE, 1000, 3000)[500:-500]).max() < 1e-3


def test_cepstrum_finds_the_period_of_a_series():
    v = sum(tone(200 * k, 0.1 / k, 4096) for k in range(1, 20))
    c = P.cepstrum(v)
    assert abs(int(c[40:].argmax()) + 41 - RATE / 200) <= 1


def test_coherence_kurtosis_wavelet():
    rng = np.random.default_rng(1)
    t = np.arange(8192)
    assert P.cyclic_coherence(np.cos(2 * np.pi * t * 8 / 64) * (1 + np.cos(2 * np.pi * t * 2 / 64)), 64, 16, 2)[6:9].max() > 0.99
    assert P.cyclic_coherence(rng.normal(size=8192), 64, 64, 2).max() < 0.5
    bank = P.band_kurtosis(rng.normal(size=8192), 1.0, 2)
    assert len(bank) == 6 and all(abs(x) < 0.8 for x in bank.values())
    grid = np.geomspace(100, 4000, 30)
    assert grid[P.wavelet_powers(tone(1000), RATE, grid).argmax()] == pytest.approx(1000, rel=0.1)


def test_report_of_a_tone_and_of_short_or_broken_segments(spark):
    from pyspark.sql import functions as F

    x = S.tone(spark, 1000, 0.1, 0.064, RATE, rec=1).unionByName(spark.range(20).select(F.lit(2).cast("long").alias("rec"), F.col("id").alias("n"), F.lit(1.0).alias("value")))
    x = x.unionByName(spark.range(64).select(F.lit(3).cast("long").alias("rec"), F.col("id").alias("n"), F.when(F.col("id") == 7, F.lit(float("nan"))).otherwise(0.5).alias("value")))
    rows = {(r["rec"], r["segment"]): r for r in P.segment_report(x, 512, float(RATE)).collect()}
    assert rows[1, 0]["top_hz"] == 1000 and rows[1, 0]["top_amplitude"] == pytest.approx(0.1) and rows[1, 0]["power"] == pytest.approx(0.005, rel=0.01) and rows[1, 0]["repeat_samples"] % 16 == 0
    assert rows[2, 0]["status"] == rows[3, 0]["status"] == "unavailable" and rows[2, 0]["top_hz"] is None
