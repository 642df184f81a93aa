"""Order analysis by blocks against a plain one of the whole recording, and against signals whose orders are known."""

import math

import numpy as np
import pytest

from cadenza.operators.filters import butterworth, system
from cadenza.operators.orders import Orders, angular_samples, order_analysis, order_peaks
from plain import both_ways

RATE = 8000.0


def table(spark, recs):
    return spark.createDataFrame([(r, n, float(a), float(b)) for r, (v, f) in recs.items() for n, (a, b) in enumerate(zip(v, f, strict=True))], "rec string, n long, value double, base double").repartition(5)


def turning(seconds=4.0, rate=RATE):
    """A rotation that speeds up from 17 Hz, first slowly, with orders 3 and 7 in it."""
    t = np.arange(int(seconds * rate)) / rate
    f = 17 + 1.3 * t**2
    phase = 2 * np.pi * (17 * t + 1.3 * t**3 / 3)
    return 0.3 * np.sin(3 * phase + 0.4) + 0.12 * np.sin(7 * phase), f


def plainly(v, f, rate, config):
    s = system(8, None, min(0.45 * rate, 0.4 * config.per_cycle * f.min()), rate)
    y = both_ways(butterworth(8, None, min(0.45 * rate, 0.4 * config.per_cycle * f.min()), rate), v, s.reach)
    cycles = np.concatenate([[0.0], np.cumsum((f[1:] + f[:-1]) / 2 / rate)])
    trim = max(1, round(config.edge * rate))
    first, last = math.ceil(cycles[trim]), math.floor(cycles[len(f) - trim - 1])
    where = first + np.arange((last - first) * config.per_cycle) / config.per_cycle
    return first, last - first, np.interp(where, cycles, y), np.interp(where, cycles, np.arange(len(f)) / rate)


def curve(curves, rec, name):
    return np.array([r.value for r in sorted((r for r in curves if r.rec == rec and r.curve == name), key=lambda r: r.k)])


@pytest.mark.parametrize("size", [640, 10**6])
def test_blocks_are_the_whole(spark, size):
    """A recording in 50 blocks, and in one, gives what plain arithmetic over all of it gives."""
    v, f = turning()
    config = Orders(per_cycle=128, highest=15)
    about, curves, maps = order_analysis(table(spark, {"a": (v, f)}), RATE, config, size)
    about, curves, maps = about.collect()[0], curves.collect(), maps.collect()
    first, count, y, t = plainly(v, f, RATE, config)
    assert (about.status, about.first_cycle, about.cycles) == ("available", first, count)
    frame = 8 * 128
    starts = np.arange(0, len(y) - frame + 1, frame // 2)
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(frame) / frame)
    p = np.array([np.abs(np.fft.rfft((y[s : s + frame] - y[s : s + frame].mean()) * w)) ** 2 / (128 * (w**2).sum()) for s in starts])
    p[:, 1:-1] *= 2
    assert np.allclose(curve(curves, "a", "psd"), p.mean(axis=0)[:121], rtol=1e-7, atol=1e-12)
    assert about.power == pytest.approx(p.mean(axis=0).sum() / 8) and about.mean_square == pytest.approx((y**2).mean())
    turns = y.reshape(count, 128)
    assert np.allclose(curve(curves, "a", "mean"), turns.mean(axis=0), atol=1e-9) and np.allclose(curve(curves, "a", "std"), turns.std(axis=0), atol=1e-7)
    lags = np.array([(y[k:] * y[: len(y) - k]).sum() for k in range(257)])
    assert np.allclose(curve(curves, "a", "autocorrelation"), lags / lags[0], atol=1e-9)
    at = {(r.frame, r.k): (r.p, r.seconds) for r in maps}
    assert len(at) == len(starts) * 121
    for i in (0, len(starts) // 2, len(starts) - 1):
        assert at[i, 24][0] == pytest.approx(p[i, 24], rel=1e-6) and at[i, 24][1] == pytest.approx(t[starts[i] + frame // 2])


def test_orders_stay_where_they_are(spark):
    about, curves, _ = order_analysis(table(spark, {"x": turning(), "y": (np.zeros(8000), np.full(8000, 20.0))}), RATE)
    peaks = [r.order for r in sorted((r for r in order_peaks(curves).collect() if r.rec == "x"), key=lambda r: r.rank)]
    assert abs(peaks[0] - 3) <= 0.125 and any(abs(p - 7) <= 0.125 for p in peaks[:3])
    rows = {r.rec: r for r in about.collect()}
    # half the squares of both amplitudes
    assert rows["x"].power == pytest.approx((0.09 + 0.0144) / 2, rel=0.05) and rows["y"].power == 0
    quiet = [r for r in curves.collect() if r.rec == "y"]
    assert quiet and all(r.value == 0 for r in quiet)


def test_tones_beyond_the_orders_do_not_fold(spark):
    t = np.arange(32000) / RATE
    v = 0.5 * np.sin(2 * np.pi * 50 * t) + np.sin(2 * np.pi * 1350 * t)
    _, curves, _ = order_analysis(table(spark, {"a": (v, np.full(32000, 25.0))}), RATE, Orders(per_cycle=64, highest=12))
    psd = {r.at: r.value for r in curves.collect() if r.curve == "psd"}
    # 1350 Hz are order 54, which 64 samples would show as order 10
    assert max(psd[k] for k in psd if abs(k - 10) < 0.2) < 1e-6 * max(psd[k] for k in psd if abs(k - 2) < 0.2)


def test_statuses(spark):
    n = 4000
    t = np.sin(np.arange(n) / 7)
    recs = {
        "zero": (t, np.zeros(n)), "below": (t, np.full(n, -2.0)), "nan": (t, np.where(np.arange(n) == 9, np.nan, 20.0)), "value": (np.where(np.arange(n) == 3999, np.inf, t), np.full(n, 20.0)), "few": (t[:63], np.full(63, 20.0)),
        "fast": (t, np.full(n, 500.0)), "slow": (t, np.full(n, 6.0)), "edges": (t[:700], np.full(700, 30.0)), "fine": (t, np.full(n, 40.0)),
    }
    about, runs = angular_samples(table(spark, recs), RATE)
    assert {r.rec: r.status for r in about.collect()} == {"zero": "invalid", "below": "invalid", "nan": "invalid", "value": "invalid", "few": "invalid", "fast": "bandwidth", "slow": "short", "edges": "short", "fine": "available"}
    assert {r.rec for r in runs.collect()} == {"fine"}
    assert order_analysis(table(spark, {}), RATE)[0].collect() == []


@pytest.mark.parametrize("config", [{"per_cycle": 16}, {"cycles": 1}, {"highest": 0}, {"edge": -1}, {"highest": float("nan")}])
def test_impossible_orders(config):
    with pytest.raises(ValueError):
        Orders(**config)
