"""Features of packed segments that need a transform or a fold: reassigned spectra, cepstral vectors, resampling.

Spark packs and deals the segments and sums what comes back; NumPy works on one segment at a time, which is bounded by its size.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.operators.spectra import LEAST_SAMPLES, _arrays, hann, segments

#: Share of a segment's greatest power under which nothing is relocated; the greatest denominator of a ratio of speeds.
WEAK, DENOMINATOR = 1e-8, 2000


def relocated(v: np.ndarray, size: int, hop: int, rate: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(seconds, Hz, power) of each bin of each frame, moved to the centre of its energy: a window times time tells where in time it lies, the window's slope where in frequency."""
    i = np.arange(size)
    frames = np.lib.stride_tricks.sliding_window_view(v - v.mean(), size)[::hop]
    w = hann(size)
    plain, timed, sloped = (np.fft.rfft(frames * u, axis=1) for u in (w, w * (i - size / 2), np.pi / size * np.sin(2 * np.pi * i / size)))
    p = np.abs(plain) ** 2
    strong = p > max(p.max() * WEAK, 1e-300)
    row, k = np.nonzero(strong)
    t = (row * hop + size / 2 + (timed[strong] / plain[strong]).real) / rate
    f = (k / size - (sloped[strong] / plain[strong]).imag / (2 * np.pi)) * rate
    return t, f, p[strong]


def reassigned(x: DataFrame, segment: int, size: int, hop: int, rate: float) -> DataFrame:
    """(rec, segment, t, f, p) of x (rec, n, value): relocated powers, t from the segment's start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, v in enumerate(_arrays(batch.column(2))):
                if len(v) < size or not np.isfinite(v).all():
                    continue
                t, f, p = relocated(v, size, hop, rate)
                rec, at = batch.column(0)[row].as_py(), batch.column(1)[row].as_py()
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(t), rec)), pa.array(np.full(len(t), at)), pa.array(t), pa.array(f), pa.array(p)], ["rec", "segment", "t", "f", "p"])

    return segments(x, segment).mapInArrow(run, "rec long, segment long, t double, f double, p double")


def resample(v: np.ndarray, up: int, down: int, beta: float = 5.0) -> np.ndarray:
    """v at up / down of its rate, through a sinc of ten zero crossings a side under a Kaiser window; beyond its ends v is 0."""
    ratio = Fraction(up, down)
    up, down = ratio.numerator, ratio.denominator
    if up == down:
        return v.copy()
    half = 10 * max(up, down)
    taps = np.sinc(np.arange(-half, half + 1) / max(up, down)) * np.kaiser(2 * half + 1, beta)
    taps *= up / taps.sum()
    j = np.arange(-(-len(v) * up // down), dtype=np.int64)
    source = -(-(j * down - half) // up)[:, None] + np.arange(2 * half // up + 1)
    tap = (j * down + half)[:, None] - source * up
    fits = (tap >= 0) & (tap <= 2 * half) & (source >= 0) & (source < len(v))
    return (np.where(fits, taps[tap.clip(0, 2 * half)], 0.0) * v[source.clip(0, len(v) - 1)]).sum(axis=1)


def at_speed(v: np.ndarray, speed: float, wanted: float) -> np.ndarray:
    """v as if its machine had turned at the wanted speed; empty if no ratio of small numbers comes near."""
    ratio = Fraction(speed / wanted).limit_denominator(DENOMINATOR) if speed > 0 and wanted > 0 else Fraction(0)
    return resample(v, ratio.numerator, ratio.denominator) if ratio > 0 else np.zeros(0)


def mel_filters(bins: int, rate: float, count: int) -> np.ndarray:
    """Triangles of equal area, evenly spaced in mel: linear up to 1000 Hz, then 27 steps to each factor of 6.4."""
    mel = lambda f: f * 3 / 200 if f < 1000 else 15 + 27 * math.log(f / 1000) / math.log(6.4)
    hz = lambda m: m * 200 / 3 if m < 15 else 1000 * 6.4 ** ((m - 15) / 27)
    edges = np.array([hz(m) for m in np.linspace(0, mel(rate / 2), count + 2)])
    f = np.linspace(0, rate / 2, bins)
    up = (f - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    down = (edges[2:, None] - f) / (edges[2:] - edges[1:-1])[:, None]
    return np.maximum(0, np.minimum(up, down)) * (2 / (edges[2:] - edges[:-2]))[:, None]


def slopes(c: np.ndarray, order: int, width: int = 9) -> np.ndarray:
    """The derivative of so high an order along the last axis, of polynomials of that degree fitted over `width` places; the first and last fit serve the ends."""
    at = np.arange(width) - width // 2
    fit = np.linalg.pinv(np.vander(at, order + 1, increasing=True))[order] * math.factorial(order)
    inner = np.lib.stride_tricks.sliding_window_view(c, width, axis=-1) @ fit
    return np.concatenate([np.repeat(inner[..., :1], width // 2, -1), inner, np.repeat(inner[..., -1:], width // 2, -1)], axis=-1)


def cepstral(v: np.ndarray, rate: float, size: int, hop: int, mels: int, count: int = 20) -> np.ndarray:
    """Means and deviations over frames of cepstral coefficients, their slopes and their curvatures; empty if there are fewer than nine frames."""
    frames = np.lib.stride_tricks.sliding_window_view(np.pad(v, size // 2), size)[::hop] * hann(size)
    if len(frames) < 9:
        return np.zeros(0)
    p = mel_filters(size // 2 + 1, rate, mels) @ (np.abs(np.fft.rfft(frames, axis=1)) ** 2).T
    db = 10 * np.log10(np.maximum(p, 1e-10))
    db = np.maximum(db, db.max() - 80)
    i = np.arange(mels)
    dct = np.sqrt(2 / mels) * np.cos(np.pi * np.outer(np.arange(count), i + 0.5) / mels)
    dct[0] /= math.sqrt(2)
    c = dct @ db
    rows = np.concatenate([c, slopes(c, 1), slopes(c, 2)])
    return np.concatenate([rows.mean(axis=1), rows.std(axis=1)])


#: Features of a segment by name, given its samples and a parameter: a rate, a ratio or a speed.
FEATURES: dict[str, Callable[[np.ndarray, float], np.ndarray]] = {
    "cepstral": lambda v, rate: cepstral(v, rate, 32, 8, 24),
    "resampled": lambda v, ratio: resample(v, *Fraction(ratio).limit_denominator(DENOMINATOR).as_integer_ratio()),
    "speed_matched": lambda v, wanted: at_speed(v, float(np.abs(v).mean()), wanted),
}


def segment_features(x: DataFrame, size: int, parameter: float, name: str) -> DataFrame:
    """(rec, segment, values) of each segment of x (rec, n, value) that is long enough, finite, and has the feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(row, FEATURES[name](v, parameter)) for row, v in enumerate(_arrays(batch.column(2))) if len(v) >= LEAST_SAMPLES and np.isfinite(v).all()]
            found = [(row, v) for row, v in found if len(v)]
            at = pa.array([row for row, _ in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array([v.tolist() for _, v in found], pa.list_(pa.float64()))], ["rec", "segment", "values"])

    return segments(x, size).mapInArrow(run, "rec long, segment long, values array<double>")
