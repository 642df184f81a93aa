"""Spectral operators on packed samples: Spark deals bounded blocks or segments to tasks, NumPy transforms each.

A recording may be of any length: it is cut into blocks that overlap by what a frame needs, so no task gets a whole recording.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Frames in a block; least samples of a segment with a spectrum.
BLOCK_FRAMES, LEAST_SAMPLES = 512, 32
TINY = 2.2250738585072014e-308


def hann(n: int) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)


def _arrays(column: pa.ListArray) -> Iterator[np.ndarray]:
    values, ends = column.flatten().field("value").to_numpy(zero_copy_only=False), np.cumsum([0, *column.value_lengths().to_pylist()])
    yield from (values[a:b] for a, b in zip(ends, ends[1:], strict=False))


def frame_powers(v: np.ndarray, size: int, hop: int, rate: float) -> np.ndarray:
    """One-sided power densities of whole Hann frames, frames by bins."""
    w = hann(size)
    p = np.abs(np.fft.rfft(np.lib.stride_tricks.sliding_window_view(v, size)[::hop] * w, axis=1)) ** 2 / (rate * (w**2).sum())
    p[:, 1 : (size + 1) // 2] *= 2
    return p


def _by_blocks(x: DataFrame, size: int, hop: int, rate: float, keys: list[str], schema: str, rows: Callable[[np.ndarray, int], dict[str, np.ndarray]]) -> DataFrame:
    """What `rows` makes of the frames of each block of the centred recordings of x (key..., n, value), given their powers (frames by bins) and the number of the first one, with the keys before it.

    A sample goes to the blocks whose frames it is part of; mean and length of a recording go to its blocks, not to its samples."""
    step = BLOCK_FRAMES * hop
    about = x.groupBy(*keys).agg(F.avg("value").alias("mean"), F.count("*").alias("total")).filter(F.col("total") >= size).withColumn("whole", F.floor((F.col("total") - size) / hop) + 1)
    plan = about.select(*keys, "mean", "whole", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("whole") - 1) / BLOCK_FRAMES))).alias("block"))
    last = F.floor(F.col("n") / step)
    first = F.greatest(F.lit(0), F.ceil((F.col("n") - step + hop - size + 1) / step))
    packed = x.select(*keys, "n", "value", F.explode(F.sequence(F.least(first, last), last)).alias("block")).groupBy(*keys, "block").agg(F.sort_array(F.collect_list(F.struct("n", "value"))).alias("v"))
    found = packed.join(plan, [*keys, "block"]).select("v", "mean", "whole", "block", *keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, v in enumerate(_arrays(batch.column(0))):
                mean, whole, block = (batch.column(i)[row].as_py() for i in (1, 2, 3))
                frames = min(BLOCK_FRAMES, whole - block * BLOCK_FRAMES)
                out = rows(frame_powers(v[: (frames - 1) * hop + size] - mean, size, hop, rate), block * BLOCK_FRAMES)
                at = pa.array(np.full(len(next(iter(out.values()))), row))
                yield pa.RecordBatch.from_arrays([*[batch.column(4 + i).take(at) for i in range(len(keys))], *map(pa.array, out.values())], [*keys, *out])

    kinds = dict(x.dtypes)
    return found.mapInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", " + schema)


def power_spectra(x: DataFrame, size: int, hop: int, rate: float = 1.0, keys: tuple[str, ...] = ("rec",)) -> DataFrame:
    """(key..., frame, k, p): power densities of Hann frames of each centred recording of x (key..., n, value); a recording may have several keys, of any type."""

    def rows(p: np.ndarray, first: int) -> dict[str, np.ndarray]:
        n, k = p.shape
        return {"frame": np.repeat(np.arange(n, dtype=np.int64) + first, k), "k": np.tile(np.arange(k, dtype=np.int64), n), "p": p.ravel()}

    return _by_blocks(x, size, hop, rate, list(keys), "frame long, k long, p double", rows)


def mean_powers(x: DataFrame, size: int, hop: int, rate: float = 1.0, keys: tuple[str, ...] = ("rec",)) -> DataFrame:
    """(key..., k, frames, p, square): the mean over frames of the powers that power_spectra gives, and of their squares. Frames are added up in their blocks, so a block gives a row for each bin, however many frames it has."""

    def rows(p: np.ndarray, first: int) -> dict[str, np.ndarray]:
        return {"k": np.arange(p.shape[1], dtype=np.int64), "frames": np.full(p.shape[1], len(p), dtype=np.int64), "p": p.sum(axis=0), "square": (p**2).sum(axis=0)}

    added = _by_blocks(x, size, hop, rate, list(keys), "k long, frames long, p double, square double", rows)
    n = F.sum("frames")
    return added.groupBy(*keys, "k").agg(n.alias("frames"), (F.sum("p") / n).alias("p"), (F.sum("square") / n).alias("square"))


def amplitude_spectrum(v: np.ndarray) -> np.ndarray:
    """Peak amplitudes by bin, with the window's coherent gain taken out."""
    w = hann(len(v))
    a = np.abs(np.fft.rfft((v - v.mean()) * w)) / w.sum()
    a[1 : (len(v) + 1) // 2] *= 2
    return a


def find_peaks(v: np.ndarray, prominence: float = 0.0, distance: int = 1) -> list[tuple[int, float]]:
    """(place, prominence) of maxima: middles of plateaus, the higher of those nearer than `distance`, with that prominence at least."""
    edges = np.concatenate([[0], np.nonzero(np.diff(v))[0] + 1, [len(v)]])
    tops = [(int((a + b - 1) // 2)) for a, b in zip(edges[1:-2], edges[2:-1], strict=False) if v[a] > v[a - 1] and v[a] > v[b]]
    kept: list[int] = []
    for at in sorted(tops, key=lambda i: (-v[i], -i)):
        if all(abs(at - other) >= distance for other in kept):
            kept.append(at)
    out = []
    for at in sorted(kept):
        higher = np.nonzero(v > v[at])[0]
        left, right = higher[higher < at], higher[higher > at]
        low, high = (left[-1] if len(left) else 0), (right[0] + 1 if len(right) else len(v))
        depth = float(v[at] - max(v[low : at + 1].min(), v[at:high].min()))
        if depth >= prominence:
            out.append((at, depth))
    return out


def band_passed(v: np.ndarray, rate: float, low: float, high: float, order: int = 4) -> np.ndarray:
    """A Butterworth band-pass of zero phase, as the squared magnitude response on the mirrored signal's spectrum."""
    both = np.concatenate([v[::-1], v, v[::-1]])
    warp = lambda f: math.tan(math.pi * min(f, 0.4999 * rate) / rate)
    t = np.tan(np.pi * np.minimum(np.fft.rfftfreq(len(both)), 0.499999))
    a, b = warp(low), warp(high)
    with np.errstate(divide="ignore", over="ignore"):
        q = (t * t - a * b) / np.maximum(t * (b - a), 1e-300)
        gain = 1 / (1 + q ** (2 * order))
    return np.fft.irfft(np.fft.rfft(both) * gain, len(both))[len(v) : 2 * len(v)]


def envelope(v: np.ndarray) -> np.ndarray:
    """The magnitude of the analytic signal."""
    n = len(v)
    step = np.zeros(n)
    step[0] = 1
    step[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        step[n // 2] = 1
    return np.abs(np.fft.ifft(np.fft.fft(v) * step))


def tapers(n: int, nw: float = 3.0, count: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Discrete prolate spheroidal sequences, and their concentrations: eigenvectors of the tridiagonal matrix that commutes with the band's kernel."""
    i = np.arange(n)
    matrix = np.diag(((n - 1 - 2 * i) / 2.0) ** 2 * math.cos(2 * math.pi * nw / n))
    off = i[1:] * (n - i[1:]) / 2.0
    matrix[i[1:], i[:-1]] = matrix[i[:-1], i[1:]] = off
    v = np.linalg.eigh(matrix)[1][:, ::-1][:, :count].T
    lag = np.subtract.outer(i, i)
    kernel = 2 * nw / n * np.sinc(2 * nw / n * lag)
    return v, np.einsum("ki,ij,kj->k", v, kernel, v)


def multitaper(v: np.ndarray, rate: float) -> np.ndarray:
    t, weight = tapers(len(v))
    p = np.abs(np.fft.rfft(t * (v - v.mean()), axis=1)) ** 2 / rate
    p[:, 1 : (len(v) + 1) // 2] *= 2
    return (weight[:, None] * p).sum(axis=0) / weight.sum()


def cepstrum(v: np.ndarray, floor_db: float = -80.0) -> np.ndarray:
    a = np.abs(np.fft.rfft((v - v.mean()) * hann(len(v))))
    return np.fft.irfft(np.log(np.maximum(a, max(a.max() * 10 ** (floor_db / 20), TINY))), len(v))[1 : len(v) // 2]


def autocorrelation(v: np.ndarray) -> np.ndarray:
    x = v - v.mean()
    r = np.fft.irfft(np.abs(np.fft.rfft(x, 2 * len(x))) ** 2)[: len(x)]
    return r / r[0] if r[0] > 0 else np.zeros(len(x))


def cyclic_coherence(v: np.ndarray, size: int, hop: int, shift: int) -> np.ndarray:
    """Coherence of bins `shift` apart over frames, phases taken to the frames' starts; at most 1."""
    frames = np.lib.stride_tricks.sliding_window_view(v - v.mean(), size)[::hop] * hann(size)
    z = np.fft.rfft(frames, axis=1)
    z = z * np.exp(-2j * np.pi * np.outer(np.arange(len(z)) * hop, np.arange(z.shape[1])) / size)
    a, b = z[:, : z.shape[1] - shift], z[:, shift:]
    scale = np.sqrt((np.abs(a) ** 2).sum(axis=0) * (np.abs(b) ** 2).sum(axis=0))
    return np.minimum(np.abs((a * b.conj()).sum(axis=0)) / np.maximum(scale, TINY), 1.0)


def wavelet_powers(v: np.ndarray, rate: float, frequencies: np.ndarray) -> np.ndarray:
    """Mean power of a complex Morlet transform (bandwidth 1.5, centre 1) by frequency, eight scales at either end left out."""
    f = np.fft.fftfreq(len(v), 1 / rate)
    z = np.fft.fft(v - v.mean())
    out = []
    for at in frequencies:
        scale = rate / at
        edge = min(int(8 * scale), (len(v) - 1) // 2)
        c = np.fft.ifft(z * np.exp(-(np.pi**2) * 1.5 * (f * scale / rate - 1) ** 2)) * 2
        out.append(float((np.abs(c[edge : len(v) - edge]) ** 2).mean()))
    return np.array(out)


def band_kurtosis(v: np.ndarray, rate: float, levels: int = 4) -> dict[tuple[int, int], float]:
    """Excess kurtosis of the complex envelope of each dyadic band."""
    out = {}
    for level in range(1, levels + 1):
        for band in range(2**level):
            low, high = (max(x * rate / 2 / 2**level, 1e-6 * rate) for x in (band, band + 1))
            p = envelope(band_passed(v - v.mean(), rate, low, high)) ** 2
            out[level, band] = float((p**2).mean() / max(p.mean() ** 2, TINY) - 2)
    return out


def segments(x: DataFrame, size: int) -> DataFrame:
    """(rec, segment, v): samples of x (rec, n, value) packed by segments of `size`, the last one shorter."""
    return x.groupBy("rec", F.floor(F.col("n") / size).alias("segment")).agg(F.sort_array(F.collect_list(F.struct("n", "value"))).alias("v"))


def _report(v: np.ndarray, rate: float) -> dict[str, float | int | None]:
    amplitude, lags = amplitude_spectrum(v), autocorrelation(v)
    peaks = sorted((p for p in find_peaks(20 * np.log10(np.maximum(amplitude, 1e-15)), 8.0, 2) if amplitude[p[0]] > 1e-6), key=lambda p: (-amplitude[p[0]], p[0]))[:8]
    frame = min(1024, len(v))
    psd = frame_powers(v - v.mean(), frame, min(256, frame), rate).mean(axis=0)
    repeats = [(float(lags[i]), -i) for i, _ in find_peaks(lags) if lags[i] > 0]
    env = envelope(v - v.mean())
    beat = amplitude_spectrum(env)
    quefrency = cepstrum(v)
    return {
        "top_hz": peaks[0][0] * rate / len(v) if peaks else None, "top_amplitude": float(amplitude[peaks[0][0]]) if peaks else None, "peaks": len(peaks), "power": float(psd.sum() * rate / frame),
        "repeat_samples": -max(repeats)[1] if repeats else None, "envelope_mean": float(env.mean()), "envelope_hz": float(beat[1:].argmax() + 1) * rate / len(v),
        "multitaper_power": float(multitaper(v, rate).sum() * rate / len(v)) if len(v) <= 1024 else None, "quefrency": int(quefrency.argmax()) + 1,
    }


_REPORT = {"top_hz": "double", "top_amplitude": "double", "peaks": "long", "power": "double", "repeat_samples": "long", "envelope_mean": "double", "envelope_hz": "double", "multitaper_power": "double", "quefrency": "long"}


def segment_report(x: DataFrame, size: int, rate: float) -> DataFrame:
    """A row for each segment of x (rec, n, value): spectrum, peaks, power, repetition, envelope and cepstrum. Segments of fewer than LEAST_SAMPLES
    samples, or with a value that isn't finite, have status `unavailable` and nulls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_report(v, rate) if len(v) >= LEAST_SAMPLES and np.isfinite(v).all() else None for v in _arrays(batch.column(2))]
            status = pa.array(["unavailable" if r is None else "available" for r in rows])
            columns = [pa.array([None if r is None else r[c] for r in rows], pa.float64() if t == "double" else pa.int64()) for c, t in _REPORT.items()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), status, *columns], ["rec", "segment", "status", *_REPORT])

    return segments(x, size).mapInArrow(run, "rec long, segment long, status string, " + ", ".join(f"{c} {t}" for c, t in _REPORT.items()))


#: Views of a segment by name: what they give is an array, whose places are bins, lags or bands.
VIEWS: dict[str, Callable[[np.ndarray, float], np.ndarray]] = {
    "amplitude": lambda v, _: amplitude_spectrum(v),
    "multitaper": multitaper,
    "cepstrum": lambda v, _: cepstrum(v),
    "autocorrelation": lambda v, _: autocorrelation(v),
    "envelope": lambda v, _: amplitude_spectrum(envelope(v - v.mean())),
    "kurtosis_bank": lambda v, rate: np.array(list(band_kurtosis(v, rate, 3).values())),
    "cyclic": lambda v, _: cyclic_coherence(v, min(16, len(v) // 2), 4, 2),
    "wavelet": lambda v, rate: wavelet_powers(v, rate, np.geomspace(rate / len(v) * 4, rate / 2.5, 12)),
}


def segment_views(x: DataFrame, size: int, rate: float, names: list[str]) -> DataFrame:
    """(rec, segment, view, values) of each segment that is long enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(row, name, VIEWS[name](v, rate)) for row, v in enumerate(_arrays(batch.column(2))) if len(v) >= LEAST_SAMPLES and np.isfinite(v).all() for name in names]
            at = pa.array([row for row, _, _ in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array([name for _, name, _ in found], pa.string()), pa.array([v.tolist() for _, _, v in found], pa.list_(pa.float64()))], ["rec", "segment", "view", "values"])

    return segments(x, size).mapInArrow(run, "rec long, segment long, view string, values array<double>")
