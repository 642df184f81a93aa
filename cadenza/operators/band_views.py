"""Views of segments by bands: envelopes and their modulation, kurtosis of a bank of bands, cyclic coherence, and families of harmonics.

Spark packs and deals the segments, joins peaks and sums what comes back; NumPy works on one segment at a time, which is bounded by its size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.operators.blocks import by_rows
from cadenza.operators.filters import System, system
from cadenza.operators.spectra import amplitude_spectrum, envelope, find_peaks, hann, segments

#: Least samples of what is left of a segment without its ends; order of the band-pass filters; points of a modulation map; least mean envelope; least mean square of a band.
LEFT, ORDER, POINTS, FAINT, FAINT_SQUARE = 32, 4, 251, 1e-10, 1e-20
#: Peaks of a segment that families are sought among, least members of one, widest spacing of a pair in Hz, width of a class of spacings.
MOST_PEAKS, MEMBERS, WIDEST, CLASS = 24, 3, 1000.0, 2.0


def _values(x: DataFrame, size: int) -> DataFrame:
    """(rec, segment, v): segments with their values alone, which Python gets as one array; as structs each sample would be an object."""
    return segments(x, size).withColumn("v", F.col("v")["value"])


def both_ways(s: System, v: np.ndarray) -> np.ndarray | None:
    """A segment filtered forward and backward, each end continued by its point reflection; None if it is too short for that."""
    if len(v) <= s.reach:
        return None
    led = np.concatenate([2 * v[0] - v[s.reach : 0 : -1], v, 2 * v[-1] - v[-2 : -s.reach - 2 : -1]])
    there = s.run(led, s.settled * led[0])[0][::-1]
    return s.run(there, s.settled * there[0])[0][::-1][s.reach : -s.reach]


def modulation(v: np.ndarray, rate: float, band: tuple[float, float], edge: float, highest: float) -> tuple[str, dict]:
    """(status, figures) of the envelope of a band: mean; relative amplitudes of envelope and squared envelope up to half the band's width, by bins; where the former is greatest; and the former on a grid of POINTS, NaN beyond.

    Status `nyquist`: the band reaches half the rate; `short`: too few samples without the ends; `faint`: nothing in the band."""
    trim = round(edge * rate)
    if band[1] >= rate / 2:
        return "nyquist", {}
    passed = both_ways(system(ORDER, band[0], band[1], rate), v - v.mean()) if len(v) - 2 * trim >= LEFT else None
    if passed is None:
        return "short", {}
    e = envelope(passed)[trim : len(v) - trim]
    if e.mean() < FAINT:
        return "faint", {}
    hz = np.arange(len(e) // 2 + 1) * rate / len(e)
    shown = hz <= min(highest, (band[1] - band[0]) / 2)
    plain, square = amplitude_spectrum(e)[shown] / e.mean(), amplitude_spectrum(e**2)[shown] / (e**2).mean()
    return "available", {"mean": float(e.mean()), "strongest": float(hz[plain.argmax()]), "plain": plain, "square": square, "grid": np.interp(np.linspace(0, highest, POINTS), hz[shown], plain, right=np.nan)}


def modulations(x: DataFrame, size: int, rate: float, bands: list[tuple[float, float]], edge: float = 0.1, highest: float = 500.0) -> DataFrame:
    """(rec, segment, band, status, mean_envelope, strongest_hz, envelope, squared, grid) of each band, from 1, of each segment of x (rec, n, value); see `modulation`. Segments with a value that isn't finite are `invalid`.

    The grid is null where the band tells nothing: the map of a segment is the grids of its bands."""
    kind = dict(x.dtypes)["rec"]

    def run(r: tuple) -> Iterator[tuple]:
        v = np.asarray(r.v, dtype=float)
        for i, band in enumerate(bands, 1):
            status, f = modulation(v, rate, band, edge, highest) if np.isfinite(v).all() else ("invalid", {})
            grid = [None if np.isnan(g) else float(g) for g in f["grid"]] if f else None
            yield r.rec, r.segment, i, status, f.get("mean"), f.get("strongest"), f.get("plain"), f.get("square"), grid

    return by_rows(_values(x, size), f"rec {kind}, segment long, band int, status string, mean_envelope double, strongest_hz double, envelope array<double>, squared array<double>, grid array<double>", run)


def bank_kurtosis(v: np.ndarray, rate: float, edge: float, low: float = 20.0, levels: int = 4) -> list[tuple[int, float, float, float]]:
    """(level, from, to, kurtosis): excess kurtosis of the complex envelope of each of 2, 4, 8, ... equal bands between `low` Hz and 0.95 of half the rate; bands with nothing in them are left out."""
    trim, out = round(edge * rate), []
    if len(v) - 2 * trim < LEFT:
        return out
    for level in range(1, levels + 1):
        edges = np.linspace(low, 0.95 * rate / 2, 2**level + 1)
        for a, b in zip(edges, edges[1:], strict=False):
            passed = both_ways(system(ORDER, float(a), float(b), rate), v - v.mean())
            if passed is None:
                return out
            p = envelope(passed)[trim : len(v) - trim] ** 2
            if p.mean() >= FAINT_SQUARE:
                out.append((level, float(a), float(b), float((p**2).mean() / p.mean() ** 2 - 2)))
    return out


def kurtosis_bands(x: DataFrame, size: int, rate: float, edge: float = 0.1) -> DataFrame:
    """(rec, segment, level, low_hz, high_hz, kurtosis) of each segment of x (rec, n, value) that is finite and long enough."""
    kind = dict(x.dtypes)["rec"]

    def run(r: tuple) -> Iterator[tuple]:
        v = np.asarray(r.v, dtype=float)
        yield from ((r.rec, r.segment, *row) for row in (bank_kurtosis(v, rate, edge) if np.isfinite(v).all() else []))

    return by_rows(_values(x, size), f"rec {kind}, segment long, level int, low_hz double, high_hz double, kurtosis double", run)


def coherence(v: np.ndarray, rate: float, frame: int, hop: int, highest: float) -> list[tuple[int, int, float]]:
    """(shift, k, coherence): squared coherence over frames, at most 1, of the bins k and k + shift, for all shifts up to `highest` Hz, phases taken to one clock. Pairs with a bin of under 1e-8 of the greatest mean power are left out.
    Fewer than 16 frames give nothing."""
    if len(v) < frame + 15 * hop:
        return []
    z = np.fft.rfft(np.lib.stride_tricks.sliding_window_view(v - v.mean(), frame)[::hop] * hann(frame), axis=1)
    power = (np.abs(z) ** 2).mean(axis=0)
    loud, out = power > 1e-8 * power.max(), []
    for shift in range(1, min(len(power) - 2, int(highest * frame / rate)) + 1):
        turn = np.exp(-2j * np.pi * shift * hop * np.arange(len(z)) / frame)
        joint = np.abs((z[:, shift:] * z[:, :-shift].conj() * turn[:, None]).mean(axis=0)) ** 2
        k = np.nonzero(loud[shift:] & loud[:-shift])[0]
        out += [(shift, int(i), float(c)) for i, c in zip(k, np.minimum(1.0, joint[k] / (power[shift:] * power[:-shift])[k]), strict=True)]
    return out


def cyclic_map(x: DataFrame, size: int, rate: float, frame: int, highest: float = 300.0) -> DataFrame:
    """(rec, segment, shift, k, coherence) of each segment of x (rec, n, value) that is finite; frames overlap by three quarters. See `coherence`."""
    kind = dict(x.dtypes)["rec"]

    def run(r: tuple) -> Iterator[tuple]:
        v = np.asarray(r.v, dtype=float)
        yield from ((r.rec, r.segment, *row) for row in (coherence(v, rate, frame, frame // 4, highest) if np.isfinite(v).all() else []))

    return by_rows(_values(x, size), f"rec {kind}, segment long, shift int, k int, coherence double", run)


def strong_peaks(x: DataFrame, size: int, rate: float, low: float = 20.0) -> DataFrame:
    """(rec, segment, spacing, hz, amplitude): the MOST_PEAKS highest peaks of each segment's amplitude spectrum from `low` Hz on, 8 dB prominent at least; spacing is that of the bins."""
    kind = dict(x.dtypes)["rec"]

    def run(r: tuple) -> Iterator[tuple]:
        v = np.asarray(r.v, dtype=float)
        if len(v) < 4 or not np.isfinite(v).all():
            return
        a = amplitude_spectrum(v)
        if a.max() <= 0:
            return
        at = [i for i, _ in find_peaks(20 * np.log10(np.maximum(a, 1e-4 * a.max())), 8.0) if i * rate / len(v) >= low]
        for i in sorted(at, key=lambda i: (-a[i], i))[:MOST_PEAKS]:
            yield r.rec, r.segment, rate / len(v), i * rate / len(v), float(a[i])

    return by_rows(_values(x, size), f"rec {kind}, segment long, spacing double, hz double, amplitude double", run)


def _pairs(peaks: DataFrame) -> DataFrame:
    """Each peak with each one of its segment that isn't lower: a segment has MOST_PEAKS at most."""
    return peaks.join(peaks.select("rec", "segment", F.col("hz").alias("upper")), ["rec", "segment"]).filter("upper >= hz")


def harmonic_families(peaks: DataFrame) -> DataFrame:
    """(rec, segment, base_hz, members): peaks with MEMBERS peaks or more, itself among them, near whole multiples: within twice the bins' spacing, or 1 Hz."""
    near = F.abs(F.col("upper") - F.rint(F.col("upper") / F.col("hz")) * F.col("hz")) <= F.greatest(2 * F.col("spacing"), F.lit(1.0))
    return _pairs(peaks).filter(near).groupBy("rec", "segment", F.col("hz").alias("base_hz")).agg(F.array_sort(F.collect_list("upper")).alias("members")).filter(F.size("members") >= MEMBERS)


def peak_spacings(peaks: DataFrame) -> DataFrame:
    """(rec, segment, class, pairs): how many pairs of peaks are so far apart, in classes of CLASS Hz up to WIDEST; the last one holds its upper end."""
    apart = F.col("upper") - F.col("hz")
    return _pairs(peaks).filter((apart > 0) & (apart <= WIDEST)).groupBy("rec", "segment", F.least(F.floor(apart / CLASS), F.lit(int(WIDEST / CLASS) - 1)).alias("class")).agg(F.count("*").alias("pairs"))
