"""Least distance of two vectors over all shifts, from one cross-correlation instead of a slice for each shift."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from cadenza.operators.blocks import by_rows

#: Share of the fewer finite values of both overlapping parts that must be finite in both.
OVERLAP = 0.2


def _correlated(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """The sum over i of a[i + s] b[i], for s from -most to most."""
    n = 1 << (len(a) + len(b) - 1).bit_length()
    full = np.fft.irfft(np.fft.rfft(a, n) * np.fft.rfft(b, n).conj(), n)
    return full[np.arange(-most, most + 1) % n]


def spread(a: np.ndarray, b: np.ndarray, shift: int) -> float | None:
    """The deviation of a[i + shift] - b[i] where both are finite: the root mean square of the difference of both parts, each without its mean there. None where too few are."""
    n = min(len(a), len(b) + shift) - max(0, shift)
    x, y = a[max(0, shift) :][:n], b[max(0, -shift) :][:n]
    u, v = np.isfinite(x), np.isfinite(y)
    if n < 1 or (u & v).sum() < max(1, OVERLAP * min(u.sum(), v.sum())):
        return None
    return float(np.std(x[u & v] - y[u & v]))


def least_shift(a: np.ndarray, b: np.ndarray, most: int) -> tuple[float, int] | None:
    """(distance, shift) of the shift by `most` places at most with the least `spread`, the smaller shift, then the one to the left, among equals; None if no shift has enough in common.

    Over the overlap of any shift, sums of values, squares and products, of what is finite in both, are correlations of the masked vectors; those within rounding of the best are taken anew.
    """
    most = min(most, max(len(a), len(b)) - 1)
    u, v = np.isfinite(a).astype(float), np.isfinite(b).astype(float)
    if not u.any() or not v.any():
        return None
    # the same for both, so it changes no difference; it keeps sums small
    level = np.concatenate([a[u > 0], b[v > 0]]).mean()
    x, y = np.where(u > 0, a - level, 0.0), np.where(v > 0, b - level, 0.0)
    c = lambda p, q: _correlated(p, q, most)
    n = np.rint(c(u, v))
    mine, other = np.rint(c(u, np.ones(len(b)))), np.rint(c(np.ones(len(a)), v))
    enough = n >= np.maximum(1, OVERLAP * np.minimum(mine, other))
    safe = np.maximum(n, 1)
    difference = (c(x, v) - c(u, y)) / safe
    square = np.maximum((c(x * x, v) - 2 * c(x, y) + c(u, y * y)) / safe - difference**2, 0)
    if not enough.any():
        return None
    near = enough & (square <= square[enough].min() + 1e-9 * max(1.0, float((x * x).max() + (y * y).max())))
    found = [(d, abs(s), s) for s in (np.nonzero(near)[0] - most).tolist() if (d := spread(a, b, s)) is not None]
    # rounding aside, equal distances are one
    best = min(d for d, _, _ in found)
    d, _, s = min((f for f in found if f[0] <= best + 1e-12 * max(1.0, best)), key=lambda f: f[1:])
    return d, s


def shift_distances(pairs: DataFrame, keys: list[str], most: int) -> DataFrame:
    """(key..., distance, shift) of pairs (key..., a, b) of arrays; null, NaN and infinite components count as absent. Pairs without enough in common at any shift have nulls."""
    kinds = dict(pairs.dtypes)

    def run(r: tuple) -> Iterator[tuple]:
        a, b = (np.array([np.nan if x is None else x for x in v], dtype=float) if v is not None else np.empty(0) for v in (r.a, r.b))
        found = least_shift(a, b, most) if len(a) and len(b) else None
        yield (*(getattr(r, k) for k in keys), *(found or (None, None)))

    return by_rows(pairs.select(*keys, "a", "b"), ", ".join(f"{k} {kinds[k]}" for k in keys) + ", distance double, shift int", run)
