"""Recursive filters of zero phase over recordings of any length.

A cascade of second-order sections is a linear system: what it does to its state over a block is an affine map, so the state at each block's start is a scan of affine maps (blocks.py). The
recording is filtered forward, then backward, each time from the state that a constant signal would leave, and is continued at both ends by its own point reflection.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.operators.blocks import BLOCK, by_rows, durable, few, packed, scan

#: Samples that a matrix product filters at once.
STRIDE = 128


def butterworth(order: int, low: float | None, high: float | None, rate: float) -> np.ndarray:
    """Sections (b0, b1, b2, a1, a2) of a Butterworth filter: low-pass up to `high` if low is None, high-pass from `low` if high is None, else band-pass of twice the order.

    Analog poles lie on the left half of a circle; the bilinear transform with warped edges moves them into the unit circle. Each conjugate pair is a section, each gain is 1 where the filter passes.
    """
    if order < 2 or order % 2:
        raise ValueError("orders are even")
    edges = [math.tan(math.pi * f / rate) for f in (low, high) if f is not None]
    if not edges or not all(0 < f < rate / 2 for f in (low, high) if f is not None) or edges != sorted(set(edges)):
        raise ValueError("band edges lie between 0 and half the rate, in order")
    circle = np.exp(1j * np.pi * (2 * np.arange(order) + order + 1) / (2 * order))
    if len(edges) == 2:
        half = circle * (edges[1] - edges[0]) / 2
        root = np.sqrt(half**2 - edges[0] * edges[1])
        poles, numerator, at = np.concatenate([half + root, half - root]), np.array([1.0, 0.0, -1.0]), 2 * math.atan(math.sqrt(edges[0] * edges[1]))
    elif low is None:
        poles, numerator, at = circle * edges[0], np.array([1.0, 2.0, 1.0]), 0.0
    else:
        poles, numerator, at = edges[0] / circle, np.array([1.0, -2.0, 1.0]), math.pi
    z = (1 + poles) / (1 - poles)
    e = np.exp(-1j * at * np.arange(3))
    sections = []
    for p in z[z.imag > 0]:
        a = np.array([1.0, -2 * p.real, abs(p) ** 2])
        sections.append([*(numerator / abs((numerator * e).sum() / (a * e).sum())), *a[1:]])
    if 2 * len(sections) != len(z):
        raise ValueError("the band is so wide that poles are real")
    return np.array(sections)


class System:
    """A cascade of sections as a linear system, with the matrices that filter STRIDE samples at once."""

    def __init__(self, sections: np.ndarray):
        n = 2 * len(sections)
        a, b, c, d = np.zeros((n, n)), np.zeros(n), np.zeros(n), 1.0
        for i, (b0, b1, b2, a1, a2) in enumerate(sections):
            s = slice(2 * i, 2 * i + 2)
            gain = np.array([b1 - a1 * b0, b2 - a2 * b0])
            a[s] = np.outer(gain, c)
            a[s, s] = [[-a1, 1.0], [-a2, 0.0]]
            b[s] = gain * d
            c, d = b0 * c, b0 * d
            c[2 * i] += 1.0
        self.a, self.n = a, n
        into, outof = [b], [c]
        for _ in range(STRIDE):
            into.append(a @ into[-1])
            outof.append(outof[-1] @ a)
        impulse = np.array([d, *[c @ x for x in into[: STRIDE - 1]]])
        lag = np.subtract.outer(np.arange(STRIDE), np.arange(STRIDE))
        self.direct = np.where(lag >= 0, impulse[np.maximum(lag, 0)], 0.0).T
        self.into, self.outof = np.array(into[:STRIDE][::-1]), np.array(outof[:STRIDE])
        self.stride = np.linalg.matrix_power(a, STRIDE)
        #: The state that a constant signal of 1 leaves.
        self.settled = np.linalg.solve(np.eye(n) - a, b)
        self.reach = 3 * (2 * len(sections) + 1 - min(int((sections[:, 2] == 0).sum()), int((sections[:, 4] == 0).sum())))

    def run(self, v: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The filtered samples, and the state after them."""
        whole, rest = divmod(len(v), STRIDE)
        rows = np.zeros((whole + (rest > 0), STRIDE))
        rows.ravel()[: len(v)] = v
        states = np.empty((len(rows) + 1, self.n))
        states[0] = state
        for i, step in enumerate(rows @ self.into):
            states[i + 1] = self.stride @ states[i] + step
        if rest:
            states[-1] = np.linalg.matrix_power(self.a, rest) @ states[-2] + v[len(v) - rest :] @ self.into[STRIDE - rest :]
        return (rows @ self.direct + states[:-1] @ self.outof.T).ravel()[: len(v)], states[-1]

    def over(self, length: int) -> np.ndarray:
        """What so many samples do to a state."""
        return np.linalg.matrix_power(self.a, length)


@lru_cache(maxsize=256)
def system(order: int, low: float | None, high: float | None, rate: float) -> System:
    return System(butterworth(order, low, high, rate))


def _affine(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The affine map (n x n matrix, then n numbers) of two, one after the other."""
    n = math.isqrt(len(first))
    a1, b1, a2, b2 = first[: n * n].reshape(n, n), first[n * n :], second[: n * n].reshape(n, n), second[n * n :]
    return np.concatenate([(a2 @ a1).ravel(), a2 @ b1 + b2])


def _or_none(f: float | None) -> float | None:
    return None if f is None or math.isnan(f) else float(f)


def zero_phase(x: DataFrame, designs: DataFrame, rate: float, size: int = BLOCK) -> DataFrame:
    """(rec, band, block, first, values, filtered): samples of x (rec, n, value), n from 0 without gaps, as blocks of `size`, centred (`values`) and filtered forward and backward by the Butterworth filters of designs
    (rec, band, order, low, high); see `butterworth` for low and high. A design of a recording too short to be continued at its ends, or with a value that isn't finite, gives no rows. The result doesn't
    depend on `size`, but for rounding.
    """
    kind = dict(x.dtypes)["rec"]
    most = designs.agg(F.max("order")).first()[0]
    if most is None:
        return x.sparkSession.createDataFrame([], f"rec {kind}, band string, block long, first long, values array<double>, filtered array<double>")
    reach = 3 * (2 * int(most) + 1)
    size = max(size, reach + 1)
    finite = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf"))
    about = x.groupBy("rec").agg(F.count("*").alias("total"), F.avg("value").alias("mean"), F.min(finite).alias("finite")).filter("finite")
    # one row for each block to be, so that a long recording isn't one key of the join
    plan = about.join(designs, "rec").withColumn("last", F.floor((F.col("total") - 1) / size)).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))))
    blocks = durable(packed(x, ["value"], size, before=reach).join(plan, ["rec", "block"]))

    def head(r: tuple) -> tuple[System, int, np.ndarray, np.ndarray]:
        """The system, what is continued at either end, the centred samples with those before the block, the block's own."""
        s = system(int(r.order), _or_none(r.low), _or_none(r.high), rate)
        every = np.asarray(r.value) - r.mean
        return s, s.reach, every, every[r.block * size - r.first :]

    def forward(r: tuple) -> Iterator[tuple]:
        s, reach, _, own = head(r)
        if r.total <= reach:
            return
        if r.block == 0:
            led = np.concatenate([2 * own[0] - own[reach:0:-1], own])
            item = np.concatenate([np.zeros(s.n**2), s.run(led, s.settled * led[0])[1]])
        else:
            item = np.concatenate([s.over(len(own)).ravel(), s.run(own, np.zeros(s.n))[1]])
        yield r.rec, r.band, r.block, item

    own = f"rec {kind}, band string, "
    states = few(durable(scan(durable(by_rows(blocks, own + "place long, item array<double>", forward)), ["rec", "band"], _affine)).withColumnRenamed("place", "block"))

    def onward(r: tuple) -> Iterator[tuple]:
        """Forward output, on the last block with what continues it."""
        s, reach, every, own = head(r)
        led = own
        if r.block == r.last:
            led = np.concatenate([led, 2 * own[-1] - every[-2 : -reach - 2 : -1]])
        if r.block == 0:
            lead = 2 * own[0] - own[reach:0:-1]
            out = s.run(np.concatenate([lead, led]), s.settled * lead[0])[0][reach:]
        else:
            out = s.run(led, np.asarray(r.before)[s.n**2 :])[0]
        yield r.rec, r.band, r.block, r.last, r.order, r.low, r.high, own, out

    going = durable(by_rows(blocks.join(states, ["rec", "band", "block"]), own + "block long, last long, order int, low double, high double, values array<double>, out array<double>", onward))

    def backward(r: tuple) -> Iterator[tuple]:
        s, back = system(int(r.order), _or_none(r.low), _or_none(r.high), rate), np.asarray(r.out)[::-1]
        if r.block == r.last:
            item = np.concatenate([np.zeros(s.n**2), s.run(back, s.settled * back[0])[1]])
        else:
            item = np.concatenate([s.over(len(back)).ravel(), s.run(back, np.zeros(s.n))[1]])
        yield r.rec, r.band, r.last - r.block, item

    states = durable(scan(durable(by_rows(going, own + "place long, item array<double>", backward)), ["rec", "band"], _affine))

    def home(r: tuple) -> Iterator[tuple]:
        s, back = system(int(r.order), _or_none(r.low), _or_none(r.high), rate), np.asarray(r.out)[::-1]
        state = s.settled * back[0] if r.block == r.last else np.asarray(r.before)[s.n**2 :]
        yield r.rec, r.band, r.block, r.block * size, r.values, s.run(back, state)[0][::-1][: len(r.values)]

    joined = going.withColumn("place", F.col("last") - F.col("block")).join(few(states), ["rec", "band", "place"])
    return by_rows(joined, own + "block long, first long, values array<double>, filtered array<double>", home)
