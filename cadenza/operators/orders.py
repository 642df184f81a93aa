"""Order analysis at a known base frequency: spectra by multiples of a rotation instead of Hz, over recordings of any length.

The phase is a scan of block sums. Each block of time gives the samples at equal angles that fall into it; blocks of angle, which know nothing of the blocks of time, collect these with
what frames, lags and the envelope need around them, and give sums that add up over blocks. No step needs a recording in one place.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.operators.blocks import BLOCK, by_rows, durable, few, packed, scan
from cadenza.operators.filters import zero_phase
from cadenza.operators.spectra import envelope, hann

#: Frames of a block of angle; the order of the low-pass before angular sampling; least whole rotations; least samples.
ANGLE_FRAMES, LOW_PASS, LEAST_CYCLES, LEAST = 16, 8, 4, 64


@dataclass(frozen=True)
class Orders:
    """Samples of a rotation, rotations of a frame, the highest order shown, what is left out at either end in seconds."""

    per_cycle: int = 512
    cycles: int = 8
    highest: float = 20.0
    edge: float = 0.05

    def __post_init__(self):
        if not 32 <= self.per_cycle <= 4096 or not 2 <= self.cycles <= 64 or self.highest <= 0 or self.edge < 0 or not math.isfinite(self.highest + self.edge):
            raise ValueError("orders can't be taken so")


def _status(x: DataFrame, rate: float, config: Orders) -> DataFrame:
    """(rec, total, low_hz, high_hz, cutoff, usable, trim, status) of each recording: null status as far as the recording can be analysed by what is known before its phase."""
    good = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    about = x.groupBy("rec").agg(F.count("*").alias("total"), F.min("base").alias("low_hz"), F.max("base").alias("high_hz"), F.min(good("value") & good("base") & (F.col("base") > 0)).alias("fit"))
    about = about.withColumn("cutoff", F.least(F.lit(0.45 * rate), 0.4 * config.per_cycle * F.col("low_hz"))).withColumn("usable", 0.8 * F.col("cutoff") / F.nullif(F.col("high_hz"), F.lit(0.0))).withColumn("trim", F.lit(max(1, math.floor(config.edge * rate + 0.5))))
    status = F.when((F.col("total") < LEAST) | ~F.col("fit"), "invalid").when(F.lit(config.highest) > F.col("usable"), "bandwidth").when(2 * F.col("trim") >= F.col("total"), "short")
    return about.withColumn("status", status).drop("fit")


def angular_samples(x: DataFrame, rate: float, config: Orders = Orders(), size: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(rec, ..., first_cycle, cycles, status) of each recording of x (rec, n, value, base), n from 0 without gaps and base in Hz at each sample; and of those whose status is `available`
    (rec, start, values, times): runs of samples at equal angles, start counting from the first whole rotation, of the low-passed recording.

    Status `invalid`: under 64 samples, or a value that isn't finite, or a base that isn't above 0; `bandwidth`: the highest order lies beyond what base and rate resolve; `short`: fewer than four whole
    rotations between the ends left out.
    """
    kind = dict(x.dtypes)["rec"]
    about = durable(_status(x, rate, config))
    fit = about.filter("status is null")
    own = x.join(few(fit.select("rec")), "rec", "left_semi")
    smooth = zero_phase(own.select("rec", "n", "value"), fit.select("rec", F.lit("low").alias("band"), F.lit(LOW_PASS).alias("order"), F.lit(None).cast("double").alias("low"), F.col("cutoff").alias("high")), rate, size)
    smooth = durable(smooth.select("rec", "first", "filtered"))
    # speeds in the same blocks of time, each from the last sample of the block before on
    size = max(size, 3 * (2 * LOW_PASS + 1) + 1)
    speeds = durable(packed(own, ["base"], size, before=1))

    def turning(base: np.ndarray) -> np.ndarray:
        v = np.asarray(base)
        return np.concatenate([[0.0], np.cumsum((v[1:] + v[:-1]) / 2 / rate)])

    ahead = durable(scan(durable(by_rows(speeds, f"rec {kind}, place long, item array<double>", lambda r: iter([(r.rec, r.block, turning(r.base)[-1:])]))), ["rec"], np.add))
    ahead = ahead.select("rec", F.col("place").alias("block"), F.coalesce(F.col("before")[0], F.lit(0.0)).alias("before"))
    smooth = smooth.withColumn("block", F.floor(F.col("first") / size))
    found = speeds.withColumnRenamed("first", "since").join(smooth, ["rec", "block"]).join(few(ahead), ["rec", "block"])
    # where one block ends, the next one begins, to the last bit
    found = found.join(few(ahead.select("rec", (F.col("block") - 1).alias("block"), F.col("before").alias("upto"))), ["rec", "block"], "left")
    found = found.join(smooth.select("rec", (F.col("block") + 1).alias("block"), F.element_at("filtered", -1).alias("last")), ["rec", "block"], "left")

    def phases(r: tuple) -> tuple[np.ndarray, np.ndarray]:
        """Rotations and filtered samples from the last sample of the block before on."""
        cycles, y = r.before + turning(r.base), np.asarray(r.filtered)
        if not math.isnan(r.upto):
            cycles[-1] = r.upto
        return cycles, y if r.block == 0 else np.concatenate([[r.last], y])

    found = durable(found.join(few(fit.select("rec", "total", "trim")), "rec"))

    def ends(r: tuple) -> Iterator[tuple]:
        cycles, _ = phases(r)
        for k, n in enumerate((r.trim, r.total - r.trim - 1)):
            if r.first <= n < r.since + len(cycles):
                yield r.rec, k, float(cycles[n - r.since])

    marks = by_rows(found, f"rec {kind}, k int, cycles double", ends).groupBy("rec").agg(F.max(F.when(F.col("k") == 0, F.ceil("cycles"))).alias("first_cycle"), F.max(F.when(F.col("k") == 1, F.floor("cycles"))).alias("last_cycle"))
    whole = F.col("last_cycle") - F.col("first_cycle")
    about = durable(about.join(marks, "rec", "left").withColumn("cycles", F.greatest(whole, F.lit(0))).withColumn("status", F.coalesce("status", F.when(whole >= LEAST_CYCLES, "available").otherwise("short"))).drop("last_cycle"))
    step = config.per_cycle

    def turns(r: tuple) -> Iterator[tuple]:
        cycles, y = phases(r)
        # what falls on a block's very first place belongs to the block before, which ends there
        start = math.ceil((cycles[0] - r.first_cycle) * step) if r.block == 0 else math.floor((cycles[0] - r.first_cycle) * step) + 1
        at = np.arange(max(start, 0), min(math.floor((cycles[-1] - r.first_cycle) * step) + 1, r.cycles * step))
        if len(at):
            where = r.first_cycle + at / step
            yield r.rec, int(at[0]), np.interp(where, cycles, y), np.interp(where, cycles, (r.since + np.arange(len(cycles))) / rate)

    ready = found.join(few(about.filter("status = 'available'").select("rec", "first_cycle", "cycles")), "rec")
    return about, by_rows(ready, f"rec {kind}, start long, values array<double>, times array<double>", turns)


def order_analysis(x: DataFrame, rate: float, config: Orders = Orders(), size: int = BLOCK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What x (rec, n, value, base) gives by orders, see angular_samples, as three tables: about (rec, ..., status, mean_square, power) of each recording; curves (rec, curve, k, at, value), and maps (rec, frame, seconds, k, at, p).

    Curves: `psd` and `envelope_psd`, the mean density of Hann frames without their means, `at` an order up to the highest; `mean` and `std` of a rotation, `at` a phase; `autocorrelation`, 1 at lag 0, `at` a lag in rotations up to two. Frames overlap by half.
    The envelope is that of the analytic signal of a block of angle with a frame on both sides, so it differs a little from that of the whole recording. Maps hold the density of each frame, at the time of its middle.
    """
    kind = dict(x.dtypes)["rec"]
    about, runs = angular_samples(x, rate, config, size)
    step, runs = config.per_cycle, durable(runs)
    shape = few(about.filter("status = 'available'").select("rec", "cycles", (F.least(F.col("cycles"), F.lit(config.cycles)) * step).alias("frame")))

    def dealt(r: tuple) -> Iterator[tuple]:
        """Each run to the blocks of angle that need a part of it."""
        span, margin = ANGLE_FRAMES * (r.frame // 2), 2 * max(r.frame, 2 * step)
        blocks = max(1, -(-(r.cycles * step) // span))
        v, t = np.asarray(r.values), np.asarray(r.times)
        for b in range(max(0, (r.start - margin) // span), min(blocks - 1, (r.start + len(v) - 1 + margin) // span) + 1):
            a, z = max(r.start, b * span - margin), min(r.start + len(v), (b + 1) * span + margin)
            if a < z:
                yield r.rec, b, r.frame, r.cycles, a, v[a - r.start : z - r.start], t[a - r.start : z - r.start]

    parts = by_rows(runs.join(shape, "rec"), f"rec {kind}, block long, frame long, cycles long, start long, values array<double>, times array<double>", dealt)
    blocks = durable(parts.groupBy("rec", "block", "frame", "cycles").agg(F.sort_array(F.collect_list(F.struct("start", "values", "times"))).alias("v")).select("rec", "block", "frame", "cycles", F.col("v")[0]["start"].alias("start"), F.flatten("v.values").alias("values"), F.flatten("v.times").alias("times")))

    def framed(v: np.ndarray, starts: np.ndarray, frame: int) -> np.ndarray:
        w = hann(frame)
        f = v[starts[:, None] + np.arange(frame)]
        p = np.abs(np.fft.rfft((f - f.mean(axis=1, keepdims=True)) * w, axis=1)) ** 2 / (step * (w**2).sum())
        p[:, 1 : (frame + 1) // 2] *= 2
        return p

    def own(r: tuple) -> tuple[np.ndarray, int, int, np.ndarray]:
        """The samples, where the block's own ones begin and end among them, and where its frames begin."""
        span, total = ANGLE_FRAMES * (r.frame // 2), r.cycles * step
        starts = np.arange(r.block * ANGLE_FRAMES, (r.block + 1) * ANGLE_FRAMES) * (r.frame // 2)
        return np.asarray(r.values), r.block * span - r.start, min((r.block + 1) * span, total) - r.start, starts[starts + r.frame <= total] - r.start

    def shown(frame: int) -> int:
        return min(int(config.highest * frame / step + 1e-9), frame // 2) + 1

    def sums(r: tuple) -> Iterator[tuple]:
        v, a, z, starts = own(r)
        if len(starts):
            for name, y in (("psd", v), ("envelope_psd", envelope(v))):
                p = framed(y, starts, r.frame)
                yield r.rec, name, r.frame, len(starts), p.sum(axis=0)[: shown(r.frame)], float(p.sum())
        mine = v[a:z]
        phase = (np.arange(a, z) + r.start) % step
        yield r.rec, "mean", r.frame, 0, np.bincount(phase, mine, step), float((mine**2).sum())
        yield r.rec, "square", r.frame, 0, np.bincount(phase, mine**2, step), 0.0
        n = 1 << (len(v) + len(mine) - 1).bit_length()
        lags = np.fft.irfft(np.fft.rfft(v[a:], n) * np.fft.rfft(mine, n).conj(), n)[: 2 * step + 1]
        yield r.rec, "autocorrelation", r.frame, 0, np.pad(lags, (0, 2 * step + 1 - len(lags))), 0.0

    added = by_rows(blocks, f"rec {kind}, curve string, frame long, frames long, v array<double>, whole double", sums)
    wholes = durable(added.select("rec", "curve", "frame", "frames", "whole", F.posexplode("v").alias("k", "value")).groupBy("rec", "curve", "frame", "k").agg(F.sum("value").alias("value"), F.sum("frames").alias("frames"), F.sum("whole").alias("whole")).join(shape.select("rec", "cycles"), "rec"))
    totals = wholes.filter("k = 0").groupBy("rec").agg(F.max(F.when(F.col("curve") == "mean", F.col("whole") / (F.col("cycles") * step))).alias("mean_square"), F.max(F.when(F.col("curve") == "psd", F.col("whole") / F.col("frames") * step / F.col("frame"))).alias("power"))
    psd = wholes.filter("curve in ('psd', 'envelope_psd')").select("rec", "curve", "k", (F.col("k") * step / F.col("frame")).alias("at"), (F.col("value") / F.col("frames")).alias("value"))
    rotation = wholes.filter("curve in ('mean', 'square')").groupBy("rec", "k").agg(*[F.max(F.when(F.col("curve") == c, F.col("value") / F.col("cycles"))).alias(c) for c in ("mean", "square")])
    turn = rotation.select("rec", "k", F.explode(F.create_map(F.lit("mean"), F.col("mean"), F.lit("std"), F.sqrt(F.greatest(F.col("square") - F.col("mean") * F.col("mean"), F.lit(0.0))))).alias("curve", "value"))
    lags = wholes.filter("curve = 'autocorrelation'").withColumn("peak", F.max(F.when(F.col("k") == 0, F.col("value"))).over(Window.partitionBy("rec")))
    lags = lags.select("rec", "curve", "k", (F.col("k") / step).alias("at"), F.when(F.col("peak") > 0, F.col("value") / F.col("peak")).otherwise(0.0).alias("value"))
    curves = psd.unionByName(turn.select("rec", "curve", "k", (F.col("k") / step).alias("at"), "value")).unionByName(lags)

    def frames(r: tuple) -> Iterator[tuple]:
        v, _, _, starts = own(r)
        if len(starts):
            times, count = np.asarray(r.times), shown(r.frame)
            for i, p in enumerate(framed(v, starts, r.frame)):
                yield r.rec, r.block * ANGLE_FRAMES + i, float(times[starts[i] + r.frame // 2]), r.frame, p[:count]

    maps = by_rows(blocks, f"rec {kind}, frame long, seconds double, size long, p array<double>", frames)
    maps = maps.select("rec", "frame", "seconds", F.posexplode("p").alias("k", "p"), "size").select("rec", "frame", "seconds", "k", (F.col("k") * step / F.col("size")).alias("at"), "p")
    return about.join(totals, "rec", "left"), curves, maps


def order_peaks(curves: DataFrame, most: int = 10) -> DataFrame:
    """(rec, rank, order, density): the highest local maxima of the order spectrum, the lower order first among equals."""
    spectrum = curves.filter("curve = 'psd'")
    around = Window.partitionBy("rec").orderBy("k")
    tops = spectrum.withColumn("l", F.lag("value").over(around)).withColumn("r", F.lead("value").over(around)).filter("value > l and value > r")
    return tops.withColumn("rank", F.row_number().over(Window.partitionBy("rec").orderBy(F.desc("value"), "k"))).filter(F.col("rank") <= most).select("rec", "rank", F.col("at").alias("order"), F.col("value").alias("density"))
