"""Shapes of spectra by segment: centred decibels at one resolution, what changes within a segment and between segments, and variants for control.

Spectra come as rows (rec, segment, frame, k, p), so all of this is windows and sums over one shuffle by segment or by bin. A window holds one segment, whose size is bounded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.scalars import relative_decibels
from cadenza.operators.spectra import power_spectra

#: The least energy (mean square) of a segment that isn't quiet; decibels under the greatest power at which
#: shapes are floored; the distance from the mean shape at which a frame is a transient; the power that stands for silence where floors are absolute.
QUIET, FLOOR_DB, TRANSIENT_DB, SILENCE = 1e-20, -60.0, 6.0, 1e-30


def segment_levels(x: DataFrame, segment: int, size: int) -> DataFrame:
    """(rec, segment, n, available): a segment with fewer samples than a frame, or a quiet one, is unavailable."""
    levels = x.groupBy("rec", F.floor(F.col("n") / segment).alias("segment")).agg(F.count("*").alias("n"), F.var_pop("value").alias("energy"))
    return levels.select("rec", "segment", "n", ((F.col("n") >= size) & (F.col("energy") >= QUIET)).alias("available"))


def segment_spectra(x: DataFrame, segment: int, size: int, hop: int) -> DataFrame:
    """(rec, segment, frame, k, p) of the available segments of x (rec, n, value), each centred by itself."""
    at = F.floor(F.col("n") / segment)
    p = power_spectra(x.select("rec", at.alias("segment"), (F.col("n") - at * segment).alias("n"), "value"), size, hop, keys=("rec", "segment"))
    return p.join(segment_levels(x, segment, size).filter("available").select("rec", "segment"), ["rec", "segment"])


def centred_levels(p: DataFrame, keys: list[str], floor_db: float | None) -> DataFrame:
    """(keys, k, db): decibels of each line of p (keys, k, p) less their mean; floored so far under the line's greatest power, or at SILENCE if floor_db is None."""
    line = Window.partitionBy(*keys)
    level = 10 * F.log10(F.greatest("p", F.lit(SILENCE))) if floor_db is None else relative_decibels(F.col("p"), F.max("p").over(line), floor_db)
    return p.select(*keys, "k", level.alias("db")).select(*keys, "k", (F.col("db") - F.avg("db").over(line)).alias("db"))


def segment_shapes(p: DataFrame, floor_db: float | None = FLOOR_DB) -> DataFrame:
    """(rec, segment, k, db): the centred shape of each segment's mean power."""
    return centred_levels(p.groupBy("rec", "segment", "k").agg(F.avg("p").alias("p")), ["rec", "segment"], floor_db)


def transients(p: DataFrame) -> DataFrame:
    """(rec, segment, frames, active, transient): frames, those with energy, and the share of these whose shape departs from the segment's by TRANSIENT_DB."""
    segment, frame, line = (Window.partitionBy("rec", "segment", *more) for more in ([], ["frame"], ["k"]))
    y = p.select("rec", "segment", "frame", "p", F.sum("p").over(frame).alias("energy"), F.max("p").over(frame).alias("most"), F.avg("p").over(line).alias("mean"))
    own, shape = relative_decibels(F.col("p"), F.col("most"), FLOOR_DB), relative_decibels(F.col("mean"), F.max("mean").over(segment), FLOOR_DB)
    y = y.select("rec", "segment", "frame", own.alias("own"), shape.alias("shape"), (F.max("frame").over(segment) + 1).alias("frames"), (F.col("energy") > F.max("energy").over(segment) * 10 ** (FLOOR_DB / 10)).alias("active"))
    # every frame has the same bins, so the mean over rows is the mean over bins
    y = y.select("rec", "segment", "frame", "frames", "active", (F.col("own") - F.avg("own").over(frame) - F.col("shape") + F.avg("shape").over(segment)).alias("apart"))
    far = y.filter("active").groupBy("rec", "segment", "frame").agg(F.sqrt(F.avg(F.col("apart") * F.col("apart"))).alias("d"), F.first("frames").alias("frames"))
    return far.groupBy("rec", "segment").agg(F.first("frames").alias("frames"), F.count("*").alias("active"), F.avg((F.col("d") > TRANSIENT_DB).cast("double")).alias("transient"))


def shape_summary(shapes: DataFrame) -> DataFrame:
    """(rec, k, q10, mid, q90) of each bin over a recording's segments."""
    q = F.percentile("db", F.array(*[F.lit(v) for v in (0.1, 0.5, 0.9)]))
    return shapes.groupBy("rec", "k").agg(q.alias("q")).select("rec", "k", *[F.col("q")[i].alias(n) for i, n in enumerate(("q10", "mid", "q90"))])


def temporal_distances(shapes: DataFrame) -> DataFrame:
    """(rec, segment, d): how far each segment's shape is from the middle one of its recording."""
    middle = shapes.groupBy("rec", "k").agg(F.median("db").alias("mid"))
    return shapes.join(middle, ["rec", "k"]).groupBy("rec", "segment").agg(F.sqrt(F.avg((F.col("db") - F.col("mid")) ** 2)).alias("d"))


def mean_shapes(x: DataFrame, segment: int, size: int, hop: int, low: int, high: int, floor_db: float | None) -> DataFrame:
    """(rec, k, db): shapes of the bins low to high, averaged over segments; nothing of recordings with an unavailable segment."""
    whole = segment_levels(x, segment, size).groupBy("rec").agg(F.bool_and("available").alias("whole")).filter("whole").select("rec")
    p = segment_spectra(x.join(whole, "rec"), segment, size, hop).filter(F.col("k").between(low, high))
    return segment_shapes(p, floor_db).groupBy("rec", "k").agg(F.avg("db").alias("db"))
