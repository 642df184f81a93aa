"""Signal operators on long tables (rec, n, value): windows, levels, spectra, interpolation."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.operators.blocks import numbered


def samples(events: DataFrame) -> DataFrame:
    """Events as recordings: one for each user, samples in order of time, numbered within weeks and weeks by what precedes them."""
    return numbered(events, F.col("user_id"), period="week").select("rec", "n", "value")


def tone(spark: SparkSession, hz: float, amplitude: float, seconds: float, rate: int, rec: int = 0) -> DataFrame:
    """A synthetic recording."""
    return spark.range(int(seconds * rate)).select(F.lit(rec).cast("long").alias("rec"), F.col("id").alias("n"), (amplitude * F.sin(2 * math.pi * hz * F.col("id") / rate)).alias("value"))


def segment_stats(x: DataFrame, size: int) -> DataFrame:
    """Scalar measurements of each fixed segment; what is undefined is null. Kurtosis is the unbiased Pearson one."""
    n, g = F.count("*"), F.kurtosis("value")
    rms = F.sqrt(F.avg(F.col("value") * F.col("value")))
    crest = F.when(rms > 0, 20 * F.log10(F.max(F.abs("value")) / F.nullif(rms, F.lit(0.0))))
    kurtosis = F.when((n >= 4) & (F.stddev_pop("value") > 1e-15), 3 + (n - 1) / ((n - 2) * F.nullif(n - 3, F.lit(0))) * ((n + 1) * g + 6))
    return x.groupBy("rec", F.floor(F.col("n") / size).alias("segment")).agg(
        n.alias("n"), F.avg("value").alias("mean"), rms.alias("rms"), F.stddev_pop("value").alias("ac_rms"), F.max(F.abs("value")).alias("peak"), crest.alias("crest_db"), kurtosis.alias("kurtosis")
    )


def level_series(x: DataFrame, size: int) -> DataFrame:
    return x.groupBy("rec", F.floor(F.col("n") / size).alias("frame")).agg(F.count("*").alias("n"), F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rms"), F.min("value").alias("low"), F.max("value").alias("high"))


def level_changes(levels: DataFrame, least_db: float) -> DataFrame:
    """Frames whose level differs from the one before by least_db or more."""
    db = 20 * F.log10(F.greatest("rms", F.lit(1e-15)))
    step = db - F.lag(db).over(Window.partitionBy("rec").orderBy("frame"))
    return levels.withColumn("step_db", step).filter(F.abs("step_db") >= least_db)


def interpolate(x: DataFrame, grid: DataFrame) -> DataFrame:
    """(rec, t, value): linear interpolation of x (rec, t, value) at grid (rec, t); ends are held. One sort for each recording, no range join."""
    both = x.select("rec", "t", "value", F.col("t").alias("at"), F.lit(0).alias("g")).unionByName(grid.select("rec", "t", F.lit(None).cast("double").alias("value"), F.lit(None).cast("double").alias("at"), F.lit(1).alias("g")))
    order = Window.partitionBy("rec").orderBy("t", "g")
    back, ahead = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)
    near = both.select("rec", "t", "g", *[f(c, ignorenulls=True).over(w).alias(a) for f, w, c, a in ((F.last, back, "value", "v0"), (F.last, back, "at", "t0"), (F.first, ahead, "value", "v1"), (F.first, ahead, "at", "t1"))])
    value = F.when(F.col("v0").isNull(), F.col("v1")).when(F.col("v1").isNull() | (F.col("t") == F.col("t0")), F.col("v0"))
    return near.filter("g = 1").select("rec", "t", value.otherwise(F.col("v0") + (F.col("v1") - F.col("v0")) * (F.col("t") - F.col("t0")) / (F.col("t1") - F.col("t0"))).alias("value"))


def local_maxima(spectrum: DataFrame, most: int) -> DataFrame:
    """The highest strict local maxima of (rec, k, p), ties to the lower k."""
    order = Window.partitionBy("rec").orderBy("k")
    peaks = spectrum.withColumn("l", F.lag("p").over(order)).withColumn("r", F.lead("p").over(order)).filter("p > l and p > r")
    return peaks.withColumn("rank", F.row_number().over(Window.partitionBy("rec").orderBy(F.desc("p"), "k"))).filter(F.col("rank") <= most).select("rec", "rank", "k", "p")
