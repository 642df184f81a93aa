"""Analytic tests of the signal operators."""

import math

from pyspark.sql import functions as F

from cadenza.functions.scalars import decibels, significant
from cadenza.operators import signal as S
from cadenza.operators import spectra as P


def test_power_of_a_tone_is_its_mean_square(spark):
    x = S.tone(spark, 1000, 0.1, 0.064, 16000)
    p = P.power_spectra(x, 32, 8, 16000.0).groupBy("rec", "k").agg(F.avg("p").alias("p"))
    total, peak = p.agg(F.sum("p") * 16000 / 32, F.max_by("k", "p")).first()
    assert math.isclose(total, 0.005, rel_tol=0.02) and peak == 2


def test_silence_has_no_crest_and_short_segments_no_kurtosis(spark):
    x = spark.range(7).select(F.lit(0).alias("rec"), F.col("id").alias("n"), F.lit(0.0).alias("value"))
    rows = S.segment_stats(x, 5).orderBy("segment").collect()
    assert [r["n"] for r in rows] == [5, 2] and all(r["crest_db"] is None and r["kurtosis"] is None for r in rows)


def test_interpolation_holds_ends_and_hits(spark):
    x = spark.createDataFrame([(0, 0.0, 1.0), (0, 2.0, 5.0)], "rec int, t double, value double")
    grid = spark.createDataFrame([(0, -1.0), (0, 0.0), (0, 0.5), (0, 2.0), (0, 9.0)], "rec int, t double")
    assert [r["value"] for r in S.interpolate(x, grid).orderBy("t").collect()] == [1.0, 1.0, 2.0, 5.0, 5.0]


def test_level_step(spark):
    x = S.tone(spark, 1000, 0.1, 0.02, 16000).withColumn("value", F.when(F.col("n") < 160, F.col("value")).otherwise(F.col("value") * 4))
    assert [r["frame"] for r in S.level_changes(S.level_series(x, 160), 6.0).collect()] == [1]


def test_undefined_decibels_and_significant_digits(spark):
    r = spark.range(1).select(decibels(F.lit(0.0)).alias("a"), significant(F.lit(123456789.0)).alias("b")).first()
    assert r["a"] is None and r["b"] == 123456800.0
