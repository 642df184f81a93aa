"""Queries of features, on events made here."""

import datetime

from cadenza.plans.feature_queries import angular_average


def test_whole_rotations_count_in_spite_of_rounding(spark, tmp_path):
    # fifty steps of 0.1, whose sum is five rotations, but 4.999999999999998 as it is added up
    rows = [(i, datetime.datetime(2024, 1, 1, 0, i), 7, 6.0) for i in range(51)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    r = angular_average(spark, str(tmp_path)).collect()
    assert sorted((x.phase, x.turns, x["mean"], x.sd) for x in r) == [(k, 5, 6.0, 0.0) for k in range(4)]
