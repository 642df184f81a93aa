"""Queries that write recordings, on events made here."""

import datetime

from cadenza.plans.source_queries import recorded_samples


def test_values_of_more_than_16_bits_are_recorded(spark, tmp_path):
    values = [560.21, 546.1, 546.2, -600.0, 1.0, 30_000.0]
    rows = [(i, datetime.datetime(2024, 1, 1, 0, i), 7, v) for i, v in enumerate(values)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    r = recorded_samples(spark, str(tmp_path)).collect()
    assert [(x.rec, x.frames, x.reason, x.sum_0, x.sum_1, x.middle) for x in r] == [(7, 6, None, sum(round(v * 60) for v in values), 15, None)]
