"""Attempts, totals and resumption on streams and tables. Reviews and budgets are in stateful.py."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attempts_once(stream: DataFrame, key: str, time: str, delay: str = "1 hour") -> DataFrame:
    """The first attempt of each key on a stream; repeats within the delay are dropped. One that comes later than that is taken for new: where a request must never be tried again, use the ledger of stateful.py, which keeps requests for ever."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def hourly_totals(stream: DataFrame, time: str, key: str, value: str, delay: str = "10 minutes") -> DataFrame:
    """Counts and sums by hour and key; rows later than the delay are left out."""
    x = stream.withWatermark(time, delay).groupBy(F.window(time, "1 hour").alias("w"), key).agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total"))
    return x.select(F.col("w.start").alias("start"), key, "n", "total")


def not_yet_done(requests: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Requests that a run which resumes still has to make: those whose digest has no result."""
    return requests.join(done.select(key), key, "left_anti")
