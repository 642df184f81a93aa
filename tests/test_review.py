"""Ordered state in batch and on a stream, and learning."""

import random

import pytest
from pyspark.sql import functions as F

from cadenza.operators import learning as L
from cadenza.streaming import review as R


def test_attempts_and_windows_on_a_stream(spark, tmp_path):
    x = spark.createDataFrame([("a", "2026-01-01 00:10:00", 1.0), ("a", "2026-01-01 00:20:00", 2.0), ("b", "2026-01-01 01:10:00", 3.0)], "k string, t string, v double").withColumn("t", F.col("t").cast("timestamp"))
    x.coalesce(1).write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema(x.schema).parquet(str(tmp_path / "in"))
    for name, df, mode in (("once", R.attempts_once(read(), "k", "t"), "append"), ("hours", R.hourly_totals(read(), "t", "k", "v"), "complete")):
        df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination(120)
    assert spark.table("once").count() == 2
    assert {(r["k"], r["n"], r["total"]) for r in spark.table("hours").collect()} == {("a", 2, 3.0), ("b", 1, 3.0)}


def test_gate_and_specialist(spark):
    good = spark.createDataFrame([(1, "a", "t", "p"), (2, "b", "t", "p")], "id long, label string, teacher string, prompt string")
    assert L.gate_targets(good) == [] and L.gate_targets(good.filter("id = 1")) == ["fewer than two classes"] and "repeated ids" in L.gate_targets(good.union(good))
    rng = random.Random(1)
    data = [(i, i, [rng.gauss(3 * (i % 3), 1), rng.gauss(0, 9)], "abc"[i % 3]) for i in range(300)]
    x = spark.createDataFrame(data, "id long, arrival long, features array<double>, label string")
    curve = {r["size"]: r["correct"] / r["n"] for r in L.arrival_prefixes(x.filter("id < 200"), x.filter("id >= 200"), [20, 199]).collect()}
    assert curve[199] > 0.85 and min(curve.values()) > 0.6
    assert L.predict(L.fit_specialist(x), x).filter("score between 0 and 1").count() == 300


@pytest.mark.parametrize("n", [0, 5])
def test_nothing_is_done_twice(spark, n):
    x = spark.range(5).withColumnRenamed("id", "k")
    assert R.not_yet_done(x, spark.range(n).withColumnRenamed("id", "k"), "k").count() == 5 - n
