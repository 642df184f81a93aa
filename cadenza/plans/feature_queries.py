"""Queries of shapes, speed and features on events, one recording for each user, with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.functions.strict_json import canonical_json
from cadenza.operators import features as E
from cadenza.operators import shapes as H
from cadenza.operators import signal as S

#: Samples of a segment, a frame and a hop; points of a rotation.
SEGMENT, SIZE, HOP, POINTS = 24, 16, 4, 4
#: Share of a sum of steps that rounding may take from it.
ROUNDING = 1e-9


def _x(spark: SparkSession, d: str) -> DataFrame:
    return S.samples(spark.read.parquet(f"{d}/events.parquet"))


def _p(spark: SparkSession, d: str) -> DataFrame:
    return H.segment_spectra(_x(spark, d), SEGMENT, SIZE, HOP)


def shape_segments(spark, d):
    """Status, frames and transients of each segment."""
    x, p = _x(spark, d), _p(spark, d)
    found = H.transients(p)
    status = F.when(F.col("available"), "available").otherwise("unavailable").alias("status")
    return H.segment_levels(x, SEGMENT, SIZE).join(found, ["rec", "segment"], "left").select("rec", "segment", "n", status, "frames", "active", F.round("transient", 6).alias("transient"))


def shape_quantiles(spark, d):
    return H.shape_summary(H.segment_shapes(_p(spark, d))).select("rec", "k", *[F.round(c, 5).alias(c) for c in ("q10", "mid", "q90")])


def temporal_distance(spark, d):
    return H.temporal_distances(H.segment_shapes(_p(spark, d))).select("rec", "segment", F.round("d", 5).alias("d"))


def baseline_shape(spark, d):
    """Mean shapes of blocks; a recording with a short or quiet block is unavailable and has no bins."""
    x = _x(spark, d)
    shape = H.mean_shapes(x, SEGMENT, SIZE, HOP, 0, SIZE // 2, None)
    status = F.when(F.col("k").isNull(), "unavailable").otherwise("available").alias("status")
    return x.select("rec").distinct().join(shape, "rec", "left").select("rec", status, "k", F.round("db", 5).alias("db"))


def controlled_shapes(spark, d):
    """Mean shapes with the band alone, with a relative floor, and with frames of half the length."""
    x = _x(spark, d)
    variants = {"band": (SIZE, HOP, None), "floor": (SIZE, HOP, H.FLOOR_DB), "half": (SIZE // 2, HOP // 2, H.FLOOR_DB)}
    out = None
    for name, (size, hop, floor) in variants.items():
        part = H.mean_shapes(x, SEGMENT, size, hop, 1, size // 2 - 1, floor).select("rec", F.lit(name).alias("variant"), "k", F.round("db", 5).alias("db"))
        out = part if out is None else out.unionByName(part)
    return out


def angular_average(spark, d):
    """Values at equal steps of rotation, by the place in the rotation: |value| is the speed, whole inner rotations count, four at least.

    A recording that ends with a whole rotation has it, even if the sum of its steps falls short of it by rounding."""
    w = Window.partitionBy("rec").orderBy("n")
    x = _x(spark, d).withColumn("step", (F.abs("value") + F.lag(F.abs("value")).over(w)) / 120)
    x = x.select("rec", F.coalesce(F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0)).alias("t"), "value")
    turns = x.groupBy("rec").agg(F.floor(F.max("t") * (1 + ROUNDING)).alias("turns")).filter("turns >= 4")
    grid = turns.select("rec", F.explode(F.sequence(F.lit(0).cast("long"), F.col("turns") * POINTS - 1)).alias("j")).select("rec", "j", (F.col("j") / float(POINTS)).alias("t"))
    at = S.interpolate(x, grid.select("rec", "t")).join(grid, ["rec", "t"])
    return at.groupBy("rec", (F.col("j") % POINTS).alias("phase")).agg(F.count("*").alias("turns"), F.round(F.avg("value"), 5).alias("mean"), F.round(F.stddev_pop("value"), 5).alias("sd"))


def canonical_props(spark, d):
    """Properties in canonical form; null where a key is unknown or stands twice, or a number isn't finite."""
    x = spark.read.parquet(f"{d}/events.parquet")
    return x.select("event_id", canonical_json("props", frozenset({"k"})).alias("props"))


def reassigned_map(spark, d):
    """Powers relocated to their centres in time and frequency, summed in cells."""
    x = E.reassigned(_x(spark, d), 64, SIZE, HOP, 1.0)
    return x.groupBy("rec", "segment", F.floor(F.col("t") / 16).alias("row"), F.floor(F.col("f") * 8).alias("col")).agg(F.sum("p").alias("p"), F.count("*").alias("n"))


def cepstral_features(spark, d):
    return E.segment_features(_x(spark, d), 64, 8000.0, "cepstral")


def resampled(spark, d):
    """Segments resampled at three halves of their rate."""
    return E.segment_features(_x(spark, d), 64, 1.5, "resampled").select("rec", "segment", F.posexplode("values").alias("n", "value"))


def speed_matched(spark, d):
    """Segments resampled as if their mean speed, |value|, had been 100."""
    return E.segment_features(_x(spark, d), 64, 100.0, "speed_matched").select("rec", "segment", F.posexplode("values").alias("n", "value"))


_X = "x AS (SELECT user_id AS rec, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n, value FROM events)"


def _spectra(size: int, hop: int) -> str:
    weight = sum((0.5 - 0.5 * math.cos(2 * math.pi * i / size)) ** 2 for i in range(size))
    return f"""WITH {_X}, c AS (SELECT rec, n // {SEGMENT} AS segment, n % {SEGMENT} AS n, value - avg(value) OVER s AS v, count(*) OVER s AS total, var_pop(value) OVER s AS energy FROM x WINDOW s AS (PARTITION BY rec, n // {SEGMENT})),
g AS (SELECT rec, segment, any_value(total) AS n, any_value(total) >= {size} AND any_value(energy) >= {H.QUIET}::DOUBLE AS ok FROM c GROUP BY 1, 2), u AS (SELECT rec FROM g GROUP BY 1 HAVING bool_and(ok)),
f AS (SELECT c.rec, segment, g.f AS frame, c.n - g.f * {hop} AS i, c.v FROM c JOIN (SELECT unnest(range({(SEGMENT - size) // hop + 1})) AS f) g ON c.n BETWEEN g.f * {hop} AND g.f * {hop} + {size - 1} AND g.f * {hop} + {size} <= c.total WHERE energy >= {H.QUIET}::DOUBLE),
s AS (SELECT rec, segment, frame, k, sum(v * (0.5 - 0.5 * cos(2 * pi() * i / {size})) * cos(2 * pi() * k * i / {size})) AS re, sum(v * (0.5 - 0.5 * cos(2 * pi() * i / {size})) * sin(2 * pi() * k * i / {size})) AS im
      FROM f CROSS JOIN (SELECT unnest(range({size // 2 + 1})) AS k) GROUP BY ALL),
p AS (SELECT rec, segment, frame, k, CASE WHEN k > 0 AND k < {size // 2} THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END * (re * re + im * im) / {weight!r}::DOUBLE AS p FROM s),
w AS (SELECT rec, segment, k, avg(p) AS p FROM p GROUP BY ALL),
h AS (SELECT rec, segment, k, db - avg(db) OVER (PARTITION BY rec, segment) AS db FROM (SELECT rec, segment, k, 10 * log10(greatest(p, max(p) OVER (PARTITION BY rec, segment) * 1e-6, 2.2250738585072014e-308)) AS db FROM w)) """


def _mean(size: int, hop: int, low: int, high: int, floor: str) -> str:
    db = f"SELECT rec, segment, k, 10 * log10(greatest(p, {floor})) AS db FROM w JOIN u USING (rec) WHERE k BETWEEN {low} AND {high}"
    return _spectra(size, hop) + f", v AS (SELECT rec, k, avg(db) AS db FROM (SELECT rec, segment, k, db - avg(db) OVER (PARTITION BY rec, segment) AS db FROM ({db})) GROUP BY 1, 2) "


_FLOOR = "max(p) OVER (PARTITION BY rec, segment) * 1e-6, 2.2250738585072014e-308"
SQL = {
    "shape_segments": _spectra(SIZE, HOP) + f""", e AS (SELECT rec, segment, frame, sum(p) AS e FROM p GROUP BY ALL), a AS (SELECT rec, segment, frame, e > max(e) OVER (PARTITION BY rec, segment) * 1e-6 AS active, count(*) OVER (PARTITION BY rec, segment) AS frames FROM e),
        o AS (SELECT rec, segment, frame, frames, k, 10 * log10(greatest(p, max(p) OVER (PARTITION BY rec, segment, frame) * 1e-6, 2.2250738585072014e-308)) AS db FROM p JOIN a USING (rec, segment, frame) WHERE active),
        m AS (SELECT rec, segment, frame, frames, k, db - avg(db) OVER (PARTITION BY rec, segment, frame) AS db FROM o), q AS (SELECT rec, segment, frame, any_value(frames) AS frames, sqrt(avg(pow(m.db - h.db, 2))) AS d FROM m JOIN h USING (rec, segment, k) GROUP BY 1, 2, 3),
        t AS (SELECT rec, segment, any_value(frames) AS frames, count(*) AS active, avg(CASE WHEN d > {H.TRANSIENT_DB} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS transient FROM q GROUP BY 1, 2)
        SELECT rec, segment, n, CASE WHEN ok THEN 'available' ELSE 'unavailable' END AS status, frames, active, round(transient, 6) AS transient FROM g LEFT JOIN t USING (rec, segment)""",
    "shape_quantiles": _spectra(SIZE, HOP) + "SELECT rec, k, round(quantile_cont(db, 0.1), 5) AS q10, round(quantile_cont(db, 0.5), 5) AS mid, round(quantile_cont(db, 0.9), 5) AS q90 FROM h GROUP BY 1, 2",
    "temporal_distance": _spectra(SIZE, HOP) + ", m AS (SELECT rec, k, median(db) AS mid FROM h GROUP BY 1, 2) SELECT rec, segment, round(sqrt(avg(pow(db - mid, 2))), 5) AS d FROM h JOIN m USING (rec, k) GROUP BY 1, 2",
    "baseline_shape": _mean(SIZE, HOP, 0, SIZE // 2, "1e-30") + "SELECT rec, CASE WHEN k IS NULL THEN 'unavailable' ELSE 'available' END AS status, k, round(db, 5) AS db FROM (SELECT DISTINCT rec FROM x) LEFT JOIN v USING (rec)",
    "controlled_shapes": " UNION ALL ".join(
        f"SELECT * FROM ({_mean(size, hop, 1, size // 2 - 1, floor)} SELECT rec, '{name}' AS variant, k, round(db, 5) AS db FROM v)" for name, size, hop, floor in (("band", SIZE, HOP, "1e-30"), ("floor", SIZE, HOP, _FLOOR), ("half", SIZE // 2, HOP // 2, _FLOOR))
    ),
    "angular_average": f"""WITH {_X}, s AS (SELECT rec, n, value, (abs(value) + lag(abs(value)) OVER (PARTITION BY rec ORDER BY n)) / 120 AS step FROM x), c AS (SELECT rec, value, coalesce(sum(step) OVER (PARTITION BY rec ORDER BY n ROWS UNBOUNDED PRECEDING), 0) AS t FROM s),
        e AS (SELECT *, lead(t) OVER o AS t1, lead(value) OVER o AS v1 FROM c WINDOW o AS (PARTITION BY rec ORDER BY t)), m AS (SELECT rec, CAST(floor(max(t)) AS BIGINT) AS turns FROM c GROUP BY 1), g AS (SELECT rec, unnest(range(turns * {POINTS})) AS j FROM m WHERE turns >= 4)
        SELECT g.rec, g.j % {POINTS} AS phase, count(*) AS turns, round(avg(e.value + (e.v1 - e.value) * (g.j / {POINTS}.0 - e.t) / (e.t1 - e.t)), 5) AS mean, round(stddev_pop(e.value + (e.v1 - e.value) * (g.j / {POINTS}.0 - e.t) / (e.t1 - e.t)), 5) AS sd
        FROM g JOIN e ON e.rec = g.rec AND g.j / {POINTS}.0 >= e.t AND g.j / {POINTS}.0 < e.t1 GROUP BY 1, 2""",
    "canonical_props": "SELECT event_id, CAST(json(props) AS VARCHAR) AS props FROM events",
}
QUERIES = {n: globals()[n] for n in [*SQL, "reassigned_map", "cepstral_features", "resampled", "speed_matched"]}
