"""Queries of the signal family on events, one recording for each user, with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.functions.scalars import relative_decibels
from cadenza.operators import signal as S
from cadenza.operators import spectra as P

SIZE, HOP, SEGMENT, LEVEL = 32, 8, 25, 5


def _x(spark: SparkSession, d: str) -> DataFrame:
    return S.samples(spark.read.parquet(f"{d}/events.parquet"))


def _p(spark: SparkSession, d: str) -> DataFrame:
    return P.power_spectra(_x(spark, d), SIZE, HOP)


def _welch(spark: SparkSession, d: str) -> DataFrame:
    return P.mean_powers(_x(spark, d), SIZE, HOP).select("rec", "k", "p")


def segment_stats(spark, d):
    x = S.segment_stats(_x(spark, d), SEGMENT)
    return x.select("rec", "segment", "n", *[F.round(c, 6).alias(c) for c in ("mean", "rms", "ac_rms", "peak", "crest_db")], F.round("kurtosis", 4).alias("kurtosis"))


def zero_crossings(spark, d):
    x = _x(spark, d).withColumn("v", F.col("value") - F.avg("value").over(Window.partitionBy("rec")))
    x = x.withColumn("b", F.lag("v").over(Window.partitionBy("rec").orderBy("n")))
    return x.groupBy("rec").agg(F.count_if((F.col("v") < 0) != (F.col("b") < 0)).alias("crossings"), F.count("*").alias("n"))


def level_series(spark, d):
    x = S.level_series(_x(spark, d), LEVEL)
    return x.select("rec", "frame", "n", *[F.round(c, 6).alias(c) for c in ("rms", "low", "high")])


def level_changes(spark, d):
    return S.level_changes(S.level_series(_x(spark, d), LEVEL), 6.0).select("rec", "frame", F.round("step_db", 6).alias("step_db"))


def padded_windows(spark, d):
    ends = _x(spark, d).groupBy("rec").agg(F.count("*").alias("n"))
    last = F.ceil(F.greatest(F.col("n") - SIZE, F.lit(0)) / 16)
    x = ends.select("rec", "n", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("w"))
    return x.select("rec", "w", (F.col("w") * 16).alias("start"), F.least(F.lit(SIZE).cast("long"), F.col("n") - F.col("w") * 16).alias("valid"))


def stft_psd(spark, d):
    return _p(spark, d).select("rec", "frame", "k", F.round("p", 6).alias("p"))


def welch_shape(spark, d):
    return _welch(spark, d).select("rec", "k", F.round(10 * F.log10(F.greatest("p", F.lit(1e-30))), 6).alias("db"))


def welch_coverage(spark, d):
    x = _x(spark, d).groupBy("rec").agg(F.count("*").alias("n"))
    f = F.greatest(F.floor((F.col("n") - SIZE) / HOP) + 1, F.lit(0))
    covered = F.when(f > 0, (f - 1) * HOP + SIZE).otherwise(0)
    return x.select("rec", f.alias("frames"), covered.alias("covered"), (F.col("n") - covered).alias("tail"))


def band_power(spark, d):
    bands = spark.createDataFrame([(0, 0, 4), (1, 4, 8), (2, 8, 16)], "band int, low int, high int")
    x = _welch(spark, d).join(F.broadcast(bands), F.expr("k >= low and (k < high or band = 2 and k <= high)")).groupBy("rec", "band").agg((F.sum("p") / SIZE).alias("power"))
    return x.select("rec", "band", F.round("power", 6).alias("power"), F.round(F.col("power") / F.sum("power").over(Window.partitionBy("rec")), 6).alias("share"))


def centroid_flatness(spark, d):
    flat = F.exp(F.avg(F.ln(F.greatest("p", F.lit(1e-30))))) / F.avg("p")
    return _welch(spark, d).groupBy("rec").agg(F.round(F.sum(F.col("k") * F.col("p")) / F.sum("p") / SIZE, 6).alias("centroid"), F.round(flat, 6).alias("flatness"))


def spectral_peaks(spark, d):
    x = _welch(spark, d).withColumn("p", F.round("p", 9))
    return S.local_maxima(x, 4).select("rec", "rank", "k", F.round("p", 6).alias("p"))


def autocorrelation(spark, d):
    x = _x(spark, d).withColumn("v", F.col("value") - F.avg("value").over(Window.partitionBy("rec")))
    w = Window.partitionBy("rec").orderBy("n")
    x = x.select("rec", "v", *[F.lag("v", k).over(w).alias(f"v{k}") for k in range(1, 9)])
    products = [F.struct(F.lit(k).alias("lag"), (F.col("v") * F.col(f"v{k}" if k else "v")).alias("q")) for k in range(9)]
    sums = x.select("rec", F.explode(F.array(*products)).alias("e")).groupBy("rec", "e.lag").agg(F.sum("e.q").alias("q"))
    zero = F.max(F.when(F.col("lag") == 0, F.col("q"))).over(Window.partitionBy("rec"))
    return sums.select("rec", "lag", F.round(F.col("q") / F.nullif(zero, F.lit(0.0)), 6).alias("r"))


def spectral_kurtosis(spark, d):
    return P.mean_powers(_x(spark, d), SIZE, HOP).select("rec", "k", F.round(F.col("square") / (F.col("p") * F.col("p")) - 2, 6).alias("sk"))


def ridge(spark, d):
    return _p(spark, d).filter("k > 0").groupBy("rec", "frame").agg(F.max_by("k", F.struct(F.round("p", 9), -F.col("k"))).alias("k"))


def persistence(spark, d):
    db = 10 * F.log10(F.greatest("p", F.lit(1e-30)))
    cell = F.least(F.greatest(F.floor((F.round(db, 6) + 20) / 10), F.lit(0)), F.lit(9))
    return _p(spark, d).groupBy("k", cell.alias("cell")).agg(F.count("*").alias("n"))


def quantile_signature(spark, d):
    q = F.percentile("value", F.array(*[F.lit(x) for x in (0.1, 0.5, 0.9)]))
    return _x(spark, d).groupBy("rec").agg(q.alias("q")).select("rec", *[F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate(("q10", "q50", "q90"))])


def phase_integral(spark, d):
    w = Window.partitionBy("rec").orderBy("n")
    x = _x(spark, d).withColumn("rpm", F.abs("value")).withColumn("step", (F.col("rpm") + F.lag("rpm").over(w)) / 120)
    return x.groupBy("rec").agg(F.round(F.sum("step"), 6).alias("cycles"))


def interpolated_grid(spark, d):
    x = _x(spark, d).select("rec", F.col("n").cast("double").alias("t"), "value")
    ends = x.groupBy("rec").agg(F.max("t").alias("m"))
    grid = ends.select("rec", F.explode(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: i * F.col("m") / 9.0)).alias("t"))
    return S.interpolate(x, grid).select("rec", F.round("t", 6).alias("t"), F.round("value", 6).alias("value"))


def rising_edges(spark, d):
    x = _x(spark, d)
    cut = x.groupBy("rec").agg(((F.percentile("value", F.lit(0.99)) + F.percentile("value", F.lit(0.01))) / 2).alias("cut"))
    w = Window.partitionBy("rec").orderBy("n")
    up = x.join(cut, "rec").withColumn("above", F.col("value") > F.col("cut")).withColumn("before", F.lag("above").over(w)).filter("above and not before")
    period = up.withColumn("period", F.col("n") - F.lag("n").over(w))
    return period.groupBy("rec").agg(F.count("*").alias("edges"), F.when(F.count("*") >= 3, F.median("period")).alias("period"))


def synchronous_average(spark, d):
    return _x(spark, d).groupBy("rec", (F.col("n") % 8).alias("phase")).agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("sd"))


def normal_subtracted(spark, d):
    x = _welch(spark, d).withColumn("db", 10 * F.log10(F.greatest("p", F.lit(1e-30))))
    normal = x.filter("rec % 10 = 0").groupBy("k").agg(F.avg("db").alias("normal"))
    return x.join(F.broadcast(normal), "k").select("rec", "k", F.round(F.col("db") - F.col("normal"), 5).alias("delta"))


def measurement_json(spark, d):
    x = spark.read.parquet(f"{d}/events.parquet").select("event_type", F.from_json("props", "k int").k.alias("k"))
    return x.groupBy("event_type").agg(F.count("k").alias("n"), F.sum("k").alias("total"), F.min("k").alias("low"), F.max("k").alias("high"))


def event_totals(spark, d):
    x = spark.read.parquet(f"{d}/events.parquet").withColumn("day", F.dayofmonth("ts"))
    sets = x.groupingSets([["event_type", "day"], ["event_type"]], "event_type", "day")
    return sets.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def tumbling_windows(spark, d):
    x = spark.read.parquet(f"{d}/events.parquet").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return x.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def segment_report(spark, d):
    """Segments of 64 samples at 8 samples a second: spectra, peaks, repetition, envelope, cepstrum."""
    return P.segment_report(_x(spark, d), 64, 8.0)


def segment_views(spark, d):
    x = P.segment_views(_x(spark, d), 64, 8.0, ["multitaper", "envelope", "kurtosis_bank", "cyclic", "wavelet"])
    return x.select("rec", "segment", "view", F.posexplode("values").alias("k", "v"))


def fft_amplitude(spark, d):
    """Amplitude spectra of segments of 64 samples."""
    x = P.segment_views(_x(spark, d), 64, 8.0, ["amplitude"]).select("rec", "segment", F.posexplode("values").alias("k", "a"))
    return x.select("rec", "segment", F.col("k").cast("long").alias("k"), F.round("a", 6).alias("a"))


def segment_autocorrelation(spark, d):
    x = P.segment_views(_x(spark, d), 64, 8.0, ["autocorrelation"]).select("rec", "segment", F.posexplode(F.slice("values", 1, 17)).alias("lag", "r"))
    return x.select("rec", "segment", F.col("lag").cast("long").alias("lag"), F.round("r", 6).alias("r"))


def log_band_features(spark, d):
    """Powers of six bands evenly spaced in log frequency, floored, as logarithms."""
    bands = F.floor(F.log2(F.col("k").cast("double")) * 1.5)
    return _welch(spark, d).filter("k > 0").groupBy("rec", bands.alias("band")).agg(F.round(F.log10(F.greatest(F.sum("p"), F.lit(1e-12))), 6).alias("level"))


def map_pooling(spark, d):
    """Time-frequency maps pooled to 3 rows of bins by 2 columns of frames, as arrays are split: the first parts are longer."""
    x = _p(spark, d)
    size = x.groupBy("rec").agg((F.max("frame") + 1).alias("frames"))
    part = lambda i, n, parts: F.when(i < (n % parts) * (F.floor(n / parts) + 1), F.floor(i / (F.floor(n / parts) + 1))).otherwise((n % parts) + F.floor((i - (n % parts) * (F.floor(n / parts) + 1)) / F.nullif(F.floor(n / parts), F.lit(0))))
    x = x.join(size, "rec").select("rec", part(F.col("k"), F.lit(SIZE // 2 + 1), F.lit(3)).alias("row"), part(F.col("frame"), F.col("frames"), F.lit(2)).alias("col"), "p")
    return x.groupBy("rec", "row", "col").agg(F.round(F.avg("p"), 6).alias("p"))


def line_summary(spark, d):
    """Least, middle and greatest level of each line, and its six largest bins."""
    x = _welch(spark, d).withColumn("p", F.round("p", 9))
    top = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("p")).alias("q"), "k"))), 1, 6)
    x = x.groupBy("rec").agg(F.count("*").alias("n"), F.round(F.min("p"), 6).alias("low"), F.round(F.median("p"), 6).alias("mid"), F.round(F.max("p"), 6).alias("high"), top.alias("top"))
    return x.select("rec", "n", "low", "mid", "high", F.array_join(F.transform("top", lambda t: t["k"].cast("string")), ",").alias("largest"))


def peak_spacing(spark, d):
    """Differences of all pairs of a line's peaks, counted."""
    peaks = S.local_maxima(_welch(spark, d).withColumn("p", F.round("p", 9)), 24).select("rec", "k")
    other = peaks.select("rec", F.col("k").alias("k2"))
    return peaks.join(other, "rec").filter("k < k2").groupBy((F.col("k2") - F.col("k")).alias("spacing")).agg(F.count("*").alias("n"))


def running_phase(spark, d):
    w = Window.partitionBy("rec").orderBy("n")
    x = _x(spark, d).withColumn("step", (F.abs("value") + F.lag(F.abs("value")).over(w)) / 120)
    return x.select("rec", "n", F.round(F.coalesce(F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0)), 6).alias("cycles"))


def relative_welch(spark, d):
    """Levels not below 120 dB under the line's greatest power."""
    x = _welch(spark, d)
    most = x.groupBy("rec").agg(F.max("p").alias("most"))
    return x.join(most, "rec").select("rec", "k", F.round(relative_decibels(F.col("p"), F.col("most"), -120.0), 5).alias("db"))


_X = "x AS (SELECT user_id AS rec, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n, value FROM events)"
_WEIGHT = sum((0.5 - 0.5 * math.cos(2 * math.pi * i / SIZE)) ** 2 for i in range(SIZE))
_P = f"""WITH {_X}, c AS (SELECT rec, n, value - avg(value) OVER (PARTITION BY rec) AS v, count(*) OVER (PARTITION BY rec) AS total FROM x),
f AS (SELECT c.rec, g.f AS frame, c.n - g.f * {HOP} AS i, c.v FROM c JOIN (SELECT unnest(range(0, 100000)) AS f) g ON c.n >= g.f * {HOP} AND c.n < g.f * {HOP} + {SIZE} AND g.f * {HOP} + {SIZE} <= c.total),
s AS (SELECT rec, frame, k, sum(v * (0.5 - 0.5 * cos(2 * pi() * i / {SIZE})) * cos(2 * pi() * k * i / {SIZE})) AS re, sum(v * (0.5 - 0.5 * cos(2 * pi() * i / {SIZE})) * sin(2 * pi() * k * i / {SIZE})) AS im
      FROM f CROSS JOIN (SELECT unnest(range(0, {SIZE // 2 + 1})) AS k) GROUP BY ALL),
p AS (SELECT rec, frame, k, CASE WHEN k > 0 AND k < {SIZE // 2} THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END * (re * re + im * im) / {_WEIGHT!r}::DOUBLE AS p FROM s),
w AS (SELECT rec, k, avg(p) AS p FROM p GROUP BY ALL) """
_L = f"WITH {_X}, l AS (SELECT rec, n // {LEVEL} AS frame, count(*) AS n, sqrt(avg(value * value)) AS rms, min(value) AS low, max(value) AS high FROM x GROUP BY 1, 2) "
SQL = {
    "segment_stats": f"""WITH {_X} SELECT rec, n // {SEGMENT} AS segment, count(*) AS n, round(avg(value), 6) AS mean, round(sqrt(avg(value * value)), 6) AS rms, round(stddev_pop(value), 6) AS ac_rms, round(max(abs(value)), 6) AS peak,
        round(CASE WHEN sqrt(avg(value * value)) > 0 THEN 20 * log10(max(abs(value)) / sqrt(avg(value * value))) END, 6) AS crest_db, round(CASE WHEN count(*) >= 4 AND stddev_pop(value) > 1e-15 THEN kurtosis(value) + 3 END, 4) AS kurtosis FROM x GROUP BY 1, 2""",
    "zero_crossings": f"WITH {_X}, c AS (SELECT rec, n, value - avg(value) OVER (PARTITION BY rec) AS v FROM x), b AS (SELECT *, lag(v) OVER (PARTITION BY rec ORDER BY n) AS b FROM c) SELECT rec, count(*) FILTER (WHERE (v < 0) <> (b < 0)) AS crossings, count(*) AS n FROM b GROUP BY rec",
    "level_series": _L + "SELECT rec, frame, n, round(rms, 6) AS rms, round(low, 6) AS low, round(high, 6) AS high FROM l",
    "level_changes": _L + "SELECT rec, frame, round(s, 6) AS step_db FROM (SELECT rec, frame, 20 * log10(greatest(rms, 1e-15)) - lag(20 * log10(greatest(rms, 1e-15))) OVER (PARTITION BY rec ORDER BY frame) AS s FROM l) WHERE abs(s) >= 6",
    "padded_windows": f"WITH {_X}, e AS (SELECT rec, count(*) AS n FROM x GROUP BY rec), w AS (SELECT rec, n, unnest(range(0, CAST(ceil(greatest(n - {SIZE}, 0) / 16.0) AS BIGINT) + 1)) AS w FROM e) SELECT rec, w, w * 16 AS start, least({SIZE}, n - w * 16) AS valid FROM w",
    "stft_psd": _P + "SELECT rec, frame, k, round(p, 6) AS p FROM p",
    "welch_shape": _P + "SELECT rec, k, round(10 * log10(greatest(p, 1e-30)), 6) AS db FROM w",
    "welch_coverage": f"WITH {_X}, e AS (SELECT rec, count(*) AS n FROM x GROUP BY rec), f AS (SELECT rec, n, CASE WHEN n >= {SIZE} THEN (n - {SIZE}) // {HOP} + 1 ELSE 0 END AS f FROM e) SELECT rec, f AS frames, CASE WHEN f > 0 THEN (f - 1) * {HOP} + {SIZE} ELSE 0 END AS covered, n - CASE WHEN f > 0 THEN (f - 1) * {HOP} + {SIZE} ELSE 0 END AS tail FROM f",
    "band_power": _P + f", b AS (SELECT rec, CASE WHEN k < 4 THEN 0 WHEN k < 8 THEN 1 ELSE 2 END AS band, sum(p) / {SIZE} AS power FROM w GROUP BY 1, 2) SELECT rec, band, round(power, 6) AS power, round(power / sum(power) OVER (PARTITION BY rec), 6) AS share FROM b",
    "centroid_flatness": _P + f"SELECT rec, round(sum(k * p) / sum(p) / {SIZE}, 6) AS centroid, round(exp(avg(ln(greatest(p, 1e-30)))) / avg(p), 6) AS flatness FROM w GROUP BY rec",
    "spectral_peaks": _P + ", q AS (SELECT rec, k, round(p, 9) AS p FROM w), m AS (SELECT *, lag(p) OVER o AS l, lead(p) OVER o AS r FROM q WINDOW o AS (PARTITION BY rec ORDER BY k)) SELECT rec, CAST(rank AS INTEGER) AS rank, k, round(p, 6) AS p FROM (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY p DESC, k) AS rank FROM m WHERE p > l AND p > r) WHERE rank <= 4",
    "autocorrelation": f"WITH {_X}, c AS (SELECT rec, n, value - avg(value) OVER (PARTITION BY rec) AS v FROM x), s AS (SELECT a.rec, CAST(g.lag AS INTEGER) AS lag, sum(a.v * b.v) AS q FROM c a CROSS JOIN (SELECT unnest(range(0, 9)) AS lag) g LEFT JOIN c b ON b.rec = a.rec AND b.n = a.n - g.lag GROUP BY 1, 2) SELECT rec, lag, round(q / nullif(max(CASE WHEN lag = 0 THEN q END) OVER (PARTITION BY rec), 0), 6) AS r FROM s",
    "spectral_kurtosis": _P + "SELECT rec, k, round(avg(p * p) / (avg(p) * avg(p)) - 2, 6) AS sk FROM p GROUP BY ALL",
    "ridge": _P + "SELECT rec, frame, k FROM (SELECT *, row_number() OVER (PARTITION BY rec, frame ORDER BY round(p, 9) DESC, k) AS r FROM p WHERE k > 0) WHERE r = 1",
    "persistence": _P + "SELECT k, CAST(least(greatest(floor((round(10 * log10(greatest(p, 1e-30)), 6) + 20) / 10), 0), 9) AS BIGINT) AS cell, count(*) AS n FROM p GROUP BY 1, 2",
    "quantile_signature": f"WITH {_X} SELECT rec, round(quantile_cont(value, 0.1), 6) AS q10, round(quantile_cont(value, 0.5), 6) AS q50, round(quantile_cont(value, 0.9), 6) AS q90 FROM x GROUP BY rec",
    "phase_integral": f"WITH {_X}, s AS (SELECT rec, (abs(value) + lag(abs(value)) OVER (PARTITION BY rec ORDER BY n)) / 120 AS step FROM x) SELECT rec, round(sum(step), 6) AS cycles FROM s GROUP BY rec",
    "interpolated_grid": f"""WITH {_X}, e AS (SELECT rec, CAST(max(n) AS DOUBLE) AS m FROM x GROUP BY rec), g AS (SELECT rec, i * m / 9.0::DOUBLE AS t FROM e CROSS JOIN (SELECT unnest(range(0, 10)) AS i))
        SELECT g.rec, round(g.t, 6) AS t, round(a.value + (b.value - a.value) * (g.t - floor(g.t)), 6) AS value FROM g JOIN x a ON a.rec = g.rec AND a.n = CAST(floor(g.t) AS BIGINT) JOIN x b ON b.rec = g.rec AND b.n = CAST(ceil(g.t) AS BIGINT)""",
    "rising_edges": f"""WITH {_X}, c AS (SELECT rec, (quantile_cont(value, 0.99) + quantile_cont(value, 0.01)) / 2 AS cut FROM x GROUP BY rec), a AS (SELECT x.rec, n, value > cut AS above FROM x JOIN c USING (rec)), b AS (SELECT *, lag(above) OVER (PARTITION BY rec ORDER BY n) AS before FROM a),
        u AS (SELECT rec, n - lag(n) OVER (PARTITION BY rec ORDER BY n) AS period FROM b WHERE above AND NOT before) SELECT rec, count(*) AS edges, CASE WHEN count(*) >= 3 THEN median(period) END AS period FROM u GROUP BY rec""",
    "synchronous_average": f"WITH {_X} SELECT rec, n % 8 AS phase, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd FROM x GROUP BY 1, 2",
    "normal_subtracted": _P + ", b AS (SELECT rec, k, 10 * log10(greatest(p, 1e-30)) AS db FROM w), m AS (SELECT k, avg(db) AS normal FROM b WHERE rec % 10 = 0 GROUP BY k) SELECT rec, b.k, round(db - normal, 5) AS delta FROM b JOIN m USING (k)",
    "measurement_json": "SELECT event_type, count(k) AS n, CAST(sum(k) AS BIGINT) AS total, min(k) AS low, max(k) AS high FROM (SELECT event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) GROUP BY event_type",
    "event_totals": "SELECT event_type, CAST(day(ts) AS INTEGER) AS day, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY GROUPING SETS ((event_type, day(ts)), (event_type))",
    "tumbling_windows": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
}
_G = f"""WITH {_X}, g AS (SELECT rec, n // 64 AS segment, n % 64 AS i, value - avg(value) OVER (PARTITION BY rec, n // 64) AS v, count(*) OVER (PARTITION BY rec, n // 64) AS m FROM x) """
_PART = lambda i, n, parts: f"(CASE WHEN {i} < ({n} % {parts}) * ({n} // {parts} + 1) THEN {i} // ({n} // {parts} + 1) ELSE ({n} % {parts}) + ({i} - ({n} % {parts}) * ({n} // {parts} + 1)) // nullif({n} // {parts}, 0) END)"
SQL |= {
    "fft_amplitude": _G + "SELECT rec, segment, k, round(CASE WHEN k > 0 AND 2 * k < m THEN 2 ELSE 1 END * sqrt(pow(sum(w * v * cos(2 * pi() * k * i / m)), 2) + pow(sum(w * v * sin(2 * pi() * k * i / m)), 2)) / sum(w), 6) AS a FROM (SELECT *, 0.5 - 0.5 * cos(2 * pi() * i / m) AS w, unnest(range(m // 2 + 1)) AS k FROM g WHERE m >= 32) GROUP BY rec, segment, m, k",
    "segment_autocorrelation": _G + ", z AS (SELECT rec, segment, sum(v * v) AS z FROM g WHERE m >= 32 GROUP BY 1, 2), l AS (SELECT a.rec, a.segment, a.i - b.i AS lag, sum(a.v * b.v) AS q FROM g a JOIN g b ON a.rec = b.rec AND a.segment = b.segment AND a.i - b.i BETWEEN 0 AND 16 WHERE a.m >= 32 GROUP BY 1, 2, 3) SELECT rec, segment, lag, round(q / z, 6) AS r FROM l JOIN z USING (rec, segment)",
    "log_band_features": _P + "SELECT rec, CAST(floor(log2(CAST(k AS DOUBLE)) * 1.5) AS BIGINT) AS band, round(log10(greatest(sum(p), 1e-12)), 6) AS level FROM w WHERE k > 0 GROUP BY 1, 2",
    "map_pooling": _P + f", m AS (SELECT rec, max(frame) + 1 AS frames FROM p GROUP BY 1) SELECT rec, {_PART('k', SIZE // 2 + 1, 3)} AS row, {_PART('frame', 'frames', 2)} AS col, round(avg(p), 6) AS p FROM p JOIN m USING (rec) GROUP BY 1, 2, 3",
    "line_summary": _P + ", q AS (SELECT rec, k, round(p, 9) AS p FROM w), r AS (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY p DESC, k) AS r FROM q) SELECT rec, count(*) AS n, round(min(p), 6) AS low, round(median(p), 6) AS mid, round(max(p), 6) AS high, string_agg(CASE WHEN r <= 6 THEN CAST(k AS VARCHAR) END, ',' ORDER BY r) AS largest FROM r GROUP BY 1",
    "peak_spacing": _P + ", q AS (SELECT rec, k, round(p, 9) AS p FROM w), m AS (SELECT *, lag(p) OVER o AS l, lead(p) OVER o AS r FROM q WINDOW o AS (PARTITION BY rec ORDER BY k)), t AS (SELECT rec, k FROM m WHERE p > l AND p > r) SELECT b.k - a.k AS spacing, count(*) AS n FROM t a JOIN t b ON a.rec = b.rec AND a.k < b.k GROUP BY 1",
    "running_phase": f"WITH {_X}, s AS (SELECT rec, n, (abs(value) + lag(abs(value)) OVER (PARTITION BY rec ORDER BY n)) / 120 AS step FROM x) SELECT rec, n, round(coalesce(sum(step) OVER (PARTITION BY rec ORDER BY n ROWS UNBOUNDED PRECEDING), 0), 6) AS cycles FROM s",
    "relative_welch": _P + "SELECT rec, k, round(10 * log10(greatest(p, max(p) OVER (PARTITION BY rec) * 1e-12, 2.2250738585072014e-308)), 5) AS db FROM w",
}
QUERIES = {n: globals()[n] for n in [*SQL, "segment_report", "segment_views"]}
