"""Queries of all shifts, table functions, named reducers and signatures, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.operators import tables as A
from cadenza.operators.blocks import numbered
from cadenza.operators.shift_search import shift_distances

#: Shifts to either side; windows and their steps; points of a signature; cells of pooled maps.
SHIFTS, WINDOW, STEP, POINTS, CELLS = 57, 64, 48, 256, (5, 3)


def _vectors(spark, d) -> DataFrame:
    """Embeddings as gappy lines: every eleventh component from the id on is missing."""
    x = spark.read.parquet(f"{d}/embeddings.parquet")
    return x.select("vec_id", "label", F.transform("embedding", lambda v, i: F.when((i + F.col("vec_id")) % 11 == 0, F.lit(None)).otherwise(v.cast("double"))).alias("v"))


def all_shifts(spark, d):
    """Each vector against the first one of its class, at the best of all shifts."""
    x = _vectors(spark, d)
    first = x.groupBy("label").agg(F.min("vec_id").alias("ref"))
    refs = x.join(first, x.vec_id == first.ref, "left_semi").select("label", F.col("vec_id").alias("ref"), F.col("v").alias("b"))
    pairs = x.join(refs, "label").filter("vec_id <> ref").select("vec_id", "ref", F.col("v").alias("a"), "b")
    return shift_distances(pairs, ["vec_id", "ref"], SHIFTS).select("vec_id", "ref", F.round("distance", 6).alias("distance"))


def padded_recordings(spark, d):
    """Windows of each user's events, the last filled up, by the table function."""
    A.register(spark)
    x = numbered(spark.read.parquet(f"{d}/events.parquet"), F.col("user_id").cast("string")).select("rec", "n", (F.col("value") / 250 - 1).alias("value"))
    w = spark.sql(f"SELECT * FROM padded_windows(row => TABLE({{x}}) PARTITION BY (rec) ORDER BY (n), size => {WINDOW}, step => {STEP})", x=x)
    return w.select("rec", "start", "valid", "padding", F.round("rms", 6).alias("rms"), F.round("peak", 6).alias("peak"), "silence", "clipped")


def _map(spark, d) -> DataFrame:
    """A map for each class of embeddings: its first twenty vectors by id as rows, components as columns."""
    x = spark.read.parquet(f"{d}/embeddings.parquet").select("label", (F.col("vec_id") % 20).alias("row"), F.posexplode("embedding").alias("col", "value"))
    return x.groupBy("label", "row", "col").agg(F.avg(F.col("value").cast("double")).alias("value"))


def pooled_by_name(spark, d):
    """Maps of classes pooled to a few cells by three reducers."""
    rows, columns = CELLS
    out = None
    for name in ("mean", "median", "max"):
        p = A.pooled(_map(spark, d), ["label"], rows, columns, name).select("label", F.lit(name).alias("reducer"), F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.round("value", 6).alias("value"))
        out = p if out is None else out.unionByName(p)
    return out


def line_signatures(spark, d):
    """Values of each user in order of time, of any number, as lines of one length; each fifth line is unavailable and stays null. Its mean, ends and roughness."""
    x = numbered(spark.read.parquet(f"{d}/events.parquet"), F.col("user_id")).groupBy("rec").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "value"))), lambda s: s["value"]).alias("v"))
    s = x.select("rec", A.brought_to(F.when(F.col("rec") % 5 != 0, F.col("v")), POINTS).alias("s"))
    total = F.aggregate("s", F.lit(0.0), lambda t, v: t + v)
    rough = F.aggregate(F.zip_with(F.slice("s", 2, POINTS - 1), F.slice("s", 1, POINTS - 1), lambda b, a: F.abs(b - a)), F.lit(0.0), lambda t, v: t + v)
    return s.select("rec", F.round(total / POINTS, 5).alias("mean"), F.round(F.get("s", F.lit(100)), 5).alias("inner"), F.round(rough / POINTS, 5).alias("rough"))


def inverse_histograms(spark, d):
    """Levels at which 10, 50 and 90 percent of each user's values are reached, from a histogram of classes of 25."""
    h = spark.read.parquet(f"{d}/events.parquet").groupBy(F.col("user_id").alias("rec"), (F.floor(F.col("value") / 25) * 25.0).alias("level")).agg(F.count("*").alias("count"))
    return A.inverse_levels(h, ["rec"], [0.1, 0.5, 0.9]).select("rec", "share", F.round("level", 5).alias("level"))


_ROWS, _COLUMNS = CELLS


def _part(at: str, of: str, most: int) -> str:
    return f"CASE WHEN {at} < ({of} % {most}) * ({of} // {most} + 1) THEN {at} // ({of} // {most} + 1) ELSE {of} % {most} + ({at} - ({of} % {most}) * ({of} // {most} + 1)) // ({of} // {most}) END"


SQL = {
    "all_shifts": f"""WITH x AS (SELECT vec_id, label, list_transform(embedding, lambda v, i: CASE WHEN (i - 1 + vec_id) % 11 = 0 THEN NULL ELSE CAST(v AS DOUBLE) END) AS v FROM embeddings),
p AS (SELECT a.vec_id, b.vec_id AS ref, a.v AS a, b.v AS b FROM x a JOIN x b ON a.label = b.label AND b.vec_id = (SELECT min(c.vec_id) FROM x c WHERE c.label = a.label) WHERE a.vec_id <> b.vec_id),
s AS (SELECT vec_id, ref, s.s, a[greatest(s.s, 0) + 1:len(a) + least(s.s, 0)] AS a, b[greatest(-s.s, 0) + 1:len(b) - greatest(s.s, 0)] AS b FROM p CROSS JOIN (SELECT unnest(range(-{SHIFTS}, {SHIFTS + 1})) AS s) s),
t AS (SELECT vec_id, ref, s, len(list_filter(a, lambda v: v IS NOT NULL)) AS na, len(list_filter(b, lambda v: v IS NOT NULL)) AS nb, list_filter(list_transform(list_zip(a, b), lambda z: z[1] - z[2]), lambda v: v IS NOT NULL) AS d FROM s)
SELECT vec_id, ref, round(min(list_stddev_pop(d)), 6) AS distance FROM t WHERE len(d) >= greatest(1, 0.2 * least(na, nb)) GROUP BY 1, 2""",
    "padded_recordings": f"""WITH x AS (SELECT CAST(user_id AS VARCHAR) AS rec, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n, value / 250 - 1 AS v, count(*) OVER (PARTITION BY user_id) AS total FROM events),
w AS (SELECT DISTINCT rec, total, unnest(range(CAST(greatest(ceil((total - {WINDOW}) / {STEP}.0), 0) AS BIGINT) + 1)) * {STEP} AS start FROM x)
SELECT w.rec, w.start, count(*) AS valid, {WINDOW} - count(*) AS padding, round(sqrt(avg(x.v * x.v)), 6) AS rms, round(max(abs(x.v)), 6) AS peak, max(abs(x.v)) = 0 AS silence, count(*) FILTER (abs(x.v) >= 1) AS clipped
FROM w JOIN x ON x.rec = w.rec AND x.n >= w.start AND x.n < w.start + {WINDOW} GROUP BY 1, 2""",
    "pooled_by_name": f"""WITH e AS (SELECT label, vec_id % 20 AS row, unnest(range(len(embedding))) AS col, unnest(embedding) AS value FROM embeddings), m AS (SELECT label, row, col, avg(CAST(value AS DOUBLE)) AS value FROM e GROUP BY ALL),
z AS (SELECT label, max(row) + 1 AS rows, max(col) + 1 AS cols FROM m GROUP BY 1), y AS (SELECT label, {_part('row', 'rows', _ROWS)} AS r, {_part('col', 'cols', _COLUMNS)} AS c, col, value FROM m JOIN z USING (label)),
""" + ", ".join(f"{n}1 AS (SELECT label, r, c, col, {f}(value) AS v FROM y GROUP BY ALL)" for n, f in (("mean", "avg"), ("median", "median"), ("max", "max"))) + " UNION ALL ".join(f" SELECT label, '{n}' AS reducer, r AS row, c AS col, round({f}(v), 6) AS value FROM {n}1 GROUP BY 1, 3, 4" for n, f in (("mean", "avg"), ("median", "median"), ("max", "max"))),
    "line_signatures": f"""WITH x AS (SELECT user_id AS rec, list(value ORDER BY ts, event_id) AS v FROM events GROUP BY 1),
s AS (SELECT rec, CASE WHEN rec % 5 <> 0 THEN list_transform(range({POINTS}), lambda j: v[CAST(floor(j * (len(v) - 1) / {POINTS - 1}.0::DOUBLE) AS BIGINT) + 1] + (v[least(CAST(floor(j * (len(v) - 1) / {POINTS - 1}.0::DOUBLE) AS BIGINT) + 2, len(v))] - v[CAST(floor(j * (len(v) - 1) / {POINTS - 1}.0::DOUBLE) AS BIGINT) + 1]) * (j * (len(v) - 1) / {POINTS - 1}.0::DOUBLE - floor(j * (len(v) - 1) / {POINTS - 1}.0::DOUBLE))) END AS s FROM x)
SELECT rec, round(list_sum(s) / {POINTS}, 5) AS mean, round(s[101], 5) AS "inner", round(list_sum(list_transform(range(1, {POINTS}), lambda i: abs(s[i + 1] - s[i]))) / {POINTS}, 5) AS rough FROM s""",
    "inverse_histograms": """WITH h AS (SELECT user_id AS rec, floor(value / 25) * 25.0::DOUBLE AS level, count(*) AS c FROM events GROUP BY 1, 2), r AS (SELECT rec, level, sum(c) OVER w AS upto, sum(c) OVER (PARTITION BY rec) AS total FROM h WINDOW w AS (PARTITION BY rec ORDER BY level)),
q AS (SELECT *, lag(upto) OVER w AS before, lag(level) OVER w AS low FROM r WINDOW w AS (PARTITION BY rec ORDER BY level)), s AS (SELECT q.*, s.share FROM q CROSS JOIN (SELECT unnest([0.1::DOUBLE, 0.5::DOUBLE, 0.9::DOUBLE]) AS share) s WHERE q.upto >= s.share * q.total AND coalesce(q.before, -1) < s.share * q.total)
SELECT rec, share, round(coalesce(low + (level - low) * (share * total - before) / (upto - before), level), 5) AS level FROM s""",
}
QUERIES = {n: globals()[n] for n in SQL}
