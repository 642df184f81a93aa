"""Filters, phases and orders over recordings without a window or a fold along a recording; the events of each type, in order of time, are one recording."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.operators.band_views import cyclic_map, harmonic_families, kurtosis_bands, modulations, peak_spacings, strong_peaks
from cadenza.operators.base_path import Base, acceptance_grid, base_path, candidates, chosen_thresholds, estimates, estimator_check, traced_samples
from cadenza.operators.blocks import numbered, running_sum
from cadenza.operators.filters import butterworth, system, zero_phase
from cadenza.operators.orders import Orders, angular_samples, order_analysis
from cadenza.operators.orders import order_peaks as peaks_of_orders

#: Samples a second, as the recordings are taken; samples of a block.
RATE, SIZE = 8.0, 4096
#: Bands of filtered recordings: name, order, edges in Hz.
BANDS = (("low", 4, None, 0.5), ("band", 2, 0.8, 1.6))
#: Orders of the recordings by an assumed speed; limits of bases that are searched.
ORDERS, BASE = Orders(per_cycle=64, cycles=8, highest=2.0, edge=1.0), Base(low=0.25, high=1.5, frame=20.0, hop=4.0)
#: Orders of the recordings whose base is searched for.
FOUND = Orders(per_cycle=64, cycles=8, highest=3.4, edge=1.0)
#: Recordings cut into segments, as if sampled at so many Hz, and bands of their envelopes.
SEGMENT, FAST, CARRIERS = 1000, 1000.0, [(50.0, 100.0), (100.0, 200.0), (200.0, 400.0), (400.0, 600.0)]


def _recordings(spark, d) -> DataFrame:
    return numbered(spark.read.parquet(f"{d}/events.parquet"), F.col("event_type")).select("rec", "n", "value")


def _turning(spark, d) -> DataFrame:
    """Recordings with an assumed speed: from 0.35 Hz at first to 0.7 Hz and back, by the length of the type's name."""
    return _recordings(spark, d).withColumn("base", 0.35 + 0.35 * F.abs(F.sin(F.col("n") / 100.0 / F.length("rec"))))


def _ringing(spark, d) -> DataFrame:
    """Recordings of a comb whose base is told by the length of the type's name, and drifts; the events' values, scaled down, are its noise."""
    base = 0.3 + 0.06 * F.length("rec") + 0.02 * F.sin(F.col("n") / 400.0)
    # the phase is the integral of the base
    phase = 2 * F.pi() * (F.col("n") / RATE * (0.3 + 0.06 * F.length("rec")) + 400.0 / RATE * 0.02 * (1 - F.cos(F.col("n") / 400.0)))
    tone = 0.5 * F.cos(phase) + 0.4 * F.cos(2 * phase + 1) + 0.3 * F.cos(3 * phase + 2)
    return _recordings(spark, d).select("rec", "n", (tone + F.col("value") / 2000.0).alias("value"), base.alias("base"))


def running_totals(spark, d):
    """The running sum of each recording, block by block."""
    return running_sum(_recordings(spark, d), SIZE).select("rec", "n", F.round("total", 4).alias("total"))


def filtered_bands(spark, d):
    """Recordings filtered forward and backward by two Butterworth filters, as levels of stretches of 50 samples."""
    designs = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("rec")).distinct()
    bands = F.array(*[F.struct(F.lit(b).alias("band"), F.lit(o).alias("order"), F.lit(low).cast("double").alias("low"), F.lit(high).cast("double").alias("high")) for b, o, low, high in BANDS])
    y = zero_phase(_recordings(spark, d), designs.select("rec", F.explode(bands).alias("b")).select("rec", "b.*"), RATE, SIZE)
    each = y.select("rec", "band", "first", F.posexplode("filtered").alias("i", "v")).withColumn("stretch", F.floor((F.col("first") + F.col("i")) / 50))
    return each.groupBy("rec", "band", "stretch").agg(F.round(F.sqrt(F.avg(F.col("v") * F.col("v"))), 6).alias("rms"), F.round(F.max("v"), 6).alias("top"))


def rotations(spark, d):
    """Mean and deviation of each recording by the place in the rotation, at its assumed speed."""
    _, runs = angular_samples(_turning(spark, d), RATE, ORDERS, SIZE)
    each = runs.select("rec", "start", F.posexplode("values").alias("i", "v"))
    return each.groupBy("rec", ((F.col("start") + F.col("i")) % ORDERS.per_cycle).alias("place")).agg(F.count("*").alias("turns"), F.round(F.avg("v"), 5).alias("mean"), F.round(F.stddev_pop("v"), 5).alias("sd"))


def order_spectra(spark, d):
    """Mean density by order, at the assumed speed."""
    _, curves, _ = order_analysis(_turning(spark, d), RATE, ORDERS, SIZE)
    return curves.filter("curve = 'psd'").select("rec", F.col("k").cast("long").alias("k"), F.round("at", 4).alias("order"), F.round("value", 4).alias("density"))


def order_summary(spark, d):
    """What order analysis says of each recording, at a base that was searched for in it: status, rotations, and the highest orders."""
    x = _ringing(spark, d)
    about, curves, _ = order_analysis(traced_samples(x.select("rec", "n", "value"), base_path(x.select("rec", "n", "value"), RATE, BASE)[2]), RATE, FOUND, SIZE)
    tops = peaks_of_orders(curves, 3).groupBy("rec").agg(F.array_sort(F.collect_list("order")).alias("orders"))
    return about.join(tops, "rec", "left").select("rec", "status", "cycles", F.round("power", 4).alias("power"), "orders")


def base_frequencies(spark, d):
    """Frames, reliable frames and status of the search for each recording's base, and how far the path is from the base that the recording was made with."""
    x = _ringing(spark, d)
    about, path, _ = base_path(x.select("rec", "n", "value"), RATE, BASE)
    known = x.groupBy("rec", F.floor(F.col("n") / (BASE.hop * RATE)).alias("frame")).agg(F.avg("base").alias("base"))
    middle = path.withColumn("frame", F.col("frame") + F.lit(int(BASE.frame / BASE.hop / 2)))
    off = middle.join(known, ["rec", "frame"]).groupBy("rec").agg(F.round(F.max(F.abs(F.col("hz") / F.col("base") - 1)), 4).alias("off"))
    return about.join(off, "rec", "left").select("rec", "frames", "reliable", "status", "off")


def _parts(spark, d) -> tuple[DataFrame, DataFrame]:
    """Recordings cut to stretches of 500 samples, the noisier the later, and the mean base of each."""
    x = _ringing(spark, d).withColumn("part", F.floor(F.col("n") / 500))
    x = x.select(F.concat_ws("-", "rec", F.col("part").cast("string")).alias("rec"), (F.col("n") % 500).alias("n"), (F.col("value") + F.col("part") % 5 * F.sin(F.xxhash64("rec", "n") % 1000) * 0.3).alias("value"), "base")
    return x.select("rec", "n", "value"), x.groupBy("rec").agg(F.avg("base").alias("base"))


def threshold_grid(spark, d):
    """What each pair of thresholds would accept, and how much of it is near the base that the recordings were made with; the pair chosen is marked."""
    x, known = _parts(spark, d)
    about, path, _ = base_path(x, RATE, BASE)
    grid = acceptance_grid(estimates(about, path), known, [0.4, 0.5, 0.65, 0.8], [0.0, 0.04, 0.08])
    return grid.join(chosen_thresholds(grid).select("score", "lead", F.lit(True).alias("chosen")), ["score", "lead"], "left").withColumn("chosen", F.coalesce("chosen", F.lit(False)))


def base_ratios(spark, d):
    """Accepted recordings by the ratio of the base found to the known one."""
    x, known = _parts(spark, d)
    about, path, _ = base_path(x, RATE, BASE)
    return estimator_check(about, estimates(about, path), known)


def base_candidates(spark, d):
    """Bases of harmonic combs in each frame, best first, with the one on the best path marked."""
    x = _ringing(spark, d).select("rec", "n", "value")
    found = candidates(x, RATE, BASE).select("rec", "block", "since", F.posexplode(F.arrays_zip("hz", "score")).alias("i", "z")).filter("block = 0 or i > 0")
    each = found.select("rec", (F.col("since") + F.col("i")).alias("frame"), F.posexplode(F.arrays_zip("z.hz", "z.score")).alias("rank", "c"))
    taken = base_path(x, RATE, BASE)[1].select("rec", "frame", F.col("hz").alias("taken"))
    return each.join(taken, ["rec", "frame"], "left").select("rec", "frame", (F.col("rank") + 1).alias("rank"), F.col("c")["hz"].alias("hz"), F.col("c")["score"].alias("score"), F.coalesce(F.col("c")["hz"] == F.col("taken"), F.lit(False)).alias("on_path"))


def modulation_map(spark, d):
    """Relative modulation by bands of each segment, on one grid; bands beyond half the rate tell nothing."""
    m = modulations(_recordings(spark, d), SEGMENT, FAST, CARRIERS)
    return m.select("rec", "segment", "band", "status", F.round("mean_envelope", 5).alias("mean"), F.round("strongest_hz", 3).alias("strongest"), F.transform("grid", lambda g: F.round(g, 5)).alias("grid"))


def bank_of_kurtosis(spark, d):
    """Kurtosis of the bands of four dyadic levels in each segment."""
    return kurtosis_bands(_recordings(spark, d), SEGMENT, FAST).withColumn("kurtosis", F.round("kurtosis", 5))


def cyclic_coherences(spark, d):
    """The strongest coherence of each shift in each segment."""
    c = cyclic_map(_recordings(spark, d), SEGMENT, FAST, 100, 50.0)
    return c.groupBy("rec", "segment", "shift").agg(F.count("*").alias("bins"), F.round(F.max("coherence"), 6).alias("top"), F.round(F.avg("coherence"), 6).alias("mean"))


def families_of_harmonics(spark, d):
    """Families of harmonics in each segment, and how many peaks each has."""
    return harmonic_families(strong_peaks(_recordings(spark, d), SEGMENT, FAST)).select("rec", "segment", F.round("base_hz", 4).alias("base"), F.size("members").alias("members"))


def spacings_of_peaks(spark, d):
    """Pairs of strong peaks by their distance, over all segments of a recording."""
    return peak_spacings(strong_peaks(_recordings(spark, d), SEGMENT, FAST)).groupBy("rec", "class").agg(F.sum("pairs").alias("pairs"))


_X = "x AS MATERIALIZED (SELECT event_type AS rec, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS n, value FROM events)"


def _recursion(bands: tuple) -> str:
    """SQL that filters x (rec, n, value) sample by sample, forward and backward: z (rec, band, n, v)."""
    found = [(b, butterworth(o, low, high, RATE), system(o, low, high, RATE)) for b, o, low, high in bands]
    count = len(found[0][1])
    number = lambda v: f"{float(v)!r}::DOUBLE"
    coefficients = [f"{c}{i}" for i in range(count) for c in ("b0_", "b1_", "b2_", "a1_", "a2_")]
    states = [f"s{i}_{k}" for i in range(count) for k in (1, 2)]
    rows = ", ".join(f"('{b}', {s.reach}, {', '.join(number(v) for v in sections.ravel())}, {', '.join(number(v) for v in s.settled)})" for b, sections, s in found)
    settled = [f"z_{s}" for s in states]
    step, u = [], "u"
    for i in range(count):
        step += [f"b0_{i} * {u} + s{i}_1 AS y{i}", f"b1_{i} * {u} - a1_{i} * y{i} + s{i}_2 AS t{i}_1", f"b2_{i} * {u} - a2_{i} * y{i} AS t{i}_2"]
        u = f"y{i}"

    def way(name: str, source: str) -> str:
        return f"""{name}(rec, band, j, y, {', '.join(states)}) AS (SELECT rec, band, 0, NULL::DOUBLE, {', '.join(f'z_{s} * us[1]' for s in states)} FROM {source} JOIN k USING (band)
       UNION ALL SELECT rec, band, j, {u}, {', '.join(f't{i}_{n}' for i in range(count) for n in (1, 2))} FROM (SELECT f.rec, f.band, f.j + 1 AS j, s.us[f.j + 1] AS u, {', '.join(step)} FROM {name} f JOIN {source} s ON s.rec = f.rec AND s.band = f.band JOIN k ON k.band = f.band WHERE f.j < len(s.us)))"""

    return f"""k(band, reach, {', '.join(coefficients)}, {', '.join(settled)}) AS (VALUES {rows}),
l AS (SELECT rec, list(value - m ORDER BY n) AS v FROM (SELECT *, avg(value) OVER (PARTITION BY rec) AS m FROM x) GROUP BY rec),
e AS MATERIALIZED (SELECT rec, band, list_concat(list_concat(list_transform(range(reach, 0, -1), lambda i: 2 * v[1] - v[i + 1]), v), list_transform(range(1, reach + 1), lambda i: 2 * v[-1] - v[len(v) - i])) AS us FROM l CROSS JOIN k WHERE len(v) > reach),
{way('there', 'e')},
r AS MATERIALIZED (SELECT rec, band, list(y ORDER BY j DESC) AS us FROM there WHERE j > 0 GROUP BY rec, band),
{way('back', 'r')},
z AS MATERIALIZED (SELECT b.rec, b.band, len(r.us) - b.j - k.reach AS n, b.y AS v FROM back b JOIN r USING (rec, band) JOIN k USING (band) WHERE b.j > k.reach AND b.j <= len(r.us) - k.reach)"""


_TURNS = f"""p AS (SELECT z.rec, z.n, z.v, 0.35 + 0.35 * abs(sin(z.n / 100.0::DOUBLE / length(z.rec))) AS base FROM z),
c AS (SELECT rec, n, v, coalesce(sum(s) OVER (PARTITION BY rec ORDER BY n), 0) AS t FROM (SELECT *, (base + lag(base) OVER (PARTITION BY rec ORDER BY n)) / 2 / {RATE} AS s FROM p)),
i AS (SELECT rec, n, v, t, lead(t) OVER (PARTITION BY rec ORDER BY n) AS t1, lead(v) OVER (PARTITION BY rec ORDER BY n) AS v1, count(*) OVER (PARTITION BY rec) AS total FROM c),
m AS (SELECT rec, max(ceil(t)) FILTER (n = {int(ORDERS.edge * RATE)}) AS a, max(floor(t)) FILTER (n = total - {int(ORDERS.edge * RATE)} - 1) AS b FROM i GROUP BY rec HAVING b - a >= 4),
g AS (SELECT rec, a, unnest(range(CAST((b - a) * {ORDERS.per_cycle} AS BIGINT))) AS j FROM m),
w AS MATERIALIZED (SELECT g.rec, g.j, i.v + (i.v1 - i.v) * (g.a + g.j / {ORDERS.per_cycle}.0::DOUBLE - i.t) / (i.t1 - i.t) AS v FROM g JOIN i ON i.rec = g.rec AND g.a + g.j / {ORDERS.per_cycle}.0::DOUBLE >= i.t AND g.a + g.j / {ORDERS.per_cycle}.0::DOUBLE < i.t1)"""
_LOW = (("low", 8, None, 0.45 * RATE),)
_FRAME = ORDERS.cycles * ORDERS.per_cycle

SQL = {
    "running_totals": f"WITH {_X} SELECT rec, n, round(sum(value) OVER (PARTITION BY rec ORDER BY n), 4) AS total FROM x",
    "filtered_bands": f"WITH RECURSIVE {_X}, {_recursion(BANDS)} SELECT rec, band, CAST(n // 50 AS BIGINT) AS stretch, round(sqrt(avg(v * v)), 6) AS rms, round(max(v), 6) AS top FROM z GROUP BY 1, 2, 3",
    "rotations": f"WITH RECURSIVE {_X}, {_recursion(_LOW)}, {_TURNS} SELECT rec, j % {ORDERS.per_cycle} AS place, count(*) AS turns, round(avg(v), 5) AS mean, round(stddev_pop(v), 5) AS sd FROM w GROUP BY 1, 2",
    "order_spectra": f"""WITH RECURSIVE {_X}, {_recursion(_LOW)}, {_TURNS},
f AS (SELECT w.rec, s.f, w.j - s.f * {_FRAME // 2} AS i, w.v FROM w JOIN (SELECT rec, unnest(range((max(j) + 1 - {_FRAME}) // {_FRAME // 2} + 1)) AS f FROM w GROUP BY rec HAVING max(j) + 1 >= {_FRAME}) s ON s.rec = w.rec AND w.j >= s.f * {_FRAME // 2} AND w.j < s.f * {_FRAME // 2} + {_FRAME}),
h AS (SELECT rec, f, i, (v - avg(v) OVER (PARTITION BY rec, f)) * (0.5 - 0.5 * cos(2 * pi() * i / {_FRAME})) AS v FROM f),
q AS (SELECT rec, f, k, pow(sum(v * cos(2 * pi() * k * i / {_FRAME})), 2) + pow(sum(v * sin(2 * pi() * k * i / {_FRAME})), 2) AS p FROM h CROSS JOIN (SELECT unnest(range({int(ORDERS.highest * ORDERS.cycles) + 1})) AS k) GROUP BY ALL)
SELECT rec, k, round(k / {ORDERS.cycles}.0, 4) AS "order", round(avg(p) * CASE WHEN k > 0 THEN 2 ELSE 1 END / ({ORDERS.per_cycle} * {_FRAME * 3 / 8}::DOUBLE), 4) AS density FROM q GROUP BY rec, k""",
}
QUERIES = {n: globals()[n] for n in [*SQL, "order_summary", "base_frequencies", "base_candidates", "threshold_grid", "base_ratios", "modulation_map", "bank_of_kurtosis", "cyclic_coherences", "families_of_harmonics", "spacings_of_peaks"]}
