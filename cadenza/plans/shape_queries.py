"""Queries of the comparison family on embeddings, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.functions.scalars import rms_distance
from cadenza.operators import comparison as C

R6 = 6


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return C.shapes(spark.read.parquet(f"{d}/embeddings.parquet"), "vec_id", "label", "embedding")


def _distances(spark: SparkSession, d: str, per_class: int = 1) -> DataFrame:
    refs, queries = C.split_bank(_vectors(spark, d), per_class)
    return C.distances(queries, refs)


def _decisions(spark: SparkSession, d: str) -> DataFrame:
    return C.decide(_distances(spark, d), 0.18, 0.002)


def nearest_reference_decision(spark, d):
    return _decisions(spark, d).select("query", "truth", "nearest", F.round("d", R6).alias("d"), F.round("lead", R6).alias("lead"), "outcome")


def nearest_reference_confusion(spark, d):
    return _decisions(spark, d).groupBy("truth", "nearest", "outcome").agg(F.count("*").alias("n"))


def nearest_reference_scores(spark, d):
    x = _decisions(spark, d).select("truth", F.when(F.col("outcome") == "known", F.col("nearest")).alias("said"))
    both = x.select(F.explode(F.array(F.struct(F.col("truth").alias("label"), F.lit(1).alias("s"), F.lit(0).alias("p"), F.when(F.col("truth") == F.col("said"), 1).otherwise(0).alias("t")), F.struct(F.col("said").alias("label"), F.lit(0).alias("s"), F.lit(1).alias("p"), F.lit(0).alias("t")))).alias("e")).select("e.*").filter("label is not null")
    c = both.groupBy("label").agg(F.sum("s").alias("support"), F.sum("p").alias("predicted"), F.sum("t").alias("correct"))
    f1 = F.when(F.col("support") + F.col("predicted") > 0, 2.0 * F.col("correct") / (F.col("support") + F.col("predicted"))).otherwise(0.0)
    return c.select("label", "support", "predicted", "correct", F.round(F.try_divide("correct", "support"), R6).alias("recall"), F.round(f1, R6).alias("f1"))


def overall_scores(spark, d):
    """Accuracy over all queries, share that was answered, accuracy of these, and the mean F1 of all classes."""
    c = nearest_reference_scores(spark, d)
    said = c.agg(F.sum("support").alias("n"), F.sum("predicted").alias("answered"), F.sum("correct").alias("correct"), F.round(F.avg("f1"), 5).alias("macro_f1"))
    return said.select("n", "answered", "correct", F.round(F.col("correct") / F.col("n"), R6).alias("accuracy"), F.round(F.try_divide("answered", "n"), R6).alias("coverage"), F.round(F.try_divide("correct", "answered"), R6).alias("precision"), "macro_f1")


def class_ranking_regimes(spark, d):
    x = _distances(spark, d, 4).select("query", F.col("ref_class").alias("class"), (F.col("ref") % 2).alias("regime"), (F.col("ref") % 5).alias("group"), "d")
    return C.class_ranking(x).select("query", "class", F.round("d", R6).alias("d"))


def bank_variability(spark, d):
    refs, _ = C.split_bank(_vectors(spark, d), 6)
    x = C.pairs(refs, ["class"]).withColumn("within", (F.col("a") % 2 == F.col("b") % 2))
    return x.groupBy("class", "within").agg(F.count("*").alias("pairs"), *[F.round(f("d"), R6).alias(n) for f, n in ((F.min, "low"), (F.median, "mid"), (F.max, "high"))])


def reference_separation(spark, d):
    refs, _ = C.split_bank(_vectors(spark, d), 1)
    ends = C.bank_pairs(refs).select(F.explode(F.array("a", "b")).alias("ref"), "d")
    return ends.groupBy("ref").agg(F.round(F.min("d"), R6).alias("nearest"))


def medoid_per_class(spark, d):
    """The member of each class with the least mean distance to all others of it."""
    x = C.mean_distances(_vectors(spark, d)).filter("d is not null")
    return x.groupBy("class").agg(F.min_by("id", F.struct(F.round("d", 9), "id")).alias("medoid"))


def leave_one_class_out(spark, d):
    """Each class left out in turn: its queries' next best class takes over, so the two best classes of a query answer every fold."""
    best = _distances(spark, d).groupBy("query", "truth").agg(F.slice(F.sort_array(F.collect_list(F.struct("d", "ref_class"))), 1, 2).alias("b"))
    x = best.select("truth", F.col("b")[0]["ref_class"].alias("c1"), F.col("b")[0]["d"].alias("d1"), F.col("b")[1]["ref_class"].alias("c2"), F.col("b")[1]["d"].alias("d2"))
    hit1, hit2 = (F.col("c1") == F.col("truth")).cast("long"), (F.col("c2") == F.col("truth")).cast("long")
    whole = x.agg(F.count("*").alias("n"), F.sum(hit1).alias("hits"), F.sum("d1").alias("sum"))
    moved = x.groupBy(F.col("c1").alias("excluded")).agg(F.sum(hit2 - hit1).alias("gain"), F.sum(F.col("d2") - F.col("d1")).alias("far"))
    own = x.groupBy(F.col("truth").alias("excluded")).agg(F.count("*").alias("unseen"))
    folds = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("label").alias("excluded")).distinct()
    y = folds.join(moved, "excluded", "left").join(own, "excluded", "left").join(F.broadcast(whole), F.lit(True))
    none = F.lit(0).cast("long")
    return y.select("excluded", "n", (F.col("hits") + F.coalesce("gain", none)).alias("correct"), F.coalesce("unseen", none).alias("unseen"), F.round((F.col("sum") + F.coalesce("far", F.lit(0.0))) / F.col("n"), R6).alias("mean_d"))


def leave_group_out_holdout(spark, d):
    x = _distances(spark, d, 4).filter("query % 5 <> ref % 5").groupBy("query", "truth", "ref_class").agg(F.min("d").alias("d"))
    order = Window.partitionBy("query").orderBy("d", "ref_class")
    return x.withColumn("r", F.row_number().over(order)).filter("r = 1").select("query", "truth", F.col("ref_class").alias("nearest"), F.round("d", R6).alias("d"))


def retrieval_top2x2(spark, d):
    x = _distances(spark, d, 4)
    member = Window.partitionBy("query", "ref_class").orderBy("d", "ref")
    x = x.withColumn("m", F.row_number().over(member)).filter("m <= 2").withColumn("best", F.min("d").over(Window.partitionBy("query", "ref_class")))
    rank = F.dense_rank().over(Window.partitionBy("query").orderBy("best", "ref_class"))
    return x.withColumn("c", rank).filter("c <= 2").select("query", "c", "m", "ref")


def open_set_evaluation(spark, d):
    x = _decisions(spark, d).withColumn("known", F.col("truth") < 8)
    kind = F.when(F.col("outcome") == "indeterminate", "indeterminate").when(F.col("outcome") == "outside_reference", F.when(F.col("known"), "false_rejection").otherwise("correct_unknown_rejection")).when(~F.col("known"), "unknown_false_accept").when(F.col("nearest") == F.col("truth"), "correct_known").otherwise("wrong_known")
    return x.groupBy(kind.alias("category")).agg(F.count("*").alias("n"), F.round(F.avg("d"), R6).alias("mean_d"))


def geometry_spread_lead(spark, d):
    order = Window.partitionBy("query").orderBy("d", "ref_class")
    x = _distances(spark, d).withColumn("r", F.row_number().over(order)).withColumn("second", F.lead("d").over(order))
    return x.groupBy("query").agg(F.round(F.max("d") - F.min("d"), R6).alias("spread"), F.round(F.max(F.when(F.col("r") == 1, F.col("second") - F.col("d"))), R6).alias("lead"))


def ratio_rule_calibration(spark, d):
    near = _decisions(spark, d)
    refs, _ = C.split_bank(_vectors(spark, d), 1)
    apart = C.bank_pairs(refs).select(F.explode(F.array("class_a", "class_b")).alias("class"), "d").groupBy("class").agg(F.min("d").alias("apart"))
    grid = spark.createDataFrame([(x,) for x in (0.25, 0.375, 0.5, 0.625, 0.75, 1.0)], "fraction double")
    x = near.join(F.broadcast(apart), near.nearest == apart["class"]).join(F.broadcast(grid), F.lit(True))
    accepted = F.col("d") / F.col("apart") <= F.col("fraction")
    return x.groupBy("fraction").agg(F.count_if(accepted).alias("accepted"), F.count_if(accepted & (F.col("nearest") == F.col("truth"))).alias("correct"))


def band_contributions(spark, d):
    refs, queries = C.split_bank(_vectors(spark, d), 1)
    r = refs.select(F.col("class").alias("ref_class"), F.col("shape").alias("rs"))
    x = queries.join(F.broadcast(r), F.col("class") == F.col("ref_class")).select("id", F.size("shape").alias("k"), F.posexplode(F.zip_with("shape", "rs", lambda a, b: (a - b) * (a - b))).alias("i", "q"))
    return x.groupBy("id", F.floor(F.col("i") / 16).alias("band")).agg(F.round(F.sum("q") / F.max("k"), 9).alias("share"))


def _grouped_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Medians of the distances between groups (class, id % 3) of a bank, each pair of groups once."""
    refs, _ = C.split_bank(_vectors(spark, d), 6)
    x = C.bank_pairs(refs)
    ends = F.array_sort(F.array(F.struct(F.col("class_a").alias("c"), (F.col("a") % 3).alias("g")), F.struct(F.col("class_b").alias("c"), (F.col("b") % 3).alias("g"))))
    x = x.select(ends.alias("e"), "d").filter("e[0] <> e[1]").groupBy("e").agg(F.median("d").alias("d"))
    return x.select(F.col("e")[0]["c"].alias("ca"), F.col("e")[1]["c"].alias("cb"), F.col("d"))


def separation_metrics(spark, d):
    """Each class's groups among themselves against those of the nearest class: ratio of medians, gap to any class, share of pairs in order."""
    x = _grouped_pairs(spark, d)
    within = x.filter("ca = cb").select(F.col("ca").alias("class"), "d")
    between = x.filter("ca <> cb").select(F.explode(F.array(F.struct(F.col("ca").alias("class"), F.col("cb").alias("other")), F.struct(F.col("cb").alias("class"), F.col("ca").alias("other")))).alias("p"), "d").select("p.*", "d")
    inner = within.groupBy("class").agg(F.count("*").alias("pairs"), F.median("d").alias("within"), F.max("d").alias("most"), F.collect_list("d").alias("ws"))
    outer = between.groupBy("class", "other").agg(F.median("d").alias("m"), F.collect_list("d").alias("bs"), F.min("d").alias("least"))
    near = outer.groupBy("class").agg(F.min(F.struct("m", "other", "bs")).alias("near"), F.min("least").alias("least"))
    score = lambda w, b: F.when(w < b, 1.0).when(w == b, 0.5).otherwise(0.0)
    order = F.flatten(F.transform("ws", lambda w: F.transform("near.bs", lambda b: score(w, b))))
    y = inner.join(near, "class")
    return y.select("class", "pairs", F.col("near.other").alias("nearest"), F.round(F.col("within") / F.nullif("near.m", F.lit(0.0)), R6).alias("ratio"), F.round(F.col("least") - F.col("most"), R6).alias("gap"), F.round(F.aggregate(order, F.lit(0.0), lambda s, v: s + v) / F.size(order), R6).alias("ordered"))


def class_threshold_calibration(spark, d):
    """Thresholds of each class, a factor of its largest own distance: right answers with the class in the bank and with it left out, and the best factor."""
    refs, queries = C.split_bank(_vectors(spark, d), 6)
    limits = C.bank_pairs(refs).filter("class_a = class_b").groupBy(F.col("class_a").alias("c")).agg(F.max("d").alias("limit"))
    x = C.distances(queries, refs).groupBy("query", "truth", "ref_class").agg(F.min("d").alias("d"))
    seen = x.groupBy("query", "truth").agg(F.min(F.struct("d", "ref_class")).alias("b"), F.min(F.when(F.col("ref_class") != F.col("truth"), F.struct("d", "ref_class"))).alias("o"))
    trials = seen.select("truth", F.explode(F.array(F.struct(F.lit(True).alias("visible"), F.col("b").alias("b")), F.struct(F.lit(False).alias("visible"), F.col("o").alias("b")))).alias("t")).select("truth", "t.visible", F.col("t.b.ref_class").alias("c"), F.col("t.b.d").alias("d"))
    grid = spark.createDataFrame([(v,) for v in (1.0, 1.05, 1.1, 1.2, 1.25, 1.5)], "factor double")
    y = trials.join(F.broadcast(limits), "c").join(F.broadcast(grid), F.lit(True))
    accepted = F.col("d") <= F.col("factor") * F.col("limit")
    right = F.when(F.col("visible"), accepted & (F.col("c") == F.col("truth"))).otherwise(~accepted)
    y = y.groupBy("factor").agg(F.count_if(F.col("visible") & right).alias("known"), F.count_if(~F.col("visible") & right).alias("unknown"))
    best = y.agg(F.max(F.struct((F.col("known") + F.col("unknown")).alias("s"), "factor")).alias("m")).select(F.col("m.factor").alias("best"))
    return y.join(F.broadcast(best), F.lit(True)).select("factor", "known", "unknown", (F.col("factor") == F.col("best")).alias("chosen"))


def shift_search_distance(spark, d):
    """The least distance of each query to its class's reference over shifts of up to three places, on what overlaps; ties go to the smaller shift."""
    refs, queries = C.split_bank(_vectors(spark, d), 1)
    if refs.limit(C.MAX_REFERENCES + 1).count() > C.MAX_REFERENCES:
        raise ValueError("the bank is too large")
    x = queries.join(F.broadcast(refs.select("class", F.col("shape").alias("rs"))), "class")

    def at(shift: int):
        a, b = (F.slice("shape", 1 + shift, 64 - shift), F.slice("rs", 1, 64 - shift)) if shift >= 0 else (F.slice("shape", 1, 64 + shift), F.slice("rs", 1 - shift, 64 + shift))
        return F.struct(F.round(rms_distance(a, b), 9).alias("d"), F.lit(abs(shift)).alias("size"), F.lit(shift).alias("shift"))

    best = F.array_min(F.array(*[at(k) for k in range(-3, 4)]))
    return x.select("id", F.round(best["d"], R6).alias("d"), best["shift"].alias("shift"))


def screen_score_table(spark, d):
    """Right answers and the mean rank of the truth by scenario and method, with the totals of each method in the same pass."""
    x = _vectors(spark, d)
    refs, queries = C.split_bank(x, 1)
    halves = [("whole", lambda v: v), ("lower", lambda v: F.slice(v, 1, 32)), ("upper", lambda v: F.slice(v, 33, 32))]
    ranked = None
    for name, part in halves:
        y = C.distances(queries.withColumn("shape", part(F.col("shape"))), refs.withColumn("shape", part(F.col("shape"))))
        order = Window.partitionBy("query").orderBy(F.round("d", 9), "ref_class")
        y = y.withColumn("rank", F.row_number().over(order)).filter("truth = ref_class").select((F.col("query") % 3).alias("scenario"), F.lit(name).alias("method"), "rank")
        ranked = y if ranked is None else ranked.unionByName(y)
    sets = ranked.groupingSets([["scenario", "method"], ["method"]], "scenario", "method")
    return sets.agg(F.count("*").alias("total"), F.count_if(F.col("rank") == 1).alias("correct"), F.round(F.avg("rank"), R6).alias("mean_rank"))


def distance_summary(spark, d):
    """Pairs, middle, least and greatest distance for each pair of neighbouring classes; classes without pairs have nulls."""
    refs, _ = C.split_bank(_vectors(spark, d), 6)
    x = C.bank_pairs(refs).filter("class_b - class_a between -1 and 1").groupBy(F.least("class_a", "class_b").alias("low"), F.greatest("class_a", "class_b").alias("high"))
    found = x.agg(F.count("*").alias("pairs"), *[F.round(f("d"), R6).alias(n) for f, n in ((F.median, "mid"), (F.min, "least"), (F.max, "most"))])
    cells = spark.range(12).select(F.col("id").cast("int").alias("low"), F.explode(F.array(F.col("id").cast("int"), (F.col("id") + 1).cast("int"))).alias("high"))
    return cells.join(found, ["low", "high"], "left").select("low", "high", F.coalesce("pairs", F.lit(0)).alias("pairs"), "mid", "least", "most")


def forced_nearest(spark, d):
    """The nearest class even so, unless two are equally near; and whether it lies within half the distance of that class to its nearest neighbour."""
    refs, _ = C.split_bank(_vectors(spark, d), 1)
    order = Window.partitionBy("query").orderBy("d", "ref_class")
    x = _distances(spark, d).withColumn("r", F.row_number().over(order)).withColumn("second", F.lead("d").over(order)).filter("r = 1")
    apart = C.bank_pairs(refs).select(F.explode(F.array("class_a", "class_b")).alias("ref_class"), "d").groupBy("ref_class").agg(F.min("d").alias("apart"))
    tie = F.coalesce(F.abs(F.col("second") - F.col("d")) <= 1e-9 * F.greatest("second", "d"), F.lit(False))
    y = x.join(F.broadcast(apart), "ref_class", "left")
    return y.select("query", "truth", F.when(~tie, F.col("ref_class")).alias("forced"), (F.col("d") < 0.5 * F.col("apart")).alias("inside"))


def compared_shapes(spark, d):
    """Each query against its class's reference, some on another grid by rule: unavailable, or the distance and where the signed difference is greatest."""
    refs, queries = C.split_bank(_vectors(spark, d), 1)
    if refs.limit(C.MAX_REFERENCES + 1).count() > C.MAX_REFERENCES:
        raise ValueError("the bank is too large")
    x = queries.withColumn("shape", F.when(F.col("id") % 11 == 0, F.slice("shape", 1, 32)).otherwise(F.col("shape"))).join(F.broadcast(refs.select("class", F.col("shape").alias("rs"))), "class")
    away = F.zip_with("shape", "rs", lambda a, b: a - b)
    gap = rms_distance(F.col("shape"), F.col("rs"))
    most = F.array_max(F.transform(away, lambda v, i: F.struct(F.round(F.abs(v), 9).alias("q"), (-i).alias("i"), v.alias("v"))))
    return x.select("id", F.when(gap.isNull(), "unavailable").otherwise("available").alias("status"), F.round(gap, R6).alias("d"), F.when(gap.isNotNull(), -most["i"]).alias("at"), F.when(gap.isNotNull(), F.round(most["v"], R6)).alias("difference"))


def open_set_rates(spark, d):
    """Coverage and error rates of the open-set rule; null where nothing counts."""
    x = _decisions(spark, d).select((F.col("truth") < 8).alias("known"), "outcome", (F.col("nearest") == F.col("truth")).alias("hit"))
    accepted = F.count_if(F.col("outcome") == "known")
    wrong = F.count_if((F.col("outcome") == "known") & ~(F.col("known") & F.col("hit")))
    rate = lambda a, b: F.round(F.try_divide(a, b), R6)
    return x.agg(
        F.count("*").alias("total"), rate(accepted, F.count("*")).alias("label_coverage"), rate(wrong, accepted).alias("label_error"), rate(F.count_if(F.col("outcome") != "indeterminate"), F.count("*")).alias("decision_coverage"),
        rate(F.count_if((F.col("outcome") == "known") & ~F.col("known")), F.count_if(~F.col("known"))).alias("false_accepts"), rate(F.count_if((F.col("outcome") == "known") & F.col("known") & F.col("hit")), F.count_if(F.col("known"))).alias("accuracy"),
    )


_BASE = """
WITH s AS (SELECT vec_id AS id, label AS class, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
v AS (SELECT id, class, list_transform(e, lambda x: x - list_sum(e) / len(e)) AS shape, row_number() OVER (PARTITION BY class ORDER BY id) AS r FROM s),
d AS (SELECT q.id AS query, q.class AS truth, f.id AS ref, f.class AS ref_class,
             sqrt(list_sum(list_transform(list_zip(q.shape, f.shape), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) / len(q.shape)) AS d
      FROM v q JOIN v f ON f.r <= {n} AND q.r > {n}),
k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY d, ref_class) AS r, lead(d) OVER (PARTITION BY query ORDER BY d, ref_class) AS second FROM d),
o AS (SELECT query, truth, ref_class AS nearest, d, second - d AS lead, CASE WHEN d > 0.18 THEN 'outside_reference' WHEN second - d < 0.002 THEN 'indeterminate' ELSE 'known' END AS outcome FROM k WHERE r = 1),
pr AS (SELECT x.class, x.id AS a, y.id AS b, y.class AS other, sqrt(list_sum(list_transform(list_zip(x.shape, y.shape), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) / len(x.shape)) AS d
       FROM v x JOIN v y ON x.id < y.id AND x.r <= {n} AND y.r <= {n})
"""


def _sql(text: str, n: int = 1) -> str:
    return _BASE.replace("{n}", str(n)) + text


SQL = {
    "nearest_reference_decision": _sql("SELECT query, truth, nearest, round(d, 6) AS d, round(lead, 6) AS lead, outcome FROM o"),
    "nearest_reference_confusion": _sql("SELECT truth, nearest, outcome, count(*) AS n FROM o GROUP BY ALL"),
    "nearest_reference_scores": _sql("""SELECT label, CAST(sum(s) AS BIGINT) AS support, CAST(sum(p) AS BIGINT) AS predicted, CAST(sum(t) AS BIGINT) AS correct,
        round(CASE WHEN sum(s) > 0 THEN sum(t) / sum(s) END, 6) AS recall, round(2.0 * sum(t) / (sum(s) + sum(p)), 6) AS f1
        FROM (SELECT truth AS label, 1 AS s, 0 AS p, CASE WHEN outcome = 'known' AND nearest = truth THEN 1 ELSE 0 END AS t FROM o UNION ALL SELECT nearest, 0, 1, 0 FROM o WHERE outcome = 'known') GROUP BY label"""),
    "overall_scores": _sql("""SELECT CAST(sum(s) AS BIGINT) AS n, CAST(sum(p) AS BIGINT) AS answered, CAST(sum(t) AS BIGINT) AS correct, round(sum(t) / sum(s), 6) AS accuracy, round(sum(p) / sum(s), 6) AS coverage, round(sum(t) / nullif(sum(p), 0), 6) AS precision, round(avg(f1), 5) AS macro_f1
        FROM (SELECT label, sum(s) AS s, sum(p) AS p, sum(t) AS t, round(2.0 * sum(t) / (sum(s) + sum(p)), 6) AS f1 FROM (SELECT truth AS label, 1 AS s, 0 AS p, CASE WHEN outcome = 'known' AND nearest = truth THEN 1 ELSE 0 END AS t FROM o UNION ALL SELECT nearest, 0, 1, 0 FROM o WHERE outcome = 'known') GROUP BY label)"""),
    "class_ranking_regimes": _sql("""SELECT query, class, round(min(d), 6) AS d FROM (SELECT query, class, regime, median(d) AS d FROM (SELECT query, ref_class AS class, ref % 2 AS regime, ref % 5 AS g, median(d) AS d FROM d GROUP BY ALL) GROUP BY ALL) GROUP BY ALL""", 4),
    "bank_variability": _sql("SELECT class, a % 2 = b % 2 AS within, count(*) AS pairs, round(min(d), 6) AS low, round(median(d), 6) AS mid, round(max(d), 6) AS high FROM pr WHERE class = other GROUP BY ALL", 6),
    "reference_separation": _sql("SELECT ref, round(min(d), 6) AS nearest FROM (SELECT a AS ref, d FROM pr UNION ALL SELECT b, d FROM pr) GROUP BY ref"),
    "medoid_per_class": _sql("SELECT class, id AS medoid FROM (SELECT class, id, row_number() OVER (PARTITION BY class ORDER BY round(avg(d), 9), id) AS r FROM (SELECT class, a AS id, d FROM pr WHERE class = other UNION ALL SELECT class, b, d FROM pr WHERE class = other) GROUP BY class, id) WHERE r = 1", 1_000_000_000),
    "leave_one_class_out": _sql("""SELECT excluded, count(*) AS n, count(*) FILTER (WHERE nearest = truth) AS correct, count(*) FILTER (WHERE truth = excluded) AS unseen, round(avg(d), 6) AS mean_d
        FROM (SELECT excluded, query, truth, ref_class AS nearest, d, row_number() OVER (PARTITION BY excluded, query ORDER BY d, ref_class) AS r FROM d JOIN (SELECT DISTINCT label AS excluded FROM embeddings) ON ref_class <> excluded) WHERE r = 1 GROUP BY excluded"""),
    "leave_group_out_holdout": _sql("SELECT query, truth, ref_class AS nearest, round(d, 6) AS d FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY d, ref_class) AS r FROM d WHERE query % 5 <> ref % 5) WHERE r = 1", 4),
    "retrieval_top2x2": _sql("""SELECT query, CAST(c AS INTEGER) AS c, CAST(m AS INTEGER) AS m, ref FROM (SELECT *, dense_rank() OVER (PARTITION BY query ORDER BY best, ref_class) AS c FROM (SELECT *, row_number() OVER (PARTITION BY query, ref_class ORDER BY d, ref) AS m, min(d) OVER (PARTITION BY query, ref_class) AS best FROM d) WHERE m <= 2) WHERE c <= 2""", 4),
    "open_set_evaluation": _sql("""SELECT CASE WHEN outcome = 'indeterminate' THEN outcome WHEN outcome = 'outside_reference' THEN CASE WHEN truth < 8 THEN 'false_rejection' ELSE 'correct_unknown_rejection' END WHEN truth >= 8 THEN 'unknown_false_accept' WHEN nearest = truth THEN 'correct_known' ELSE 'wrong_known' END AS category, count(*) AS n, round(avg(d), 6) AS mean_d FROM o GROUP BY 1"""),
    "geometry_spread_lead": _sql("SELECT query, round(max(d) - min(d), 6) AS spread, round(max(CASE WHEN r = 1 THEN second - d END), 6) AS lead FROM k GROUP BY query"),
    "ratio_rule_calibration": _sql("""SELECT fraction, count(*) FILTER (WHERE d / apart <= fraction) AS accepted, count(*) FILTER (WHERE d / apart <= fraction AND nearest = truth) AS correct
        FROM o JOIN (SELECT c, min(d) AS apart FROM (SELECT class AS c, d FROM pr UNION ALL SELECT other, d FROM pr) GROUP BY c) ON c = nearest CROSS JOIN (SELECT unnest([0.25, 0.375, 0.5, 0.625, 0.75, 1.0])::DOUBLE AS fraction) GROUP BY fraction"""),
    "band_contributions": _sql("""SELECT id, CAST(floor(i / 16) AS BIGINT) AS band, round(sum(q) / max(k), 9) AS share FROM (SELECT q.id, len(q.shape) AS k, unnest(range(len(q.shape))) AS i,
        unnest(list_transform(list_zip(q.shape, f.shape), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS q FROM v q JOIN v f ON f.r = 1 AND q.r > 1 AND q.class = f.class) GROUP BY 1, 2"""),
}
_RMS = lambda a, b: f"sqrt(list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) / len({a}))"
_SHIFTS = " UNION ALL ".join(f"SELECT id, {k} AS shift, round({_RMS(f'q[{1 + max(k, 0)}:{64 + min(k, 0)}]', f'r[{1 - min(k, 0)}:{64 - max(k, 0)}]')}, 9) AS d FROM j" for k in range(-3, 4))
_METHODS = " UNION ALL ".join(f"SELECT q.id AS query, q.class AS truth, f.class AS ref_class, '{n}' AS method, round({_RMS(f'q.shape[{a}:{b}]', f'f.shape[{a}:{b}]')}, 9) AS d FROM v q JOIN v f ON f.r = 1 AND q.r > 1" for n, a, b in (("whole", 1, 64), ("lower", 1, 32), ("upper", 33, 64)))
SQL |= {
    "separation_metrics": _sql(""", e AS (SELECT least(class * 10 + a % 3, other * 10 + b % 3) AS x, greatest(class * 10 + a % 3, other * 10 + b % 3) AS y, d FROM pr), g AS (SELECT x // 10 AS ca, y // 10 AS cb, median(d) AS d FROM e WHERE x <> y GROUP BY x, y),
        w AS (SELECT ca AS class, d FROM g WHERE ca = cb), b AS (SELECT ca AS class, cb AS other, d FROM g WHERE ca <> cb UNION ALL SELECT cb, ca, d FROM g WHERE ca <> cb), near AS (SELECT class, other, median(d) AS m, row_number() OVER (PARTITION BY class ORDER BY median(d), other) AS r FROM b GROUP BY 1, 2),
        z AS (SELECT w.class, avg(CASE WHEN w.d < b.d THEN 1 WHEN w.d = b.d THEN 0.5 ELSE 0 END) AS ordered FROM w JOIN near ON near.class = w.class AND near.r = 1 JOIN b ON b.class = near.class AND b.other = near.other GROUP BY 1)
        SELECT class, pairs, other AS nearest, round(wm / nullif(m, 0), 6) AS ratio, round(least - most, 6) AS gap, round(ordered, 6) AS ordered FROM (SELECT class, count(*) AS pairs, median(d) AS wm, max(d) AS most FROM w GROUP BY 1) JOIN (SELECT class, min(d) AS least FROM b GROUP BY 1) USING (class) JOIN near USING (class) JOIN z USING (class) WHERE near.r = 1""", 6),
    "class_threshold_calibration": _sql(""", l AS (SELECT class AS c, max(d) AS lim FROM pr WHERE class = other GROUP BY 1), m AS (SELECT query, truth, ref_class, min(d) AS d FROM d GROUP BY ALL),
        t AS (SELECT truth, true AS visible, ref_class AS c, d FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY d, ref_class) AS r FROM m) WHERE r = 1 UNION ALL SELECT truth, false, ref_class, d FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY d, ref_class) AS r FROM m WHERE ref_class <> truth) WHERE r = 1),
        y AS (SELECT factor, count(*) FILTER (WHERE visible AND d <= factor * lim AND c = truth) AS known, count(*) FILTER (WHERE NOT visible AND d > factor * lim) AS unknown FROM t JOIN l USING (c) CROSS JOIN (SELECT unnest([1.0, 1.05, 1.1, 1.2, 1.25, 1.5])::DOUBLE AS factor) GROUP BY 1)
        SELECT factor, known, unknown, row_number() OVER (ORDER BY known + unknown DESC, factor DESC) = 1 AS chosen FROM y""", 6),
    "shift_search_distance": _sql(f", j AS (SELECT q.id, q.shape AS q, f.shape AS r FROM v q JOIN v f ON f.r = 1 AND q.r > 1 AND q.class = f.class), tried AS ({_SHIFTS}) SELECT id, round(d, 6) AS d, shift FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, abs(shift), shift) AS r FROM tried) WHERE r = 1"),
    "screen_score_table": _sql(f", a AS ({_METHODS}), b AS (SELECT *, row_number() OVER (PARTITION BY query, method ORDER BY d, ref_class) AS rank FROM a), c AS (SELECT query % 3 AS scenario, method, rank FROM b WHERE truth = ref_class) SELECT scenario, method, count(*) AS total, count(*) FILTER (WHERE rank = 1) AS correct, round(avg(rank), 6) AS mean_rank FROM c GROUP BY GROUPING SETS ((scenario, method), (method))"),
    "distance_summary": _sql(", f AS (SELECT least(class, other) AS low, greatest(class, other) AS high, count(*) AS pairs, round(median(d), 6) AS mid, round(min(d), 6) AS least, round(max(d), 6) AS most FROM pr WHERE abs(class - other) <= 1 GROUP BY 1, 2), c AS (SELECT CAST(i AS INTEGER) AS low, CAST(i + j AS INTEGER) AS high FROM (SELECT unnest(range(12)) AS i) CROSS JOIN (SELECT unnest(range(2)) AS j)) SELECT low, high, coalesce(pairs, 0) AS pairs, mid, least, most FROM c LEFT JOIN f USING (low, high)", 6),
    "forced_nearest": _sql(", h AS (SELECT c, min(d) AS apart FROM (SELECT class AS c, d FROM pr UNION ALL SELECT other, d FROM pr) GROUP BY 1) SELECT query, truth, CASE WHEN NOT coalesce(abs(second - d) <= 1e-9 * greatest(second, d), false) THEN ref_class END AS forced, d < 0.5 * apart AS inside FROM k LEFT JOIN h ON c = ref_class WHERE r = 1"),
    "compared_shapes": _sql(f''', j AS (SELECT q.id, q.shape AS q, f.shape AS r FROM v q JOIN v f ON f.r = 1 AND q.r > 1 AND q.class = f.class), e AS (SELECT id, unnest(range(64)) AS i, unnest(list_transform(list_zip(q, r), lambda p: p[1] - p[2])) AS v FROM j WHERE id % 11 <> 0), m AS (SELECT id, CAST(i AS INTEGER) AS place, round(v, 6) AS difference FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(abs(v), 9) DESC, i) AS n FROM e) WHERE n = 1) SELECT id, CASE WHEN id % 11 = 0 THEN 'unavailable' ELSE 'available' END AS status, CASE WHEN id % 11 <> 0 THEN round({_RMS('q', 'r')}, 6) END AS d, place AS "at", difference FROM j LEFT JOIN m USING (id)'''),
    "open_set_rates": _sql("SELECT count(*) AS total, round(count(*) FILTER (WHERE outcome = 'known') / count(*), 6) AS label_coverage, round(count(*) FILTER (WHERE outcome = 'known' AND NOT (truth < 8 AND nearest = truth)) / nullif(count(*) FILTER (WHERE outcome = 'known'), 0), 6) AS label_error, round(count(*) FILTER (WHERE outcome <> 'indeterminate') / count(*), 6) AS decision_coverage, round(count(*) FILTER (WHERE outcome = 'known' AND truth >= 8) / nullif(count(*) FILTER (WHERE truth >= 8), 0), 6) AS false_accepts, round(count(*) FILTER (WHERE outcome = 'known' AND truth < 8 AND nearest = truth) / nullif(count(*) FILTER (WHERE truth < 8), 0), 6) AS accuracy FROM o"),
}
QUERIES = {n: globals()[n] for n in SQL}
