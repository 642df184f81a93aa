"""Queries of decision contracts, ordered state and learning, on decisions made from the tables and spoilt by rule, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.operators import decisions as V
from cadenza.operators import learning as L
from cadenza.operators import nested as N
from cadenza.streaming import review as R
from cadenza.streaming import stateful as T

#: Conditions compared; the mean square distance up to which two vectors are alike; what spoils a body, by id modulo 12: a text in it and what stands there instead.
CONDITIONS, ALIKE = 4, 1.9
SPOILT = {
    1: ('"similar":false', '"similar":0'), 2: ('"condition_id":"C1"', '"condition_id":"C0"'), 3: ('"R:C2"', '"R:C3"'), 4: ('"Q:report"', '"Q:other"'), 5: ('"explanation":"', '"note":"'), 6: ('"explanation":"alike"', '"explanation":" "'),
    7: ('"outcome":"similar"', '"outcome":"different"'), 8: ('"comparisons":[', '"comparisons":[{},'), 9: ('"differences":[]', '"differences":[null]'), 10: ('}]', '}'),
}


def _spoilt(id_: Column, body: Column, spoilt: dict[int, tuple[str, str]], of: int) -> Column:
    out = body
    for k, (old, new) in spoilt.items():
        out = F.when(id_ % of == k, F.replace(body, F.lit(old), F.lit(new))).otherwise(out)
    return out


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), "label", F.transform("embedding", lambda v: v.cast("double")).alias("v"))


def _near(spark: SparkSession, d: str) -> DataFrame:
    """(id, label, near): for each vector, an array of conditions with whether it is alike to the first vector of their class."""
    x = _vectors(spark, d)
    first = x.filter(F.col("label") < CONDITIONS).groupBy("label").agg(F.min_by("v", "id").alias("r"))
    refs = first.agg(F.map_from_entries(F.collect_list(F.struct("label", "r"))).alias("refs")).withColumn("one", F.lit(1))
    near = lambda i: F.aggregate(F.zip_with("v", F.element_at("refs", i), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, y: s + y)
    labels = F.array_sort(F.map_keys("refs"))
    return x.withColumn("one", F.lit(1)).join(F.broadcast(refs), "one").select("id", "label", F.transform(labels, lambda i: F.struct(F.concat(F.lit("C"), i.cast("string")).alias("c"), (near(i) <= ALIKE).alias("s"))).alias("near"))


def whole_report_validation(spark, d):
    """Decisions in JSON on each vector, from its distances to the first vectors of four classes, most of them spoilt in their text; by the rule that is broken first."""
    y = _near(spark, d)
    comparison = F.transform("near", lambda n: F.to_json(F.struct(n["c"].alias("condition_id"), n["s"].alias("similar"), F.array(F.lit("level")).alias("similarities"), F.array().cast("array<string>").alias("differences"), F.array(F.concat(F.lit("R:"), n["c"]), F.lit("Q:report")).alias("evidence_ids"))))
    chosen = F.get(F.filter("near", lambda n: n["s"]), F.lit(0))["c"]
    body = F.concat(F.lit('{"outcome":"'), F.when(chosen.isNull(), "different").otherwise("similar"), F.lit('","condition_id":'), F.coalesce(F.concat(F.lit('"'), chosen, F.lit('"')), F.lit("null")), F.lit(',"comparisons":['), F.array_join(comparison, ","), F.lit('],"explanation":"alike"}'))
    references = F.map_from_entries(F.transform("near", lambda n: F.struct(n["c"], F.array(F.concat(F.lit("R:"), n["c"])))))
    verdicts = V.whole_report(y.select("id", _spoilt(F.col("id"), body, SPOILT, 12).alias("body"), references.alias("references"), F.array(F.lit("Q:report")).alias("query")))
    return verdicts.groupBy("verdict").agg(F.count("*").alias("n"), F.min("id").alias("first"), F.max("id").alias("last"))


#: What spoils a visual decision and an audit of diagrams, by id modulo 7.
VISUAL = {1: ('"outcome":"known"', '"outcome":"likely"'), 2: ('"condition_id":"', '"condition_id":"X'), 3: (',"explanation":"seen"', ""), 4: ('"seen"', '""'), 5: ('"condition_id":null', '"condition_id":"C1"'), 6: ("}", "")}
AUDITS = {1: ('"figure":"F1"', '"figure":"F2"'), 2: ('"view":"ridge"', '"view":"welch"'), 3: ('"finding":"clear"', '"finding":"clear","note":1'), 4: ('"views":[', '"views":[1,2,3,'), 5: ('"views"', '"ranked"'), 6: ('"view":"welch"', '"view":"wavelet"')}


def visual_decisions(spark, d):
    """Decisions of three keys in JSON on each vector: its class if that is one of four, else none; most of them spoilt in their text."""
    x = _vectors(spark, d).select("id", "label")
    known = F.col("label") < CONDITIONS
    body = F.concat(F.lit('{"outcome":"'), F.when(known, "known").otherwise("outside_reference"), F.lit('","condition_id":'), F.when(known, F.concat(F.lit('"C'), F.col("label").cast("string"), F.lit('"'))).otherwise("null"), F.lit(',"explanation":"seen"}'))
    conditions = F.array(*[F.lit(f"C{i}") for i in range(CONDITIONS)])
    verdicts = V.visual_decision(x.select("id", _spoilt(F.col("id"), body, VISUAL, 7).alias("body"), conditions.alias("conditions")))
    return verdicts.groupBy("verdict").agg(F.count("*").alias("n"), F.min("id").alias("first"), F.max("id").alias("last"))


def diagram_audit(spark, d):
    """Audits in JSON on each vector: as many of its views as its class says, the first one first; most of them spoilt in their text."""
    x = _vectors(spark, d).select("id", "label")
    names = F.array(*map(F.lit, ("welch", "ridge", "cepstrum", "orders", "wavelet", "levels")))
    entries = F.transform(F.slice(names, 1, (F.col("label") % 6 + 1).cast("int")), lambda v, i: F.concat(F.lit('{"view":"'), v, F.lit('","figure":"F'), i.cast("string"), F.lit('","finding":"clear"}')))
    figures = F.map_from_entries(F.transform(F.filter(names, lambda v: v != "wavelet"), lambda v: F.struct(v, F.concat(F.lit("F"), (F.array_position(names, v) - 1).cast("string")))))
    body = F.concat(F.lit('{"views":['), F.array_join(entries, ","), F.lit("]}"))
    verdicts = V.diagram_audit(x.select("id", _spoilt(F.col("id"), body, AUDITS, 7).alias("body"), figures.alias("figures")))
    return verdicts.groupBy("verdict").agg(F.count("*").alias("n"), F.min("id").alias("first"), F.max("id").alias("last"))


def outcome_categories(spark, d):
    """Each vector against the first vectors of the first four classes: alike to one of them is known, to none is outside, to several is undecided; what that is worth, by the vector's own class."""
    near = _near(spark, d)
    alike = F.filter("near", lambda n: n["s"])
    truth = F.when(F.col("label") < CONDITIONS, F.concat(F.lit("C"), F.col("label").cast("string")))
    return near.groupBy(V.outcome_category(truth, F.get(alike, F.lit(0))["c"], F.size(alike) > 1).alias("kind")).agg(F.count("*").alias("n"), F.min("id").alias("first"))


#: What spoils a teacher's answer, by the document's id modulo 10.
ANSWERS = {1: ('"score":0', '"score":"0'), 2: ('"observations":["', '"observations":["","'), 3: ('"label"', '"labels"'), 4: ('"observations":', '"score":0.5,"observations":'), 5: ('"score":0', '"score":1'), 6: ('"]}', '"]')}


def teacher_answers(spark, d):
    """Answers in JSON on each document: its language as label, its share of letters as score, its lines as observations, some spoilt in their text; by the rule that is broken first."""
    x = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text"))
    lines = F.filter(F.transform(F.split("text", "\n"), lambda t: F.regexp_replace(t, "[^A-Za-z0-9 ]", "")), lambda t: F.trim(t) != "")
    share = F.round(F.length(F.regexp_replace("text", "[^A-Za-z]", "")) / F.greatest(F.length("text"), F.lit(1)) * 0.9, 3)
    body = F.concat(F.lit('{"label":"'), F.coalesce("lang", F.lit("")), F.lit('","score":'), F.format_string("%.3f", share), F.lit(',"observations":['), F.array_join(F.transform(lines, lambda t: F.concat(F.lit('"'), t, F.lit('"'))), ","), F.lit("]}"))
    verdicts = V.teacher_answer(x.select(F.col("doc_id").alias("id"), _spoilt(F.col("doc_id"), body, ANSWERS, 10).alias("body")))
    return verdicts.groupBy("verdict").agg(F.count("*").alias("n"), F.min("id").alias("first"), F.max("id").alias("last"))


def decision_schemas(spark, d):
    """The schema of decisions on the brands of each size of parts: its length, what may be chosen, and the keys it asks for."""
    x = spark.read.parquet(f"{d}/part.parquet").groupBy("p_size").agg(F.array_sort(F.collect_set("p_brand")).alias("c")).select("p_size", "c", V.report_schema(F.col("c")).alias("s"))
    v = F.parse_json("s")
    at = lambda p, t: F.variant_get(v, "$.json_schema.schema." + p, t)
    return x.select("p_size", F.size(at("properties.condition_id.enum", "array<string>")).alias("choices"), F.array_join(at("required", "array<string>"), ",").alias("keys"), F.length("s").cast("long").alias("length"))


def interleaved_arms(spark, d):
    """Stages of two arms for each user in the order they are due: by position, then stage, the arm that goes first taking turns."""
    x = spark.read.parquet(f"{d}/events.parquet").select("user_id", "event_id", "ts", F.when(F.col("event_id") % 2 == 0, "fixed").otherwise("adaptive").alias("arm"))
    place = Window.partitionBy("user_id", "arm").orderBy("ts", "event_id")
    x = x.withColumn("position", F.row_number().over(place) - 1).withColumn("stage", F.explode(F.slice(F.array(F.lit(0), F.lit(1), F.lit(2)), 1, (F.col("event_id") % 3 + 1).cast("int"))))
    second = F.col("arm") != F.when(F.col("position") % 2 == 0, "fixed").otherwise("adaptive")
    due = Window.partitionBy("user_id").orderBy("position", "stage", second)
    return x.select("user_id", "arm", "position", "stage", F.row_number().over(due).alias("turn"))


def seeded_sample(spark, d):
    """Ten documents of each source without replacement, by a salted digest of the id: any run, of any size of cluster, draws the same."""
    x = spark.read.parquet(f"{d}/documents.parquet").select("source", "doc_id", F.sha2(F.concat(F.lit("draw-17:"), F.col("doc_id").cast("string")), 256).alias("h"))
    drawn = x.withColumn("place", F.row_number().over(Window.partitionBy("source").orderBy("h")))
    return drawn.filter("place <= 10").select("source", "place", "doc_id")


#: Classes of memory decisions, and what spoils one, by id modulo 9.
CLASSES = [f"C{i}" for i in range(5)]
MEMORY = {1: ('"decision":"accept"', '"decision":"review"'), 2: ('.CARD"', '.CARDS"'), 3: ('"Q:report",', ""), 4: ('"candidates":[', '"candidates":["C0","C0",'), 5: ('"explanation":"near"', '"explanation":null'), 6: ('"condition_id":null', '"condition_id":"C1"'), 7: ('"evidence":[', '"evidence":["R:other",')}


def memory_decisions(spark, d):
    """Decisions in JSON on each vector: its class where that is one of five, else review, with the cards of its class and the next one; most of them spoilt in their text."""
    x = _vectors(spark, d).select("id", (F.col("label") % 7).alias("k"))
    name = lambda k: F.concat(F.lit("C"), k.cast("string"))
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    known = F.col("k") < len(CLASSES)
    two = F.array(F.col("k") % len(CLASSES), (F.col("k") + 1) % len(CLASSES))
    body = F.concat(
        F.lit('{"decision":"'), F.when(known, "accept").otherwise("review"), F.lit('","condition_id":'), F.when(known, quoted(name(F.col("k")))).otherwise("null"), F.lit(',"candidates":['), F.array_join(F.transform(two, lambda k: quoted(name(k))), ","),
        F.lit('],"evidence":["Q:report",'), F.array_join(F.transform(two, lambda k: quoted(F.concat(name(k), F.lit(".CARD")))), ","), F.lit('],"explanation":"near"}'),
    )
    evidence = F.concat(F.array(F.lit("Q:report")), F.transform(two, lambda k: F.concat(name(k), F.lit(".CARD"))))
    verdicts = V.memory_decision(x.select("id", _spoilt(F.col("id"), body, MEMORY, 9).alias("body"), evidence.alias("evidence"), F.lit("Q:report").alias("query")), CLASSES)
    return verdicts.groupBy("verdict").agg(F.count("*").alias("n"), F.min("id").alias("first"), F.max("id").alias("last"))


#: Views that are taken out of packets, and keys whose texts stay in them.
PRUNED, TEXTS = ["cepstrum", "orders"], ["status"]
_VIEWS = ("welch", "cepstrum", "ridge", "orders")


def _packets(spark: SparkSession, d: str) -> DataFrame:
    """A packet in JSON for each conversation: its turns with views of each, and cells that cite them."""
    x = spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role", F.length("text").alias("n"))
    views = F.struct(*[F.when((F.col("turn") + k) % 3 != 0, F.struct((F.col("n") * (k + 1)).alias("power"), F.array(F.col("turn"), F.col("n")).alias("bins"), F.col("role").alias("note"))).alias(v) for k, v in enumerate(_VIEWS)])
    turn = F.struct("turn", F.struct("n", F.col("role").alias("status"), F.lit("free text").alias("remark"), views.alias("views")).alias("t"), F.transform(F.array(*map(F.lit, _VIEWS)), lambda v: F.concat(F.lit("report."), F.col("turn").cast("string"), F.lit("."), v)).alias("cells"))
    y = x.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    return y.select(F.col("conv_id").alias("id"), F.to_json(F.struct(F.transform("t", lambda t: t["t"]).alias("turns"), F.flatten(F.transform("t", lambda t: t["cells"])).alias("cells"))).alias("body"))


def view_pruning(spark, d):
    """Packets without some views, and without what cites them, put together again: values before and after, the sum of numbers that are left, and what a second reading still finds of those views."""
    tree = N.nodes(spark, _packets(spark, d))
    after = N.nodes(spark, N.assembled(N.pruned(tree, PRUNED)))
    number = F.coalesce(F.col("value").try_cast("double"), F.lit(0.0))
    names = F.array(*[F.lit(f".{v}") for v in PRUNED])
    left = F.arrays_overlap("path", names) | F.coalesce(F.col("value").rlike("[.](" + "|".join(PRUNED) + ')"$'), F.lit(False))
    old = tree.groupBy("id").agg(F.count("value").alias("before"))
    new = after.groupBy("id").agg(F.count("value").alias("kept"), F.sum(number).alias("total"), F.count_if(left).alias("left_over"))
    return old.join(new, "id", "left")


def evidence_packets(spark, d):
    """Packets without free texts: values of each kind that are left, and the turns of the packet put together."""
    tree = N.without_texts(N.nodes(spark, _packets(spark, d)), TEXTS)
    texts = F.coalesce(F.startswith("value", F.lit('"')), F.lit(False))
    kinds = tree.filter("kind = 'value'").groupBy("id").agg(F.count_if(texts).alias("texts"), F.count_if(~texts).alias("others"))
    turns = F.size(F.variant_get(F.parse_json("body"), "$.turns", "array<variant>"))
    return kinds.join(N.assembled(tree).select("id", turns.alias("turns")), "id")


def silver_labels(spark, d):
    """Answers of a teacher that reads letters: the language by the marks it uses, with the share of plain letters as score; too long texts fail, too short ones it leaves. By what became of them, and how many are right."""
    x = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text"))
    n = F.length("text")
    label = F.when(n < 60, F.lit(None)).when(F.col("text").rlike("[äöüß]"), "de").when(F.col("text").rlike("[ñáó]"), "es").when(F.col("text").rlike("[éèêç]"), "fr").when(F.col("text").rlike("[0-9]{3}"), "numbers").otherwise("en")
    score = F.round(F.length(F.regexp_replace("text", "[^A-Za-z ]", "")) / F.greatest(n, F.lit(1)), 6)
    answers = x.select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 4 == 3, "test").otherwise("train").alias("partition"), label.alias("label"), score.alias("score"), F.when(n > 12_000, "too long").alias("error"), "lang")
    told = L.silver_status(answers, ["en", "de", "fr", "es"])
    return told.groupBy("status").agg(F.count("*").alias("n"), F.count_if((F.col("status") == "labelled") & (F.col("label") == F.col("lang"))).alias("right"), F.round(F.avg("score"), 4).alias("score"))


def specialist_scores(spark, d):
    """A linear specialist on embeddings: every fifth row is held out; right answers and mean probability by class."""
    x = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda v: v.cast("double")).alias("features"), F.col("label").cast("string").alias("label"))
    held = x.filter("id % 5 = 0")
    said = L.predict(L.fit_specialist(x.filter("id % 5 <> 0").select("features", "label")), held).join(held.select("id", "label"), "id")
    return said.groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col("said") == F.col("label")).alias("correct"), F.round(F.avg("score"), 3).alias("score"))


def margin_machine(spark, d):
    """A margin machine with a radial kernel on embeddings, classes weighed alike: every fifth row is held out; right answers by class."""
    x = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda v: v.cast("double")).alias("features"), F.col("label").cast("string").alias("label"))
    held = x.filter("id % 5 = 0")
    said = L.fit_margins(x.filter("id % 5 <> 0").select("features", "label"), features=128).predict(held).join(held.select("id", "label"), "id")
    return said.groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col("said") == F.col("label")).alias("correct"))


#: Fixed values. Reviews that an arm may ask a person for; requests of a run at most, cents each reserves, milliseconds until one counts as lost.
REVIEWS, LIMIT = 16, T.Budget(most=40, reserve=411, lost=7_200_000)


def _journal(spark: SparkSession, d: str) -> DataFrame:
    """An arm for each user, a query for each event: a third are accepted at once, a third by retrieval, a third need a person. Every tenth has a person's label too early, every thirteenth is of the bank."""
    x = spark.read.parquet(f"{d}/events.parquet").withColumn("id", F.col("event_id"))
    arm = F.concat(F.when(F.col("user_id") % 2 == 0, "adaptive-").otherwise("fixed-"), F.col("user_id").cast("string"))
    label = F.concat(F.lit("c"), (F.col("id") % 4).cast("string"))

    def row(place: int, stage: str, action, label) -> Column:
        return F.struct(F.lit(place).alias("place"), F.lit(stage).alias("stage"), action.cast("string").alias("action"), label.cast("string").alias("label"))

    none = F.lit(None)
    rows = [
        row(0, "summary", F.when(F.col("id") % 3 == 0, "accept").otherwise("review"), F.when(F.col("id") % 3 == 0, label)), F.when(F.col("id") % 10 == 7, row(1, "human", none, label)),
        F.when(F.col("id") % 3 > 0, row(2, "retrieval", F.when(F.col("id") % 3 == 1, "accept").otherwise("review"), F.when(F.col("id") % 3 == 1, label))), F.when(F.col("id") % 3 == 2, row(3, "human", none, label)),
    ]
    each = x.select(arm.alias("arm"), "id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.explode(F.array_compact(F.array(*rows))).alias("r"))
    return each.select("arm", (F.col("at") * 4 + F.col("r.place")).alias("seq"), F.when(F.col("id") % 13 == 0, "seed").otherwise(F.col("id").cast("string")).alias("query"), "r.stage", "r.action", "r.label")


def review_machine(spark, d):
    """What came of the rows of each arm, with its reviews, and version and size of its bank in the end."""
    rows = _journal(spark, d)
    out = T.run_reviews(rows, rows.select("arm", F.lit("seed").alias("member"), F.lit("c0").alias("label")).distinct(), REVIEWS)
    counts = out.groupBy("arm", "outcome").agg(F.count("*").alias("n"), *[F.max(c).alias(c) for c in ("reviews", "version", "members")])
    whole = Window.partitionBy("arm")
    return counts.select("arm", "outcome", "n", *[F.max(c).over(whole).alias(c) for c in ("reviews", "version", "members")])


def _spending(spark: SparkSession, d: str) -> DataFrame:
    """A run for each user, a request for each event, which ends after `value` minutes, for some at no known or at too high a cost. Every seventh never ends, every seventeenth is tried twice."""
    x = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").cast("string").alias("run"), F.col("event_id").alias("id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), (F.unix_micros(F.col("ts").cast("timestamp")) + F.round(F.col("value") * 60_000_000).cast("long")).alias("to"))

    def row(at, kind: str, cost) -> Column:
        return F.struct(at.alias("at"), F.lit(kind).alias("kind"), cost.cast("long").alias("cost"))

    end = F.when(F.col("id") % 7 != 3, row(F.col("to"), "finish", F.when(F.col("id") % 5 != 1, F.col("id") * 7 % 450)))
    rows = [row(F.col("at"), "reserve", F.lit(None)), F.when(F.col("id") % 17 == 0, row(F.col("at") + 1, "reserve", F.lit(None))), end]
    each = x.select("run", "id", F.explode(F.array_compact(F.array(*rows))).alias("r"))
    return each.select("run", (F.col("r.at") * 2 + (F.col("r.kind") == "finish").cast("long")).alias("seq"), F.timestamp_micros("r.at").alias("time"), "r.kind", F.col("id").cast("string").alias("request"), "r.cost")


def budget_ledger(spark, d):
    """What came of the events of each run, and what it has spent in the end. Requests are lost as far as ten minutes before the last event."""
    rows = _spending(spark, d)
    last = rows.agg(F.max(F.unix_millis("time"))).first()[0]
    out = T.run_ledger(rows, LIMIT, None if last is None else last - 600_000)
    counts = out.groupBy("run", "outcome").agg(F.count("*").alias("n"), F.max_by("spent", F.when(F.col("spent").isNotNull(), F.col("seq"))).alias("spent"), F.max(F.when(F.col("spent").isNotNull(), F.col("seq"))).alias("seq"))
    whole = Window.partitionBy("run")
    return counts.select("run", "outcome", "n", F.max_by("spent", "seq").over(whole).alias("spent"))


def resumed_requests(spark, d):
    """Requests of documents that have no result yet, by digest: copies of what is done need none."""
    x = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang", F.sha2("text", 256).alias("request"))
    return R.not_yet_done(x, x.filter("doc_id % 3 = 0"), "request").groupBy("lang").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


def _spoilt_sql(id_: str, spoilt: dict[int, tuple[str, str]], of: int) -> str:
    return "CASE " + " ".join(f"WHEN {id_} % {of} = {k} THEN replace(body, '{old}', '{new}')" for k, (old, new) in spoilt.items()) + " ELSE body END"


SQL = {
    "whole_report_validation": f"""WITH v AS (SELECT vec_id AS id, label, embedding AS v FROM embeddings), f AS (SELECT label AS k, arg_min(v, id) AS r FROM v WHERE label < {CONDITIONS} GROUP BY 1),
n AS (SELECT id, 'C' || k AS c, list_sum(list_transform(list_zip(v, r), lambda z: (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)) * (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)))) <= {ALIKE}::DOUBLE AS s, k FROM v CROSS JOIN f),
b AS (SELECT id, '{{"outcome":"' || CASE WHEN bool_or(s) THEN 'similar' ELSE 'different' END || '","condition_id":' || coalesce('"' || (min(c) FILTER (s)) || '"', 'null') || ',"comparisons":[' ||
      string_agg('{{"condition_id":"' || c || '","similar":' || s || ',"similarities":["level"],"differences":[],"evidence_ids":["R:' || c || '","Q:report"]}}', ',' ORDER BY k) || '],"explanation":"alike"}}' AS body FROM n GROUP BY id),
s AS (SELECT id, {_spoilt_sql("id", SPOILT, 12)} AS body FROM b),
p AS (SELECT id, CASE WHEN json_valid(body) THEN CAST(body AS JSON) END AS j FROM s),
q AS (SELECT id, j, j->'$.comparisons[*]' AS cs FROM p),
r AS (SELECT id, j, cs, list_transform(cs, lambda c: c->>'$.condition_id') AS names, list_transform(list_filter(cs, lambda c: c->>'$.similar' = 'true'), lambda c: c->>'$.condition_id') AS alike,
      len(list_filter(cs, lambda c: NOT coalesce(list_sort(json_keys(c)) = ['condition_id', 'differences', 'evidence_ids', 'similar', 'similarities'] AND json_type(c->'$.similar') = 'BOOLEAN'
        AND len(list_filter(list_concat(list_concat(c->'$.similarities[*]', c->'$.differences[*]'), c->'$.evidence_ids[*]'), lambda t: json_type(t) <> 'VARCHAR')) = 0, false))) AS broken,
      len(list_filter(cs, lambda c: len(list_filter(c->>'$.evidence_ids[*]', lambda e: e <> 'R:' || (c->>'$.condition_id') AND e <> 'Q:report')) > 0)) AS fabricated,
      len(list_filter(cs, lambda c: NOT (list_contains(c->>'$.evidence_ids[*]', 'R:' || (c->>'$.condition_id')) AND list_contains(c->>'$.evidence_ids[*]', 'Q:report')))) AS one_sided FROM q)
SELECT CASE WHEN j IS NULL THEN 'json' WHEN list_sort(json_keys(j)) <> ['comparisons', 'condition_id', 'explanation', 'outcome'] THEN 'keys' WHEN j->>'$.outcome' NOT IN ('similar', 'different') THEN 'outcome' WHEN trim(j->>'$.explanation') = '' THEN 'explanation'
  WHEN len(cs) <> {CONDITIONS} THEN 'comparisons' WHEN broken > 0 THEN 'comparison' WHEN len(list_distinct(names)) < len(names) THEN 'condition' WHEN fabricated > 0 THEN 'fabricated' WHEN one_sided > 0 THEN 'one_sided'
  WHEN j->>'$.outcome' = 'similar' AND list_contains(alike, j->>'$.condition_id') OR j->>'$.outcome' = 'different' AND json_type(j->'$.condition_id') = 'NULL' AND len(alike) = 0 THEN 'valid' ELSE 'conclusion' END AS verdict,
  count(*) AS n, min(id) AS first, max(id) AS last FROM r GROUP BY 1""",
    "visual_decisions": f"""WITH b AS (SELECT vec_id AS id, '{{"outcome":"' || CASE WHEN label < {CONDITIONS} THEN 'known' ELSE 'outside_reference' END || '","condition_id":' || CASE WHEN label < {CONDITIONS} THEN '"C' || label || '"' ELSE 'null' END || ',"explanation":"seen"}}' AS body FROM embeddings),
s AS (SELECT id, {_spoilt_sql("id", VISUAL, 7)} AS body FROM b), p AS (SELECT id, CASE WHEN json_valid(body) THEN CAST(body AS JSON) END AS j FROM s)
SELECT CASE WHEN j IS NULL THEN 'json' WHEN list_sort(json_keys(j)) <> ['condition_id', 'explanation', 'outcome'] THEN 'keys' WHEN j->>'$.outcome' NOT IN ('known', 'outside_reference', 'indeterminate') THEN 'outcome'
  WHEN j->>'$.outcome' = 'known' AND j->>'$.condition_id' NOT IN ('C0', 'C1', 'C2', 'C3') OR j->>'$.outcome' <> 'known' AND json_type(j->'$.condition_id') <> 'NULL' THEN 'condition' WHEN trim(j->>'$.explanation') = '' THEN 'explanation' ELSE 'valid' END AS verdict, count(*) AS n, min(id) AS first, max(id) AS last FROM p GROUP BY 1""",
    "diagram_audit": f"""WITH n AS (SELECT ['welch', 'ridge', 'cepstrum', 'orders', 'wavelet', 'levels'] AS n), b AS (SELECT vec_id AS id, '{{"views":[' || array_to_string(list_transform(range(label % 6 + 1), lambda i: '{{"view":"' || n[i + 1] || '","figure":"F' || i || '","finding":"clear"}}'), ',') || ']}}' AS body FROM embeddings CROSS JOIN n),
s AS (SELECT id, CAST({_spoilt_sql("id", AUDITS, 7)} AS JSON) AS j FROM b), q AS (SELECT id, j, j->'$.views[*]' AS e, j->>'$.views[*].view' AS v, j->>'$.views[*].figure' AS f FROM s)
SELECT CASE WHEN json_keys(j) <> ['views'] THEN 'keys' WHEN len(e) NOT BETWEEN 1 AND 5 THEN 'count' WHEN len(list_filter(e, lambda x: NOT coalesce(list_sort(json_keys(x)) = ['figure', 'finding', 'view'], false))) > 0 THEN 'entry' WHEN list_contains(v, 'wavelet') THEN 'unavailable'
  WHEN len(list_distinct(v)) < len(v) THEN 'repeated' WHEN len(list_filter(list_zip(v, f), lambda z: z[2] <> 'F' || (list_position(['welch', 'ridge', 'cepstrum', 'orders', 'wavelet', 'levels'], z[1]) - 1))) > 0 THEN 'figure' ELSE 'valid' END AS verdict, count(*) AS n, min(id) AS first, max(id) AS last FROM q GROUP BY 1""",
    "teacher_answers": f"""WITH x AS (SELECT doc_id AS id, coalesce(lang, '') AS lang, coalesce(text, '') AS text FROM documents),
l AS (SELECT id, lang, round(length(regexp_replace(text, '[^A-Za-z]', '', 'g')) / greatest(length(text), 1)::DOUBLE * 0.9::DOUBLE, 3) AS share, list_filter(list_transform(string_split(text, chr(10)), lambda t: regexp_replace(t, '[^A-Za-z0-9 ]', '', 'g')), lambda t: trim(t) <> '') AS ls FROM x),
b AS (SELECT id, '{{"label":"' || lang || '","score":' || printf('%.3f', share) || ',"observations":[' || coalesce(array_to_string(list_transform(ls, lambda t: '"' || t || '"'), ','), '') || ']}}' AS body FROM l),
s AS (SELECT id, {_spoilt_sql("id", ANSWERS, 10)} AS body FROM b),
p AS (SELECT id, CASE WHEN json_valid(body) THEN CAST(body AS JSON) END AS j FROM s),
q AS (SELECT id, j, json_keys(j) AS k, j->'$.observations[*]' AS o FROM p)
SELECT CASE WHEN j IS NULL OR len(list_distinct(k)) < len(k) THEN 'json' WHEN list_sort(k) <> ['label', 'observations', 'score'] THEN 'keys' WHEN trim(j->>'$.label') = '' THEN 'label' WHEN json_type(j->'$.score') = 'VARCHAR' OR CAST(j->>'$.score' AS DOUBLE) NOT BETWEEN 0 AND 1 THEN 'score'
  WHEN len(o) > 64 OR len(list_filter(o, lambda t: json_type(t) <> 'VARCHAR' OR trim(t->>'$') = '' OR length(t->>'$') > 8192)) > 0 THEN 'observations' ELSE 'valid' END AS verdict, count(*) AS n, min(id) AS first, max(id) AS last FROM q GROUP BY 1""",
    "memory_decisions": f"""WITH x AS (SELECT vec_id AS id, label % 7 AS k FROM embeddings), y AS (SELECT id, k, 'C' || (k % 5) AS a, 'C' || ((k + 1) % 5) AS b FROM x),
b AS (SELECT id, a, b, '{{"decision":"' || CASE WHEN k < 5 THEN 'accept' ELSE 'review' END || '","condition_id":' || CASE WHEN k < 5 THEN '"C' || k || '"' ELSE 'null' END || ',"candidates":["' || a || '","' || b || '"],"evidence":["Q:report","' || a || '.CARD","' || b || '.CARD"],"explanation":"near"}}' AS body FROM y),
s AS (SELECT id, a, b, CAST({_spoilt_sql("id", MEMORY, 9)} AS JSON) AS j FROM b),
q AS (SELECT *, j->>'$.candidates[*]' AS c, j->>'$.evidence[*]' AS e, j->>'$.condition_id' AS t, j->>'$.decision' AS d FROM s)
SELECT CASE WHEN len(c) > 2 OR len(list_distinct(c)) < len(c) THEN 'candidates' WHEN d = 'accept' AND NOT coalesce(list_contains(c, t), false) OR d = 'review' AND t IS NOT NULL THEN 'condition'
  WHEN len(list_filter(e, lambda z: z NOT IN ('Q:report', a || '.CARD', b || '.CARD'))) > 0 OR NOT list_contains(e, 'Q:report') OR len(list_filter(e, lambda z: ends_with(z, '.CARD'))) = 0 OR d = 'accept' AND NOT list_contains(e, t || '.CARD') THEN 'citations'
  WHEN j->>'$.explanation' IS NULL THEN 'explanation' ELSE 'valid' END AS verdict, count(*) AS n, min(id) AS first, max(id) AS last FROM q GROUP BY 1""",
    "outcome_categories": f"""WITH v AS (SELECT vec_id AS id, label, embedding AS v FROM embeddings), f AS (SELECT label AS k, arg_min(v, id) AS r FROM v WHERE label < {CONDITIONS} GROUP BY 1),
n AS (SELECT id, label, k, list_sum(list_transform(list_zip(v, r), lambda z: (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)) * (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)))) <= {ALIKE}::DOUBLE AS s FROM v CROSS JOIN f),
a AS (SELECT id, any_value(label) AS label, count(*) FILTER (s) AS n, min(k) FILTER (s) AS k FROM n GROUP BY id)
SELECT CASE WHEN n > 1 THEN 'undecided' WHEN label < {CONDITIONS} AND n = 1 THEN CASE WHEN label = k THEN 'correct' ELSE 'wrong' END WHEN label < {CONDITIONS} THEN 'rejected_known' WHEN n = 1 THEN 'accepted_unknown' ELSE 'correct_rejection' END AS kind, count(*) AS n, min(id) AS first FROM a GROUP BY 1""",
    "view_pruning": f"""WITH x AS (SELECT conv_id AS id, turn, length(text) AS n FROM conversations), v AS (SELECT id, turn, n, k.k, k.k IN (1, 3) AS gone, (turn + k.k) % 3 <> 0 AS there FROM x CROSS JOIN (SELECT unnest(range(4)) AS k) k)
SELECT id, sum(CASE WHEN there THEN 5 ELSE 1 END)::BIGINT + 3 * count(DISTINCT turn) AS before, sum(CASE WHEN gone THEN 0 WHEN there THEN 5 ELSE 1 END)::BIGINT + 3 * count(DISTINCT turn) AS kept,
       sum(CASE WHEN there AND NOT gone THEN n * (k + 1) + turn + n ELSE 0 END) + sum(CASE WHEN k = 0 THEN n ELSE 0 END) AS total, CAST(0 AS BIGINT) AS left_over FROM v GROUP BY id""",
    "evidence_packets": "WITH x AS (SELECT conv_id AS id, turn, (turn % 3 <> 0)::INT + ((turn + 1) % 3 <> 0)::INT + ((turn + 2) % 3 <> 0)::INT + (turn % 3 <> 0)::INT AS views FROM conversations) SELECT id, count(*) AS texts, (count(*) + 3 * sum(views))::BIGINT AS others, count(*)::INTEGER AS turns FROM x GROUP BY id",
    "silver_labels": """WITH x AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
a AS (SELECT doc_id, lang, t, CASE WHEN length(t) < 60 THEN NULL WHEN regexp_matches(t, '[äöüß]') THEN 'de' WHEN regexp_matches(t, '[ñáó]') THEN 'es' WHEN regexp_matches(t, '[éèêç]') THEN 'fr' WHEN regexp_matches(t, '[0-9]{3}') THEN 'numbers' ELSE 'en' END AS label, round(length(regexp_replace(t, '[^A-Za-z ]', '', 'g')) / greatest(length(t), 1)::DOUBLE, 6) AS score FROM x),
s AS (SELECT *, CASE WHEN doc_id % 4 = 3 THEN 'not_attempted' WHEN length(t) > 12000 THEN 'failed' WHEN label IS NULL THEN 'abstained' WHEN label = 'numbers' THEN 'failed' ELSE 'labelled' END AS status FROM a)
SELECT status, count(*) AS n, count(*) FILTER (status = 'labelled' AND label = lang) AS "right", round(avg(score), 4) AS score FROM s GROUP BY 1""",
    "review_machine": f"""WITH x AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'adaptive-' ELSE 'fixed-' END || user_id AS arm, event_id AS id, epoch_us(ts) AS t0 FROM events),
a AS (SELECT *, id % 13 <> 0 AS own, id % 13 <> 0 AND id % 3 = 2 AS asks, count(*) FILTER (id % 13 <> 0 AND id % 3 = 2) OVER (PARTITION BY arm ORDER BY t0, id) AS nth FROM x),
o AS (SELECT arm, id, unnest([CASE WHEN NOT own THEN 'refused' WHEN id % 3 = 0 THEN 'accepted' ELSE 'retrieve' END, CASE WHEN id % 10 = 7 THEN 'refused' END, CASE WHEN id % 3 = 0 THEN NULL WHEN NOT own THEN 'refused' WHEN id % 3 = 1 THEN 'accepted' WHEN nth <= {REVIEWS} THEN 'ask' ELSE 'budget_exhausted' END,
      CASE WHEN id % 3 <> 2 THEN NULL WHEN own AND nth <= {REVIEWS} THEN 'labelled' ELSE 'refused' END]) AS outcome FROM a),
r AS (SELECT arm, CAST(least({REVIEWS}, max(nth)) AS INTEGER) AS reviews FROM a GROUP BY arm)
SELECT arm, outcome, count(*) AS n, any_value(reviews) AS reviews, CASE WHEN starts_with(arm, 'adaptive') THEN any_value(reviews) ELSE 0 END AS version, CASE WHEN starts_with(arm, 'adaptive') THEN any_value(reviews) ELSE 0 END + 1 AS members FROM o JOIN r USING (arm) WHERE outcome IS NOT NULL GROUP BY arm, outcome""",
    "budget_ledger": f"""WITH x AS (SELECT CAST(user_id AS VARCHAR) AS run, event_id AS id, epoch_us(ts) AS t0, epoch_us(ts) + CAST(round(value * 60000000) AS BIGINT) AS t1, event_id % 7 <> 3 AS ends, CASE WHEN event_id % 5 <> 1 THEN event_id * 7 % 450 END AS cost FROM events),
u AS (SELECT max(CASE WHEN ends THEN greatest(t0, t1) WHEN id % 17 = 0 THEN t0 + 1 ELSE t0 END) // 1000 - 600000 AS until FROM x),
a AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY t0, id) <= {LIMIT.most} AS taken, t0 // 1000 + {LIMIT.lost} AS due FROM x),
f AS (SELECT *, CASE WHEN NOT ends THEN NULL WHEN NOT taken THEN 'unknown' WHEN t1 // 1000 > due THEN 'late' WHEN cost > {LIMIT.reserve} THEN 'excess' WHEN cost IS NULL THEN 'kept' ELSE 'settled' END AS fin FROM a),
o AS (SELECT run, unnest([CASE WHEN taken THEN 'reserved' ELSE 'over_cap' END, CASE WHEN id % 17 = 0 THEN CASE WHEN taken THEN 'repeated' ELSE 'over_cap' END END, fin, CASE WHEN fin = 'late' OR taken AND (fin IS NULL OR fin = 'excess') AND due < until THEN 'lost' END]) AS outcome FROM f CROSS JOIN u),
s AS (SELECT run, CAST(sum(CASE WHEN fin = 'settled' THEN cost WHEN taken THEN {LIMIT.reserve} ELSE 0 END) AS BIGINT) AS spent FROM f GROUP BY run)
SELECT run, outcome, count(*) AS n, any_value(spent) AS spent FROM o JOIN s USING (run) WHERE outcome IS NOT NULL GROUP BY run, outcome""",
    "decision_schemas": """WITH x AS (SELECT p_size, list_sort(list(DISTINCT p_brand)) AS c FROM part GROUP BY 1), y AS (SELECT p_size, len(c) AS n, length(array_to_string(list_transform(c, lambda b: '"' || b || '"'), ',')) AS l FROM x)
SELECT p_size, CAST(n + 1 AS INTEGER) AS choices, 'outcome,condition_id,comparisons,explanation' AS keys, 2 * l + length('{"type":"json_schema","json_schema":{"name":"report_similarity","strict":true,"schema":{"type":"object","additionalProperties":false,"required":["outcome","condition_id","comparisons","explanation"],"properties":{"outcome":{"type":"string","enum":["similar","different"]},"condition_id":{"type":["string","null"],"enum":[,null]},"comparisons":{"type":"array","items":{"type":"object","additionalProperties":false,"required":["condition_id","similar","similarities","differences","evidence_ids"],"properties":{"condition_id":{"type":"string","enum":[]},"similar":{"type":"boolean"},"similarities":{"type":"array","items":{"type":"string"}},"differences":{"type":"array","items":{"type":"string"}},"evidence_ids":{"type":"array","items":{"type":"string"}}}}},"explanation":{"type":"string"}}}}}') AS length FROM y""",
    "interleaved_arms": """WITH x AS (SELECT user_id, event_id, CASE WHEN event_id % 2 = 0 THEN 'fixed' ELSE 'adaptive' END AS arm, row_number() OVER (PARTITION BY user_id, event_id % 2 ORDER BY ts, event_id) - 1 AS position FROM events),
y AS (SELECT user_id, arm, position, unnest(range(event_id % 3 + 1)) AS stage FROM x) SELECT user_id, arm, position, stage, row_number() OVER (PARTITION BY user_id ORDER BY position, stage, arm <> CASE WHEN position % 2 = 0 THEN 'fixed' ELSE 'adaptive' END) AS turn FROM y""",
    "seeded_sample": "SELECT source, place, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY sha256('draw-17:' || doc_id)) AS place FROM documents) WHERE place <= 10",
    "resumed_requests": "WITH x AS (SELECT doc_id, lang, sha256(text) AS h FROM documents) SELECT lang, count(*) AS n, min(doc_id) AS first FROM x WHERE h NOT IN (SELECT h FROM x WHERE doc_id % 3 = 0 AND h IS NOT NULL) OR h IS NULL GROUP BY 1",
}
QUERIES = {n: globals()[n] for n in [*SQL, "specialist_scores", "margin_machine"]}
