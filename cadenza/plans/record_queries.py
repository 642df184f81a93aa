"""Queries of the integrity, decision and record families, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _secrets() -> dict[str, str]:
    """Patterns of secrets by name, put together from what each format's public description fixes."""
    url64, base64 = "[A-Za-z0-9_-]", "[A-Za-z0-9+/]"
    # a digest of 32 bytes takes 43 characters of base64 without filling, one of 64 bytes 86; the shortest signed header, {"alg":"HS256"}, takes 20, and what encodes `{"` begins with eyJ
    digest, long_digest, header = 43, 86, 20
    return {
        "jwt": f"eyJ{url64}{{{header - 3},}}[.]e{url64}{{2,}}[.]{url64}{{{digest},}}",
        # a kind, then 30 random characters and 6 of a checksum; fine-grained ones have 22 and 59
        "github": "gh[pousr]_[A-Za-z0-9]{36}|github_pat_[A-Za-z0-9]{22}_[A-Za-z0-9]{59}",
        # four letters for the kind, then 16 of base32
        "aws": "(AKIA|ASIA)[A-Z2-7]{16}",
        # the middle is the base64 of a name, between random parts of 20 characters at least
        "openai": f"sk-{url64}{{20,}}T3BlbkFJ{url64}{{20,}}",
        # labels of textual encodings: any words before PRIVATE KEY
        "private_key": "-----BEGIN ([A-Z0-9]+ )*PRIVATE KEY-----",
        "storage_key": f"AccountKey *= *{base64}{{{long_digest}}}==",
        # a signature in a link may have its characters escaped
        "signed_link": f"[?&]sig=([A-Za-z0-9]|%[0-9A-Fa-f]{{2}}|[+/]){{{digest},}}",
        # a name for a secret, and a value of 8 characters, as short as passwords may mostly be
        "assigned": "(?i)(api[_-]?key|secret|password|token) *[:=] *[A-Za-z0-9_-]{8,}",
        "email": "[A-Za-z0-9._-]+@[A-Za-z0-9-]+[.][A-Za-z]{2,}",
    }


SECRETS = _secrets()


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def duplicate_hash_groups(spark, d):
    x = _t(spark, d, "documents").select(F.sha2("text", 256).alias("h"), "doc_id", "source")
    return x.groupBy("h").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.countDistinct("source").alias("sources")).filter("n > 1")


def split_leakage(spark, d):
    x = duplicate_hash_groups(spark, d).filter("sources > 1")
    return x.agg(F.count("*").alias("leaking"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))


def lowest_hash_per_class(spark, d):
    x = _t(spark, d, "documents").select("source", "doc_id", F.sha2(F.concat(F.lit("order:"), F.col("doc_id").cast("string")), 256).alias("h"))
    return x.groupBy("source").agg(F.min_by("doc_id", "h").alias("doc_id"), F.min("h").alias("h"))


def secrets_in(text: Column) -> Column:
    """The kinds of secrets that a text holds."""
    return F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(n)) for n, p in SECRETS.items()]))


def secret_findings(spark, d):
    """Secrets in documents and in turns of conversations."""
    x = _t(spark, d, "documents").select(F.lit("documents").alias("kept_in"), F.col("doc_id").alias("id"), F.lit(0).cast("long").alias("place"), "text")
    x = x.unionByName(_t(spark, d, "conversations").select(F.lit("conversations").alias("kept_in"), F.col("conv_id").alias("id"), F.col("turn").cast("long").alias("place"), "text"))
    return x.select("kept_in", "id", "place", F.explode(secrets_in(F.col("text"))).alias("kind"))


def html_links(spark, d):
    links = F.regexp_extract_all("html", F.lit(r'(?:href|src)="([^"]+)"'), F.lit(1))
    return _t(spark, d, "pages").select("page_id", F.posexplode(links).alias("pos", "link"))


#: Words that an item begins with, by which documents are found that may hold it.
ANCHOR = 8


def exact_contamination(spark, d):
    """Documents that hold the whole text of an item of ten words or more, letter by letter. Runs of words are joined with the first words of items; what meets is compared as a whole."""

    # the word before an item's first and that after its last may be joined to it by other characters than blanks, so runs begin at its second word
    bench = _t(spark, d, "benchmark").select("item_id", F.col("text").alias("item"), F.xxhash64(*[F.xxhash64(F.get(F.split("text", " "), F.lit(k))) for k in range(1, ANCHOR + 1)]).alias("h"))
    docs = _t(spark, d, "documents").select("doc_id", "text")
    hashed = docs.select("doc_id", F.transform(F.split("text", " "), lambda w: F.xxhash64(w)).alias("w"))
    # the hash of a run is that of its words' hashes
    runs = F.transform("w", lambda h, i: F.xxhash64(h, *[F.get("w", i + k) for k in range(1, ANCHOR)]))
    found = hashed.select("doc_id", F.explode(F.array_distinct(runs)).alias("h")).join(bench.select("item_id", "h"), "h").select("doc_id", "item_id").distinct()
    return found.join(docs, "doc_id").join(bench.drop("h"), "item_id").filter(F.contains("text", "item")).select("doc_id", "item_id")


def label_confusion(spark, d):
    x = _t(spark, d, "labels").join(_t(spark, d, "documents").select("doc_id", (F.col("n_chars") > 1000).cast("int").alias("said")), "doc_id")
    return x.groupBy("quality").pivot("said", [0, 1]).count().na.fill(0).select("quality", F.col("0").alias("said_0"), F.col("1").alias("said_1"))


def abstention_coverage(spark, d):
    x = _t(spark, d, "documents").join(_t(spark, d, "labels"), "doc_id", "left")
    return x.groupBy("lang").agg(F.count("*").alias("n"), F.count("quality").alias("judged"), F.round(F.count("quality") / F.count("*"), 6).alias("coverage"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))


def paired_cells(spark, d):
    x = _t(spark, d, "lineitem")
    paired = x.groupBy("l_orderkey", "l_suppkey").agg(F.count("*").alias("n"), F.countDistinct("l_returnflag").alias("flags")).filter("n = 2 and flags = 2")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey")
    return x.join(paired, ["l_orderkey", "l_suppkey"]).withColumn("r", F.row_number().over(order)).filter("r = 1").select("l_orderkey", "l_suppkey", "l_linenumber")


def review_listing_page(spark, d):
    x = _t(spark, d, "customer").filter(F.instr(F.lower("c_name"), "customer") > 0).filter("c_mktsegment = 'BUILDING'")
    return x.orderBy(F.desc("c_acctbal"), F.desc("c_custkey")).offset(20).limit(20).select("c_custkey", "c_name", "c_acctbal")


def review_counts(spark, d):
    x = _t(spark, d, "orders")
    return x.agg(F.count("*").alias("n"), *[F.coalesce(F.count_if(F.col("o_orderstatus") == s), F.lit(0)).alias(f"n_{s.lower()}") for s in "FOP"])


def review_merge(spark, d):
    """Updates apply where the expected revision is the current one; others conflict."""
    now = _t(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 3).alias("revision"), "o_orderstatus")
    put = _t(spark, d, "orders").filter("o_orderkey % 5 = 0").select("o_orderkey", (F.col("o_orderkey") % 2).alias("expected"), F.lit("R").alias("status"))
    x = now.join(put, "o_orderkey", "left")
    ok = F.col("expected") == F.col("revision")
    return x.select("o_orderkey", F.when(ok, F.col("revision") + 1).otherwise(F.col("revision")).alias("revision"), F.when(ok, F.col("status")).otherwise(F.col("o_orderstatus")).alias("status"), F.coalesce(~ok, F.lit(False)).alias("conflict"))


def cell_completeness(spark, d):
    """Cells of brand, size and first word of the type that no part falls into."""
    x = _t(spark, d, "part").select("p_brand", "p_size", F.substring_index("p_type", " ", 1).alias("sort")).distinct()
    one = lambda c: x.select(c).distinct().withColumn("one", F.lit(1))
    return one("p_brand").join(one("p_size"), "one").join(one("sort"), "one").drop("one").join(x, ["p_brand", "p_size", "sort"], "left_anti")


def ledger_running_cap(spark, d):
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    x = _t(spark, d, "orders").withColumn("spent", F.sum("o_totalprice").over(order)).filter("spent <= 500000")
    return x.groupBy("o_custkey").agg(F.count("*").alias("n"), F.round(F.max("spent"), 2).alias("spent"))


def stop_on_first_failure(spark, d):
    before = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    bad = F.when(F.col("event_type") == "error", 1).otherwise(0)
    x = _t(spark, d, "events").withColumn("failed", F.coalesce(F.sum(bad).over(before), F.lit(0))).filter("failed = 0")
    return x.groupBy("user_id").agg(F.count("*").alias("n"), F.max("event_id").alias("last"))


def stream_last_decision(spark, d):
    x = _t(spark, d, "conversations")
    return x.groupBy("conv_id").agg(F.max_by("role", "turn").alias("role"), F.max("turn").alias("turn"), F.count("*").alias("n"))


def manifest_diff(spark, d):
    x = _t(spark, d, "documents")
    old = x.filter("doc_id % 7 <> 0").select("doc_id", F.sha2("text", 256).alias("a"))
    new = x.filter("doc_id % 11 <> 0").select("doc_id", F.sha2(F.when(F.col("doc_id") % 13 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("b"))
    kind = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").when(F.col("a") != F.col("b"), "changed").otherwise("same")
    return old.join(new, "doc_id", "full").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def learning_curve(spark, d):
    order = Window.partitionBy("quality").orderBy(F.sha2(F.col("doc_id").cast("string"), 256))
    ranked = _t(spark, d, "labels").withColumn("r", F.row_number().over(order))
    sizes = spark.createDataFrame([(n,) for n in (4, 16, 64)], "size int")
    return ranked.filter("r <= 64").join(F.broadcast(sizes), F.expr("r <= size")).groupBy("size").agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic"))


def nearest_price_snap(spark, d):
    """The nearest of thirty price points, each a third over the last, within a tenth of the price; ties to the lower."""
    points = F.transform(F.sequence(F.lit(0), F.lit(29)), lambda i: F.floor(F.pow(F.lit(4 / 3), i) * 1000).cast("double"))
    x = _t(spark, d, "orders").withColumn("point", F.array_min(F.transform(points, lambda p: F.struct(F.abs(p - F.col("o_totalprice")).alias("gap"), p.alias("p")))))
    return x.filter("point.gap <= 0.1 * o_totalprice").groupBy(F.col("point.p").alias("point")).agg(F.count("*").alias("n"))


def audit_summary(spark, d):
    q = F.percentile("o_totalprice", F.array(*[F.lit(v) for v in (0.0, 0.05, 0.5, 0.95, 1.0)]))
    x = _t(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), q.alias("q"))
    return x.select("o_orderpriority", "n", *[F.round(F.col("q")[i], 4).alias(f"q{i}") for i in range(5)])


def grouped_costs(spark, d):
    x = _t(spark, d, "lineitem")
    cost = F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    return x.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("quantity"), F.round(F.sum(cost), 1).alias("cost"), F.count("*").alias("n"), F.count_if(F.col("l_shipdate").isNull()).alias("unknown"))


def decision_validation(spark, d):
    """Each event as a decision in JSON: it is valid if its keys are known, its value is in range and its outcome fits."""
    made = F.to_json(F.struct(F.col("event_type").alias("outcome"), F.from_json("props", "k int").k.alias("k")))
    parsed = F.from_json(made, "outcome string, k int")
    x = _t(spark, d, "events").select(parsed.alias("p"))
    fits = F.col("p.outcome").isin("click", "view", "purchase") & F.col("p.k").between(0, 50)
    return x.groupBy("p.outcome").agg(F.count("*").alias("n"), F.count_if(F.coalesce(fits, F.lit(False))).alias("valid"))


_H = "h AS (SELECT sha256(text) AS h, count(*) AS n, min(doc_id) AS first, count(DISTINCT source) AS sources FROM documents GROUP BY 1 HAVING count(*) > 1)"
_SECRET_SQL = "WITH x AS (SELECT 'documents' AS kept_in, doc_id AS id, CAST(0 AS BIGINT) AS place, text FROM documents UNION ALL SELECT 'conversations', conv_id, CAST(turn AS BIGINT), text FROM conversations) " + " UNION ALL ".join(f"SELECT kept_in, id, place, '{n}' AS kind FROM x WHERE regexp_matches(text, '{p}')" for n, p in SECRETS.items())
SQL = {
    "duplicate_hash_groups": f"WITH {_H} SELECT * FROM h",
    "split_leakage": f"WITH {_H} SELECT count(*) AS leaking, CAST(coalesce(sum(n), 0) AS BIGINT) AS rows FROM h WHERE sources > 1",
    "lowest_hash_per_class": "SELECT source, arg_min(doc_id, h) AS doc_id, min(h) AS h FROM (SELECT source, doc_id, sha256('order:' || doc_id) AS h FROM documents) GROUP BY source",
    "secret_findings": _SECRET_SQL,
    "html_links": """SELECT page_id, CAST(unnest(range(len(l))) AS INTEGER) AS pos, unnest(l) AS link FROM (SELECT page_id, regexp_extract_all(html, '(?:href|src)="([^"]+)"', 1) AS l FROM pages)""",
    "exact_contamination": "SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)",
    "label_confusion": "SELECT quality, count(*) FILTER (WHERE n_chars <= 1000) AS said_0, count(*) FILTER (WHERE n_chars > 1000) AS said_1 FROM labels JOIN documents USING (doc_id) GROUP BY quality",
    "abstention_coverage": "SELECT lang, count(*) AS n, count(quality) AS judged, round(count(quality) / count(*), 6) AS coverage, CAST(coalesce(sum(toxic), 0) AS BIGINT) AS toxic FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang",
    "paired_cells": """WITH p AS (SELECT l_orderkey, l_suppkey FROM lineitem GROUP BY 1, 2 HAVING count(*) = 2 AND count(DISTINCT l_returnflag) = 2) SELECT l_orderkey, l_suppkey, l_linenumber FROM (SELECT l.l_orderkey, l.l_suppkey, l_linenumber, row_number() OVER (PARTITION BY l.l_orderkey ORDER BY l_linenumber, l.l_suppkey) AS r FROM lineitem l JOIN p ON p.l_orderkey = l.l_orderkey AND p.l_suppkey = l.l_suppkey) WHERE r = 1""",
    "review_listing_page": "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE instr(lower(c_name), 'customer') > 0 AND c_mktsegment = 'BUILDING' ORDER BY c_acctbal DESC, c_custkey DESC LIMIT 20 OFFSET 20",
    "review_counts": "SELECT count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_f, count(*) FILTER (WHERE o_orderstatus = 'O') AS n_o, count(*) FILTER (WHERE o_orderstatus = 'P') AS n_p FROM orders",
    "review_merge": """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 AND o_orderkey % 2 = o_orderkey % 3 THEN o_orderkey % 3 + 1 ELSE o_orderkey % 3 END AS revision, CASE WHEN o_orderkey % 5 = 0 AND o_orderkey % 2 = o_orderkey % 3 THEN 'R' ELSE o_orderstatus END AS status, o_orderkey % 5 = 0 AND o_orderkey % 2 <> o_orderkey % 3 AS conflict FROM orders""",
    "cell_completeness": "WITH x AS (SELECT DISTINCT p_brand, p_size, split_part(p_type, ' ', 1) AS sort FROM part) SELECT b.p_brand, s.p_size, t.sort FROM (SELECT DISTINCT p_brand FROM x) b CROSS JOIN (SELECT DISTINCT p_size FROM x) s CROSS JOIN (SELECT DISTINCT sort FROM x) t EXCEPT SELECT * FROM x",
    "ledger_running_cap": "SELECT o_custkey, count(*) AS n, round(max(spent), 2) AS spent FROM (SELECT o_custkey, sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS spent FROM orders) WHERE spent <= 500000 GROUP BY o_custkey",
    "stop_on_first_failure": "SELECT user_id, count(*) AS n, max(event_id) AS last FROM (SELECT user_id, event_id, coalesce(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS failed FROM events) WHERE failed = 0 GROUP BY user_id",
    "stream_last_decision": "SELECT conv_id, arg_max(role, turn) AS role, max(turn) AS turn, count(*) AS n FROM conversations GROUP BY conv_id",
    "manifest_diff": """WITH o AS (SELECT doc_id, sha256(text) AS a FROM documents WHERE doc_id % 7 <> 0), n AS (SELECT doc_id, sha256(CASE WHEN doc_id % 13 = 0 THEN text || '!' ELSE text END) AS b FROM documents WHERE doc_id % 11 <> 0)
        SELECT CASE WHEN b IS NULL THEN 'missing' WHEN a IS NULL THEN 'extra' WHEN a <> b THEN 'changed' ELSE 'same' END AS kind, count(*) AS n FROM o FULL JOIN n USING (doc_id) GROUP BY 1""",
    "learning_curve": "WITH r AS (SELECT toxic, row_number() OVER (PARTITION BY quality ORDER BY sha256(CAST(doc_id AS VARCHAR))) AS r FROM labels) SELECT size, count(*) AS n, CAST(sum(toxic) AS BIGINT) AS toxic FROM r JOIN (SELECT CAST(unnest([4, 16, 64]) AS INTEGER) AS size) ON r <= size GROUP BY size",
    "nearest_price_snap": "SELECT p AS point, count(*) AS n FROM (SELECT o_totalprice, p, abs(p - o_totalprice) AS gap, row_number() OVER (PARTITION BY o_orderkey ORDER BY abs(p - o_totalprice), p) AS r FROM orders CROSS JOIN (SELECT floor(pow(4 / 3, i) * 1000)::DOUBLE AS p FROM (SELECT unnest(range(30)) AS i))) WHERE r = 1 AND gap <= 0.1 * o_totalprice GROUP BY p",
    "audit_summary": "SELECT o_orderpriority, count(*) AS n, " + ", ".join(f"round(quantile_cont(o_totalprice, {v}), 4) AS q{i}" for i, v in enumerate((0.0, 0.05, 0.5, 0.95, 1.0))) + " FROM orders GROUP BY 1",
    "grouped_costs": "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS quantity, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 1) AS cost, count(*) AS n, count(*) FILTER (WHERE l_shipdate IS NULL) AS unknown FROM lineitem GROUP BY 1, 2",
    "decision_validation": "SELECT event_type AS outcome, count(*) AS n, count(*) FILTER (WHERE event_type IN ('click', 'view', 'purchase') AND CAST(json_extract_string(props, '$.k') AS INTEGER) BETWEEN 0 AND 50) AS valid FROM events GROUP BY 1",
}
QUERIES = {n: globals()[n] for n in SQL}
