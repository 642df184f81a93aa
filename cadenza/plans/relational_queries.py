"""Queries of projections, filters, joins, aggregates, orders, sets and scalars over records, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.functions.scalars import greatest_divisor, significant

#: Fixed values. Prices of a million tokens: fresh input, cached input, output; the most input tokens that are priced.
PRICES, MOST_TOKENS = (5.0, 0.5, 25.0), 64_000


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _rounded(x: Column, digits: int = 6) -> Column:
    return F.round(x, digits)


def opaque_projection(spark, d):
    """An allow-list of columns, with opaque identifiers in place of keys."""
    kept = {"s_suppkey": "ref", "s_nationkey": "cell", "s_acctbal": "level"}
    x = _t(spark, d, "supplier").select([F.col(a).alias(b) for a, b in kept.items()])
    return x.select(F.concat(F.lit("R"), F.lpad(F.col("ref").cast("string"), 6, "0")).alias("ref"), F.concat(F.lit("C"), F.lpad((F.col("cell") + 1).cast("string"), 2, "0")).alias("cell"), "level")


def significant_digits(spark, d):
    x = _t(spark, d, "embeddings").select("vec_id", F.posexplode(F.slice("embedding", 1, 8)).alias("pos", "v"))
    return x.select("vec_id", F.col("pos"), F.round(significant(F.col("v").cast("double")), 9).alias("v"))


def label_filter(spark, d):
    """All rows, rows without a label, and rows of each label; a null label equals nothing."""
    x = _t(spark, d, "documents").join(_t(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    modes = F.array_compact(F.array(F.lit("all"), F.when(F.col("quality").isNull(), "unreviewed"), F.when(F.col("quality") == 1, "good"), F.when(F.col("quality") == 0, "poor")))
    return x.select(F.explode(modes).alias("mode"), "n_chars").groupBy("mode").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


def quality_gates(spark, d):
    x = _t(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.max(F.abs("value")).alias("peak"), F.stddev_pop("value").alias("ac"))
    gate = F.when(F.col("ac") == 0, "constant").when(F.col("peak") > 250, "spike").when(F.col("ac") < 20, "quiet").otherwise("kept")
    return x.groupBy(gate.alias("gate")).agg(F.count("*").alias("recordings"), F.sum("n").alias("samples"))


def phase_roles(spark, d):
    """Development, final and novelty rows by rule; only rows without load take part."""
    load, profile = F.col("vec_id") % 2, F.floor(F.col("vec_id") / 2) % 8
    role = F.when(F.col("label") >= 8, "novelty").when(profile < 3, "development").otherwise("final")
    x = _t(spark, d, "embeddings").filter(load == 0)
    return x.groupBy(role.alias("role"), "label").agg(F.count("*").alias("n"), F.min("vec_id").alias("first"))


def accepted_scores(spark, d):
    x = _t(spark, d, "orders").filter("o_orderstatus = 'F' and o_totalprice >= 100000")
    return x.groupBy("o_orderpriority").agg(F.count("*").alias("n"), _rounded(F.min("o_totalprice"), 2).alias("least"))


def finite_coordinates(spark, d):
    """Coordinates that are finite in every row; a few are spoilt by rule."""
    x = _t(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "v"))
    v = F.when((F.col("vec_id") % 97 == 3) & (F.col("pos") % 16 == 5), F.lit(float("nan"))).otherwise(F.col("v").cast("double"))
    x = x.select("pos", v.alias("v")).groupBy("pos").agg(F.bool_and(~F.isnan("v") & F.col("v").isNotNull()).alias("finite"), F.sum(F.when(~F.isnan("v"), F.col("v"))).alias("s"))
    return x.filter("finite").select(F.col("pos"), F.round("s", 3).alias("s"))


def prediction_key_sets(spark, d):
    """Truth and predictions by id: both must have the same keys, once each."""
    truth = _t(spark, d, "labels").groupBy("doc_id").agg(F.count("*").alias("t"), F.max("quality").alias("truth"))
    said = _t(spark, d, "documents").filter("doc_id % 9 <> 0").groupBy("doc_id").agg(F.count("*").alias("p"), F.max((F.col("n_chars") > 800).cast("int")).alias("said"))
    kind = F.when(F.col("p").isNull(), "missing").when(F.col("t").isNull(), "extra").when((F.col("p") > 1) | (F.col("t") > 1), "duplicate").when(F.col("truth") == F.col("said"), "correct").otherwise("wrong")
    return truth.join(said, "doc_id", "full").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def permitted_history(spark, d):
    """Turns that lie before the last turn of the user: no future evidence."""
    x = _t(spark, d, "conversations")
    last = x.filter("role = 'user'").groupBy("conv_id").agg(F.max("turn").alias("cut"))
    allowed = x.join(last, "conv_id").filter("turn < cut").select("conv_id", "turn")
    return x.join(allowed, ["conv_id", "turn"], "left_semi").groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


def registered_cells(spark, d):
    """Each nation's cell must be registered exactly once: none, one or many customers of a segment."""
    cells = _t(spark, d, "nation").select(F.col("n_nationkey").alias("nation"))
    found = _t(spark, d, "customer").filter("c_mktsegment = 'MACHINERY' and c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("n"))
    status = F.when(F.col("n").isNull(), "none").when(F.col("n") == 1, "one").otherwise("many")
    return cells.join(found, "nation", "left").select("nation", F.coalesce("n", F.lit(0)).alias("n"), status.alias("status"))


def repeated_in_other_blocks(spark, d):
    """Values of one type and user in blocks of a day against the block before: pairs, means of both and of the difference."""
    x = _t(spark, d, "events").groupBy("user_id", "event_type", F.dayofyear("ts").alias("day")).agg(F.avg("value").alias("v"))
    before = x.select("user_id", "event_type", (F.col("day") + 1).alias("day"), F.col("v").alias("w"))
    return x.join(before, ["user_id", "event_type", "day"]).groupBy("event_type").agg(F.count("*").alias("pairs"), _rounded(F.avg(F.col("v") - F.col("w")), 4).alias("difference"), _rounded(F.max(F.abs(F.col("v") - F.col("w"))), 4).alias("most"))


def biased_kurtosis(spark, d):
    sq = F.col("value") * F.col("value")
    return _t(spark, d, "events").groupBy("user_id").agg(_rounded(F.avg(sq * sq) / F.nullif(F.avg(sq) * F.avg(sq), F.lit(0.0)) - 3, 4).alias("kurtosis"))


def latency_summary(spark, d):
    x = _t(spark, d, "lineitem").join(_t(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate"), "l_orderkey")
    days = F.datediff("l_shipdate", "o_orderdate")
    return x.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum(days).alias("total"), F.percentile(days, F.lit(0.5)).alias("middle"), _rounded(F.percentile(days, F.lit(0.95)), 4).alias("p95"))


def all_windows_correct(spark, d):
    right = (F.col("l_quantity") <= 45) & (F.col("l_discount") <= 0.09)
    x = _t(spark, d, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.bool_and(right).alias("whole"), F.count("*").alias("windows"))
    return x.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count_if("whole").alias("whole"), F.sum("windows").alias("windows"))


def most_common(spark, d):
    """The three commonest values of each group, ties to the lesser value."""
    x = _t(spark, d, "customer").groupBy("c_mktsegment", "c_nationkey").agg(F.count("*").alias("n"))
    order = Window.partitionBy("c_mktsegment").orderBy(F.desc("n"), "c_nationkey")
    return x.withColumn("rank", F.row_number().over(order)).filter("rank <= 3")


def price_histogram(spark, d):
    """64 cells of equal width between least and most; the last one is closed."""
    x = _t(spark, d, "orders")
    ends = x.agg(F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"))
    cell = F.least(F.floor((F.col("o_totalprice") - F.col("low")) / F.nullif(F.col("high") - F.col("low"), F.lit(0.0)) * 64), F.lit(63).cast("long"))
    return x.join(F.broadcast(ends), F.lit(True)).groupBy(cell.alias("cell")).agg(F.count("*").alias("n"))


def error_direction(spark, d):
    x = _t(spark, d, "labels").join(_t(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    said = F.when(F.col("n_chars") < 300, F.lit(None)).when(F.col("n_chars") < 1200, 0).otherwise(1)
    kind = F.when(said.isNull(), "review").when(said == F.col("toxic"), "correct").when(F.col("toxic") == 1, "unsafe").otherwise("false_alarm")
    return x.groupBy(kind.alias("direction")).agg(F.count("*").alias("n"))


def ledger_reconciliation(spark, d):
    """Attempts of each root by its orders, and by the items that were billed for them: orders without items, items without an order, and whether what was billed is within a tenth of what was agreed."""
    orders = _t(spark, d, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_custkey") % 50).alias("root"), F.col("o_totalprice").alias("agreed"))
    lines = _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias("billed"))
    both = orders.join(lines, "k", "full").groupBy("root").agg(F.count("agreed").alias("attempted"), F.count("billed").alias("received"), F.count_if(F.col("billed").isNull()).alias("open"), F.count_if(F.col("agreed").isNull()).alias("orphans"), F.sum("agreed").alias("agreed"), F.sum("billed").alias("billed"))
    return both.select("root", "attempted", "received", "open", "orphans", F.round(F.col("billed") / F.col("agreed"), 4).alias("share"), F.coalesce(F.abs(F.col("billed") / F.col("agreed") - 1) <= 0.1, F.lit(False)).alias("reconciled"))


def inverse_distribution(spark, d):
    grid = [i / 10 for i in range(11)]
    x = _t(spark, d, "events").groupBy("event_type").agg(F.percentile("value", F.array(*map(F.lit, grid))).alias("q"))
    return x.select("event_type", F.posexplode("q").alias("tenth", "v")).select("event_type", "tenth", _rounded(F.col("v"), 4).alias("v"))


def restored_clock(spark, d):
    """Segment times on the recording's clock: the segment's start is added again."""
    x = _t(spark, d, "events").withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1)
    x = x.withColumn("segment", F.floor(F.col("n") / 25)).withColumn("local", (F.col("n") % 25) / 8.0)
    return x.groupBy("user_id", "segment").agg(_rounded(F.min(F.col("local") + F.col("segment") * 25 / 8.0)).alias("begin"), _rounded(F.max(F.col("local") + F.col("segment") * 25 / 8.0)).alias("end"))


def arrival_sequence(spark, d):
    salted = F.sha2(F.concat(F.lit("arrival:"), F.col("vec_id").cast("string")), 256)
    order = Window.partitionBy("label").orderBy(salted, "vec_id")
    return _t(spark, d, "embeddings").select("label", "vec_id", F.row_number().over(order).alias("arrival"))


def middle_pick(spark, d):
    """The middle of each sorted pool without its first member."""
    pool = F.array_sort(F.collect_set("s_suppkey"))
    x = _t(spark, d, "supplier").groupBy("s_nationkey").agg(pool.alias("pool")).select("s_nationkey", F.slice("pool", 2, 100_000_000).alias("pool"))
    return x.filter(F.size("pool") > 0).select("s_nationkey", F.element_at("pool", (F.floor(F.size("pool") / 2) + 1).cast("int")).alias("picked"))


def even_pick(spark, d):
    """Four evenly spaced places of each order's lines, each once."""
    x = _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    places = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.floor(i * (F.col("n") - 1) / 3)))
    return x.select("l_orderkey", F.explode(places).alias("place"))


def category_representatives(spark, d):
    x = _t(spark, d, "labels").join(_t(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return x.groupBy("lang", "quality", "toxic").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))


def priority_order(spark, d):
    """Urgency first, then status by a custom order, then the largest price."""
    status = F.when(F.col("o_orderstatus") == "P", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    order = Window.partitionBy(F.col("o_custkey")).orderBy("o_orderpriority", status, F.desc("o_totalprice"), "o_orderkey")
    return _t(spark, d, "orders").withColumn("place", F.row_number().over(order)).filter("place <= 2").select("o_custkey", "place", "o_orderkey")


def arms_union(spark, d):
    arms = [("documents", "n_chars", "doc_id"), ("orders", "o_totalprice", "o_orderkey"), ("lineitem", "l_quantity", "l_orderkey")]
    rows = [_t(spark, d, t).select(F.lit(t).alias("arm"), F.col(v).cast("double").alias("v"), F.col(k).alias("k")) for t, v, k in arms]
    return reduce(DataFrame.unionByName, rows).groupBy("arm").agg(F.count("*").alias("n"), F.countDistinct("k").alias("keys"), _rounded(F.avg("v"), 3).alias("mean"))


def key_set_difference(spark, d):
    """Keys expected and not there, and there and not expected."""
    want, have = _t(spark, d, "customer").filter("c_custkey % 6 <> 0").select(F.col("c_custkey").alias("k")).distinct(), _t(spark, d, "orders").select(F.col("o_custkey").alias("k")).distinct()
    return want.exceptAll(have).select("k", F.lit("missing").alias("side")).union(have.exceptAll(want).select("k", F.lit("extra").alias("side")))


def citation_sets(spark, d):
    """Citations of each user's events: whether they are within what is allowed, and cite anything that only a query shows."""
    x = _t(spark, d, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("cited"))
    allowed, query_only = F.array(*map(F.lit, ("click", "view", "purchase"))), F.array(F.lit("purchase"), F.lit("error"))
    return x.select("user_id", (F.size(F.array_except("cited", allowed)) == 0).alias("subset"), F.arrays_overlap("cited", query_only).alias("overlaps"), F.size("cited").alias("n"))


def factor_cells(spark, d):
    """2^3 masks by nation: how many customers each cell has; all cells are listed."""
    masks = spark.range(8).select(F.col("id").alias("mask"))
    cells = _t(spark, d, "nation").select(F.col("n_nationkey").alias("nation")).join(F.broadcast(masks), F.lit(True))
    mask = (F.col("c_acctbal") > 0).cast("long") + 2 * (F.col("c_custkey") % 2) + 4 * (F.col("c_mktsegment") == "BUILDING").cast("long")
    have = _t(spark, d, "customer").groupBy(F.col("c_nationkey").alias("nation"), mask.alias("mask")).agg(F.count("*").alias("n"))
    return cells.join(have, ["nation", "mask"], "left").select("nation", "mask", F.coalesce("n", F.lit(0)).alias("n"))


def rounding_and_ratios(spark, d):
    """Half-to-even rounding, greatest common divisors and ratios in lowest terms."""
    x = _t(spark, d, "part").select("p_partkey", "p_size")
    g = greatest_divisor(F.col("p_size").cast("long"), (F.col("p_partkey") % 60 + 1))
    x = x.withColumn("g", g)
    return x.select("p_partkey", F.bround(F.col("p_size") / 2.0, 0).alias("even"), F.col("g").alias("gcd"), F.floor(F.col("p_size") / F.col("g")).alias("num"), F.floor((F.col("p_partkey") % 60 + 1) / F.col("g")).alias("den"))


def split_arrays(spark, d):
    """Arrays split into five parts, the first ones longer: size and mean of each."""
    n = F.size("embedding")
    at = lambda i: F.floor(i * F.floor(n / 5) + F.least(i, n % 5)).cast("int")
    parts = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.slice("embedding", at(i) + 1, at(i + 1) - at(i)))
    x = _t(spark, d, "embeddings").select("vec_id", F.posexplode(parts).alias("part", "v"))
    return x.select("vec_id", "part", F.size("v").alias("n"), _rounded(F.aggregate("v", F.lit(0.0), lambda s, e: s + e.cast("double")) / F.size("v")).alias("mean"))


def url_parts(spark, d):
    """Base name, stem and a full match of a pattern, of each URL's path."""
    path = F.regexp_extract("url", r"^[a-z]+://[^/?#]*([^?#]*)", 1)
    base = F.element_at(F.split(path, "/"), -1)
    stem = F.when(F.instr(base, ".") > 1, F.regexp_replace(base, r"\.[^.]*$", "")).otherwise(base)
    lang = F.regexp_extract(path, r"^/([a-z]{2})/", 1)
    return _t(spark, d, "pages").select("page_id", base.alias("base"), stem.alias("stem"), lang.alias("lang"), F.col("url").rlike(r"^https?://[^/]+/[a-z]{2}/[0-9]+$").alias("whole"))


def role_lookup(spark, d):
    """A map's value for each role, and a default."""
    known = F.create_map(*[F.lit(x) for x in ("user", 1, "assistant", 2)])
    return _t(spark, d, "conversations").groupBy(F.coalesce(F.try_element_at(known, F.col("role")), F.lit(0)).alias("code")).agg(F.count("*").alias("n"), F.count_if(F.trim("text") != "").alias("filled"), F.count_if(F.startswith(F.lower("text"), F.lit("t"))).alias("t"))


def encoded_media(spark, d):
    """Data URLs of short texts, decoded again, with their digests."""
    x = _t(spark, d, "customer").select("c_custkey", F.concat(F.lit("data:text/plain;base64,"), F.base64(F.encode("c_name", "UTF-8"))).alias("u"), "c_name")
    back = F.decode(F.unbase64(F.substring_index("u", ",", -1)), "UTF-8")
    return x.select("c_custkey", "u", (back == F.col("c_name")).alias("same"), F.md5(F.col("c_name").cast("binary")).alias("digest"))


def iso_times(spark, d):
    x = _t(spark, d, "events").groupBy("event_type").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return x.select("event_type", F.date_format("a", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("begin"), (F.unix_micros(F.col("b").cast("timestamp")) - F.unix_micros(F.col("a").cast("timestamp"))).alias("micros"))


def identifier_validation(spark, d):
    """Ids from digests, some spoilt by rule: 32 lower-case hex digits are valid."""
    h = F.md5(F.col("o_orderkey").cast("string").cast("binary"))
    made = F.when(F.col("o_orderkey") % 5 == 0, F.upper(h)).when(F.col("o_orderkey") % 7 == 0, F.substring(h, 1, 31)).otherwise(h)
    return _t(spark, d, "orders").select(F.when(made.rlike("^[0-9a-f]{32}$"), "valid").when(F.length(made) != 32, "length").otherwise("form").alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


def token_costs(spark, d):
    """Cost of prompts with cached parts; more cached than sent, or too long a prompt, has none."""
    prompt, cached, out = F.col("l_partkey") % 70_000, F.col("l_suppkey") * 7 % 3000, F.col("l_linenumber").cast("long") * 10
    cost = F.when((cached <= prompt) & (prompt <= MOST_TOKENS), ((prompt - cached) * PRICES[0] + cached * PRICES[1] + out * PRICES[2]) / 1e6)
    x = _t(spark, d, "lineitem").select("l_returnflag", cost.alias("cost"))
    return x.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count("cost").alias("priced"), _rounded(F.sum("cost"), 4).alias("cost"))


def escaped_text(spark, d):
    escape = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    shown = F.when(F.col("page_id") % 3 == 0, F.lit("undefined")).otherwise(F.format_number(F.col("page_id") / 7.0, 2))
    return _t(spark, d, "pages").select("page_id", F.length(escape(F.col("html"))).cast("long").alias("n"), F.md5(escape(F.col("html")).cast("binary")).alias("digest"), shown.alias("shown"))


def manifest_build(spark, d):
    return _t(spark, d, "pages").select(F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.sha2(F.col("html").cast("binary"), 256).alias("sha256"), F.octet_length("html").cast("long").alias("bytes"))


def chain_replay(spark, d):
    """States of an ordered journal name their parent's digest; a few are broken by rule. Each conversation is replayed up to its first break."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    x = _t(spark, d, "conversations").withColumn("own", F.sha2(F.concat_ws("|", F.col("conv_id").cast("string"), F.col("turn").cast("string"), "text"), 256))
    x = x.withColumn("before", F.lag("own").over(order)).withColumn("told", F.when((F.col("conv_id") % 5 == 0) & (F.col("turn") % 3 == 2), F.lit("broken")).otherwise(F.col("before")))
    bad = F.sum(F.when(F.col("told").eqNullSafe(F.col("before")), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return x.withColumn("bad", bad).groupBy("conv_id").agg(F.count("*").alias("n"), F.count_if(F.col("bad") == 0).alias("replayed"))


def registration_binding(spark, d):
    """Rows whose frozen digest still binds them; a few have changed since."""
    frozen = _t(spark, d, "benchmark").select("item_id", F.sha2("text", 256).alias("frozen"))
    now = _t(spark, d, "benchmark").select("item_id", F.sha2(F.when(F.col("item_id") % 10 == 4, F.lower("text")).otherwise(F.col("text")), 256).alias("now"))
    return frozen.join(now, "item_id", "left").groupBy(F.coalesce(F.col("frozen") == F.col("now"), F.lit(False)).alias("bound")).agg(F.count("*").alias("n"))


def render_leaks(spark, d):
    """Groups, recordings and contents that lie in more than one split."""
    split = F.when(F.col("doc_id") % 10 < 7, "train").otherwise("test")
    x = _t(spark, d, "documents").select(split.alias("split"), F.explode(F.array(F.struct(F.lit("group").alias("kind"), F.col("source").alias("key")), F.struct(F.lit("recording").alias("kind"), F.col("doc_id").cast("string").alias("key")), F.struct(F.lit("content").alias("kind"), F.sha2("text", 256).alias("key")))).alias("e"))
    x = x.groupBy("e.kind", "e.key").agg(F.countDistinct("split").alias("splits"), F.count("*").alias("rows"))
    return x.groupBy("kind").agg(F.count("*").alias("keys"), F.count_if(F.col("splits") > 1).alias("leaking"), F.sum("rows").alias("rows"))


def balanced_partition(spark, d):
    """One customer, that of the least salted digest, for each of 8 x 8 x 2 cells of class, profile and load; roles by rule in salted order of cells, with counts of each class. Cells without a customer lack in them."""
    x = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", (F.col("c_nationkey") % 8).cast("long").alias("class"), (F.col("c_custkey") % 8).alias("profile"), (F.col("c_acctbal") > 4500).cast("long").alias("load"))
    salted = F.sha2(F.concat(F.lit("member-"), F.col("c_custkey").cast("string")), 256)
    x = x.groupBy("class", "profile", "load").agg(F.min_by("c_custkey", salted).alias("member"))
    cell = F.sha2(F.concat_ws("-", F.lit("role"), *[F.col(c).cast("string") for c in ("class", "profile", "load")]), 256)
    x = x.withColumn("r", F.row_number().over(Window.partitionBy("class").orderBy(cell)))
    role = F.when(F.col("r") <= 2, "seed").when(F.col("r") <= 10, "stream").otherwise("evaluation")
    return x.groupBy("class", role.alias("role")).agg(F.count("*").alias("n"), F.countDistinct("profile", "load").alias("cells"), F.sum("member").alias("members"))


def whole_item_contamination(spark, d):
    """How many documents have all lines of an item of the benchmark among their own, by digest of the squeezed lines; lines of up to 20 characters don't count, items without any are listed with 0."""
    squeezed = lambda c: F.sha2(F.trim(F.regexp_replace(F.lower(c), r"\s+", " ")), 256)
    items = _t(spark, d, "benchmark").select("item_id")
    parts = _t(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).select("doc_id", squeezed(F.col("line")).alias("h"))
    lines = _t(spark, d, "benchmark").select("item_id", F.explode(F.split("text", "\n")).alias("line")).filter("length(line) > 20").select("item_id", squeezed(F.col("line")).alias("h")).distinct()
    whole = lines.groupBy("item_id").agg(F.count("*").alias("lines"))
    met = lines.join(parts.distinct(), "h").groupBy("item_id", "doc_id").agg(F.count("*").alias("lines"))
    hit = met.join(whole, ["item_id", "lines"]).groupBy("item_id").agg(F.count("*").alias("n"))
    return items.join(hit, "item_id", "left").select("item_id", F.coalesce("n", F.lit(0)).alias("n"))


_SQUEEZED = "sha256(trim(regexp_replace(lower({}), '\\s+', ' ', 'g')))"
SQL = {
    "opaque_projection": "SELECT 'R' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS ref, 'C' || lpad(CAST(s_nationkey + 1 AS VARCHAR), 2, '0') AS cell, s_acctbal AS level FROM supplier",
    "significant_digits": "WITH x AS (SELECT vec_id, CAST(unnest(range(8)) AS INTEGER) AS pos, CAST(unnest(embedding[1:8]) AS DOUBLE) AS v FROM embeddings), s AS (SELECT *, CASE WHEN v <> 0 THEN pow(10.0::DOUBLE, 6 - floor(log10(abs(v)))) END AS k FROM x) SELECT vec_id, pos, round(CASE WHEN v = 0 THEN 0.0::DOUBLE ELSE round_even(v * k, 0) / k END, 9) AS v FROM s",
    "label_filter": "WITH x AS (SELECT n_chars, quality FROM documents LEFT JOIN labels USING (doc_id)) SELECT 'all' AS mode, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM x UNION ALL SELECT 'unreviewed', count(*), CAST(sum(n_chars) AS BIGINT) FROM x WHERE quality IS NULL HAVING count(*) > 0 UNION ALL SELECT CASE quality WHEN 1 THEN 'good' ELSE 'poor' END, count(*), CAST(sum(n_chars) AS BIGINT) FROM x WHERE quality IS NOT NULL GROUP BY quality",
    "quality_gates": "WITH x AS (SELECT count(*) AS n, max(abs(value)) AS peak, stddev_pop(value) AS ac FROM events GROUP BY user_id) SELECT CASE WHEN ac = 0 THEN 'constant' WHEN peak > 250 THEN 'spike' WHEN ac < 20 THEN 'quiet' ELSE 'kept' END AS gate, count(*) AS recordings, CAST(sum(n) AS BIGINT) AS samples FROM x GROUP BY 1",
    "phase_roles": "SELECT CASE WHEN label >= 8 THEN 'novelty' WHEN (vec_id // 2) % 8 < 3 THEN 'development' ELSE 'final' END AS role, label, count(*) AS n, min(vec_id) AS first FROM embeddings WHERE vec_id % 2 = 0 GROUP BY 1, 2",
    "accepted_scores": "SELECT o_orderpriority, count(*) AS n, round(min(o_totalprice), 2) AS least FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 100000 GROUP BY 1",
    "finite_coordinates": "WITH x AS (SELECT vec_id, CAST(unnest(range(len(embedding))) AS INTEGER) AS pos, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) SELECT pos, round(sum(v), 3) AS s FROM x GROUP BY pos HAVING count(*) FILTER (WHERE vec_id % 97 = 3 AND pos % 16 = 5) = 0",
    "prediction_key_sets": "WITH t AS (SELECT doc_id, count(*) AS t, max(quality) AS truth FROM labels GROUP BY 1), p AS (SELECT doc_id, count(*) AS p, max(CASE WHEN n_chars > 800 THEN 1 ELSE 0 END) AS said FROM documents WHERE doc_id % 9 <> 0 GROUP BY 1) SELECT CASE WHEN p IS NULL THEN 'missing' WHEN t IS NULL THEN 'extra' WHEN p > 1 OR t > 1 THEN 'duplicate' WHEN truth = said THEN 'correct' ELSE 'wrong' END AS kind, count(*) AS n FROM t FULL JOIN p USING (doc_id) GROUP BY 1",
    "permitted_history": "WITH c AS (SELECT conv_id, max(turn) AS cut FROM conversations WHERE role = 'user' GROUP BY 1) SELECT conv_id, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations JOIN c USING (conv_id) WHERE turn < cut GROUP BY 1",
    "registered_cells": "WITH f AS (SELECT c_nationkey, count(*) AS n FROM customer WHERE c_mktsegment = 'MACHINERY' AND c_acctbal > 9000 GROUP BY 1) SELECT n_nationkey AS nation, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 'none' WHEN n = 1 THEN 'one' ELSE 'many' END AS status FROM nation LEFT JOIN f ON c_nationkey = n_nationkey",
    "repeated_in_other_blocks": "WITH x AS (SELECT user_id, event_type, dayofyear(ts) AS day, avg(value) AS v FROM events GROUP BY ALL) SELECT a.event_type, count(*) AS pairs, round(avg(a.v - b.v), 4) AS difference, round(max(abs(a.v - b.v)), 4) AS most FROM x a JOIN x b ON a.user_id = b.user_id AND a.event_type = b.event_type AND a.day = b.day + 1 GROUP BY 1",
    "biased_kurtosis": "SELECT user_id, round(avg(value * value * (value * value)) / nullif(avg(value * value) * avg(value * value), 0) - 3, 4) AS kurtosis FROM events GROUP BY 1",
    "latency_summary": "WITH x AS (SELECT l_returnflag, date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS days FROM lineitem JOIN orders ON l_orderkey = o_orderkey) SELECT l_returnflag, count(*) AS n, CAST(sum(days) AS BIGINT) AS total, CAST(quantile_cont(days, 0.5) AS DOUBLE) AS middle, round(quantile_cont(days, 0.95), 4) AS p95 FROM x GROUP BY 1",
    "all_windows_correct": "WITH x AS (SELECT l_orderkey, l_returnflag, bool_and(l_quantity <= 45 AND l_discount <= 0.09) AS whole, count(*) AS windows FROM lineitem GROUP BY 1, 2) SELECT l_returnflag, count(*) AS n, count(*) FILTER (WHERE whole) AS whole, CAST(sum(windows) AS BIGINT) AS windows FROM x GROUP BY 1",
    "most_common": "SELECT * FROM (SELECT c_mktsegment, c_nationkey, count(*) AS n, CAST(row_number() OVER (PARTITION BY c_mktsegment ORDER BY count(*) DESC, c_nationkey) AS INTEGER) AS rank FROM customer GROUP BY 1, 2) WHERE rank <= 3",
    "price_histogram": "WITH e AS (SELECT min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders) SELECT CAST(least(floor((o_totalprice - low) / nullif(high - low, 0) * 64), 63) AS BIGINT) AS cell, count(*) AS n FROM orders, e GROUP BY 1",
    "error_direction": "WITH x AS (SELECT toxic, CASE WHEN n_chars < 300 THEN NULL WHEN n_chars < 1200 THEN 0 ELSE 1 END AS said FROM labels JOIN documents USING (doc_id)) SELECT CASE WHEN said IS NULL THEN 'review' WHEN said = toxic THEN 'correct' WHEN toxic = 1 THEN 'unsafe' ELSE 'false_alarm' END AS direction, count(*) AS n FROM x GROUP BY 1",
    "ledger_reconciliation": """WITH l AS (SELECT l_orderkey AS k, sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS billed FROM lineitem GROUP BY 1), b AS (SELECT o_custkey % 50 AS root, o_totalprice AS agreed, billed FROM orders FULL JOIN l ON o_orderkey = k),
        g AS (SELECT root, count(agreed) AS attempted, count(billed) AS received, count(*) FILTER (billed IS NULL) AS open, count(*) FILTER (agreed IS NULL) AS orphans, sum(billed) / sum(agreed) AS share FROM b GROUP BY 1)
        SELECT root, attempted, received, open, orphans, round(share, 4) AS share, coalesce(abs(share - 1) <= 0.1, false) AS reconciled FROM g""",
    "inverse_distribution": "WITH q AS (SELECT event_type, quantile_cont(value, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS q FROM events GROUP BY 1) SELECT event_type, CAST(unnest(range(11)) AS INTEGER) AS tenth, round(unnest(q), 4) AS v FROM q",
    "restored_clock": "WITH x AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM events) SELECT user_id, n // 25 AS segment, round(min(n / 8.0::DOUBLE), 6) AS begin, round(max(n / 8.0::DOUBLE), 6) AS end FROM x GROUP BY 1, 2",
    "arrival_sequence": "SELECT label, vec_id, CAST(row_number() OVER (PARTITION BY label ORDER BY sha256('arrival:' || vec_id), vec_id) AS INTEGER) AS arrival FROM embeddings",
    "middle_pick": "WITH p AS (SELECT s_nationkey, (list_sort(list(DISTINCT s_suppkey)))[2:] AS pool FROM supplier GROUP BY 1) SELECT s_nationkey, pool[len(pool) // 2 + 1] AS picked FROM p WHERE len(pool) > 0",
    "even_pick": "WITH x AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) SELECT DISTINCT l_orderkey, CAST(floor(i * (n - 1) / 3.0) AS BIGINT) AS place FROM x CROSS JOIN (SELECT unnest(range(4)) AS i)",
    "category_representatives": "SELECT lang, quality, toxic, min(doc_id) AS first, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2, 3",
    "priority_order": "SELECT o_custkey, place, o_orderkey FROM (SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_totalprice DESC, o_orderkey) AS INTEGER) AS place FROM orders) WHERE place <= 2",
    "arms_union": "SELECT 'documents' AS arm, count(*) AS n, count(DISTINCT doc_id) AS keys, round(avg(CAST(n_chars AS DOUBLE)), 3) AS mean FROM documents UNION ALL SELECT 'orders', count(*), count(DISTINCT o_orderkey), round(avg(o_totalprice), 3) FROM orders UNION ALL SELECT 'lineitem', count(*), count(DISTINCT l_orderkey), round(avg(l_quantity), 3) FROM lineitem",
    "key_set_difference": "WITH w AS (SELECT DISTINCT c_custkey AS k FROM customer WHERE c_custkey % 6 <> 0), h AS (SELECT DISTINCT o_custkey AS k FROM orders) SELECT k, 'missing' AS side FROM (SELECT k FROM w EXCEPT SELECT k FROM h) UNION ALL SELECT k, 'extra' FROM (SELECT k FROM h EXCEPT SELECT k FROM w)",
    "citation_sets": "SELECT user_id, bool_and(event_type IN ('click', 'view', 'purchase')) AS subset, bool_or(event_type IN ('purchase', 'error')) AS overlaps, CAST(count(DISTINCT event_type) AS INTEGER) AS n FROM events GROUP BY 1",
    "factor_cells": "WITH h AS (SELECT c_nationkey AS nation, CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END + 2 * (c_custkey % 2) + CASE WHEN c_mktsegment = 'BUILDING' THEN 4 ELSE 0 END AS mask, count(*) AS n FROM customer GROUP BY 1, 2) SELECT n_nationkey AS nation, m.mask, coalesce(h.n, 0) AS n FROM nation CROSS JOIN (SELECT unnest(range(8)) AS mask) m LEFT JOIN h ON h.nation = n_nationkey AND h.mask = m.mask",
    "rounding_and_ratios": "WITH x AS (SELECT p_partkey, p_size, p_partkey % 60 + 1 AS q FROM part) SELECT p_partkey, round_even(p_size / 2.0::DOUBLE, 0) AS even, CAST(gcd(p_size, q) AS BIGINT) AS gcd, CAST(p_size // gcd(p_size, q) AS BIGINT) AS num, CAST(q // gcd(p_size, q) AS BIGINT) AS den FROM x",
    "split_arrays": "WITH x AS (SELECT vec_id, embedding AS e, len(embedding) AS n, CAST(unnest(range(5)) AS INTEGER) AS part FROM embeddings), y AS (SELECT vec_id, part, e[part * (n // 5) + least(part, n % 5) + 1 : (part + 1) * (n // 5) + least(part + 1, n % 5)] AS v FROM x) SELECT vec_id, part, CAST(len(v) AS INTEGER) AS n, round(list_sum(list_transform(v, lambda e: CAST(e AS DOUBLE))) / len(v), 6) AS mean FROM y",
    "url_parts": "WITH x AS (SELECT page_id, url, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages), b AS (SELECT *, string_split(path, '/')[-1] AS base FROM x) SELECT page_id, base, CASE WHEN instr(base, '.') > 1 THEN regexp_replace(base, '\\.[^.]*$', '') ELSE base END AS stem, regexp_extract(path, '^/([a-z]{2})/', 1) AS lang, regexp_full_match(url, 'https?://[^/]+/[a-z]{2}/[0-9]+') AS whole FROM b",
    "role_lookup": "SELECT CASE role WHEN 'user' THEN 1 WHEN 'assistant' THEN 2 ELSE 0 END AS code, count(*) AS n, count(*) FILTER (WHERE trim(text) <> '') AS filled, count(*) FILTER (WHERE starts_with(lower(text), 't')) AS t FROM conversations GROUP BY 1",
    "encoded_media": "SELECT c_custkey, 'data:text/plain;base64,' || to_base64(encode(c_name)) AS u, true AS same, md5(c_name) AS digest FROM customer",
    "iso_times": "SELECT event_type, strftime(min(ts), '%Y-%m-%dT%H:%M:%SZ') AS begin, epoch_us(max(ts)) - epoch_us(min(ts)) AS micros FROM events GROUP BY 1",
    "identifier_validation": "WITH x AS (SELECT o_orderkey AS k, md5(CAST(o_orderkey AS VARCHAR)) AS h FROM orders), m AS (SELECT CASE WHEN k % 5 = 0 THEN upper(h) WHEN k % 7 = 0 THEN h[1:31] ELSE h END AS m FROM x) SELECT CASE WHEN regexp_full_match(m, '[0-9a-f]{32}') THEN 'valid' WHEN length(m) <> 32 THEN 'length' ELSE 'form' END AS kind, count(*) AS n FROM m GROUP BY 1",
    "token_costs": f"WITH x AS (SELECT l_returnflag, l_partkey % 70000 AS p, l_suppkey * 7 % 3000 AS c, l_linenumber * 10 AS o FROM lineitem), y AS (SELECT l_returnflag, CASE WHEN c <= p AND p <= {MOST_TOKENS} THEN ((p - c) * 5.0::DOUBLE + c * 0.5::DOUBLE + o * 25.0::DOUBLE) / 1e6 END AS cost FROM x) SELECT l_returnflag, count(*) AS n, count(cost) AS priced, round(sum(cost), 4) AS cost FROM y GROUP BY 1",
    "escaped_text": "WITH x AS (SELECT page_id, replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS e FROM pages) SELECT page_id, length(e) AS n, md5(e) AS digest, CASE WHEN page_id % 3 = 0 THEN 'undefined' ELSE format('{:,.2f}', page_id / 7.0::DOUBLE) END AS shown FROM x",
    "manifest_build": "SELECT 'pages/' || page_id || '.html' AS path, sha256(html) AS sha256, CAST(octet_length(encode(html)) AS BIGINT) AS bytes FROM pages",
    "chain_replay": "WITH o AS (SELECT conv_id, turn, sha256(conv_id || '|' || turn || '|' || text) AS own FROM conversations), b AS (SELECT *, lag(own) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM o), t AS (SELECT *, CASE WHEN conv_id % 5 = 0 AND turn % 3 = 2 THEN 'broken' ELSE before END AS told FROM b), s AS (SELECT conv_id, sum(CASE WHEN told IS NOT DISTINCT FROM before THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS bad FROM t) SELECT conv_id, count(*) AS n, count(*) FILTER (WHERE bad = 0) AS replayed FROM s GROUP BY 1",
    "registration_binding": "SELECT sha256(text) = sha256(CASE WHEN item_id % 10 = 4 THEN lower(text) ELSE text END) AS bound, count(*) AS n FROM benchmark GROUP BY 1",
    "render_leaks": "WITH x AS (SELECT CASE WHEN doc_id % 10 < 7 THEN 'train' ELSE 'test' END AS split, source, CAST(doc_id AS VARCHAR) AS rec, sha256(text) AS h FROM documents), e AS (SELECT split, 'group' AS kind, source AS key FROM x UNION ALL SELECT split, 'recording', rec FROM x UNION ALL SELECT split, 'content', h FROM x), k AS (SELECT kind, key, count(DISTINCT split) AS splits, count(*) AS rows FROM e GROUP BY 1, 2) SELECT kind, count(*) AS keys, count(*) FILTER (WHERE splits > 1) AS leaking, CAST(sum(rows) AS BIGINT) AS rows FROM k GROUP BY 1",
    "balanced_partition": """WITH x AS (SELECT c_custkey, c_nationkey % 8 AS class, c_custkey % 8 AS profile, CASE WHEN c_acctbal > 4500 THEN 1 ELSE 0 END AS load FROM customer), m AS (SELECT class, profile, load, arg_min(c_custkey, sha256('member-' || c_custkey)) AS member FROM x GROUP BY 1, 2, 3),
        r AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY sha256('role-' || class || '-' || profile || '-' || load)) AS r FROM m) SELECT class, CASE WHEN r <= 2 THEN 'seed' WHEN r <= 10 THEN 'stream' ELSE 'evaluation' END AS role, count(*) AS n, count(DISTINCT profile * 2 + load) AS cells, sum(member)::BIGINT AS members FROM r GROUP BY 1, 2""",
    "whole_item_contamination": f"WITH p AS (SELECT DISTINCT doc_id, {_SQUEEZED.format('line')} AS h FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)), l AS (SELECT DISTINCT item_id, {_SQUEEZED.format('line')} AS h FROM (SELECT item_id, unnest(string_split(text, chr(10))) AS line FROM benchmark) WHERE length(line) > 20), w AS (SELECT item_id, count(*) AS lines FROM l GROUP BY 1), m AS (SELECT item_id, doc_id, count(*) AS lines FROM l JOIN p USING (h) GROUP BY 1, 2), n AS (SELECT item_id, count(*) AS n FROM m JOIN w USING (item_id, lines) GROUP BY 1) SELECT item_id, coalesce(n, 0) AS n FROM benchmark LEFT JOIN n USING (item_id)",
}
QUERIES = {n: globals()[n] for n in SQL}
