"""Nested JSON by its nodes: taken apart level by level as VARIANT, pruned by path, and put together again.

A node's path is its steps from the top: `.key` into an object, `#0000000012` into an array, so paths sort as arrays do. Levels are unnested one after the other until none holds a container, and
put together from the deepest one up; each level is one pass, however many bodies there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.operators.blocks import durable


def _kind(v: Column) -> Column:
    found = F.schema_of_variant(v)
    return F.when(F.startswith(found, F.lit("OBJECT")), "object").when(F.startswith(found, F.lit("ARRAY")), "array").otherwise("value")


def nodes(spark: SparkSession, x: DataFrame) -> DataFrame:
    """(id, path, kind, value) of each node of x (id, body): kind is object, array or value, value the JSON of a value and null of others. A body that isn't JSON, or names a key twice, has none."""
    level = x.select("id", F.array().cast("array<string>").alias("path"), F.try_parse_json("body").alias("v")).filter("v is not null").withColumn("kind", _kind(F.col("v")))
    found = None
    while True:
        level = durable(level)
        part = level.select("id", "path", "kind", F.when(F.col("kind") == "value", F.to_json("v")).alias("value"))
        found = part if found is None else found.union(part)
        inner = level.filter("kind <> 'value'")
        if inner.isEmpty():
            return found
        each = spark.sql("SELECT id, path, kind, e.pos, e.key, e.value AS v FROM {inner}, LATERAL variant_explode(v) AS e", inner=inner)
        step = F.when(F.col("kind") == "array", F.concat(F.lit("#"), F.lpad(F.col("pos").cast("string"), 10, "0"))).otherwise(F.concat(F.lit("."), F.col("key")))
        level = each.select("id", F.array_append("path", step).alias("path"), "v").withColumn("kind", _kind(F.col("v")))


def pruned(tree: DataFrame, removed: list[str]) -> DataFrame:
    """The nodes without those that lie at or under a removed key, and without texts that name one as their last part, as `report.1.welch` does."""
    names = F.array(*[F.lit(f".{n}") for n in removed])
    last = F.element_at(F.split(F.regexp_replace("value", '^"|"$', ""), r"\."), -1)
    cites = F.startswith("value", F.lit('"')) & last.isin(removed)
    return tree.filter(~F.arrays_overlap("path", names) & ~F.coalesce(cites, F.lit(False)))


def without_texts(tree: DataFrame, kept: list[str]) -> DataFrame:
    """The nodes without texts, but for those under a kept key, or in an array under one."""
    named = F.element_at(F.filter("path", lambda p: F.startswith(p, F.lit("."))), -1)
    texts = F.coalesce(F.startswith("value", F.lit('"')), F.lit(False))
    return tree.filter(~texts | F.coalesce(F.when(F.exists("path", lambda p: F.startswith(p, F.lit("."))), named).isin([f".{k}" for k in kept]), F.lit(False)))


def assembled(tree: DataFrame) -> DataFrame:
    """(id, body) of nodes (id, path, kind, value): keys in order, arrays closed up where items are missing, containers that have lost all as empty ones. Nodes whose container is missing are left out."""
    tree = durable(tree.withColumn("depth", F.size("path")))
    depth = tree.agg(F.max("depth")).first()[0]
    if depth is None:
        return tree.select("id", F.col("value").alias("body"))
    done = None
    for at in range(depth, -1, -1):
        level = tree.filter(F.col("depth") == at).select("id", "path", "kind", "value")
        if done is not None:
            # what the level below has given, by container
            inner = done.select("id", F.slice("path", 1, at).alias("path"), F.element_at("path", -1).alias("step"), "json").groupBy("id", "path").agg(F.array_sort(F.collect_list(F.struct("step", "json"))).alias("c"))
            level = level.join(inner, ["id", "path"], "left")
        else:
            level = level.withColumn("c", F.lit(None).cast("array<struct<step:string,json:string>>"))
        own = F.coalesce("c", F.array().cast("array<struct<step:string,json:string>>"))
        keyed = F.transform(own, lambda c: F.concat(F.to_json(F.substring(c["step"], F.lit(2), F.length(c["step"])).cast("variant")), F.lit(":"), c["json"]))
        json = F.when(F.col("kind") == "value", F.col("value")).when(F.col("kind") == "array", F.concat(F.lit("["), F.array_join(F.transform(own, lambda c: c["json"]), ","), F.lit("]"))).otherwise(F.concat(F.lit("{"), F.array_join(keyed, ","), F.lit("}")))
        done = durable(level.select("id", "path", json.alias("json")))
    return done.select("id", F.col("json").alias("body"))
