"""Merkle manifest of a dataset, with proofs by coordinates.

Rows of a group, in order, are the leaves of the group's tree; the roots of the groups' trees are the leaves of the tree on top. Nodes are kept in one table under
(top, tree, level, idx). A leaf's place and the size of its group say which nodes its proof needs: these coordinates are exploded, joined with the node table, put in order, and
concatenated or folded up to the root. The leaves of one run need the same nodes above the run, so they are asked for once a run.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.common import Cuts
from cadenza.llm.places import numbered

#: Nodes of the upper levels broadcast at most (about 12 MB); copies of each node of the top tree where even these are too many to be broadcast.
BROADCAST_NODES, SALTS = 100_000, 32
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    """The SHA-256 of texts put together, as lower-case hexadecimal text."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def encoded(value: Column) -> Column:
    """A value with its bytes' count before it, so that fields can't run into each other; `-` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(values: dict[str, Column]) -> Column:
    return digest(*[encoded(v) for v in values.values()])


@dataclass
class Manifest:
    """leaves (tree, idx, n, top_idx, top_n, digest, ...) with the columns kept of the rows; levels of nodes (top, tree, level, idx, digest) with how many each holds, of the groups' trees and of
    the tree on top; subroots (top_idx, subroot); the root, None without rows; powers of the fanout, one for each level below a root."""

    leaves: DataFrame
    levels: list[tuple[DataFrame, int]]
    top_levels: list[tuple[DataFrame, int]]
    subroots: DataFrame
    root: str | None
    powers: list[int]

    @property
    def nodes(self) -> DataFrame:
        """All nodes as one table."""
        return _union([level for level, _ in self.levels + self.top_levels])


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df)
    return out


def _levels(cuts: Cuts, leaves: DataFrame, fanout: int, most: int, top: bool) -> tuple[list[tuple[DataFrame, int]], DataFrame]:
    """The levels of all trees whose leaves are (tree, idx, n, digest), most of one tree at most, and (tree, digest) of their roots."""
    level, found, roots, depth = leaves.select("tree", "idx", "n", "digest"), [], [], 0
    while True:
        found.append((level.select(F.lit(top).alias("top"), "tree", F.lit(depth).alias("level"), "idx", "digest"), level.count()))
        roots.append(level.filter("n = 1").select("tree", "digest"))
        if most <= 1:
            return found, _union(roots)
        runs = level.filter("n > 1").groupBy("tree", F.expr(f"idx div {fanout}").alias("idx"), F.expr(f"(n + {fanout - 1}) div {fanout}").alias("n")).agg(F.sort_array(F.collect_list(F.struct("idx", "digest"))).alias("run"))
        level = cuts.cut(runs.select("tree", "idx", "n", digest(F.array_join(F.transform("run", lambda x: x["digest"]), "")).alias("digest")))
        most, depth = -(-most // fanout), depth + 1


def manifest(rows: DataFrame, cuts: Cuts, fanout: int = 8) -> Manifest:
    """The manifest of rows (group, key, digest, ...): group is a text or null, leaves ascend by key (nulls first), then digest. Other columns stay with the leaves."""
    # the group null comes first and isn't the empty text
    named = cuts.cut(rows.withColumn("tree", F.coalesce(F.concat(F.lit("="), F.col("group")), F.lit(""))).drop("group"))
    trees = numbered(cuts, named.select("tree").distinct().withColumn("all", F.lit("")), "all", ["tree"]).select("tree", F.col("idx").alias("top_idx"), F.col("n").alias("top_n"))
    leaves = numbered(cuts, named, "tree", ["key", "digest"], trees)
    cuts.drop(named)
    most, most_trees = (x or 0 for x in leaves.agg(F.max("n"), F.max("top_n")).first())
    levels, roots = _levels(cuts, leaves, fanout, most, False)
    tops = cuts.cut(roots.join(trees, "tree").select(F.lit("").alias("tree"), F.col("top_idx").alias("idx"), F.col("top_n").alias("n"), "digest"))
    top_levels, root = _levels(cuts, tops, fanout, most_trees, True)
    found, powers = root.first(), [1]
    while powers[-1] * fanout < max(most, most_trees):
        powers.append(powers[-1] * fanout)
    return Manifest(leaves, levels, top_levels, tops.select(F.col("idx").alias("top_idx"), F.col("digest").alias("subroot")), found.digest if found else None, powers)


def steps_of(m: Manifest) -> Column:
    """(top, level, at) of a leaf and of each node above it but the root: a level lies below another one as long as more nodes than one are left there."""
    powers = F.array(*[F.lit(p).cast("long") for p in m.powers])

    def steps(idx: str, n: str, top: bool) -> Column:
        return F.transform(F.filter(powers, lambda p: p < F.col(n)), lambda p, level: F.struct(F.lit(top).alias("top"), level.alias("level"), F.floor(F.col(idx) / p).alias("at"), F.ceil(F.col(n) / p).alias("of")))

    return F.concat(steps("idx", "n", False), steps("top_idx", "top_n", True))


def paths(m: Manifest, cuts: Cuts, fanout: int = 8) -> DataFrame:
    """(tree, run, path) of each run of leaves, path being (top, level, idx, digest) of all nodes that proofs of its leaves need, in order: the leaves of the run, and above
    them the siblings of what stands above the run."""

    def needed(s: Column) -> Column:
        run = F.sequence(s["at"] - s["at"] % fanout, F.least(s["at"] - s["at"] % fanout + fanout, s["of"]) - 1)
        own = F.filter(run, lambda i: (~s["top"] & (s["level"] == 0)) | (i != s["at"]))
        return F.transform(own, lambda i: F.struct(s["top"].alias("top"), s["level"].alias("level"), i.alias("idx")))

    firsts = m.leaves.filter(F.col("idx") % fanout == 0).select("tree", F.expr(f"idx div {fanout}").alias("run"), steps_of(m).alias("steps"))
    asked = firsts.select("tree", "run", F.explode(F.flatten(F.transform("steps", needed))).alias("at")).select(F.when(F.col("at.top"), "").otherwise(F.col("tree")).alias("of"), "at.*", "tree", "run")
    keys = ["of", "top", "level", "idx"]
    # the levels of few nodes, from the top down, are asked for by many runs each: these go to all; what is left is asked for by few
    few, many, total = [], [], 0
    for level, size in sorted(m.levels + m.top_levels, key=lambda x: x[1]):
        total += size
        (few if total <= BROADCAST_NODES else many).append(level.withColumnRenamed("tree", "of"))
    parts = []
    if few:
        parts.append(asked.join(F.broadcast(_union(few)), keys))
    if many:
        # only where there are very many groups is a node of the top tree among these; a large group asks for its neighbours again and again, so they lie in several places
        salted = _union(many).withColumn("salt", F.explode(F.when(F.col("top"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
        parts.append(asked.withColumn("salt", F.when(F.col("top"), F.pmod("run", F.lit(SALTS)).cast("int")).otherwise(0)).join(salted, [*keys, "salt"]).drop("salt"))
    return _union(parts).groupBy("tree", "run").agg(F.sort_array(F.collect_list(F.struct("top", "level", "idx", "digest"))).alias("path"))


def proofs(m: Manifest, cuts: Cuts, fanout: int = 8) -> DataFrame:
    """The leaves with steps (see steps_of) and path (see paths): all that folding needs."""
    own = m.leaves.withColumn("run", F.expr(f"idx div {fanout}")).withColumn("steps", steps_of(m))
    none = F.array().cast("array<struct<top:boolean,level:int,idx:bigint,digest:string>>")
    return own.join(paths(m, cuts, fanout), ["tree", "run"], "left").drop("run").withColumn("path", F.coalesce("path", none))


def _text(path: Column) -> Column:
    return F.array_join(F.transform(path, lambda x: x["digest"]), "")


def siblings(path: Column, idx: Column) -> Column:
    """The digests of a proof put together, left to right and level by level, of the leaf at idx."""
    return _text(F.filter(path, lambda x: x["top"] | (x["level"] > 0) | (x["idx"] != idx)))


def folded(start: Column, steps: Column, path: Column) -> Column:
    """The root that follows from a leaf's digest and the siblings at each step."""

    def up(now: Column, s: Column) -> Column:
        run = F.filter(path, lambda x: (x["top"] == s["top"]) & (x["level"] == s["level"]))
        return digest(_text(F.filter(run, lambda x: x["idx"] < s["at"])), now, _text(F.filter(run, lambda x: x["idx"] > s["at"])))

    return F.aggregate(steps, start, up)


def tamper_check(spark: SparkSession, docs: DataFrame, cuts: Cuts | None = None) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for every row of docs (doc_id, source, lang, n_chars, text); other columns are ignored, whatever their names.

    The manifest groups by lang and orders by doc_id. A third of the rows, by the CRC-32 of doc_id, is then read with A-Z of text in lower case, as if tampered with: their leaves are taken anew and
    folded with the untampered siblings. verified tells whether that gives the root still, as it does for texts without such letters. Null values are `-`; null lang is a group of its own, before
    the others; rows with a null doc_id come first in their group and aren't tampered with; of rows with one doc_id the leaf decides, and repeated rows are leaves of their own, with one digest. A lone row is leaf, subroot
    and root, and its proof is empty. An empty table gives an empty result.
    """
    cuts = cuts or Cuts(spark, "merkle")
    own = docs.select(*FIELDS)
    values = {f: F.col(f) for f in FIELDS}
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    changed = F.when(hit, leaf_digest(values | {"text": F.translate("text", letters, letters.lower())}))
    m = manifest(own.select(F.col("lang").alias("group"), F.col("doc_id").alias("key"), leaf_digest(values).alias("digest"), changed.alias("changed")), cuts)
    steps, path = F.col("steps"), F.col("path")
    found = proofs(m, cuts)
    if m.top_levels[0][1] <= BROADCAST_NODES:
        found = found.join(F.broadcast(m.subroots), "top_idx")
    else:
        found = found.withColumn("subroot", folded(F.col("digest"), F.filter(steps, lambda s: ~s["top"]), path))
    found = found.select("key", "digest", "subroot", siblings(path, F.col("idx")).alias("siblings"), folded(F.coalesce("changed", "digest"), steps, path).alias("folded_root"), F.lit(m.root).alias("root"))
    return found.select(F.col("key").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", "root", digest(F.col("siblings")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
