"""Connected groups of a similarity join, found without emitting all pairs of a group.

`resolve` gets postings (sig, id, info) such that every pair that may link shares a sig, and a function that verifies candidate pairs. Each round, every
sig proposes one pivot, the most central of its ids, and only (member, pivot) pairs are verified, so work is linear in the postings. Pairs already in
one group need no check. Once rounds no longer pay, the pairs left between different groups are verified, so the result equals that of verifying every pair.
Pairs that their infos rule out are dropped as they are joined, before they are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.common import Cuts

#: Rounds of pivots before the rest is verified pair by pair; pairs left for each posting at which rounds end, and share of a round's pairs that link under which
#: they do; parts into which hot labels are dealt.
ROUNDS, LEFT_PER_POSTING, WORTH, SALTS = 6, 4.0, 0.02, 16


def components(spark: SparkSession, edges: DataFrame, cuts: Cuts) -> DataFrame:
    """(id, comp) for every id in edges (a, b): comp is the smallest id reachable. Labels spread along edges until nothing changes; every
    third step they jump to their label's label instead, so chains take few steps. A step is one job of joins and sums on the cluster."""
    both = cuts.cut(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = cuts.cut(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("comp"), F.lit(True).alias("moved")))
    turn = 0
    while True:
        turn += 1
        if turn % 3:
            near = both.join(labels.select("id", "comp"), both.b == F.col("id")).groupBy("a").agg(F.min("comp").alias("m"))
            new = labels.join(near, labels.id == near.a)
        else:
            # each label's own label, looked up once for each; a label that a large share of ids bear is dealt to SALTS parts
            jump = labels.select("comp").distinct().join(labels.select(F.col("id").alias("comp"), F.col("comp").alias("m")), "comp")
            jump = jump.select(F.col("comp").alias("root"), "m", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("part"))
            new = labels.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(jump, F.expr("comp = root and salt = part"))
        moved = Observation()
        step = new.select("id", F.least("comp", "m").alias("comp"), (F.least("comp", "m") < F.col("comp")).alias("moved"))
        step = cuts.cut(step.observe(moved, F.sum(F.col("moved").cast("long")).alias("n")))
        cuts.drop(labels)
        labels = step
        if turn % 3 and not moved.get["n"]:
            cuts.drop(both)
            return labels.select("id", "comp")


def resolve(
    spark: SparkSession, postings: DataFrame, verify: Callable[[DataFrame], DataFrame], cuts: Cuts, may_link: Callable[[Column, Column], Column], central: Callable[[Column], Column], left: float = LEFT_PER_POSTING,
    shared: bool = False,
) -> DataFrame | None:
    """(id, comp) of all ids with a link, or None if there are none. postings (sig, id, info) are distinct, central(info) is the same for all postings of an id.

    may_link may turn down only pairs of infos that verify would turn down; an id is the more central, the less central(info) is. Rounds of pivots end when at most `left`
    pairs are left for each posting; the result is the same for any, and for any `central`.

    Where shared is set, verify gets the number of sigs that a pair shares as `agree`, and may leave out links between ids that others connect."""

    def distinct(found: DataFrame) -> DataFrame:
        if not shared:
            return found.select("a", "b").distinct()
        return found.groupBy("a", "b").agg(F.count("*").alias("agree"))

    # at first each id is its own comp, which needn't be written
    kept = cuts.cut(postings.join(shared_sigs(postings), "sig", "left_semi"))
    live = kept.withColumn("comp", F.col("id"))
    parts: list[DataFrame] = []
    labels: DataFrame | None = None
    dry = False
    for turn in range(ROUNDS + 1):
        counts = live.groupBy("sig", "comp").count().groupBy("sig").agg(F.sum("count").alias("n"), F.sum(F.col("count") * F.col("count")).alias("same")).filter("same < n * n")
        pairs_left, rows = counts.agg(F.sum((F.col("n") * F.col("n") - F.col("same")) / 2), F.sum("n")).first()
        if not pairs_left:
            break
        last = turn == ROUNDS or dry or pairs_left <= left * rows
        open_sigs = live.join(counts.select("sig"), "sig", "left_semi")
        if last:
            other = open_sigs.select("sig", F.col("id").alias("b"), F.col("comp").alias("comp_b"), F.col("info").alias("info_b"))
            found = open_sigs.join(other, "sig").filter(F.expr("id < b and comp <> comp_b") & may_link(F.col("info"), F.col("info_b"))).select(F.col("id").alias("a"), "b")
        else:
            # one priority for all sigs, so that sigs of one group propose the same pivot: the most central id first, later any of the more central ones
            rank = central(F.col("info"))
            order = F.struct(rank if turn == 0 else F.floor(rank * 20), F.xxhash64(F.lit(turn), "id"), F.col("id"))
            pivot = live.groupBy("sig").agg(F.min(F.struct(order.alias("o"), F.col("id").alias("b"), F.col("comp").alias("comp_b"), F.col("info").alias("info_b"))).alias("p")).select("sig", "p.b", "p.comp_b", "p.info_b")
            found = open_sigs.join(pivot, "sig").filter((F.col("comp") != F.col("comp_b")) & may_link(F.col("info"), F.col("info_b"))).select(F.least("id", "b").alias("a"), F.greatest("id", "b").alias("b"))
        pairs = cuts.cut(distinct(found))
        linked = cuts.cut(verify(pairs))
        n_linked = linked.count()
        dry = not last and n_linked < WORTH * pairs.count()
        cuts.drop(pairs)
        if n_linked:
            parts.append(linked)
            links = parts[0]
            for part in parts[1:]:
                links = links.union(part)
            labels = components(spark, links, cuts)
        if last:
            break
        if labels is None:
            new = live
        else:
            new = live.drop("comp").join(labels.select("id", F.col("comp").alias("to")), "id", "left").select("sig", "id", "info", F.coalesce("to", "id").alias("comp"))
        # a sig of two members is done once its only pair is verified, unless that may wait for pivots of other sigs
        new = cuts.cut(new.join((counts if shared else counts.filter("n > 2")).select("sig"), "sig", "left_semi"))
        cuts.drop(kept)
        kept = live = new
    cuts.drop(kept)
    return labels


def shared_sigs(postings: DataFrame) -> DataFrame:
    """The sigs of two ids or more."""
    return postings.groupBy("sig").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo < hi").select("sig")
