"""Places of rows in an order, found without sorting any group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm.common import Cuts, small_enough

#: Blocks broadcast at most: one for each group in each partition (about 10 MB).
BROADCAST_BLOCKS = 100_000


def numbered(cuts: Cuts, rows: DataFrame, group: str, keys: list[str], extra: DataFrame | None = None) -> DataFrame:
    """rows with idx, the place from 0 within the row's group in ascending order of keys (nulls first), and n, the rows of the group.

    Rows are dealt to partitions by ranges of (group, keys) and sorted there; what precedes each partition's block of a group is a running sum over blocks, of which
    there are as many as partitions and groups at most. group holds no nulls. extra (group, ...) adds columns of each group. Rows with equal keys lie in one partition; add a key that tells them apart.
    """
    low = (1 << 33) - 1
    placed = cuts.cut(rows.repartitionByRange(group, *keys).sortWithinPartitions(group, *keys).withColumn("at", F.monotonically_increasing_id()))
    blocks = placed.groupBy(group, F.shiftright("at", 33).alias("part")).agg(F.min(F.col("at").bitwiseAND(F.lit(low))).alias("first"), F.count("*").alias("size"))
    before = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0))).withColumn("n", F.sum("size").over(Window.partitionBy(group))).drop("size")
    blocks = cuts.cut(blocks if extra is None else blocks.join(extra, group))
    small = F.broadcast(blocks) if small_enough(blocks, BROADCAST_BLOCKS) else blocks
    out = cuts.cut(placed.withColumn("part", F.shiftright("at", 33)).join(small, [group, "part"]).withColumn("idx", F.col("at").bitwiseAND(F.lit(low)) - F.col("first") + F.col("start")).drop("at", "part", "first", "start"))
    cuts.drop(placed, blocks)
    return out
