"""Comparison of queries with a bank of known references, and decisions that may abstain."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.scalars import centred, rms_distance
from cadenza.operators.blocks import pieces

#: A bank holds this many references at most, so it may be broadcast.
MAX_REFERENCES = 64


def split_bank(vectors: DataFrame, per_class: int = 1) -> tuple[DataFrame, DataFrame]:
    """(references, queries) of vectors (id, class, shape): the first ids of each class are references."""
    order = F.row_number().over(Window.partitionBy("class").orderBy("id"))
    ranked = vectors.withColumn("r", order)
    return ranked.filter(F.col("r") <= per_class).drop("r"), ranked.filter(F.col("r") > per_class).drop("r")


def shapes(vectors: DataFrame, id_col: str, class_col: str, array_col: str) -> DataFrame:
    return vectors.select(F.col(id_col).alias("id"), F.col(class_col).alias("class"), centred(F.col(array_col)).alias("shape"))


def distances(queries: DataFrame, references: DataFrame) -> DataFrame:
    """(query, truth, ref, ref_class, d) of each query with each reference; the bank is checked for its size and broadcast."""
    if references.limit(MAX_REFERENCES + 1).count() > MAX_REFERENCES:
        raise ValueError(f"a bank holds {MAX_REFERENCES} references at most")
    r = references.select(F.col("id").alias("ref"), F.col("class").alias("ref_class"), F.col("shape").alias("ref_shape"))
    pairs = queries.select(F.col("id").alias("query"), F.col("class").alias("truth"), "shape").join(F.broadcast(r), F.lit(True))
    return pairs.select("query", "truth", "ref", "ref_class", rms_distance(F.col("shape"), F.col("ref_shape")).alias("d"))


def decide(d: DataFrame, most: float, margin: float) -> DataFrame:
    """Open-set rule: beyond `most` outside the references; a lead under `margin` indeterminate; else the nearest class."""
    order = Window.partitionBy("query").orderBy("d", "ref_class")
    ranked = d.filter("d is not null").withColumn("r", F.row_number().over(order)).withColumn("second", F.lead("d").over(order))
    lead = F.col("second") - F.col("d")
    outcome = F.when(F.col("d") > most, "outside_reference").when(lead < margin, "indeterminate").otherwise("known")
    return ranked.filter("r = 1").select("query", "truth", F.col("ref_class").alias("nearest"), "d", lead.alias("lead"), outcome.alias("outcome"))


def class_ranking(d: DataFrame) -> DataFrame:
    """Distances (query, class, regime, group, d) to classes: medians over members, then over groups; the least regime. A null member makes
    its regime, and so its class, null."""

    def guarded(value: Column, of: str) -> Column:
        return F.when(F.count(of) == F.count("*"), value)

    groups = d.groupBy("query", "class", "regime", "group").agg(guarded(F.median("d"), "d").alias("d"))
    regimes = groups.groupBy("query", "class", "regime").agg(guarded(F.median("d"), "d").alias("d"))
    return regimes.groupBy("query", "class").agg(guarded(F.min("d"), "d").alias("d"), guarded(F.min_by("regime", F.struct("d", "regime")), "d").alias("regime"))


def bank_pairs(references: DataFrame) -> DataFrame:
    """(a, b, class_a, class_b, d) of all unordered pairs of a bank, which is checked for its size and broadcast."""
    if references.limit(MAX_REFERENCES + 1).count() > MAX_REFERENCES:
        raise ValueError(f"a bank holds {MAX_REFERENCES} references at most")
    a = references.select(F.col("id").alias("a"), F.col("class").alias("class_a"), F.col("shape").alias("sa"))
    b = references.select(F.col("id").alias("b"), F.col("class").alias("class_b"), F.col("shape").alias("sb"))
    return a.join(F.broadcast(b), F.col("a") < F.col("b")).select("a", "b", "class_a", "class_b", rms_distance(F.col("sa"), F.col("sb")).alias("d"))


def _members(v: pa.StructArray) -> tuple[pa.Array, np.ndarray]:
    """The ids, and the shapes as a matrix, of structs (id, shape); no value becomes a Python object."""
    ids, shapes = v.flatten()
    size = len(shapes[0])
    if any(n != size for n in shapes.value_lengths().to_numpy(zero_copy_only=False)):
        raise ValueError("shapes of one class differ in length")
    return ids, shapes.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), size)


def mean_distances(vectors: DataFrame, block: int = 512) -> DataFrame:
    """(class, id, d): the mean distance of each of vectors (id, class, shape) to the others of its class, null if it is alone.

    A class is packed into blocks by a hash of the id, and each pair of blocks is one row, so a large class is dealt to many tasks; what is shuffled then is one sum a vector and block."""
    size = vectors.groupBy("class").agg(F.ceil(F.count("*") / block).alias("blocks"))
    dealt = vectors.join(F.broadcast(size), "class").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    packed = dealt.groupBy("class", "block").agg(F.collect_list(F.struct("id", "shape")).alias("v"), F.first("blocks").alias("blocks"))
    left = packed.select("class", "v", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    both = left.join(packed.select("class", "block", F.col("v").alias("w")), ["class", "block"]).select("class", "v", "w")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            for row, key in enumerate(piece.column(0).to_pylist()):
                (ids, x), (others, y) = (_members(piece.column(c)[row].values) for c in (1, 2))
                d = np.array([np.sqrt(((y - v) ** 2).mean(axis=1)) for v in x])
                apart = ids.to_numpy(zero_copy_only=False)[:, None] != others.to_numpy(zero_copy_only=False)[None, :]
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(ids), pa.string()), ids, pa.array((d * apart).sum(axis=1)), pa.array(apart.sum(axis=1))], ["class", "id", "s", "n"])

    kinds = dict(vectors.dtypes)
    sums = both.select(F.col("class").cast("string").alias("class"), "v", "w").mapInArrow(run, f"class string, id {kinds['id']}, s double, n long").withColumn("class", F.col("class").cast(kinds["class"]))
    return sums.groupBy("class", "id").agg((F.sum("s") / F.nullif(F.sum("n"), F.lit(0))).alias("d"))


def pairs(vectors: DataFrame, keys: list[str]) -> DataFrame:
    """Unordered pairs of vectors (id, shape) with equal keys: (keys, a, b, d)."""
    a = vectors.select(*keys, F.col("id").alias("a"), F.col("shape").alias("sa"))
    b = vectors.select(*keys, F.col("id").alias("b"), F.col("shape").alias("sb"))
    return a.join(b, keys).filter("a < b").select(*keys, "a", "b", rms_distance(F.col("sa"), F.col("sb")).alias("d"))
