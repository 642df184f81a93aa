"""Exact top-k inner products by a three-phase uniform threshold.

A score is a sum of partial scores, one for each block of dimensions; each block, split into ranges of
candidates, is a local score list. Phase 1 gathers the best k of each list with their whole scores; the k-th best of all is a lower bound t of the
k-th score. Phase 2 broadcasts t, divided by the number of lists, as the cutoff: whatever stays below it in
every list stays below t, so each list sends what reaches it. Phase 3 resolves the remaining entries exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.llm.common import Cuts

#: Vectors in a block of candidates and of queries; blocks of dimensions.
CANDIDATES, QUERIES, LISTS = 4096, 1024, 2


#: Below this, sums of doubles are exact integers; a score that no entry has.
EXACT, NONE = 2.0**53, np.iinfo(np.int64).min


def _matrix(packed: list) -> tuple[np.ndarray, np.ndarray]:
    ids = np.array([x["id"] for x in packed], dtype=np.int64)
    return ids, np.array([x["v"] for x in packed], dtype=np.int64)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Every inner product, exactly: in doubles where they suffice, as they are faster."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64) if most < EXACT else a @ b.T


def _parts(width: int) -> list[slice]:
    edges = [width * i // LISTS for i in range(LISTS + 1)]
    return [slice(a, b) for a, b in zip(edges, edges[1:], strict=False)]


def _phase1(k: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for q, c in zip(frame["q"], frame["c"], strict=True):
                (qi, qv), (_, cv) = _matrix(q), _matrix(c)
                top = min(k, len(cv))
                seen = np.zeros((len(qv), len(cv)), dtype=bool)
                for part in _parts(qv.shape[1]):
                    lists = _products(qv[:, part], cv[:, part])
                    np.put_along_axis(seen, np.argpartition(-lists, top - 1, axis=1)[:, :top], True, axis=1)
                # whole scores of what leads a list only
                rows, cols = np.nonzero(seen)
                score = np.einsum("ij,ij->i", qv[rows], cv[cols])
                ends = np.searchsorted(rows, np.arange(len(qv) + 1))
                yield pd.DataFrame({"query": qi, "scores": [np.sort(score[x:y])[::-1][:k].tolist() for x, y in zip(ends, ends[1:], strict=False)]})

    return run


def _phase2(k: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for q, c, cutoffs in zip(frame["q"], frame["c"], frame["cut"], strict=True):
                (qi, qv), (ci, cv) = _matrix(q), _matrix(c)
                known = {x["id"]: x["t"] for x in cutoffs}
                t = np.array([NONE if known.get(i) is None else known[i] for i in qi.tolist()], dtype=np.int64)
                sent = np.zeros((len(qi), len(ci)), dtype=bool)
                for part in _parts(qv.shape[1]):
                    sent |= _products(qv[:, part], cv[:, part]) >= (t // LISTS)[:, None]
                # phase 3: the whole score of what a list has sent; what falls below t leaves, and so does what k better entries of this range beat
                rows, cols = np.nonzero(sent)
                score = np.einsum("ij,ij->i", qv[rows], cv[cols])
                keep = score >= t[rows]
                rows, cols, score = rows[keep], cols[keep], score[keep]
                order = np.lexsort((ci[cols], -score, rows))
                rows, cols, score = rows[order], cols[order], score[order]
                first = np.searchsorted(rows, rows)
                keep = np.arange(len(rows)) - first < k
                yield pd.DataFrame({"query": qi[rows[keep]], "first_id": ci[cols[keep]], "score": score[keep]})

    return run


def _blocks(df: DataFrame, size: int, name: str) -> tuple[DataFrame, DataFrame]:
    """Rows packed by width into blocks (w, name, first letter of name) of about `size`, dealt by a hash of the id: none grows with the table. And (w, n), how many blocks a width has."""
    counts = df.groupBy(F.size("v").alias("w")).agg(F.ceil(F.count("*") / size).cast("int").alias("n"))
    packed = df.withColumn("w", F.size("v")).join(counts, "w").groupBy("w", F.pmod(F.xxhash64("id"), F.col("n")).cast("int").alias(name)).agg(F.collect_list(F.struct("id", "v")).alias(name[0]))
    return packed, counts


def top_k(spark: SparkSession, vectors: DataFrame, is_query, k: int = 20, scale: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k highest integer inner products of each query row of vectors (vec_id, embedding); other columns are ignored, whatever their names.

    Components become floor(scale * x). Ties go to the smaller vec_id; a query isn't its own candidate. Rows with a null vec_id, and vectors that are null, empty or hold null
    or non-finite components, take no part. Vectors of different widths have no product: a query's candidates are those of its own width. A vec_id that occurs more than once counts once, with its least vector. Equal vectors are
    scored once; their k + 1 smallest ids stand for them. Scores are exact; where they could be beyond a long, an error is raised. An empty table gives an empty result.
    """
    cuts = Cuts(spark, "topk")
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & fine).select(F.col("vec_id").cast("long").alias("id"), F.transform("embedding", lambda x: x.cast("double") * scale).alias("v"))
    # no product is greater than the square of the longest vector
    longest = whole.agg(F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + (F.abs(x) + 1) * (F.abs(x) + 1)))).first()[0]
    if longest is not None and longest >= 2.0**63:
        raise ValueError("scores of these vectors could be beyond a long")
    rows = cuts.cut(whole.select("id", F.transform("v", lambda x: F.floor(x)).alias("v")).groupBy("id").agg(F.min("v").alias("v")))
    # equal vectors: the k + 1 smallest ids; the limit works before the shuffle, so no group gathers in one task
    rank = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    members = cuts.cut(rows.withColumn("r", rank).filter(F.col("r") <= k + 1).groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")))
    cands = members.select(F.element_at("ids", 1).alias("id"), "v")
    queries = rows.filter(is_query(F.col("id")))
    cand_blocks, counts = _blocks(cands, CANDIDATES, "cb")
    query_blocks, dealt = _blocks(queries, QUERIES, "qb")
    n = counts.agg(F.sum("n")).first()[0] or 1
    # every block of queries meets every block of candidates of its width: an equi-join on the candidates' block
    q = query_blocks.join(counts, "w").withColumn("cb", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).drop("n").repartition("w", "qb", "cb")
    pairs = cuts.cut(q.join(cand_blocks, ["w", "cb"]).select("w", "qb", "q", "c").repartition(max(1, min(2000, n * 4)), "qb", F.xxhash64(F.col("c")[0]["id"])))
    kk = k + 1  # the query itself may be among them
    local = pairs.select("q", "c").mapInPandas(_phase1(kk), "query long, scores array<long>")
    best = local.groupBy("query").agg(F.flatten(F.collect_list("scores")).alias("s"))
    cutoff = best.select("query", F.when(F.size("s") >= kk, F.element_at(F.sort_array("s", asc=False), F.lit(kk))).alias("t"))
    q_of = queries.select("id", F.size("v").alias("w")).join(dealt, "w").select("id", "w", F.pmod(F.xxhash64("id"), F.col("n")).cast("int").alias("qb"))
    cut_blocks = q_of.join(cutoff, q_of.id == cutoff.query).groupBy("w", "qb").agg(F.collect_list(F.struct("id", "t")).alias("cut"))
    sent = pairs.join(cut_blocks, ["w", "qb"]).select("q", "c", "cut").mapInPandas(_phase2(kk), "query long, first_id long, score long")
    order = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "first_id"))
    classes = sent.withColumn("r", order).filter(F.col("r") <= kk)
    ids = members.select(F.element_at("ids", 1).alias("first_id"), "ids")
    listed = classes.join(ids, "first_id").select("query", "score", F.explode("ids").alias("vec_id")).filter("vec_id <> query")
    final = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    return listed.withColumn("rank", final.cast("int")).filter(F.col("rank") <= k).select(F.col("query").alias("query_id"), "rank", "vec_id", "score")
