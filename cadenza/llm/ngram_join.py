"""N-gram Jaccard join by token-combination prefixes.

1. Each text becomes its set of five-word shingles, hashed to 64 bits; equal sets become one.
2. In hash order, linked sets share at least k tokens of their prefixes extended by k - 1 (k about 8 % of
   the set). Sets whose extended prefix shares fewer tokens than that with any other set can't link and leave.
3. The sets that remain are counted exactly, and their tokens ordered by frequency, then hash. A set meets partners of each class of sizes by
   keys of their own, as the least overlap, and so the prefix, goes by both sizes. Rare tokens of the prefix are indexed singly. Frequent tokens are
   indexed only as combinations of neighbours in that order, two of them or, of very frequent ones, three, over a prefix so much longer that a linked
   pair without a common rare prefix token must agree in at least one combination.
4. Candidates whose shared tokens can still reach the overlap are verified exactly, by pivots (groups.py).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.common import Cuts, small_enough
from cadenza.llm.groups import resolve

#: Shingle length in words; the share of a set by which the first prefix is extended; from more than so many sets on a token is frequent, and very frequent;
#: ratio of the sizes of neighbouring classes.
WORDS, EXTENSION, FREQUENT, VERY_FREQUENT, RATIO = 5, 0.08, 32, 1024, 1.1
#: Words of 64 bits of a set's parities.
PARITY = 4
_MARKS = [f"m{i}" for i in range(PARITY)]
#: Ids broadcast at most (16 MB); beyond it the same join shuffles.
BROADCAST_IDS = 2_000_000
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_hashes(text: bytes | None) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; bytes.lower and bytes.split know A-Z and the six ASCII blanks only."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, dtype=np.int64)
    h = pd.util.hash_array(np.array(words, dtype=object), categorize=False)
    n = max(1, len(words) - WORDS + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(n, dtype=np.uint64)
        for i in range(min(WORDS, len(words))):
            total += h[i : i + n] * _MULTIPLIERS[i]
        if len(words) < WORDS:
            total += np.uint64(len(words))
        return np.unique(_mix(total).view(np.int64))


def _need(n: np.ndarray | int) -> np.ndarray | int:
    """The least common tokens of a linked set of n: ceil(0.8 n)."""
    return -(-4 * n // 5)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            n, g1, g2, heads = [], [], [], []
            for text in part.column(1).to_pylist():
                tokens = shingle_hashes(text)
                n.append(len(tokens))
                with np.errstate(over="ignore"):
                    u = tokens.view(np.uint64)
                    g1.append(int(u.sum(dtype=np.uint64).view(np.int64)))
                    g2.append(int(_mix(u * np.uint64(0x9FB21C651E98DF25)).sum(dtype=np.uint64).view(np.int64)))
                # keep what the longest extended prefix needs
                heads.append(tokens[: len(tokens) - _need(len(tokens)) + 1 + int(EXTENSION * len(tokens))])
            flat = np.concatenate(heads) if heads else np.empty(0, dtype=np.int64)
            ends = np.concatenate([[0], np.cumsum([len(x) for x in heads])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(g1, pa.int64()), pa.array(g2, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["doc_id", "n", "g1", "g2", "head"])


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            part = batch.slice(at, 200)
            sets = [shingle_hashes(x) for x in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column(0).to_numpy(), [len(s) for s in sets])), pa.array(np.concatenate(sets))], ["id", "h"])


def _class(n: int) -> int:
    return math.floor(math.log(n) / math.log(RATIO))


def signatures(df: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """The keys of a set of n tokens, given those (frequency, hash) it shares with any set, rarest first; the others come before them and match nothing.

    For each class of partners' sizes: sets of n and m tokens link if they share a = 4/9 (n + m) or more. Of the first l common tokens each lies among the first
    n - a + l of the set. l = 1 gives the prefix for single tokens. At most d = (n + m) / 9 tokens lie in one set only; each of them parts two neighbours at most once, three twice, so
    of d + 2 common tokens two neighbours stay together, and of 2 d + 4 two or, where there are very frequent ones, three.
    """
    common = len(h)
    unique = n - common
    keys = []
    biggest = min(5 * n // 4, 9 * common // 4 - n)
    smallest = -(-4 * n // 5)
    if biggest < smallest:
        return np.empty(0, dtype=np.int64)
    u = h.view(np.uint64)
    two, three = (df > FREQUENT) & (df <= VERY_FREQUENT), df > VERY_FREQUENT
    own = _class(n)
    single = np.nonzero(df <= FREQUENT)[0]
    at2, at3 = np.nonzero(two)[0], np.nonzero(three)[0]
    with np.errstate(over="ignore"):
        pairs = _mix(u[at2[:-1]] * _MULTIPLIERS[0] + u[at2[1:]] * _MULTIPLIERS[1]) if len(at2) > 1 else u[:0]
        triples = _mix(u[at3[:-2]] * _MULTIPLIERS[0] + u[at3[1:-1]] * _MULTIPLIERS[1] + u[at3[2:]] * _MULTIPLIERS[2]) if len(at3) > 2 else u[:0]
        for other in range(_class(smallest), _class(biggest) + 1):
            low, high = max(smallest, math.ceil(RATIO**other * (1 - 1e-9))), min(biggest, math.floor(RATIO ** (other + 1) * (1 + 1e-9)))
            if low > high:
                continue
            prefix = n - -(-4 * (n + low) // 9) + 1 - unique
            apart = (n + high) // 9
            longer = prefix - 1 + (2 * apart + 4 if len(at3) else apart + 2)
            found = [u[single[single < prefix]], pairs[at2[1:] < longer] if len(pairs) else pairs, triples[at3[2:] < longer] if len(triples) else triples]
            place = np.uint64(min(own, other) * 4096 + max(own, other) + 1)
            keys += [_mix(x ^ (place * _MULTIPLIERS[3 + (k > 0)] + np.uint64(k))) for k, x in enumerate(found) if len(x)]
    return np.unique(np.concatenate(keys)).view(np.int64) if keys else np.empty(0, dtype=np.int64)


def parity(h: np.ndarray) -> np.ndarray:
    """64 PARITY bits: for each place that a token's hash may name, whether an odd number of tokens name it. Sets differ in as many tokens as bits, or more."""
    odd = np.bincount((h.view(np.uint64) >> np.uint64(48)).astype(np.int64) % (64 * PARITY), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(sig, id, info) of sets (id, n, df, h)."""
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            part = batch.slice(at, 200)
            df, h = part.column(2), part.column(3)
            ends, flat_df, flat_h = df.offsets.to_numpy(), df.values.to_numpy(), h.values.to_numpy()
            starts_h = h.offsets.to_numpy()
            ns = part.column(1).to_numpy()
            got = [signatures(flat_df[ends[i] : ends[i + 1]], flat_h[starts_h[i] : starts_h[i + 1]], int(ns[i])) for i in range(part.num_rows)]
            times = [len(x) for x in got]
            common = np.diff(ends)
            marks = np.array([parity(flat_h[starts_h[i] : starts_h[i + 1]]) for i in range(part.num_rows)]).reshape(-1, PARITY)
            columns = [ns, common.astype(np.int64), *marks.T]
            info = pa.StructArray.from_arrays([pa.array(np.repeat(c, times)) for c in columns], ["n", "common", *_MARKS])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(got) if got else np.empty(0, dtype=np.int64)), pa.array(np.repeat(part.column(0).to_numpy(), times)), info], ["sig", "id", "info"])


def _may_link(a: Column, b: Column) -> Column:
    """Whether sets may differ in so few tokens as a link allows. They differ in those that no other set has, and in one at least for each bit of the parities."""
    both = a["n"] + b["n"]
    bits = sum((F.bit_count(a[m].bitwiseXOR(b[m])).cast("long") for m in _MARKS), F.lit(0).cast("long"))
    return (9 * F.least(a["common"], b["common"]) >= 4 * both) & (both - a["common"] - b["common"] + bits <= F.floor(both / 9))


def jaccard_components(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_copies) for every row of docs (doc_id, text).

    Two documents link when their sets of five-word shingles have a Jaccard similarity of 0.8 or more; fewer words
    make one shingle. component_id is the smallest doc_id reachable by links. A null or empty text, or one of blanks,
    has no shingles and links with nothing, not even its like; its n_copies is 1. Repeated texts are one set, so they need no pairs; repeated rows
    stay, ties of doc_id too. Other columns of docs are ignored. An empty table gives an empty result.
    """
    cuts = Cuts(spark, "ngram")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    sets = cuts.cut(rows.mapInArrow(_sets, "doc_id long, n long, g1 long, g2 long, head array<long>"))
    reps = cuts.cut(sets.filter("n > 0").groupBy("g1", "g2", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_copies")))

    # 2. what may link at all
    heads = sets.filter("n > 0").select(F.col("doc_id").alias("id"), "n", "head").join(reps.select(F.col("rep").alias("id")), "id", "left_semi")
    emitted = heads.select("id", F.explode("head").alias("h"))
    shared = emitted.groupBy("h").agg(F.count("*").alias("df")).filter("df > 1").select("h")
    hits = emitted.join(shared, "h").groupBy("id").agg(F.count("*").alias("hits"))
    sizes = reps.select(F.col("rep").alias("id"), "n")
    least = F.floor(F.ceil(F.col("n") * 4 / 5) * EXTENSION) + 1
    alive = cuts.cut(hits.join(sizes, "id").filter(F.col("hits") >= least).select("id", "n"))

    # 3. exact frequencies among these, and signatures
    ids = alive.select("id")
    ids = F.broadcast(ids) if small_enough(ids, BROADCAST_IDS) else ids
    full = cuts.cut(rows.withColumnRenamed("doc_id", "id").join(ids, "id", "left_semi").mapInArrow(_tokens, "id long, h long"))
    df = full.groupBy("h").agg(F.count("*").alias("df")).filter("df > 1")
    kept = full.join(df, "h").groupBy("id").agg(F.sort_array(F.collect_set(F.struct("df", "h"))).alias("t"))
    kept = kept.join(alive, "id").filter(F.size("t") >= F.ceil(F.col("n") * 4 / 5))
    kept = cuts.cut(kept.select("id", "n", F.transform("t", lambda t: t["df"]).alias("df"), F.transform("t", lambda t: t["h"]).alias("h")))
    cuts.drop(full, alive)
    postings = cuts.cut(kept.mapInArrow(_postings, "sig long, id long, info struct<n:long,common:long," + ",".join(f"{m}:long" for m in _MARKS) + ">"))
    words = kept.select("id", "n", "h")

    def verify(pairs: DataFrame) -> DataFrame:
        a = words.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("h").alias("ha"))
        b = words.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("h").alias("hb"))
        both = F.size(F.array_intersect("ha", "hb"))
        return pairs.join(a, "a").join(b, "b").filter(100 * both >= 80 * (F.col("na") + F.col("nb") - both)).select("a", "b")

    labels = resolve(spark, postings, verify, cuts, _may_link, lambda info: 1 - info["common"] / info["n"])
    cuts.drop(kept, postings)
    if labels is not None:
        reps = reps.join(labels.withColumnRenamed("id", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    else:
        reps = reps.withColumn("comp", F.col("rep"))
    out = sets.select("doc_id", "n", "g1", "g2").join(reps.select("g1", "g2", "n", "comp", "n_copies"), ["g1", "g2", "n"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("comp", "doc_id").alias("component_id"), F.coalesce("n_copies", F.lit(1).cast("long")).alias("n_copies"))
