"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders, so a question and its re-parameterised copy have the same template. Windows of five
template tokens are joined on their hash with those of the benchmark; an item of fewer tokens is one window of its own length. A window without a literal token, and that of a short
item, is joined on its values instead; an item of one or two tokens is found only in a document that is nothing else. A document is contaminated
with an item if it has at least 0.8 of the item's windows and its slots are filled consistently at one place: each value of the item's slots stands for one
value there.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.common import Cuts, small_enough

#: Tokens in a window; tokens of an item that is found inside of longer texts; share of an item's windows; share of slots filled consistently; benchmark windows broadcast at most (about 64 MB); memo entries.
WINDOW, INSIDE, SIMILAR, CONSISTENT, BROADCAST_WINDOWS, MEMO = 5, 3, 0.8, 0.8, 500_000, 400_000
#: Units of measure.
UNITS = frozenset("mm cm dm m km inch inches foot feet ft yard yards mile miles mg g gram grams kg kilogram kilograms ton tons tonnes lb lbs oz ounce ounces ml cl l liter liters litre litres gallon gallons ms s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years usd eur gbp dollar dollars euro euros cent cents pound pounds percent w kw v a hz khz mhz ghz kb mb gb tb c f k j kj cal kcal".split())
NAME, NUM, UNIT, MARK = "<name>", "<num>", "<unit>", "\ue000"
_NAMED = re.compile(r"(?<=[a-zà-ÿ0-9,;:] )(?=[A-ZÀ-Þ][a-zà-ÿ])")
_TOKEN = re.compile(rf"\d+(?:[.,]\d+)*|[^\W\d][^\W]*|{MARK}\w+")
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def canonical(token: str) -> str:
    """The template token of a token; a capital inside a sentence marks a name."""
    if token[0] == MARK:
        return NAME
    if token[0].isdigit():
        return NUM
    token = token.lower()
    return UNIT if token in UNITS else token


class _Hashes(dict):
    """Hashes of template tokens by token, odd for literals and even for placeholders; starts anew when full."""

    def __missing__(self, token: str) -> int:
        template = canonical(token)
        self[token] = h = xxhash.xxh3_64_intdigest(template) >> 1 << 1 | (template not in (NAME, NUM, UNIT))
        return h


def _rolled(h: np.ndarray, length: int) -> np.ndarray:
    """The hash of each run of so many hashes."""
    n = len(h) - length + 1
    total = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(length):
            total += h[i : i + n] * _MULTIPLIERS[i]
        total ^= total >> np.uint64(29)
        total *= np.uint64(0xBF58476D1CE4E5B9)
    return (total ^ (total >> np.uint64(32))).view(np.int64)


def windows(text: str | None, memo: _Hashes, lengths: list[int] | None = None) -> tuple[list[str], list[tuple[int, np.ndarray]]]:
    """Tokens of a whole text, and for each length of windows the hash of the window at each place. Without lengths it is WINDOW, or all tokens if they are fewer."""
    tokens = _TOKEN.findall(_NAMED.sub(MARK, text)) if text else []
    if not tokens:
        return tokens, []
    if len(memo) > MEMO:
        memo.clear()
    templates, exact, found = np.array([memo[t] for t in tokens], dtype=np.uint64), None, []
    for length in lengths if lengths is not None else [min(WINDOW, len(tokens))]:
        if len(tokens) < length or (length < INSIDE and len(tokens) > length):
            continue
        h = _rolled(templates, length)
        # what has no literal token, or is short, tells too little by its template: its values count
        bare = np.ones(len(h), bool)
        if length >= WINDOW:
            upto = np.concatenate([[0], np.cumsum(templates & np.uint64(1), dtype=np.int64)])
            bare = upto[length:] == upto[:-length]
        if bare.any():
            if exact is None:
                exact = np.array([xxhash.xxh3_64_intdigest(t.lstrip(MARK).lower(), 1) for t in tokens], dtype=np.uint64)
            h = np.where(bare, _rolled(exact, length), h)
        found.append((length, h))
    return tokens, found


def _slots(tokens: list[str], at: int, length: int) -> list[str]:
    """Values of the slots of the window at a place."""
    return [t for t in tokens[at : at + length] if canonical(t) in (NAME, NUM, UNIT)]


def _explode(known: np.ndarray | None, lengths: list[int] | None = None):
    """Windows with their slot values; those in the sorted array `known` only, if it is given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Hashes()
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                ids, places, hashes, slots, sizes = [], [], [], [], []
                for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    tokens, found = windows(text, memo, lengths)
                    for length, h in found:
                        if known is None:
                            at = range(len(h))
                        elif len(known):
                            at = np.nonzero(known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h)[0].tolist()
                        else:
                            at = ()
                        for i in at:
                            ids.append(key)
                            places.append(i)
                            hashes.append(int(h[i]))
                            slots.append(_slots(tokens, i, length))
                            sizes.append(length)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(places, pa.int32()), pa.array(hashes, pa.int64()), pa.array(slots, pa.list_(pa.string())), pa.array(sizes, pa.int32())], ["id", "place", "h", "slots", "length"])

    return run


_WINDOWS = "id long, place int, h long, slots array<string>, length int"


def consistency(matches: pa.Table) -> float:
    """How consistently a document fills an item's slots where it does so best, of matches (place, item_place, slots, item_slots).

    Each distance between a match's places is tried as where the item begins: each window of the item counts at its match nearest to there, so words put in or left out
    only move what follows. Each slot is a vote for a value of the item and the document's value for it; the share of votes for each value's commonest counterpart counts.
    """
    code: dict[str, int] = {}
    places: dict[tuple, list[tuple[int, list[int]]]] = {}
    for place, at, have, want in zip(*(matches.column(c).to_pylist() for c in ("place", "item_place", "slots", "item_slots")), strict=True):
        places.setdefault((at, *(x.lower() for x in want)), []).append((place - at, [code.setdefault(x.lower(), len(code)) for x in have]))
    starts, best = np.unique([d for found in places.values() for d, _ in found]), 0.0
    for first in range(0, len(starts), 4096):
        begin = starts[first : first + 4096]
        votes: dict[str, list[np.ndarray]] = {}
        for (_, *want), found in places.items():
            found.sort()
            at = np.array([d for d, _ in found])
            right = np.minimum(np.searchsorted(at, begin), len(at) - 1)
            left = np.maximum(right - 1, 0)
            nearest = np.where(np.abs(at[left] - begin) <= np.abs(at[right] - begin), left, right)
            values = np.array([x for _, x in found])[nearest]
            for k, x in enumerate(want):
                votes.setdefault(x, []).append(values[:, k])
        most, total = np.zeros(len(begin)), 0
        for x in votes.values():
            ordered = np.sort(np.array(x), axis=0)
            run, longest = np.ones(len(begin)), np.ones(len(begin))
            for a, b in zip(ordered, ordered[1:]):
                run = np.where(a == b, run + 1, 1)
                longest = np.maximum(longest, run)
            most, total = most + longest, total + len(x)
        best = max(best, float((most / total).max()))
    return best


def _judged(key: tuple, matches: pa.Table) -> pa.Table:
    return pa.table({"id": [key[0].as_py()], "item_id": [key[1].as_py()], "consistency": [consistency(matches)]})


def contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, shared, windows, consistency) of each document with an item of the benchmark (item_id, text) that it contains.

    Null and empty texts hold nothing, items or documents. Repeated rows count once. Whole texts are compared; other columns are ignored. Items whose windows are placeholders only, such as rows of numbers, and those of under WINDOW tokens are found with their
    own values only, and those of under INSIDE tokens only as a whole document. Consistency is 1 where a window has no
    slots. A benchmark of more than BROADCAST_WINDOWS windows is joined by a shuffle, with the same result.
    """
    cuts = Cuts(spark, "decontaminate")
    items = benchmark.filter("item_id is not null").select(F.col("item_id").cast("long").alias("id"), "text")
    wanted = items.mapInArrow(_explode(None), _WINDOWS).select(F.col("id").alias("item_id"), F.col("place").alias("item_place"), "h", F.col("slots").alias("item_slots"), "length")
    totals = wanted.groupBy("item_id").agg(F.countDistinct("h").alias("windows"))
    hashes = wanted.select("h").distinct()
    lengths = sorted(r["length"] for r in wanted.select("length").distinct().collect())
    known = None
    if small_enough(hashes, BROADCAST_WINDOWS):
        known = np.sort(np.array([r["h"] for r in hashes.collect()], dtype=np.int64))
    found = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("id"), "text").mapInArrow(_explode(known, lengths), _WINDOWS)
    # a window that many places of an item or a document share meets itself once for each item and document, with its fillings
    found = found.groupBy("id", "h", "length").agg(F.collect_list(F.struct("place", "slots")).alias("there"))
    wanted = wanted.groupBy("item_id", "h", "length").agg(F.collect_list(F.struct("item_place", "item_slots")).alias("here"))
    met = cuts.cut(found.join(F.broadcast(wanted) if small_enough(wanted, BROADCAST_WINDOWS) else wanted, ["h", "length"]))
    pairs = met.select("id", "item_id", "h")
    shared = pairs.groupBy("id", "item_id").agg(F.countDistinct("h").alias("shared"))
    likely = shared.join(totals, "item_id").filter(F.col("shared") >= F.col("windows") * SIMILAR)
    # places are paired only for likely items, and only where there are slots to compare
    filled = met.join(likely.select("id", "item_id"), ["id", "item_id"], "left_semi").select("id", "item_id", F.explode("there").alias("t"), "here").filter(F.size("t.slots") > 0)
    filled = filled.select("id", "item_id", "t", F.explode("here").alias("w")).select("id", "item_id", "t.place", "w.item_place", "t.slots", "w.item_slots").distinct()
    agree = filled.groupBy("id", "item_id").applyInArrow(_judged, "id long, item_id long, consistency double")
    out = likely.join(agree, ["id", "item_id"], "left").withColumn("consistency", F.coalesce("consistency", F.lit(1.0)))
    return out.filter(F.col("consistency") >= CONSISTENT).select(F.col("id").alias("doc_id"), "item_id", "shared", "windows", "consistency")


def without_leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no item of the benchmark, with docs' columns, whatever their names. Null and empty texts and rows with a null doc_id stay; repeated rows
    stay or go together; an empty table, or an empty benchmark, takes nothing away."""
    bad = contaminated(spark, docs, benchmark).select("doc_id").distinct()
    return docs.join(F.broadcast(bad) if small_enough(bad, BROADCAST_WINDOWS) else bad, "doc_id", "left_anti")
