"""Order MinHash fingerprints, with DataFrame functions only.

A text is a sequence of short pieces; its k-mers are numbered by occurrence, so repeats differ. Each of M starting points on the ring of hashes puts the numbered k-mers in an order of its own,
uniform over all hashes: clockwise from there. The first TUPLE of them, put back in the order of the text, are hashed to one entry of the fingerprint. Two texts share an entry
if they share these k-mers and their order, so likeness falls with edits and with moved passages alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Entries of a fingerprint; k-mers in each; pieces in a k-mer; what a piece is.
M, TUPLE, K, PIECE = 64, 2, 2, r"[^\s]{1,4}"
#: Documents of one range of ids about, ranges for each shuffle partition at least, and ranges at most: their bounds are what the driver holds.
RANGE, PER_PARTITION, MOST_RANGES = 20_000, 8, 10_000
#: A numbered k-mer is one long: the high bits are its hash, the low ones its place in the text, so sorting longs sorts hashes.
_PLACE = 31
_LOW = (1 << _PLACE) - 1


def _low(x: Column) -> Column:
    return x.bitwiseAND(F.lit(_LOW).cast("long"))


def _high(x: Column) -> Column:
    return x.bitwiseAND(F.lit(~_LOW).cast("long"))


def _same(x: Column, y: Column) -> Column:
    """Whether the hashes of two longs are equal; null if one is."""
    return F.shiftrightunsigned(x.bitwiseXOR(y), _PLACE) == 0


def _halving(size: Column) -> Column:
    """Powers of two up to a size, the largest first."""
    return F.filter(F.array(*[F.lit(1 << b) for b in range(30, -1, -1)]), lambda d: d <= size)


def least_at(values: Column, wanted: Column, halving: Column | None = None) -> Column:
    """The first place, from 0, in an ascending array of longs at which a value is no less than the one wanted; the array's size if there is none. halving is _halving(size), if at hand."""
    steps = _halving(F.size(values)) if halving is None else halving
    return F.aggregate(steps, F.lit(0), lambda at, d: F.when(F.get(values, at + d - 1) < wanted, at + d).otherwise(at))


def with_fingerprint(df: DataFrame, text: str, out: str, m: int = M, size: int = TUPLE, k: int = K) -> DataFrame:
    """df with a column of m longs, the fingerprint of a text. Texts of fewer than k pieces are one k-mer; without pieces, all entries are 0. Null texts have none.

    The steps follow one another as columns, since an array that several functions use would be computed for each of them."""
    rest = df.columns
    own = df.withColumn("_p", F.regexp_extract_all(text, F.lit(PIECE), F.lit(0)))
    grams = F.transform("_p", lambda p, i: _high(F.xxhash64(p, *[F.get("_p", i + j) for j in range(1, k)])).bitwiseOR(i.cast("long")))
    own = own.select(*rest, F.sort_array(F.slice(grams, 1, F.greatest(F.size("_p") - k + 1, F.lit(1)))).alias("_s"))
    own = own.select(*rest, "_s", _halving(F.size("_s")).alias("_d"))
    # equal k-mers lie side by side, by place. The first of them keeps its hash; for others, how many precede it is found by halving steps, and numbers its hash

    def occurrence(x: Column, i: Column) -> Column:
        return F.aggregate("_d", F.lit(0), lambda n, d: F.when((n + d <= i) & _same(x, F.get("_s", i - n - d)), n + d).otherwise(n))

    numbered = F.transform("_s", lambda x, i: F.when(_same(x, F.get("_s", i - 1)), _high(F.xxhash64(_high(x), occurrence(x, i))).bitwiseOR(_low(x))).otherwise(x))
    own = own.select(*rest, "_d", F.sort_array(numbered).alias("_o"))
    starts = F.array(*[F.lit(-(1 << 63) + (2 * p + 1) * (1 << 63) // m).cast("long") for p in range(m)])
    own = own.select(*rest, "_o", F.transform(starts, lambda s: least_at(F.col("_o"), s, F.col("_d"))).alias("_at"))
    n = F.size("_o")

    def entry(at: Column) -> Column:
        chosen = F.transform(F.sequence(F.lit(0), F.least(F.lit(size), n) - 1), lambda j: F.get("_o", F.pmod(at + j, n)))
        # place first, then hash
        ordered = F.sort_array(F.transform(chosen, lambda x: F.shiftleft(_low(x), 64 - _PLACE - 1).bitwiseOR(F.shiftrightunsigned(x, _PLACE + 1))))
        return F.xxhash64(F.transform(ordered, lambda x: x.bitwiseAND(F.lit((1 << (64 - _PLACE - 1)) - 1).cast("long"))))

    made = F.when(n == 0, F.array_repeat(F.lit(0).cast("long"), m)).otherwise(F.transform("_at", entry))
    return own.select(*rest, F.when(F.col("_o").isNotNull(), made).alias(out))


def likeness(a: Column, b: Column) -> Column:
    """The share of entries that two fingerprints have in common, 0 to 1."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x) / F.size(a)


def shown(fingerprint: Column) -> Column:
    """A fingerprint as text: 8 hexadecimal digits for each entry."""
    return F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.lower(F.hex(x.bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))), 8, "0")), "")


def _longs(values: list) -> Column:
    """An array of constants as one constant."""
    return F.split(F.lit(",".join(map(str, values))), ",")


def range_tops(docs: DataFrame, partitions: int) -> list[int]:
    """Some of the ids of docs, ascending, the largest among them: between neighbours lie about equally many rows. Nothing but ids is read."""
    n, top = docs.agg(F.count("doc_id"), F.max("doc_id")).first()
    ranges = max(1, min(max(n // RANGE, partitions * PER_PARTITION), MOST_RANGES, n))
    if top is None:
        return []
    inner = []
    if ranges > 1:
        inner = docs.agg(F.percentile_approx("doc_id", _longs([i / ranges for i in range(1, ranges)]).cast("array<double>"), F.lit(max(10_000, 10 * ranges)))).first()[0]
    return sorted({*inner, top})


def edited_and_next(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited, fingerprint, edited_fingerprint, next_fingerprint) for every row of docs (doc_id, text); other columns are ignored, whatever their names.

    The next row comes after in descending order of doc_id, rows of one doc_id by the hash of their texts, and the first row after the last. The edited text has the last third of its code points replaced
    by as many of the next row's first ones, or all it has. A null text is an empty one. Rows with a null doc_id have no place in the order: they have a fingerprint, and null
    for all that needs a next row. A row alone is its own next one. An empty table gives an empty result.

    Each text is shuffled once, into a range of ids; the first rows of a range go to the range before as guests, as they follow its last row.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    tops = range_tops(own, int(spark.conf.get("spark.sql.shuffle.partitions")))
    made = with_fingerprint(own, "text", "fingerprint")
    placeless = made.filter("doc_id is null").select("doc_id", F.length("text").cast("long").alias("n_chars"), F.lit(None).cast("string").alias("edited"), "fingerprint", *[F.lit(None).cast("array<bigint>").alias(f"{x}_fingerprint") for x in ("edited", "next")])
    if not tops:
        return placeless
    bounds = _longs(tops).cast("array<bigint>")
    placed = made.filter("doc_id is not null").withColumn("range", least_at(bounds, F.col("doc_id"))).withColumn("tie", F.xxhash64("text"))
    here = F.struct(F.col("range").alias("range"), F.lit(False).alias("guest"))
    before = F.struct(((F.col("range") + 1) % len(tops)).alias("range"), F.lit(True).alias("guest"))
    at = F.explode(F.when(F.get(bounds, F.col("range")) == F.col("doc_id"), F.array(here, before)).otherwise(F.array(here))).alias("at")
    dealt = placed.select("doc_id", "text", "fingerprint", "tie", at).select("doc_id", "text", "fingerprint", "tie", "at.range", "at.guest")
    order = Window.partitionBy("range").orderBy("guest", F.desc("doc_id"), "tie")
    met = dealt.select("doc_id", "text", "fingerprint", "guest", F.lead("text").over(order).alias("next"), F.lead("fingerprint").over(order).alias("next_fingerprint")).filter("not guest")
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    edited = met.select("doc_id", n.cast("long").alias("n_chars"), F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next", F.lit(1), cut)).alias("edited"), "fingerprint", "next_fingerprint")
    return with_fingerprint(edited, "edited", "edited_fingerprint").select(*placeless.columns).union(placeless)


def edit_report(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """What edited_and_next gives as digests, texts of fingerprints and likenesses; see there for hard cases."""
    found = edited_and_next(spark, docs)
    return found.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), shown(F.col("fingerprint")).alias("fingerprint"), shown(F.col("edited_fingerprint")).alias("edited_fingerprint"),
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
