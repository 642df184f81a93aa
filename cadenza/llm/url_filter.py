"""URL filters by a Bloom filter cascade.

Rules are host-and-path prefixes. The keys of a URL are its host's suffixes, each with a path prefix of a length
that some rule has. Level 0 is a Bloom filter of the listed keys, level 1 one of the unlisted keys of the corpus that level 0
accepts, level 2 one of the listed keys that level 1 accepts, and so on until nothing is accepted wrongly. A level holds about a twentieth of what the level two before it
held, and is hashed anew, so their number grows with the logarithm of the keys and needs no limit.
The cascade knows the corpus's complete key universe, so it answers exactly, without a join.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rules must fit into one expression; a level's wrong share; bytes of a level at most, as it is part of the plan.
MAX_RULES, WRONG, MAX_BYTES = 50_000, 0.05, 64_000_000


@dataclass(frozen=True)
class Level:
    bits: int
    hashes: int
    words: tuple[int, ...]


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL: empty where it is null or has no `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3))
    # from the first / ? or # on
    tail = F.regexp_extract(rest, r"(?s)[/?#].*$", 0)
    host = F.substr(rest, F.lit(1), F.length(rest) - F.length(tail))
    path = F.regexp_extract(tail, r"(?s)^[^?#]*", 0)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(host, upper, lower), F.lit("")), F.coalesce(path, F.lit(""))


def url_keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """The keys of a URL, longest first where two are equal in rank: every host suffix with every path prefix of a known length."""
    labels = F.split(host, r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fits = [F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]
    prefixes = F.array_compact(F.array(*fits))
    return F.array_distinct(F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p)))))


def _positions(key: Column, level: int, bits: int, hashes: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(level), F.lit(i), key), F.lit(bits)) for i in range(hashes)]


def _accepts(key: Column, number: int, level: Level) -> Column:
    # the words of a level are one binary literal; a byte holds eight positions
    blob = F.lit(bytes(level.words))
    tests = [F.getbit(F.conv(F.hex(F.substr(blob, (p / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int"), (p % 8).cast("int")) == 1 for p in _positions(key, number, level.bits, level.hashes)]
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def _level(keys: DataFrame, count: int, number: int) -> Level:
    """A filter of the keys: its bits are set by the executors; its size goes by count, never by the rows seen, and is checked before it is gathered."""
    bits = max(64, math.ceil(-count * math.log(WRONG) / math.log(2) ** 2))
    if bits > 8 * MAX_BYTES:
        raise ValueError(f"a level of {count} keys is over {MAX_BYTES} bytes")
    hashes = max(1, round(bits / max(1, count) * math.log(2)))
    spots = keys.select(F.explode(F.array(*_positions(F.col("key"), number, bits, hashes))).alias("p"))
    rows = spots.groupBy((F.col("p") / 8).cast("int").alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1), (F.col("p") % 8).cast("int"))).alias("v")).collect()
    words = [0] * (bits // 8 + 1)
    for r in rows:
        words[r["w"]] = r["v"]
    return Level(bits, hashes, tuple(words))


def build_cascade(spark: SparkSession, listed: list[str], universe: DataFrame) -> list[Level]:
    """Levels for the listed keys over universe (key, distinct). Odd levels hold the unlisted keys that got through so far;
    their number is a few hundredths of the universe at the first and falls at each further one."""
    inside = spark.createDataFrame([(k,) for k in listed], "key string")
    outside = universe.filter(~F.col("key").isin(listed)) if len(listed) <= 1000 else universe.join(F.broadcast(inside), "key", "left_anti")
    levels: list[Level] = []
    sides, counts = [inside, outside], [len(listed), None]
    while counts[len(levels) % 2] != 0:
        number = len(levels)
        side = number % 2
        if counts[side] is None:
            counts[side] = sides[side].count()
            if not counts[side]:
                break
        levels.append(_level(sides[side], counts[side], number))
        sides[1 - side] = sides[1 - side].filter(_accepts(F.col("key"), number, levels[-1]))
        counts[1 - side] = sides[1 - side].count()
    return levels


def is_listed(key: Column, levels: list[Level]) -> Column:
    """Whether a key of the universe is listed: so it is if the first level that refuses it is an odd one, or if none refuses it and
    the last is an even one."""
    out = F.lit(len(levels) % 2 == 1)
    for number in reversed(range(len(levels))):
        out = F.when(_accepts(key, number, levels[number]), out).otherwise(F.lit(number % 2 == 1))
    return out


def filter_urls(spark: SparkSession, pages: DataFrame, rules: list[tuple[str, str, str]], otherwise: str = "allow") -> DataFrame:
    """pages with host, path, rule and verdict; rules are (verdict, host, path prefix).

    A rule fits its host and the host's subdomains where the path starts with the rule's; the longest that fits wins. A URL whose keys
    the cascade all refuses has rule null and the verdict `otherwise`: it isn't listed. Null, empty or malformed URLs have an empty host and
    path and fit no rule. Repeated rows stay; columns that are named host, path, rule or verdict are replaced. An empty table gives an empty result.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    verdicts = {host.lower() + path: verdict for verdict, host, path in rules}
    lengths = sorted({len(path) for _, _, path in rules})
    host, path = split_url(F.col("url"))
    split = pages.withColumns({"host": host, "path": path})
    keys = url_keys(F.col("host"), F.col("path"), lengths)
    universe = split.select(F.explode(keys).alias("key")).distinct()
    levels = build_cascade(spark, list(verdicts), universe)
    found = F.filter(keys, lambda k: is_listed(k, levels))
    best = F.array_max(F.transform(found, lambda k: F.struct(F.length(k).alias("n"), k.alias("k"))))["k"]
    verdict = F.create_map(*[F.lit(x) for kv in verdicts.items() for x in kv])
    return split.withColumn("rule", best).withColumn("verdict", F.coalesce(F.element_at(verdict, F.col("rule")), F.lit(otherwise)))
