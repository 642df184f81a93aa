"""Table functions and named reducers, for SQL and for DataFrames."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

WINDOW_SCHEMA = "rec string, start long, valid long, padding long, rms double, peak double, silence boolean, clipped long"


class PaddedWindows:
    """Windows of a recording, as its samples come in order: every `step` samples one of `size` begins, until one reaches the end; the last is filled up with zeros, which count for nothing.

    No more than one window of samples is kept."""

    def __init__(self):
        self.rec, self.held, self.first, self.done, self.n = None, [], 0, 0, 0

    def _row(self, values: list[float]) -> tuple:
        peak = max(map(abs, values))
        return self.rec, self.first, len(values), self.size - len(values), math.sqrt(math.fsum(v * v for v in values) / len(values)), peak, peak == 0, sum(v <= -1 or v >= 1 for v in values)

    def eval(self, row: Row, size: int, step: int) -> Iterator[tuple]:
        if not 0 < step <= size:
            raise ValueError("windows step by 1 to their size")
        self.rec, self.size, self.step = str(row["rec"]), size, step
        self.held.append(row["value"])
        self.n += 1
        if len(self.held) == size:
            yield self._row(self.held)
            self.done, self.first, self.held = self.n, self.first + step, self.held[step:]

    def terminate(self) -> Iterator[tuple]:
        # samples that no whole window has reached
        if self.rec is not None and self.n > self.done:
            yield self._row(self.held)


def register(spark: SparkSession) -> None:
    """`padded_windows(row => TABLE(x) PARTITION BY (rec) ORDER BY (n), size => 64, step => 48)` in SQL, for x with rec, n and value."""
    spark.udtf.register("padded_windows", udtf(PaddedWindows, returnType=WINDOW_SCHEMA))


#: Reducers by name: an aggregate of a column.
REDUCERS: dict[str, Callable[[Column], Column]] = {"mean": F.avg, "median": F.median, "min": F.min, "max": F.max, "rms": lambda c: F.sqrt(F.avg(c * c))}


def pooled(cells: DataFrame, keys: list[str], rows: int, columns: int, reducer: str) -> DataFrame:
    """(key..., row, col, value): maps (key..., row, col, value), rows and columns numbered from 0, brought to so many rows and columns at most. Cells are dealt to parts whose sizes differ by one at most, the larger first, and each
    part's rows are reduced for each column, then the columns. reducer is a name of REDUCERS; add to it what it lacks."""
    if reducer not in REDUCERS:
        raise ValueError(f"no reducer {reducer}")
    reduced = REDUCERS[reducer]
    sizes = cells.groupBy(*keys).agg((F.max("row") + 1).alias("rows"), (F.max("col") + 1).alias("cols"))

    def part(at: str, of: str, most: int) -> Column:
        n = F.least(F.lit(most).cast("long"), F.col(of))
        small, more = F.floor(F.col(of) / n), F.col(of) % n
        whole = more * (small + 1)
        return F.when(F.col(at) < whole, F.floor(F.col(at) / (small + 1))).otherwise(more + F.floor((F.col(at) - whole) / small))

    x = cells.join(sizes, keys).withColumn("r", part("row", "rows", rows)).withColumn("c", part("col", "cols", columns))
    x = x.groupBy(*keys, "r", "col", "c").agg(reduced(F.col("value")).alias("value"))
    return x.groupBy(*keys, F.col("r").alias("row"), F.col("c").alias("col")).agg(reduced(F.col("value")).alias("value"))


def brought_to(values: Column, points: int) -> Column:
    """An array of any length as so many points, by straight lines between equally spaced values; null of a null or empty one."""

    def at(j: Column) -> Column:
        where = j * (F.size(values) - 1) / float(points - 1)
        low = F.floor(where).cast("int")
        a, b = F.get(values, low), F.get(values, F.least(low + 1, F.size(values) - 1))
        return a + (b - a) * (where - low)

    return F.when(F.size(values) > 0, F.transform(F.sequence(F.lit(0), F.lit(points - 1)), at))


def inverse_levels(histogram: DataFrame, keys: list[str], shares: list[float]) -> DataFrame:
    """(key..., share, level): where the running share of a histogram (key..., level, count) reaches each share, by straight lines between levels; below the first level's share, the first level. Empty histograms give null.

    The levels of one histogram are one row: keep them few."""
    cells = histogram.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("level", "count"))).alias("cells"))
    running = F.aggregate("cells", F.struct(F.lit(0.0).alias("sum"), F.array().cast("array<struct<level:double,upto:double>>").alias("out")), lambda s, c: F.struct((s["sum"] + c["count"]).alias("sum"), F.array_append(s["out"], F.struct(c["level"].cast("double").alias("level"), (s["sum"] + c["count"]).alias("upto"))).alias("out")))
    x = cells.select(*keys, running.alias("r")).select(*keys, F.col("r.sum").alias("total"), F.col("r.out").alias("out"), F.explode(F.array(*map(F.lit, shares))).alias("share"))
    want = F.col("share") * F.col("total")
    above, below = F.filter("out", lambda c: c["upto"] >= want), F.filter("out", lambda c: c["upto"] < want)
    x = x.select(*keys, "share", "total", want.alias("want"), F.get(above, F.lit(0)).alias("b"), F.element_at(F.when(F.size(below) > 0, below), -1).alias("a"))
    line = F.col("a.level") + (F.col("b.level") - F.col("a.level")) * (F.col("want") - F.col("a.upto")) / (F.col("b.upto") - F.col("a.upto"))
    return x.select(*keys, "share", F.when(F.col("total") > 0, F.coalesce(line, F.col("b.level"))).alias("level"))
