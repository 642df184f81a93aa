"""Recordings of any length in bounded blocks, and scans along them.

What runs along a recording (a phase, the state of a recursive filter, a best path) is cut into blocks, each of which becomes one item of an associative operation: a sum, an affine
map, a max-plus matrix. `scan` says what all items before a block combine to, level by level, so that no task gets more than FANOUT items of one recording at once.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

#: Samples of a block; items combined in one row; blocks broadcast at most, with a few numbers each (about 10 MB).
BLOCK, FANOUT, BROADCAST_BLOCKS = 16_384, 256, 50_000
#: Bytes of a batch that a task of Python unpacks at once, and cells that it hands back at once; a single row may pass both.
PIECE_BYTES, PIECE_CELLS = 4_000_000, 200_000

Combine = Callable[[np.ndarray, np.ndarray], np.ndarray]


def shared_folder(spark: SparkSession) -> str:
    """The folder that executors share, from spark.checkpoint.dir. Only a local session may leave it unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="cadenza-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def durable(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back: its lineage is cut, and what lost executors held is there still."""
    path = f"{shared_folder(df.sparkSession)}/blocks-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(events: DataFrame, rec: Column, ts: str = "ts", tie: str = "event_id", period: str = "day") -> DataFrame:
    """events with rec and n, the place from 0 in the recording, by time and then tie. Rows are numbered within periods, and periods by what precedes them, so no task sorts a recording."""
    at = events.withColumn("rec", rec).withColumn("_period", F.date_trunc(period, ts))
    sizes = at.groupBy("rec", "_period").agg(F.count("*").alias("_size"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(Window.partitionBy("rec").orderBy("_period").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_size")
    own = at.withColumn("_own", F.row_number().over(Window.partitionBy("rec", "_period").orderBy(ts, tie)))
    return own.join(before, ["rec", "_period"]).withColumn("n", F.col("_own") - 1 + F.col("_before")).drop("_period", "_own", "_before")


def packed(x: DataFrame, columns: list[str], size: int, before: int = 0, after: int = 0) -> DataFrame:
    """(rec, block, first, column...): samples of x (rec, n, column...) as arrays by blocks of `size`, with up to so many samples before and after the block's own, and the n of the first."""
    own = F.floor(F.col("n") / size)
    blocks = F.sequence(F.floor(F.greatest(F.col("n") - after, F.lit(0)) / size), F.floor((F.col("n") + before) / size))
    # samples beyond the last block have no block of their own
    cut = x.select("rec", "n", *columns, own.alias("own"), F.explode(blocks).alias("block")) if before or after else x.select("rec", "n", *columns, own.alias("own"), own.alias("block"))
    found = cut.groupBy("rec", "block").agg(F.sort_array(F.collect_list(F.struct("n", *columns))).alias("v"), F.max(F.col("own") == F.col("block")).alias("real")).filter("real")
    return found.select("rec", "block", F.col("v")[0]["n"].alias("first"), *[F.col("v").getField(c).alias(c) for c in columns])


def pieces(batches: Iterator[pa.RecordBatch], most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about so many bytes, a row at least: a batch that is bounded in bytes takes many times these as Python objects."""
    for batch in batches:
        step = max(1, most * batch.num_rows // max(batch.nbytes, 1))
        yield from (batch.slice(at, step) for at in range(0, batch.num_rows, step))


def _cells(v: object) -> int:
    if isinstance(v, np.ndarray) and v.dtype != object:
        return v.size
    return sum(map(_cells, v)) if isinstance(v, (tuple, list, np.ndarray)) else 1


def by_rows(df: DataFrame, schema: str, rows: Callable[[tuple], Iterator[tuple]]) -> DataFrame:
    """Rows of df mapped to rows of a schema; arrays come as NumPy arrays. What a task holds as Python objects is bounded, however large Spark's batches are and however many rows come of one."""
    form = df.sparkSession.createDataFrame([], schema).schema
    target = to_arrow_schema(form)

    def packed_rows(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(column, f.type, from_pandas=True) for column, f in zip(zip(*out, strict=True), target, strict=True)], schema=target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, cells = [], 0
        for piece in pieces(batches):
            for r in piece.to_pandas().itertuples(index=False):
                for o in rows(r):
                    out.append(o)
                    cells += _cells(o)
                    if cells >= PIECE_CELLS:
                        yield packed_rows(out)
                        out, cells = [], 0
        if out:
            yield packed_rows(out)

    return df.mapInArrow(run, form)


def scan(items: DataFrame, keys: list[str], combine: Combine, fanout: int = FANOUT) -> DataFrame:
    """(key..., place, before): what the items of all smaller places combine to, null for the first. items (key..., place, item) hold an array each; places run from 0 without gaps. combine is associative, and takes the earlier item first."""
    kinds = dict(items.dtypes)
    own = ", ".join(f"{k} {kinds[k]}" for k in keys)
    levels, most = [items.select(*keys, "place", "item")], items.agg(F.max("place")).first()[0] or 0

    def groups(level: DataFrame) -> DataFrame:
        return level.groupBy(*keys, F.floor(F.col("place") / fanout).alias("up")).agg(F.sort_array(F.collect_list(F.struct("place", "item"))).alias("v"))

    def total(r: tuple) -> Iterator[tuple]:
        out = None
        for e in r.v:
            item = np.asarray(e["item"])
            out = item if out is None else combine(out, item)
        yield (*r[: len(keys)], r.up, out)

    while most >= fanout:
        levels.append(durable(by_rows(groups(levels[-1]), f"{own}, place long, item array<double>", total)))
        most //= fanout

    def within(r: tuple) -> Iterator[tuple]:
        now = None if r.above is None else np.asarray(r.above)
        for e in r.v:
            yield (*r[: len(keys)], e["place"], now)
            item = np.asarray(e["item"])
            now = item if now is None else combine(now, item)

    above = None
    for level in reversed(levels):
        grouped = groups(level)
        grouped = grouped.withColumn("above", F.lit(None).cast("array<double>")) if above is None else grouped.join(above.select(*keys, F.col("place").alias("up"), F.col("before").alias("above")), [*keys, "up"], "left")
        above = by_rows(grouped, f"{own}, place long, before array<double>", within)
    return above


def few(df: DataFrame, rows: int = BROADCAST_BLOCKS) -> DataFrame:
    """df, to be broadcast if it has few rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def running_sum(x: DataFrame, size: int = BLOCK) -> DataFrame:
    """(rec, n, value, total): the sum of all values of x (rec, n, value) up to n. Values that are null count as 0."""
    blocks = durable(packed(x.select("rec", "n", F.coalesce(F.col("value"), F.lit(0.0)).alias("value")), ["value"], size))
    kind = dict(x.dtypes)["rec"]
    items = by_rows(blocks, f"rec {kind}, place long, item array<double>", lambda r: iter([(r.rec, r.block, np.array([np.sum(r.value)]))]))
    before = few(durable(scan(durable(items), ["rec"], np.add)))
    joined = blocks.join(before.withColumnRenamed("place", "block"), ["rec", "block"], "left")

    def run(r: tuple) -> Iterator[tuple]:
        yield r.rec, r.first, r.value, np.cumsum(r.value) + (0.0 if r.before is None else r.before[0])

    out = by_rows(joined, f"rec {kind}, first long, value array<double>, total array<double>", run)
    return out.select("rec", "first", F.posexplode(F.arrays_zip("value", "total")).alias("i", "z")).select("rec", (F.col("first") + F.col("i")).alias("n"), "z.value", "z.total")


