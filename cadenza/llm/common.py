"""Helpers shared by the text operators: durable cuts of lineage, and reading of tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Where the session names none, a temporary one serves a local session; a cluster must name its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="cadenza-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Cuts opened within `scratch`, innermost last.
_open: list[list[Cuts]] = []


@contextmanager
def scratch() -> Iterator[None]:
    """Removes, at its end, every table cut by operators called within. What they return must have been written by then."""
    _open.append([])
    try:
        yield
    finally:
        for cuts in _open.pop():
            cuts.close()


class Cuts:
    """Tables written to the shared folder to cut lineage. `drop` removes single ones; what is left can be removed by `close`."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.base, self.n = spark, f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}", 0
        self.places: dict[int, tuple[DataFrame, str]] = {}
        if _open:
            _open[-1].append(self)

    def path(self) -> str:
        self.n += 1
        return f"{self.base}/{self.n}"

    def cut(self, df: DataFrame) -> DataFrame:
        path = self.path()
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.places[id(out)] = (out, path)
        return out

    def _delete(self, path: str) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def drop(self, *frames: DataFrame | None) -> None:
        """Remove the tables of these frames, as returned by `cut`; None and other frames are passed over."""
        for df in frames:
            if (found := self.places.pop(id(df), None)) is not None:
                self._delete(found[1])

    def close(self) -> None:
        """Remove every table of these cuts."""
        self.places.clear()
        self._delete(self.base)


def held_out(doc_id: Column) -> Column:
    """Rows kept out of every fit: crc32 of the id as text, modulo 4, is 2."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether df has at most `rows` rows; counts no further than that."""
    return df.limit(rows + 1).count() <= rows
