"""ZIP archives as tables: a Python data source with a partition for each run of members, planned from the central directory.

`spark.dataSource.register(ZipMembers)`, then `spark.read.format("zip_members").load(folder or file)`. Options on the member's name are answered from the directory, so what they turn down is never read. They are
options and no pushed filters: Spark 4.1 keeps a reader for all queries of a DataFrame, and what one query had pushed would be left out of the next. Tasks open the archive where its path leads on their own
machine, so it must lie in a shared folder.
"""

from __future__ import annotations

import os
import zipfile
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes, packed, that one partition reads about.
PART_BYTES = 32_000_000
SCHEMA = "archive string, member string, bytes long, crc32 long, content binary, error string"


class Members(InputPartition):
    def __init__(self, archive: str, members: list[str]):
        self.archive, self.members = archive, members


def _files(path: str) -> list[str]:
    parsed = urlparse(path)
    if parsed.scheme not in ("", "file"):
        raise ValueError("archives lie in a folder that all executors see")
    local = unquote(parsed.path) if parsed.scheme else path
    return sorted(os.path.join(local, n) for n in os.listdir(local) if n.lower().endswith(".zip")) if os.path.isdir(local) else [local]


class ZipReader(DataSourceReader):
    def __init__(self, path: str, part_bytes: int, prefix: str, suffix: str):
        self.path, self.part_bytes, self.prefix, self.suffix = path, part_bytes, prefix, suffix

    def _takes(self, name: str) -> bool:
        return name.startswith(self.prefix) and name.endswith(self.suffix)

    def partitions(self) -> list[InputPartition]:
        """Members in the order of the directory, cut where PART_BYTES are reached. An archive whose directory can't be read is a partition of its own, which says so."""
        parts: list[InputPartition] = []
        for archive in _files(self.path):
            try:
                with zipfile.ZipFile(archive) as z:
                    infos = [i for i in z.infolist() if not i.is_dir() and self._takes(i.filename)]
            except (zipfile.BadZipFile, OSError):
                parts.append(Members(archive, []))
                continue
            run, size = [], 0
            for i in infos:
                run.append(i.filename)
                size += i.compress_size
                if size >= self.part_bytes:
                    parts.append(Members(archive, run))
                    run, size = [], 0
            if run:
                parts.append(Members(archive, run))
        # Spark asks a reader without partitions for one part, None
        return parts or [Members("", [])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        """A row for each member: its content, or what is wrong with it."""
        if not partition.members:
            if partition.archive:
                yield partition.archive, None, None, None, None, "no directory"
            return
        with zipfile.ZipFile(partition.archive) as z:
            for name in partition.members:
                info = z.getinfo(name)
                try:
                    yield partition.archive, name, info.file_size, info.CRC, z.read(name), None
                except (zipfile.BadZipFile, NotImplementedError, RuntimeError, EOFError, OSError, ValueError) as e:
                    yield partition.archive, name, info.file_size, info.CRC, None, type(e).__name__
                except Exception as e:  # zlib.error has no other base
                    if type(e).__module__ != "zlib":
                        raise
                    yield partition.archive, name, info.file_size, info.CRC, None, "zlib"


class ZipMembers(DataSource):
    """Members of the archive, or of all archives in the folder, at `path`. Options `prefix` and `suffix`: how names of members begin and end; `partBytes`: packed bytes of a partition."""

    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ZipReader(self.options["path"], int(self.options.get("partBytes", PART_BYTES)), self.options.get("prefix", ""), self.options.get("suffix", ""))


def zip_members(spark: SparkSession, path: str, prefix: str = "", suffix: str = "", part_bytes: int = PART_BYTES) -> DataFrame:
    """(archive, member, bytes, crc32, content, error) of each member whose name begins and ends so; checks that fail are rows with an error, also of an archive without a directory."""
    spark.dataSource.register(ZipMembers)
    return spark.read.format("zip_members").options(prefix=prefix, suffix=suffix, partBytes=str(part_bytes)).load(path)


def numeric_rows(members: DataFrame, columns: list[str], sep: str = ",") -> DataFrame:
    """(archive, member, n, column..., error) of members that are tables of numbers without a heading: a row for each line, n from 0. A line of another count of cells, or with a cell that is no number, has an error and nulls.

    The text is cut and cast by Spark's own functions; only unpacking takes Python."""
    lines = members.filter("error is null").select("archive", "member", F.posexplode(F.split(F.regexp_replace(F.col("content").cast("string"), r"\s+$", ""), r"\r?\n")).alias("n", "line"))
    cells = F.split(F.col("line"), sep, -1)
    values = F.transform(cells, lambda c: F.trim(c).try_cast("double"))
    bad = F.when(F.size(cells) != len(columns), "cells").when(F.exists(values, lambda v: v.isNull() | F.isnan(v)), "number")
    x = lines.select("archive", "member", F.col("n").cast("long").alias("n"), values.alias("v"), bad.alias("error"))
    return x.select("archive", "member", "n", *[F.when(F.col("error").isNull(), F.get("v", F.lit(i))).alias(c) for i, c in enumerate(columns)], "error")


def member_labels(member: Column) -> list[Column]:
    """family, position, severity and value of a member's path: family/value, family/severity/value or, where faults have a place, family/position/severity/value."""
    parts = F.split(member, "/")
    deep = F.size(parts)
    return [
        F.get(parts, F.lit(0)).alias("family"), F.when(deep == 4, F.get(parts, F.lit(1))).alias("position"), F.when(deep >= 3, F.element_at(parts, -2)).alias("severity"),
        F.regexp_extract(F.element_at(parts, -1), r"^(.*?)(\.[^.]*)?$", 1).alias("value"),
    ]
