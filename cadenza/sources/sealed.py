"""A sealed sink: a folder that is written once, as a whole or not at all.

`spark.dataSource.register(SealedFolder)`, then `df.write.format("sealed").mode("append").save(folder)` with df of (file, line): lines of a file are written in the order they come in, so partition and
sort them first. Each task creates its files exclusively in a hidden folder and reports their digests; the driver moves the folder into place and seals it with a manifest only if every task has succeeded.
Tasks that are tried again write under new names, and what no report names is removed. The folder must be one that driver and executors share.
"""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

MANIFEST = "manifest.json"


def _local(path: str) -> str:
    parsed = urlparse(path)
    if parsed.scheme not in ("", "file"):
        raise ValueError("a sealed folder lies where driver and executors see it as a folder")
    return unquote(parsed.path) if parsed.scheme else path


@dataclass
class Written(WriterCommitMessage):
    """(file, name it was written under, bytes, digest) of a task's files."""

    files: list[tuple[str, str, int, str]]


class SealedWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.target = _local(path)
        self.work = f"{self.target}.{uuid.uuid4().hex}.writing"

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        os.makedirs(self.work, exist_ok=True)
        done, name, out, digest, size = [], None, None, None, 0

        def closed() -> None:
            out.flush()
            os.fsync(out.fileno())
            out.close()
            done.append((name, os.path.basename(out.name), size, digest.hexdigest()))

        for file, line in iterator:
            if not isinstance(file, str) or os.path.isabs(file) or ".." in file.split("/") or file in ("", MANIFEST):
                raise ValueError(f"{file!r} can't be the name of a file here")
            if file != name:
                if out is not None:
                    closed()
                if any(file == f for f, *_ in done):
                    raise ValueError(f"lines of {file} aren't together")
                name, digest, size = file, hashlib.sha256(), 0
                # exclusive: no other attempt has this name
                out = open(os.path.join(self.work, uuid.uuid4().hex), "xb")
            data = ("" if line is None else line).encode() + b"\n"
            out.write(data)
            digest.update(data)
            size += len(data)
        if out is not None:
            closed()
        return Written(done)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files = [f for m in messages if m is not None for f in m.files]
        try:
            if len({f for f, *_ in files}) < len(files):
                raise ValueError("two tasks have written one file")
            os.makedirs(self.work, exist_ok=True)
            kept = f"{self.work}/files"
            for file, held, _, _ in files:
                os.makedirs(os.path.dirname(f"{kept}/{file}"), exist_ok=True)
                os.rename(f"{self.work}/{held}", f"{kept}/{file}")
            os.makedirs(kept, exist_ok=True)
            with open(f"{kept}/{MANIFEST}", "x", encoding="utf-8") as out:
                json.dump({"files": {f: {"bytes": n, "sha256": d} for f, _, n, d in sorted(files)}}, out, indent=1)
                out.flush()
                os.fsync(out.fileno())
            # a folder that is there, even an empty one, is never replaced
            os.mkdir(self.target)
            os.rename(kept, self.target)
        finally:
            shutil.rmtree(self.work, ignore_errors=True)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        shutil.rmtree(self.work, ignore_errors=True)


class SealedFolder(DataSource):
    """The folder at `path`; it must not exist yet."""

    @classmethod
    def name(cls) -> str:
        return "sealed"

    def schema(self) -> str:
        return "file string, line string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("a sealed folder is never overwritten")
        if os.path.exists(_local(self.options["path"])):
            raise FileExistsError("the folder is there")
        return SealedWriter(self.options["path"])


def write_sealed(df: DataFrame, path: str, order: list[str]) -> None:
    """Writes df (file, line, ...) with the lines of each file in an order; a file is written by one task, so deal large tables to many files."""
    df.sparkSession.dataSource.register(SealedFolder)
    df.repartition("file").sortWithinPartitions("file", *order).select("file", "line").write.format("sealed").mode("append").save(path)


def verify_sealed(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, sha256, status) of each file of the manifest or the folder: `ok`, `changed`, `missing` or `extra`. Empty files that the manifest doesn't know aren't seen."""
    local = _local(path)
    listed = spark.read.text(f"file://{local}/{MANIFEST}", wholetext=True).select(F.explode(F.from_json("value", "files map<string, struct<bytes: long, sha256: string>>")["files"]).alias("file", "said"))
    there = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"file://{local}")
    there = there.select(F.replace(F.regexp_replace("path", "^file:/+", "/"), F.lit(local + "/"), F.lit("")).alias("file"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes")).filter(F.col("file") != MANIFEST)
    both = listed.join(there, "file", "full")
    status = F.when(F.col("said").isNull(), "extra").when(F.col("sha256").isNull(), "missing").when((F.col("said.sha256") == F.col("sha256")) & (F.col("said.bytes") == F.col("bytes")), "ok").otherwise("changed")
    return both.select("file", F.coalesce("said.bytes", "bytes").alias("bytes"), F.coalesce("said.sha256", "sha256").alias("sha256"), status.alias("status"))
