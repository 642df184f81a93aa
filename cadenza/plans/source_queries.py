"""Queries that write archives, recordings and sealed folders from the tables, read them back, and compare."""

from __future__ import annotations

import os
import uuid
import zipfile
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.operators.blocks import numbered, shared_folder
from cadenza.sources.archives import member_labels, numeric_rows, zip_members
from cadenza.sources.sealed import verify_sealed, write_sealed
from cadenza.sources.wav import UPLOADS, Wav, audit, canonical, read_samples


def _place(spark: SparkSession, name: str) -> str:
    """A new folder of this machine's name for the one that executors share."""
    return f"{urlparse(shared_folder(spark)).path}/{name}-{uuid.uuid4().hex}"


def zip_tables(df: DataFrame, folder: str) -> int:
    """Writes df (archive, member, content), archives as ZIP files, each by the task that has it; returns how many. An attempt writes under a name of its own and moves the file into place."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.makedirs(folder, exist_ok=True)
        held, done = None, 0
        for frame in frames:
            for archive, member, content in frame.itertuples(index=False):
                if held is None or held[0] != archive:
                    if held is not None:
                        held[1].close()
                        os.replace(held[2], f"{folder}/{held[0]}.zip")
                    path = f"{folder}/{uuid.uuid4().hex}.part"
                    held, done = (archive, zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED), path), done + 1
                held[1].writestr(member, content)
        if held is not None:
            held[1].close()
            os.replace(held[2], f"{folder}/{held[0]}.zip")
        yield pd.DataFrame({"n": [done]})

    return df.repartition("archive").sortWithinPartitions("archive", "member").select("archive", "member", "content").mapInPandas(run, "n long").agg(F.sum("n")).first()[0] or 0


def _recordings(spark, d) -> DataFrame:
    return numbered(spark.read.parquet(f"{d}/events.parquet"), F.col("event_type"))


def archived_channels(spark, d):
    """Samples of each type of event as CSV members of archives, by user, read back: rows, sums of both channels and labels of each member."""
    x = _recordings(spark, d).select("rec", (F.col("user_id") % 20).alias("part"), "n", F.col("value"), (F.col("value") / 4).alias("quarter"))
    member = F.concat("rec", F.lit("/"), F.when(F.col("part") % 2 == 0, F.lit("ball/")).otherwise(F.lit("")), F.lit("s"), (F.col("part") % 3).cast("string"), F.lit("/"), F.col("part").cast("string"), F.lit(".5.csv"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "value", "quarter"))), lambda s: F.concat(s["value"].cast("string"), F.lit(","), s["quarter"].cast("string"))), "\n")
    folder = _place(spark, "archives")
    zip_tables(x.groupBy(F.col("rec").alias("archive"), member.alias("member")).agg(text.alias("content")), folder)
    rows = numeric_rows(zip_members(spark, folder, suffix=".csv"), ["value", "quarter"])
    return rows.groupBy("member").agg(F.count("*").alias("rows"), F.count("error").alias("errors"), F.round(F.sum("value"), 4).alias("value"), F.round(F.sum("quarter"), 4).alias("quarter")).select(*member_labels(F.col("member")), "rows", "errors", F.col("value").alias("sum"), "quarter")


def recorded_samples(spark, d):
    """Each user's events as a recording of two channels in WAV, read back: frames, and the sums of both channels and of a slice, in steps of 1/60. Samples have 32 bits, as values beyond 546 need more than 16."""
    x = numbered(spark.read.parquet(f"{d}/events.parquet"), F.col("user_id")).select("rec", "n", F.round(F.col("value") * 60).cast("int").alias("a"), (F.col("event_id") % 1000).cast("int").alias("b"))
    folder = _place(spark, "recordings")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.makedirs(folder, exist_ok=True)
        for frame in frames:
            for rec, a, b in frame.itertuples(index=False):
                pcm = np.stack([a, b], axis=1).astype("<i4").tobytes()
                part = f"{folder}/{uuid.uuid4().hex}.part"
                with open(part, "xb") as out:
                    out.write(canonical(Wav(2, 4, 8000, pcm)))
                os.replace(part, f"{folder}/{rec}.wav")
            yield pd.DataFrame({"n": [len(frame)]})

    x.groupBy("rec").agg(F.array_sort(F.collect_list(F.struct("n", "a", "b"))).alias("v")).select("rec", "v.a", "v.b").mapInPandas(run, "n long").agg(F.sum("n")).collect()
    rec = F.regexp_extract("path", r"([0-9]+)\.wav$", 1).cast("long").alias("rec")
    total = F.round(F.sum(F.col("value") * 2.0**31)).cast("long")
    first, second = (read_samples(spark, f"file://{folder}", channel=c).groupBy(rec).agg(total.alias(f"sum_{c}")) for c in (0, 1))
    middle = read_samples(spark, f"file://{folder}", 0, 10 / 8000, 20 / 8000).groupBy(rec).agg(total.alias("middle"), F.count("*").alias("in_middle"))
    frames = audit(spark, f"file://{folder}", UPLOADS).select(rec, "frames", "reason")
    return frames.join(first, "rec", "left").join(second, "rec", "left").join(middle, "rec", "left")


def sealed_documents(spark, d):
    """Documents as lines of JSON in a sealed folder, a file for each language and source, read back: lines and characters of each file, and whether it is as the manifest says."""
    x = spark.read.parquet(f"{d}/documents.parquet")
    name = F.concat(F.lit("lang="), F.coalesce("lang", F.lit("none")), F.lit("/"), F.xxhash64("source").cast("string"), F.lit(".jsonl"))
    folder = _place(spark, "sealed")
    write_sealed(x.select(name.alias("file"), F.to_json(F.struct("doc_id", "lang", "source", "n_chars")).alias("line"), "doc_id"), folder, ["doc_id"])
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").text(f"file://{folder}").select(F.from_json("value", "doc_id long, lang string, source string, n_chars long").alias("r"), F.regexp_extract(F.col("_metadata.file_path"), r"(lang=[^/]*/[^/]*)$", 1).alias("file"))
    held = lines.groupBy("file").agg(F.min("r.lang").alias("lang"), F.min("r.source").alias("source"), F.count("*").alias("rows"), F.sum("r.n_chars").alias("chars"))
    return held.join(verify_sealed(spark, folder).select("file", "status"), "file", "full").select("lang", "source", "rows", "chars", "status")


SQL = {
    "archived_channels": """WITH x AS (SELECT event_type AS rec, user_id % 20 AS part, value FROM events)
SELECT rec AS family, CASE WHEN part % 2 = 0 THEN 'ball' END AS position, 's' || (part % 3) AS severity, part || '.5' AS value, count(*) AS rows, CAST(0 AS BIGINT) AS errors, round(sum(x.value), 4) AS sum, round(sum(x.value / 4), 4) AS quarter FROM x GROUP BY rec, part""",
    "recorded_samples": """WITH x AS (SELECT user_id AS rec, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n, CAST(round(value * 60) AS INTEGER) AS a, event_id % 1000 AS b FROM events)
SELECT rec, count(*) AS frames, CAST(NULL AS VARCHAR) AS reason, sum(a)::BIGINT AS sum_0, sum(b)::BIGINT AS sum_1, (sum(a) FILTER (n >= 10 AND n < 30))::BIGINT AS middle, nullif(count(*) FILTER (n >= 10 AND n < 30), 0) AS in_middle FROM x GROUP BY rec""",
    "sealed_documents": "SELECT lang, source, count(*) AS rows, sum(n_chars)::BIGINT AS chars, 'ok' AS status FROM documents GROUP BY 1, 2",
}
QUERIES = {n: globals()[n] for n in SQL}
