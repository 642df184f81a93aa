"""WAV recordings and the tables that come with them, read as DataFrames.

Files are read by Spark's binary source, one row a file, so a scan is dealt to all tasks; a file that fails its checks is a row with a reason, not a failed job.
"""

from __future__ import annotations

import hashlib
import io
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Limits of a file, and the samples that leave a task in one batch.
MOST_BYTES, MOST_CHANNELS, BATCH_SAMPLES = 2_000_000_000, 64, 1_000_000
PCM, EXTENSIBLE = 1, 0xFFFE


@dataclass(frozen=True)
class Wav:
    channels: int
    width: int
    rate: int
    pcm: bytes

    @property
    def frames(self) -> int:
        return len(self.pcm) // (self.channels * self.width)


@dataclass(frozen=True)
class Limits:
    """What a reader takes beside whole files: bytes, channels, samples a second, seconds, and whether the extensible format counts as PCM."""

    most_bytes: int = MOST_BYTES
    channels: int = MOST_CHANNELS
    rates: tuple[int, int] = (1, 2**32 - 1)
    seconds: float = float("inf")
    extensible: bool = True


#: Anything whole; and what uploads are held to: plain PCM of one or two channels, 8 to 192 kHz, two minutes at most.
ANY, UPLOADS = Limits(), Limits(128_000_000, 2, (8_000, 192_000), 120.0, False)


def parse_wav(data: bytes, limits: Limits = ANY) -> Wav:
    """The PCM of a RIFF/WAVE file with one `fmt ` chunk before one `data` chunk and exact lengths, within limits; ValueError says what is wrong."""
    if len(data) > limits.most_bytes:
        raise ValueError("too large")
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("no RIFF/WAVE header")
    if struct.unpack("<I", data[4:8])[0] != len(data) - 8:
        raise ValueError("RIFF length is wrong")
    at, form, pcm = 12, None, None
    while at < len(data):
        if at + 8 > len(data):
            raise ValueError("chunk header is cut")
        name, size = struct.unpack("<4sI", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if len(body) < size:
            raise ValueError("chunk is cut")
        if name == b"fmt ":
            if form is not None or pcm is not None or size < 16:
                raise ValueError("one whole fmt chunk must come first")
            form = struct.unpack("<HHIIHH", body[:16])
            if form[0] == EXTENSIBLE and size >= 40 and limits.extensible:
                form = (struct.unpack("<H", body[24:26])[0], *form[1:])
        elif name == b"data":
            if form is None or pcm is not None:
                raise ValueError("one data chunk must follow the fmt chunk")
            pcm = body
        at += 8 + size + size % 2
    if form is None or pcm is None:
        raise ValueError("no fmt or data chunk")
    kind, channels, rate, byte_rate, align, bits = form
    if kind != PCM or bits not in (8, 16, 24, 32):
        raise ValueError("no integer PCM")
    if not 1 <= channels <= MOST_CHANNELS or rate < 1 or align != channels * bits // 8 or byte_rate != rate * align:
        raise ValueError("fmt contradicts itself")
    if not pcm or len(pcm) % align:
        raise ValueError("no whole frames")
    if channels > limits.channels or not limits.rates[0] <= rate <= limits.rates[1] or len(pcm) > limits.seconds * rate * align:
        raise ValueError("beyond the limits")
    return Wav(channels, bits // 8, rate, bytes(pcm))


def canonical(wav: Wav) -> bytes:
    """The same samples with a plain header and nothing else."""
    align = wav.channels * wav.width
    pad = len(wav.pcm) % 2
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(wav.pcm) + pad, b"WAVE", b"fmt ", 16, PCM, wav.channels, wav.rate, wav.rate * align, align, 8 * wav.width, b"data", len(wav.pcm))
    return head + wav.pcm + b"\0" * pad


def samples_of(wav: Wav, channel: int, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Samples of one channel, -1 to 1, from one frame up to another."""
    if not 0 <= channel < wav.channels:
        raise ValueError("no such channel")
    raw = np.frombuffer(wav.pcm, np.uint8).reshape(wav.frames, wav.channels, wav.width)[start:stop, channel]
    if wav.width == 1:
        return (raw[:, 0].astype(np.float64) - 128) / 128
    wide = np.zeros((len(raw), 4), np.uint8)
    wide[:, 4 - wav.width :] = raw
    return wide.view("<i4")[:, 0] / 2.0**31


def _files(spark: SparkSession, path: str, pattern: str = "*.wav") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "content")


def _tried(content: bytes, limits: Limits = ANY) -> tuple[Wav | None, str | None]:
    try:
        return parse_wav(content, limits), None
    except ValueError as e:
        return None, str(e)


_AUDIT = {"path": "string", "reason": "string", "channels": "int", "width": "int", "rate": "int", "frames": "long", "pcm_sha256": "string", "peak": "double", "constant": "boolean"}


def audit(spark: SparkSession, path: str, limits: Limits = ANY) -> DataFrame:
    """A row for each file under path: its format, content digest and peak, or the reason why it is refused."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
        for batch in batches:
            rows = []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                wav, reason = _tried(content.as_py(), limits)
                row = dict.fromkeys(_AUDIT) | {"path": name, "reason": reason}
                if wav:
                    ends = [(s.min(), s.max()) for s in (samples_of(wav, c) for c in range(wav.channels))]
                    row |= {"channels": wav.channels, "width": wav.width, "rate": wav.rate, "frames": wav.frames, "pcm_sha256": hashlib.sha256(wav.pcm).hexdigest(), "peak": float(max(max(-a, b) for a, b in ends)), "constant": all(a == b for a, b in ends)}
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([(c, types[t]) for c, t in _AUDIT.items()]))

    return _files(spark, path).mapInArrow(run, ", ".join(f"{c} {t}" for c, t in _AUDIT.items()))


def read_samples(spark: SparkSession, path: str, channel: int = 0, start_seconds: float = 0.0, seconds: float | None = None) -> DataFrame:
    """(path, rate, n, value) of one channel and time slice of every sound file; refused files, and files without the channel, have no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                wav, _ = _tried(content.as_py())
                if wav is None or channel >= wav.channels:
                    continue
                start = round(start_seconds * wav.rate)
                v = samples_of(wav, channel, start, None if seconds is None else start + round(seconds * wav.rate))
                for at in range(0, len(v), BATCH_SAMPLES):
                    part = v[at : at + BATCH_SAMPLES]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(np.full(len(part), wav.rate, np.int32)), pa.array(np.arange(at, at + len(part), dtype=np.int64)), pa.array(part)], ["path", "rate", "n", "value"])

    return _files(spark, path).mapInArrow(run, "path string, rate int, n long, value double")


def scan_manifest(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """Files under path against a manifest (file, sample_id, group_id, partition), file being the path within the folder: a status for each of either.

    `ok`, `missing` file, `extra` file, `refused` by its checks, `repeated` id or content, or `leaking`: its group or content lies in two partitions."""
    root = path.split(":", 1)[-1].rstrip("/").lstrip("/")
    found = audit(spark, path).withColumn("file", F.replace(F.regexp_replace(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), "^[a-z]+:/*|^/+", ""), F.lit(root + "/"), F.lit("")))
    both = manifest.join(found, "file", "full")
    for name, key, what in (("ids", "sample_id", F.lit(1)), ("copies", "pcm_sha256", F.lit(1)), ("group_parts", "group_id", F.col("partition")), ("copy_parts", "pcm_sha256", F.col("partition"))):
        counted = both.filter(F.col(key).isNotNull()).groupBy(key).agg((F.count("*") if name in ("ids", "copies") else F.countDistinct(what)).alias(name))
        both = both.join(counted, key, "left")
    status = F.when(F.col("path").isNull(), "missing").when(F.col("sample_id").isNull(), "extra").when(F.col("reason").isNotNull(), "refused").when((F.col("group_parts") > 1) | (F.col("copy_parts") > 1), "leaking").when((F.col("ids") > 1) | (F.col("copies") > 1), "repeated").otherwise("ok")
    return both.select("file", "sample_id", "group_id", "partition", "pcm_sha256", "reason", status.alias("status"))


def support_set(scanned: DataFrame, labels: DataFrame) -> DataFrame:
    """One labelled example of each class, of the least content digest, from rows of `scan_manifest` that are ok; labels is (sample_id, label)."""
    x = scanned.filter("status = 'ok'").join(labels, "sample_id")
    return x.groupBy("label").agg(F.min(F.struct("pcm_sha256", "sample_id", "group_id")).alias("e")).select("label", "e.*")


def media_store(spark: SparkSession, path: str) -> DataFrame:
    """(sha256, content, paths): each distinct sound file once, canonical, by the digest of its bytes. Written as Parquet it is a store without repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [(name, canonical(wav)) for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) if (wav := _tried(content.as_py())[0])]
            yield pa.RecordBatch.from_arrays([pa.array([hashlib.sha256(c).hexdigest() for _, c in made], pa.string()), pa.array([n for n, _ in made], pa.string()), pa.array([c for _, c in made], pa.binary())], ["sha256", "path", "content"])

    files = _files(spark, path).mapInArrow(run, "sha256 string, path string, content binary")
    return files.groupBy("sha256").agg(F.min("path").alias("path"), F.count("*").alias("copies"), F.any_value("content").alias("content"))


def read_rpm(spark: SparkSession, path: str, until_seconds: float) -> DataFrame:
    """(path, time_seconds, rpm, status) of speed traces in CSV: `ok` where times rise strictly, speeds are positive and the trace reaches from 0 to until_seconds."""
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split(F.trim("value"), r"\r?\n")).alias("place", "line")).filter("place > 0 and trim(line) <> ''")
    cell = F.split("line", ",")
    x = lines.select("path", "place", F.get(cell, F.lit(0)).try_cast("double").alias("time_seconds"), F.get(cell, F.lit(1)).try_cast("double").alias("rpm"))
    step = F.col("time_seconds") - F.lag("time_seconds").over(Window.partitionBy("path").orderBy("place"))
    bad = F.col("time_seconds").isNull() | F.col("rpm").isNull() | (F.col("rpm") <= 0) | F.coalesce(step <= 0, F.lit(False))
    ends = x.withColumn("bad", bad).groupBy("path").agg(F.bool_or("bad").alias("bad"), F.min("time_seconds").alias("a"), F.max("time_seconds").alias("b"))
    status = F.when(F.col("bad"), "unordered").when((F.col("a") > 0) | (F.col("b") < until_seconds), "short").otherwise("ok")
    return x.join(ends, "path").select("path", "time_seconds", "rpm", status.alias("status"))


def read_arrays(spark: SparkSession, path: str, column: str) -> DataFrame:
    """(path, n, value) of one array of every .npz file under path; files without it have no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                with np.load(io.BytesIO(content.as_py()), allow_pickle=False) as z:
                    v = z[column].astype(np.float64).ravel() if column in z else np.empty(0)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(v), pa.string()), pa.array(np.arange(len(v), dtype=np.int64)), pa.array(v)], ["path", "n", "value"])

    return _files(spark, path, "*.npz").mapInArrow(run, "path string, n long, value double")
