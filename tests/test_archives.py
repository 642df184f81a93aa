"""ZIP members as rows, and folders that are sealed as a whole or not at all."""

import hashlib
import json
import os
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from cadenza.sources import archives as A
from cadenza.sources import sealed as S


@pytest.fixture()
def folder(tmp_path):
    with zipfile.ZipFile(tmp_path / "one.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for i in range(7):
            z.writestr(f"normal/{i}.5.csv", f"{i},1.5\n{i},-2e3\n")
        z.writestr("overhang/ball/20g/13.csv", "1,2,3\r\nx,2\n\n4,5\n")
        z.writestr("empty/", "")
    with zipfile.ZipFile(tmp_path / "two.zip", "w", zipfile.ZIP_STORED) as z:
        z.writestr("a.csv", "7,8\n")
        z.writestr("b.csv", "unspoilt")
    data = bytearray((tmp_path / "two.zip").read_bytes())
    at = data.index(b"unspoilt")
    data[at : at + 2] = b"zz"
    (tmp_path / "two.zip").write_bytes(data)
    (tmp_path / "three.zip").write_bytes(b"no archive")
    (tmp_path / "four.txt").write_text("another kind")
    return tmp_path


def test_members_and_errors(spark, folder):
    x = A.zip_members(spark, str(folder), part_bytes=30)
    assert x.rdd.getNumPartitions() > 3
    rows = {(os.path.basename(r.archive), r.member): r for r in x.collect()}
    assert len(rows) == 11 and rows["three.zip", None].error == "no directory"
    assert rows["two.zip", "b.csv"].error == "BadZipFile" and rows["two.zip", "b.csv"].content is None and rows["two.zip", "a.csv"].content == b"7,8\n"
    assert rows["one.zip", "normal/3.5.csv"].crc32 == zlib.crc32(b"3,1.5\n3,-2e3\n")
    assert A.zip_members(spark, f"file://{folder}/two.zip").count() == 2


def test_names_are_chosen_by_the_directory(spark, folder):
    some = A.zip_members(spark, str(folder), "normal/", "5.csv", part_bytes=30)
    # two members of 16 packed bytes a partition, and the archive without a directory
    assert some.filter("error is null").count() == 7 and some.rdd.getNumPartitions() == 5
    x = A.zip_members(spark, str(folder), part_bytes=30)
    # what one query asks for doesn't stay for the next one
    assert [r.member for r in x.filter("member in ('a.csv', 'c.csv')").collect()] == ["a.csv"] and x.filter("member = 'none'").count() == 0 and x.count() == 11
    assert A.zip_members(spark, str(folder / "two.zip"), "z").collect() == []


def test_tables_of_numbers_and_labels(spark, folder):
    x = A.numeric_rows(A.zip_members(spark, str(folder / "one.zip")), ["u", "v"])
    bad = {r.n: (r.u, r.v, r.error) for r in x.filter("member like 'overhang%'").collect()}
    assert bad == {0: (None, None, "cells"), 1: (None, None, "number"), 2: (None, None, "cells"), 3: (4, 5, None)}
    assert x.filter("error is null and member like 'normal%'").agg(F.sum("u"), F.sum("v")).first()[:] == (42, 7 * -1998.5)
    names = spark.createDataFrame([("normal/12.288.csv",), ("imbalance/6g/13.csv",), ("overhang/ball/20g/13.csv",)], "m string").select(*A.member_labels(F.col("m")))
    assert [tuple(r) for r in names.collect()] == [("normal", None, None, "12.288"), ("imbalance", None, "6g", "13"), ("overhang", "ball", "20g", "13")]


def lines(spark, n=60):
    return spark.range(n).select(F.concat(F.lit("part/"), (F.col("id") % 4).cast("string"), F.lit(".jsonl")).alias("file"), F.to_json(F.struct("id")).alias("line"), "id")


def test_sealed_folder(spark, tmp_path):
    path = str(tmp_path / "out")
    S.write_sealed(lines(spark), path, ["id"])
    files = json.load(open(f"{path}/manifest.json"))["files"]
    assert set(files) == {f"part/{k}.jsonl" for k in range(4)} and os.listdir(tmp_path) == ["out"]
    want = "".join(f'{{"id":{i}}}\n' for i in range(1, 60, 4)).encode()
    assert open(f"{path}/part/1.jsonl", "rb").read() == want and files["part/1.jsonl"] == {"bytes": len(want), "sha256": hashlib.sha256(want).hexdigest()}
    assert {r.status for r in S.verify_sealed(spark, path).collect()} == {"ok"}
    open(f"{path}/part/1.jsonl", "ab").write(b"more")
    os.remove(f"{path}/part/2.jsonl")
    open(f"{path}/new", "w").write("x")
    assert {r.file: r.status for r in S.verify_sealed(spark, path).collect()} == {"part/0.jsonl": "ok", "part/1.jsonl": "changed", "part/2.jsonl": "missing", "part/3.jsonl": "ok", "new": "extra"}


def test_nothing_is_seen_of_what_failed_and_nothing_is_replaced(spark, tmp_path):
    path = str(tmp_path / "out")
    failing = lines(spark).withColumn("line", F.when(F.col("id") == 59, F.raise_error(F.lit("lost"))).otherwise(F.col("line")))
    with pytest.raises(Exception, match="lost"):
        S.write_sealed(failing, path, ["id"])
    assert os.listdir(tmp_path) == []
    for name in ("../x", "/x", "manifest.json", ""):
        with pytest.raises(Exception, match="can't be the name"):
            S.write_sealed(lines(spark, 3).withColumn("file", F.lit(name)), path, ["id"])
    assert os.listdir(tmp_path) == []
    S.write_sealed(lines(spark, 3), path, ["id"])
    with pytest.raises(Exception, match="folder is there"):
        S.write_sealed(lines(spark, 5), path, ["id"])
    with pytest.raises(Exception, match="never overwritten"):
        lines(spark, 5).select("file", "line").write.format("sealed").mode("overwrite").save(path)
    assert json.load(open(f"{path}/manifest.json"))["files"].keys() == {"part/0.jsonl", "part/1.jsonl", "part/2.jsonl"}
    # no rows: a manifest of nothing
    S.write_sealed(lines(spark, 0), str(tmp_path / "none"), ["id"])
    assert json.load(open(tmp_path / "none" / "manifest.json")) == {"files": {}}
