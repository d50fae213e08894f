"""Attempts as files: sound ones come back, and each kind of damage is named."""

import glob
import hashlib
import os
import shutil

import pytest
from pyspark.sql import DataFrameReader, Row
from pyspark.sql import functions as F

from granary.sources import attempts as S


def test_round_trip_and_damage(spark, tmp_path):
    events = spark.createDataFrame([(a, i, "send" if i % 2 else "receive", f"line {i} é\n of {a}" if i else None, i * 10) for a in (1, 2, 30) for i in range(5)], S.EVENT).repartition(4)
    records = spark.createDataFrame([(1, "ok"), (2, None), (30, "mate")], "attempt long, status string")
    first = str(tmp_path / "first")
    S.write_attempts(records, events, first)
    found, again = S.read_attempts(spark, first, "status string")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, records.collect()))
    assert sorted(map(str, again.select(*events.columns).collect())) == sorted(map(str, events.collect()))

    def damaged(name, change):
        path = str(tmp_path / name)
        shutil.copytree(first, path)
        for crc in glob.glob(f"{path}/**/.*.crc", recursive=True):
            os.remove(crc)
        change(path)
        with pytest.raises(ValueError, match=name):
            S.read_attempts(spark, path, "status string")

    log = lambda path: glob.glob(f"{path}/raw/attempt=2/part-*")[0]

    def grow(path):
        with open(log(path), "a") as f:
            f.write("{}\n")

    damaged("changed", grow)
    damaged("no_log", lambda path: shutil.rmtree(f"{path}/raw/attempt=2"))
    damaged("several_logs", lambda path: shutil.copy(log(path), log(path).replace("part-", "part-x")))
    damaged("stray", lambda path: shutil.copytree(f"{path}/raw/attempt=2", f"{path}/raw/attempt=77"))
    damaged("repeated", lambda path: spark.read.json(f"{first}/records").where("attempt = 2").write.mode("append").json(f"{path}/records"))
    odd = spark.createDataFrame([(None, 1, "x"), (5, None, None)], f"attempt bigint, {S.LOG}")
    files = spark.createDataFrame([(5, 1, 3, "x"), (None, 1, 3, "x")], "attempt long, files long, bytes long, sha256 string")
    assert sorted((r.attempt or -1, r.fault) for r in S.faults(odd, files).collect()) == [(-1, "stray"), (-1, "stray"), (5, "changed")]
    assert S.faults(odd.where(F.lit(False)), files.where(F.lit(False))).count() == 0


def test_attempt_folders_are_listed_once(spark, tmp_path, monkeypatch):
    """Folders of logs, one an attempt, are listed when they are read, not when they are written; recorded hashes are the files'."""
    listed = []
    for name in ("load", "json"):
        plain = getattr(DataFrameReader, name)
        monkeypatch.setattr(DataFrameReader, name, lambda self, path, *a, plain=plain, **k: (listed.append(path), plain(self, path, *a, **k))[1])
    rows = [(a, i, "send", f"é {i}" if i % 3 else None, None) for a in (1, 2, -30, None) for i in (2, 1, 1, 10)]
    path = str(tmp_path / "attempts")
    S.write_attempts(spark.createDataFrame([(1, "a"), (2, "b"), (-30, "c"), (4, "d")], "attempt long, status string"), spark.createDataFrame(rows, S.EVENT).repartition(5), path)
    assert f"{path}/raw" not in listed
    files = {a: (hashlib.sha256(data).hexdigest(), len(data)) for a in (1, 2, -30) for data in [open(glob.glob(f"{path}/raw/attempt={a}/part-*")[0], "rb").read()]}
    assert {r.attempt: (r.log_sha256, r.log_bytes) for r in spark.read.schema(f"attempt long, {S.LOG}").json(f"{path}/records").collect()} == files | {4: (None, None)}
    shutil.rmtree(glob.glob(f"{path}/raw/attempt=__HIVE*")[0])
    spark.read.json(f"{path}/records").where("attempt <> 4").write.json(f"{path}/sound/records")
    shutil.move(f"{path}/raw", f"{path}/sound/raw")
    records, events = S.read_attempts(spark, f"{path}/sound", "status string")
    assert listed.count(f"{path}/sound/raw") == 1 and records.count() == 3
    assert sorted(map(str, events.collect())) == sorted(str(Row(**dict(zip(("attempt", "seq", "direction", "line", "offset_ns"), r)))) for r in rows if r[0])
